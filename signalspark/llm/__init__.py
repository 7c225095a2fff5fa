"""Operators of a training-data pipeline: text cleaning, deduplication, tokens, archives."""
