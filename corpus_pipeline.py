"""Corpus pipeline: documents to token ids, one stage after another.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir),
works on all that its predecessor kept, and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``documents``, in their order.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from signalspark.llm import bpe, decontaminate, exact_dedup, langid, ngram_join
from signalspark.llm.tables import store

#: Least posterior probability of a document's language.
SURE = 0.5
#: Bytes of rows that Spark sends to a Python worker at once; texts may be long.
BATCH = "8m"


def bounded(stage):
    """The stage with small batches for Python; rows and results are the same."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        return stage(spark, docs, sf_dir)

    return run_stage


@bounded
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters, without text, or of no clear language.

    The model learns from the stage's own labelled documents; where none has a
    label, only what has no letters can be told, and nothing else is dropped.
    """
    model = langid.train(docs, F.lit(True))
    columns = docs.columns
    names = [f"c{i}" for i in range(len(columns))]
    x = langid.predict(docs.toDF(*names), model, names[columns.index("text")])
    ok = (F.col("lang_pred") != langid.NONE) & (F.col("score") >= SURE)
    if not model.langs:
        ok = F.coalesce(F.col(names[columns.index("text")]).rlike(r"\p{L}"), F.lit(False))
    return x.filter(ok).select(*names).toDF(*columns)


@bounded
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space, keep the row with the smallest doc_id."""
    return exact_dedup.without_copies(docs)


@bounded
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles, keep the one with the smallest doc_id."""
    return ngram_join.without_near_copies(docs)


@bounded
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with ten or more words in a row of a benchmark item (all words of a shorter one)."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    names = [f"c{i}" for i in range(len(docs.columns))]
    x = decontaminate.find_leaks(docs.toDF(*names), benchmark.withColumnRenamed("text", names[docs.columns.index("text")]), text=names[docs.columns.index("text")])
    return x.filter("not contaminated").select(*names).toDF(*docs.columns)


@bounded
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, hashes of the ids and of the bytes they decode to, and the ids."""
    return bpe.encode_documents(docs, keep=["doc_id"], with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("byte_bpe", encode),
]

#: Language ID and byte-level BPE have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
