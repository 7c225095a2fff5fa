"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from signalspark.llm.textmap import with_text_columns

#: N-gram lengths in characters; longer ones tell closer languages apart, at more cost.
LENGTHS = (1, 2, 3)
BUCKETS = 1 << 16
#: Characters handled at once, so that the arrays of a batch stay within some 50 MB.
SLICE = 1 << 19
NONE = "und"


@functools.lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def slices(texts: Sequence[str | None], size: int = SLICE):
    """Lists of (row, piece) of about ``size`` characters; long texts are cut, at a blank if there is one."""
    batch, chars = [], 0
    for row, text in enumerate(texts):
        text = text or ""
        at = 0
        while at < len(text):
            end = min(len(text), at + size - chars)
            if end < len(text):
                end = (text.rfind(" ", at + 1, end) + 1) or end
            batch.append((row, text[at:end]))
            chars += end - at
            at = end
            if chars >= size - 64:
                yield batch
                batch, chars = [], 0
    if batch:
        yield batch


def ngrams(pieces: Sequence[tuple[int, str]], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of pieces: (buckets, rows), rows ascending.

    Letters in lower case; each run of other characters is one blank, and a blank
    stands before and after each piece.  N-grams lie in a word with its blanks.
    """
    parts = [f" {p.lower()} " for _, p in pieces]
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    row = np.repeat(np.array([r for r, _ in pieces]), [len(p) for p in parts])
    edge = np.zeros(len(code), bool)
    edge[np.cumsum([0, *(len(p) for p in parts[:-1])])] = True
    letter = letters()[code]
    stay = letter | edge
    stay[1:] |= letter[:-1]
    code = np.where(letter, code, 32)[stay].astype(np.uint64)
    row, letter = row[stay], letter[stay]
    found, rows = [], []
    for n in LENGTHS:
        m = len(code) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + code[i : i + m]
        inner = letter[:m].copy() if n == 1 else letter[1 : m + 1].copy() if n > 2 else letter[:m] | letter[1 : m + 1]
        for i in range(2, n - 1):
            inner &= letter[i : i + m]
        h = h[inner]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        found.append((h >> np.uint64(32)).astype(np.int64) % buckets)
        rows.append(row[:m][inner])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(np.concatenate(rows), kind="stable")
    return np.concatenate(found)[order], np.concatenate(rows)[order]


class Model:
    """Languages, log prior and the (buckets x languages) matrix of log probabilities."""

    def __init__(self, langs: list[str], docs: np.ndarray, counts: np.ndarray, alpha: float = 0.5) -> None:
        self.langs = langs
        self.prior = np.log(docs / docs.sum()) if len(langs) else docs
        total = counts.sum(axis=0, keepdims=True) + alpha * len(counts)
        self.matrix = np.log((counts + alpha) / total).astype(np.float32)

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        total = np.zeros((len(texts), len(self.langs)))
        seen = np.zeros(len(texts), bool)
        for batch in slices(texts):
            bucket, row = ngrams(batch, len(self.matrix))
            if not len(bucket):
                continue
            first = np.flatnonzero(np.diff(row, prepend=-1))
            for k in range(len(self.langs)):
                total[row[first], k] += np.add.reduceat(self.matrix[bucket, k], first, dtype=np.float64)
            seen[row[first]] = True
        if not self.langs:
            return [NONE] * len(texts), [0.0] * len(texts)
        total += self.prior
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return (
            [self.langs[b] if s else NONE for b, s in zip(best, seen, strict=True)],
            np.where(seen, score, 0.0).tolist(),
        )


def train(
    documents: DataFrame,
    rows: Column,
    docs_per_lang: int = 5000,
    max_langs: int = 1000,
    buckets: int = BUCKETS,
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
) -> Model:
    """Count n-grams of the labelled ``rows``.

    The model is fitted on about ``docs_per_lang`` documents of each language,
    chosen by a hash of the id (all of them where there are fewer); counts add
    up in Spark.  Ties between languages go to the first by name.  More than
    ``max_langs`` languages are an error: the matrix would not fit a broadcast.
    """
    known = documents.filter(rows & F.col(lang).isNotNull()).select(
        F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")
    )
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_langs + 1).collect()}
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros(0), np.zeros((buckets, 0)))
    scale = 1 << 30
    share = F.coalesce(
        *[F.when(F.col("lang") == x, F.lit(min(scale, scale * docs_per_lang // sizes[x]))) for x in langs]
    )
    # rows without an id are told apart by their text
    draw = F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64(F.col("id").cast("string")))
    sample = known.filter(F.pmod(draw, F.lit(scale)) < share)
    index = {x: i for i, x in enumerate(langs)}

    def count(batches):
        seen = np.zeros((len(langs), buckets), np.int64)
        for b in batches:
            owner = np.array([index[x] for x in b.column(0).to_pylist()], np.int64)
            for batch in slices(b.column(1).to_pylist()):
                bucket, row = ngrams(batch, buckets)
                seen += np.bincount(owner[row] * buckets + bucket, minlength=seen.size).reshape(seen.shape)
        k, j = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(j, pa.int32()), pa.array(seen[k, j])], ["lang", "bucket", "n"])

    counts = np.zeros((buckets, len(langs)))
    got = (
        sample.select("lang", "text").mapInArrow(count, "lang int, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    counts[got["bucket"], got["lang"]] = got["n"]
    return Model(langs, np.array([sizes[x] for x in langs], float), counts)


def predict(documents: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` (a learned language, or ``und``) and ``score`` (its posterior, 0 to 1).

    A null text, one without letters, and any text under a model without
    languages are ``und`` with score 0.  Repeated rows get equal answers; an
    empty table stays empty; columns of these names are replaced.  The model
    (buckets x languages floats) is broadcast; no shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return with_text_columns(documents, lambda: shared.value.predict, "lang_pred string, score double", text, keep)
