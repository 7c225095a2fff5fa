"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from signalspark.llm.textmap import with_text_columns

BUCKETS = 1 << 18
#: Labelled documents that the model is fitted on, at most about; chosen by a hash of the id.
SAMPLE = 16_384
SHARDS = 8
WORD_N, SHAPE_N = (1, 2), (1, 2, 3)
#: Words of a text that are turned into features at once.
SLICE = 1 << 18
_CLASSES = ((re.compile(r"[^\W\d_]+"), lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a"), (re.compile(r"\d+"), lambda m: "0"))
_AGAIN = re.compile(r"(.)\1+", re.S)


def shape(word: str) -> str:
    """Kind of a word: runs of letters as ``a`` (``A`` if upper case), of digits as ``0``, other characters once."""
    for rule, to in _CLASSES:
        word = rule.sub(to, word)
    return _AGAIN.sub(r"\1", word)


class Words(dict):
    """Place of each word in the arrays of word and shape hashes; emptied when full."""

    limit = 1 << 18

    def __init__(self) -> None:
        super().__init__()
        self.hashes = np.zeros((2, self.limit), np.uint64)

    def __missing__(self, word: str) -> int:
        at = len(self)
        self.hashes[0, at] = xxhash.xxh3_64_intdigest(word.lower())
        self.hashes[1, at] = xxhash.xxh3_64_intdigest(shape(word), seed=1)
        self[word] = at
        return at

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) + len(words) > self.limit:
            self.clear()
        return self.hashes[:, np.fromiter(map(self.__getitem__, words), np.int64, len(words))]


def features(text: str | None, seen: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text: counts of hashed word and shape n-grams, to length 1.

    A word that repeats the one before it has another shape.
    """
    words = (text or "").split()
    found = []
    for at in range(0, len(words), SLICE):
        part = seen.of(words[at : at + SLICE])
        w, s = part
        s = s.copy()
        s[1:][w[1:] == w[:-1]] ^= np.uint64(0x5851F42D4C957F2D)
        for kind, (h, lengths) in enumerate(((w, WORD_N), (s, SHAPE_N))):
            for n in lengths:
                if len(h) >= n:
                    x = np.full(len(h) - n + 1, 8 * kind + n, np.uint64)
                    for i in range(n):
                        x = (x ^ h[i : i + len(x)]) * np.uint64(0x9E3779B97F4A7C15)
                        x ^= x >> np.uint64(29)
                    found.append((x & np.uint64(BUCKETS - 1)).astype(np.int64))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    bucket, counts = np.unique(np.concatenate(found), return_counts=True)
    value = np.log1p(counts)
    return bucket, value / np.sqrt((value**2).sum())


class Ftrl:
    """Follow the regularised leader, per coordinate; the bias is the last one and isn't regularised."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(self, at) -> np.ndarray:
        z, l1 = self.z[at], np.where(np.asarray(at) == BUCKETS, 0.0, self.l1)
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / rate)

    def learn(self, bucket: np.ndarray, value: np.ndarray, label: int) -> None:
        at, x = np.append(bucket, BUCKETS), np.append(value, 1.0)
        w = self.weights(at)
        gradient = (sigmoid(w @ x) - label) * x
        old = np.sqrt(self.n[at])
        self.n[at] += gradient**2
        self.z[at] += gradient - (np.sqrt(self.n[at]) - old) / self.alpha * w


def sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(
    documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, shards: int = SHARDS, epochs: int = 3,
    doc_id: str = "doc_id", text: str = "text", label: str = "quality",
) -> np.ndarray:
    """Weights of every bucket and the bias, from ``labels`` (doc_id, 0 or 1).

    At most about ``sample`` labelled documents are used, chosen by a hash of
    the id; where an id has several labels, the largest.  ``shards`` groups of
    them are trained apart and their weights averaged in Spark, so no task sees
    more than sample / shards documents.  Without labels all weights are 0.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    known = known.groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.max(label).cast("int").alias("label"))
    count, scale = known.count(), 1 << 30
    if not count:
        return np.zeros(BUCKETS + 1)
    mix = F.pmod(F.xxhash64("id"), F.lit(scale))
    known = known.filter(mix < min(scale, scale * sample // count)).withColumn("shard", (F.xxhash64("id", F.lit(7)) % shards).cast("int"))
    # the chosen labels are bounded by ``sample``: some 0.3 MB
    x = documents.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(known), "id")

    def task():
        seen = Words()

        def run(texts):
            found = [features(t, seen) for t in texts]
            return [b.astype(np.int32) for b, _ in found], [v.astype(np.float32) for _, v in found]

        return run

    x = with_text_columns(x, task, "bucket array<int>, value array<float>", "text", ["id", "label", "shard"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        model = Ftrl()
        rows = [(np.asarray(b), np.asarray(v, float), y) for b, v, y in zip(pdf["bucket"], pdf["value"], pdf["label"], strict=True)]
        order = np.argsort([xxhash.xxh3_64_intdigest(str(i)) for i in pdf["id"]], kind="stable")
        for _ in range(epochs):
            for i in order:
                model.learn(*rows[i])
        w = model.weights(np.arange(BUCKETS + 1))
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": at, "w": w[at], "groups": 1})

    fitted = x.groupBy("shard").applyInPandas(fit, "at long, w double, groups int")
    got = fitted.groupBy("at").agg(F.sum("w").alias("w"), F.sum("groups").alias("n")).toPandas()
    weights = np.zeros(BUCKETS + 1)
    # every shard has a bias, so its count is the number of shards that had documents
    weights[got["at"]] = got["w"] / max(1, got["n"].max() if len(got) else 1)
    return weights


def score(
    documents: DataFrame, weights: np.ndarray, text: str = "text", keep: Sequence[str] | None = None, good: float = 0.7
) -> DataFrame:
    """Add ``score`` (0 to 1, higher: the label is likelier) and ``predicted`` (1 from ``good`` on).

    Whole texts as sparse dot products; a null or empty text, or one without
    words, gets the score of the bias.  Repeated rows get equal scores; an empty
    table stays empty; columns of these names are replaced.  The weights (2 MB)
    are broadcast; no shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(weights)

    def task():
        seen, w = Words(), shared.value

        def run(texts):
            scores = []
            for t in texts:
                bucket, value = features(t, seen)
                scores.append(float(sigmoid(w[bucket] @ value + w[BUCKETS])))
            return scores, [int(s >= good) for s in scores]

        return run

    return with_text_columns(documents, task, "score double, predicted int", text, None if keep is None else list(keep))
