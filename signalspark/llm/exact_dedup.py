"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Each chunk (a task's share of the input) fingerprints its normalised texts.
2. It sends each owner of a fingerprint range its distinct fingerprints, sorted
   and Golomb-coded: some 30 bits each, and a text that fills a third of the
   table once per chunk.
3. Owners answer each chunk with a bitmap of the fingerprints seen elsewhere.
4. Only suspects' texts are shuffled; whole texts are compared by grouping on
   their bytes, combined before the shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from signalspark.llm import golomb
from signalspark.llm.tables import keep_rows, partitions, remove, store
from signalspark.llm.textmap import with_text_columns

BITS = 48
SPAN = 1 << BITS
#: Fingerprints that one owner may hold at most, on average.
OWNED = 1 << 22
#: The suspects' filter has so many bits at any size of input (8 MB); where it fills up, more texts are shuffled.
FILTER_BITS = 1 << 26
_SPACE = b" \t\n\r\x0b\x0c"


def normalise(text: bytes | None) -> bytes:
    """Each run of blanks, tabs and line ends as one blank; null as empty."""
    if not text:
        return b""
    body = b" ".join(text.split())
    if not body:
        return b" "
    return b" " * (text[0] in _SPACE) + body + b" " * (text[-1] in _SPACE)


def fingerprint(body: bytes) -> int:
    return xxhash.xxh3_64_intdigest(body) >> (64 - BITS)


def fingerprints(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, row (unique), chunk, fp, sha (32 bytes) of every row."""

    def task():
        def run(texts):
            bodies = [normalise(t) for t in texts]
            return [fingerprint(b) for b in bodies], [hashlib.sha256(b).digest() for b in bodies]

        return run

    x = documents.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{text}`").alias("text"),
    )
    x = with_text_columns(x, task, "fp long, sha binary", "text", ["doc_id", "row"], binary=True)
    return x.withColumn("chunk", F.shiftright("row", 33).cast("int"))


def send(table: DataFrame, owners: int) -> DataFrame:
    """One row per chunk and owner: the chunk's distinct fingerprints, coded."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(pdf["fp"].to_numpy())
        owner = fps * owners >> BITS if owners < 1 << 15 else fps // (SPAN // owners + 1)
        out = []
        for o in np.unique(owner):
            part = fps[owner == o]
            k, unary, rest = golomb.encode(part - part[0], int(part[-1] - part[0]) + 1)
            out.append((int(o), int(key[0]), int(part[0]), len(part), k, unary, rest))
        return pd.DataFrame(out, columns=["owner", "chunk", "base", "n", "k", "unary", "rest"])

    return table.select("chunk", "fp").groupBy("chunk").applyInPandas(
        pack, "owner int, chunk int, base long, n long, k int, unary binary, rest binary"
    )


def answer(sent: DataFrame) -> DataFrame:
    """One row per chunk and owner: a bitmap of the fingerprints that other chunks have too."""

    def mark(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [
            golomb.decode(n, k, u, r) + b
            for b, n, k, u, r in zip(pdf["base"], pdf["n"], pdf["k"], pdf["unary"], pdf["rest"], strict=True)
        ]
        values, times = np.unique(np.concatenate(lists), return_counts=True)
        twice = values[times > 1]
        bitmaps = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in lists]
        return pd.DataFrame({"chunk": pdf["chunk"], "base": pdf["base"], "bitmap": bitmaps, "n": pdf["n"]})

    return sent.groupBy("owner").applyInPandas(mark, "chunk int, base long, bitmap binary, n long")


def suspects(table: DataFrame, answers: DataFrame) -> DataFrame:
    """The table with ``suspect``: another row, of this or another chunk, has the fingerprint."""

    def join(key: tuple, rows: pd.DataFrame, bitmaps: pd.DataFrame) -> pd.DataFrame:
        fps, inverse, times = np.unique(rows["fp"].to_numpy(), return_inverse=True, return_counts=True)
        bitmaps = bitmaps.sort_values("base")
        bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(bitmaps["bitmap"], bitmaps["n"], strict=True)]
        shared = np.concatenate(bits).astype(bool) | (times > 1)
        return rows.assign(suspect=shared[inverse])[["doc_id", "row", "fp", "sha", "suspect"]]

    # ids may be null, which pandas would turn into floats
    rows = table.withColumn("doc_id", F.col("doc_id").cast("string"))
    out = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(
        join, "doc_id string, row long, fp long, sha binary, suspect boolean"
    )
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def suspect_filter(marked: DataFrame) -> np.ndarray:
    """A bit per fingerprint of a suspect, as bytes; its size is fixed."""
    bit = F.pmod("fp", F.lit(FILTER_BITS))
    words = (
        marked.filter("suspect")
        .groupBy(F.shiftright(bit, 5).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(fp, 32) as int))")).alias("bits"))
        .toPandas()
    )
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def compared(documents: DataFrame, bits: np.ndarray, text: str) -> DataFrame:
    """sha and group size of texts that several rows have, compared byte by byte.

    Rows outside the filter are dropped where they are read; equal texts of a
    task combine before the shuffle, so a hot text is sent once per task.
    """
    shared = documents.sparkSession.sparkContext.broadcast(bits)

    def task():
        table = shared.value

        def run(texts):
            out = []
            for t in texts:
                body = normalise(t)
                bit = fingerprint(body) % FILTER_BITS
                out.append(body if table[bit >> 5] >> (bit & 31) & 1 else None)
            return [out]

        return run

    bodies = with_text_columns(documents.select(F.col(f"`{text}`").alias("text")), task, "body binary", "text", [], binary=True)
    same = bodies.filter("body is not null").groupBy("body").agg(F.count(F.lit(1)).alias("group_size"))
    return same.filter("group_size > 1").select(F.unhex(F.sha2("body", 256)).alias("sha"), "group_size")


def find_copies(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of documents whose texts are equal up to runs of white space.

    One row per row of ``documents``: doc_id, keep_id (the group's smallest
    doc_id), group_size, kept, text_sha256 (of the normalised text).  A null
    text counts as empty.  A null id comes after all others; of rows that
    repeat the smallest id, one is kept.  Other columns are ignored; an empty
    table gives an empty result.
    """
    spark = documents.sparkSession
    table, first = store(fingerprints(documents, doc_id, text), "fingerprints")
    owners = max(partitions(spark), -(-table.count() // OWNED))
    marked, second = store(suspects(table, answer(send(table, owners))), "suspects")
    same = compared(documents, suspect_filter(marked), text)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    best = marked.filter("suspect").groupBy("sha").agg(F.min(order).alias("best"))
    classes, _ = store(same.join(best, "sha").select("sha", "group_size", "best"), "classes")
    remove(spark, first)
    alone = F.col("best").isNull()
    grouped = marked.filter("suspect").join(classes, "sha", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    single = marked.filter("not suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    return grouped.unionByName(single)


def without_copies(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, one of each group, with all their columns.

    The rows that go are named by id and text hash; where an id and text occur
    several times, one of those rows stays.
    """
    found = find_copies(documents, doc_id, text)
    body = F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return keep_rows(documents, found, doc_id, F.sha2(body.cast("binary"), 256), "text_sha256")
