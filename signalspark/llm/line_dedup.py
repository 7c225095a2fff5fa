"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position.

1. Every document gives the 128-bit hashes of its distinct line keys; Spark
   counts documents and takes the smallest id per hash, combined before the
   shuffle, so a line that a third of all documents hold is one row per task.
2. Lines meet the hashes that enough documents hold in a salted join; what is
   dropped becomes one list of positions per document.
3. Texts meet their list and are cut at the line ends.
"""

from __future__ import annotations

import hashlib

import xxhash
from pyspark.sql import DataFrame, functions as F

from signalspark.llm.tables import store
from signalspark.llm.textmap import LOWER, with_columns, with_text_columns
from signalspark.operators.frames import attach

LEAST_CHARS = 10
LEAST_DOCUMENTS = 2
_SIGN = 1 << 63


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z in lower case."""
    return line.strip().translate(LOWER)


def long_enough(key: bytes, least: int) -> bool:
    """Whether a key has at least ``least`` code points; bytes decide unless they leave it open."""
    if len(key) < least:
        return False
    return len(key) > 4 * least or sum(b & 0xC0 != 0x80 for b in key) >= least


def key_hashes(text: bytes | None, least: int) -> list[tuple[int, int, int]]:
    """(position, two halves of the key's hash) of each line whose key counts."""
    out = []
    for i, line in enumerate((text or b"").split(b"\n")):
        key = line_key(line)
        if long_enough(key, least):
            h = xxhash.xxh3_128_intdigest(key)
            out.append((i, (h >> 64) - _SIGN, (h & (2 * _SIGN - 1)) - _SIGN))
    return out


def cut(text: bytes, drop: set[int]) -> tuple[int, bytes]:
    """Number of lines, and the text without the lines at the positions in ``drop``."""
    rows = text.split(b"\n")
    return len(rows), b"\n".join(r for i, r in enumerate(rows) if i not in drop) if drop else text


def lines(documents: DataFrame, least: int, distinct: bool) -> DataFrame:
    """doc_id, text_hash, pos, h1, h2 of every line that counts; with ``distinct`` one row per document and key.

    ``documents`` has doc_id, text_hash and text.
    """

    def task():
        def run(texts):
            out = []
            for t in texts:
                rows = key_hashes(t, least)
                if distinct:
                    rows = list({r[1:]: r for r in reversed(rows)}.values())
                out.append([dict(zip(("pos", "h1", "h2"), r, strict=True)) for r in rows])
            return [out]

        return run

    x = with_text_columns(documents, task, "lines array<struct<pos:int,h1:long,h2:long>>", keep=["doc_id", "text_hash"], binary=True)
    return x.select("doc_id", "text_hash", F.explode("lines").alias("l")).select("doc_id", "text_hash", "l.*")


def repeated_lines(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text",
    least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS,
) -> DataFrame:
    """h1, h2, n_documents, first_doc of every line key that at least ``least_documents`` rows hold.

    A line counts once per row of ``documents``; ``first_doc`` is the smallest
    id that is not null.
    """
    x = lines(named(documents, doc_id, text), least_chars, True)
    count = x.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_documents"), F.min("doc_id").alias("first_doc"))
    return count.filter(F.col("n_documents") >= least_documents)


def named(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.col(f"`{text}`")
    return documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))


def without_repeated_lines(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text",
    least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS, with_text: bool = True,
) -> DataFrame:
    """Drop lines that many documents hold, but for the document with the smallest id.

    A text is split at ``\\n`` (a null or empty one is one empty line).  A line's
    key is the line without white space at its ends, with A-Z in lower case.
    Keys of at least ``least_chars`` code points that at least ``least_documents``
    rows hold lose all their lines in rows whose id is not the smallest one.
    One row per row of ``documents``: doc_id, n_lines (before), n_dropped,
    kept_sha256 and, if asked, kept_text.  Null ids come after all others: such
    rows lose the lines that a row with an id holds too, and nothing where no
    row has an id.  Rows that repeat the smallest id all keep their lines, and
    rows that repeat an id and text get the same result.  Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    docs = named(documents, doc_id, text)
    repeated, _ = store(repeated_lines(documents, doc_id, text, least_chars, least_documents).drop("n_documents"), "lines")
    found = attach(lines(docs, least_chars, False), repeated, ["h1", "h2"], "text_hash")
    goes = F.col("first_doc").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first_doc")))
    # rows of one id and text share a list, so repeated rows need no name of their own
    drops = found.filter(goes).groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("drop"))
    drops = drops.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "drop")
    x = docs.join(drops, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left")
    x = x.select("doc_id", "text", F.coalesce("drop", F.array().cast("array<int>")).alias("drop"))
    fields = "n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text

    def task():
        def run(texts, drops):
            out = [cut(t or b"", set(d)) for t, d in zip(texts, drops, strict=True)]
            columns = [n for n, _ in out], [len(d) for d in drops], [hashlib.sha256(k).hexdigest() for _, k in out]
            return columns + ([k.decode("utf-8", "replace") for _, k in out],) * with_text

        return run

    return with_columns(x, task, fields, [F.col("text").cast("binary"), F.col("drop")], ["doc_id"])
