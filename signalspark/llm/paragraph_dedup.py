"""Substring dedup: near-equal paragraphs, and runs of equal words, across documents.

Paragraphs are lines of at least ``LEAST_WORDS`` words.  Those with equal
shingle sets are one class.  Classes meet where a band of their MinHash
signatures collides, and from there on as in the n-gram join: the smallest of a
bucket first, bitmaps, exact Jaccard, components.  Runs of ``RUN`` equal words
or more are found whatever lines they lie in (``passages``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from signalspark.llm.ngram_join import bitmap, class_of, link_classes, sets_of, wide
from signalspark.llm.passages import RUN, Anchors, run_rows, shared_runs
from signalspark.llm.shingles import PLAIN, WORDS, distinct, rolled, word_hashes
from signalspark.llm.tables import remove, store
from signalspark.llm.textmap import with_text_columns

#: Shorter lines are headings, boilerplate or list items; they are no paragraphs.
LEAST_WORDS = 25
#: At a similarity of 0.8, 1 - (1 - 0.8^4)^20 = 0.99997 of the pairs collide.
BANDS, ROWS = 20, 4
_GENERATOR = np.random.default_rng(20240101)
_MULTIPLY = _GENERATOR.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _GENERATOR.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
#: Shingles that are permuted at once (256 KB), unless one set has more.
SLICE = 1 << 16


def signatures(sets: Sequence[np.ndarray]) -> np.ndarray:
    """A row per set of hashes (none empty): one hash per band of its MinHash signature.

    Permutations act on 32 bits of a hash: numpy multiplies those several at a
    time, and what collides by chance is verified like all else.
    """
    out = np.empty((len(sets), BANDS), np.uint64)
    size = np.cumsum([0, *map(len, sets)])
    at = 0
    while at < len(sets):
        end = max(at + 1, int(np.searchsorted(size, size[at] + SLICE, "right")) - 1)
        low = np.concatenate(sets[at:end]).astype(np.uint32)
        start = size[at:end] - size[at]
        for band in range(BANDS):
            h = np.full(end - at, band + 1, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                h = (h ^ np.minimum.reduceat((low ^ _FLIP[k]) * _MULTIPLY[k], start)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(31)
            out[at:end, band] = h
        at = end
    return out.view(np.int64)


def bands(u: np.ndarray) -> np.ndarray:
    """One hash per band of the MinHash signature of a set of hashes."""
    return signatures([u])[0]


def paragraphs(texts: Sequence[bytes | None], hashes: Sequence[np.ndarray], least: int, size: int) -> list[list[tuple]]:
    """(line, start, end, words, set) of each paragraph of each text, places in code points; ``hashes`` are those of its words."""
    out: list[list[tuple]] = [[] for _ in texts]
    for rows, text, h in zip(out, texts, hashes, strict=True):
        if len(h) < max(least, 1):
            continue
        raw = np.frombuffer(text, np.uint8)
        word = np.frombuffer(text.translate(PLAIN), np.uint8) != 32
        word[1:] &= ~word[:-1]  # the first byte of each word
        breaks = np.flatnonzero(raw == 10)
        bound = np.concatenate([[0], np.searchsorted(np.flatnonzero(word), breaks), [len(h)]])
        line = np.flatnonzero(np.diff(bound) >= max(least, 1))
        if not len(line):
            continue
        start, end = np.append(0, breaks + 1)[line], np.append(breaks, len(raw))[line]
        if not text.isascii():
            chars = np.append(0, np.cumsum(raw & 0xC0 != 0x80))
            start, end = chars[start], chars[end]
        whole = rolled(h, size)
        for place in zip(line.tolist(), start.tolist(), end.tolist(), bound[line].tolist(), bound[line + 1].tolist(), strict=True):
            a, b = place[3:]
            u = whole[a : b - size + 1] if b - a >= size else rolled(h[a:b], size)
            rows.append((*place[:3], b - a, distinct(u)))
    return out


def find_repeats(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, size: int = WORDS, percent: int = 80, run: int = RUN
) -> DataFrame:
    """Paragraphs (equal or of a Jaccard similarity of ``percent`` / 100) and runs of equal words that occur in several documents.

    Groups are components of similar paragraphs.  One row per paragraph of a
    group that spans several rows of ``documents``: doc_id, body (hash of the
    text), line, start, end (code points), n_words, group_size, keep_doc_id and
    keep_start (where the group's first paragraph lies, by doc_id and place;
    null ids last), removed (all but the first).  A run of ``run`` equal words or
    more, line ends and A-Z or a-z aside, that does not lie in such a paragraph
    has rows of the same columns: where its windows of ``run`` words first
    occur, by doc_id and place; rows of one document overlap where that
    changes, and group_size counts the places of the row's most frequent
    window.  Other documents, null and
    empty texts have no rows; repeated rows are documents of their own; other
    columns are ignored; an empty table gives an empty result.
    """

    def task():
        done = set()

        def scan(texts):
            out, fresh, sets = [], [], []
            hashes = word_hashes(texts)
            for found, h in zip(paragraphs(texts, hashes, least, size), hashes, strict=True):
                a = Anchors(h, run)
                rows = [{"first": a.first.astype(np.int32), "many": a.many.astype(np.int32), "seed": a.seed, "ctx": a.ctx}] if len(a.first) else []
                for line, start, end, n_words, u in found:
                    key = xxhash.xxh3_128_digest(u.tobytes())
                    new = key not in done
                    if new:
                        if len(done) >= 1 << 20:
                            done.clear()
                        done.add(key)
                    rows.append({
                        "line": line, "start": start, "end": end, "n_words": n_words, "n": len(u), "set": key,
                        "bitmap": bitmap(u) if new else None, "wide": wide(u) if new else None,
                    })
                    if new:
                        fresh.append(rows[-1])
                        sets.append(u)
                out.append(rows)
            for row, prefix in zip(fresh, signatures(sets), strict=True):
                row["prefix"] = prefix
            return [out]

        return scan

    x = documents.select(
        F.monotonically_increasing_id().alias("doc"),
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.xxhash64(F.col(f"`{text}`")).alias("body"),
        F.col(f"`{text}`").alias("text"),
    )
    fields = "p array<struct<line:long,start:long,end:long,n_words:long,n:long,set:binary,bitmap:binary,wide:binary,prefix:array<long>,"
    fields += "first:array<int>,many:array<int>,seed:array<long>,ctx:array<long>>>"
    x = with_text_columns(x, task, fields, "text", ["doc", "doc_id", "body"], binary=True)
    x = x.select("doc", "doc_id", "body", F.explode("p").alias("p")).select("doc", "doc_id", "body", "p.*")
    table, _ = store(x, "paragraphs")
    anchors = table.filter("line is null").select("doc", "doc_id", "body", "first", "many", "seed", "ctx")
    runs = shared_runs(anchors, documents, text, run)
    runs, _ = store(run_rows(runs, documents, doc_id, text, run), "run-rows")
    table = table.filter("line is not null").drop("first", "many", "seed", "ctx")

    def cut():
        def of(texts: list[bytes | None]) -> list[list[np.ndarray]]:
            found = paragraphs(texts, word_hashes(texts), least, size)
            return [list({u.tobytes(): u for *_, u in rows}.values()) for rows in found]

        return of

    labels = link_classes(table, lambda maps: sets_of(documents, maps, doc_id, text, cut), percent, ordered=False)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "doc", "start")
    table = table.withColumn("node", class_of())
    # classes keep the name that their links have: what is summed up by it meets its label where it lies
    facts = table.groupBy("node").agg(
        F.min(order).alias("best"), F.min("doc").alias("low"), F.max("doc").alias("high"), F.count(F.lit(1)).alias("size")
    )
    named = facts.join(labels, "node", "left")
    named, path = store(named.withColumn("label", F.coalesce("label", "node")), "named")
    groups = named.groupBy("label").agg(
        F.min("best").alias("best"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("size").alias("group_size")
    )
    groups = groups.filter("low < high").select("label", "best", "group_size")
    nodes, _ = store(named.select("node", "label").join(groups, "label").drop("label"), "groups")
    remove(documents.sparkSession, path)
    first = (F.col("doc") == F.col("best.doc")) & (F.col("start") == F.col("best.start"))
    lines = table.select("doc", "doc_id", "body", "line", "start", "end", "n_words", "node").join(nodes, "node").select(
        "doc", "doc_id", "body", "line", "start", "end", "n_words", "group_size",
        F.col("best.doc_id").alias("keep_doc_id"), F.col("best.start").alias("keep_start"), (~first).alias("removed"),
    )
    around = lines.select(F.col("doc").alias("_doc"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    inside = (F.col("doc") == F.col("_doc")) & (F.col("_start") <= F.col("start")) & (F.col("end") <= F.col("_end"))
    return lines.unionByName(runs.join(around, inside, "left_anti")).drop("doc")


def without_repeats(documents: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with all their columns, removed paragraphs and runs (and what parts them from the rest) cut from the texts.

    Rows are named by id and text; rows that repeat both lose the same paragraphs.
    """
    spans = found.filter("removed").select("doc_id", "body", "start", "end").distinct().groupBy(
        F.struct("doc_id", "body").alias("_pair")
    ).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    spans, _ = store(spans, "spans")
    key = F.struct(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("body"))
    names = [f"c{i}" for i in range(len(documents.columns))]
    t = names[documents.columns.index(text)]
    x = documents.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(documents.columns, names, strict=True)], key.alias("_pair"))
    # the blank or line end behind goes too, but a line that goes on before the span keeps its end
    after = "CASE WHEN substr({0}, int(s.end + 1), 1) = '\n' AND s.start > 0 AND substr({0}, int(s.start), 1) <> '\n' THEN s.end ELSE s.end + 1 END".format(t)
    # spans may overlap
    step = "named_struct('at', greatest(a.at, {1}), 'out', concat(a.out, substr({0}, int(a.at + 1), int(s.start - a.at))))".format(t, after)
    kept = (
        f"aggregate(_spans, named_struct('at', 0L, 'out', ''), (a, s) -> {step}, "
        f"a -> concat(a.out, substr({t}, int(a.at + 1))))"
    )
    x = x.join(spans, "_pair", "left").withColumn(t, F.expr(f"CASE WHEN _spans IS NULL THEN {t} ELSE {kept} END"))
    return x.select(*names).toDF(*documents.columns)
