"""Runs of equal words that several documents share, wherever lines end.

Every window of ``RUN`` words is filed under its least run of half as many
words, its seed, so equal windows have equal seeds and a text has some 7 seeds
per 100 words.  Seeds of several documents go on.  Where all places of a seed
have the same windows, those are shared as they stand; elsewhere the windows of
each distinct place are hashed and counted.  Windows are never paired: one that
thousands of documents hold costs a row each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from signalspark.llm.repeats import again_filter
from signalspark.llm.shingles import PLAIN, word_hashes
from signalspark.llm.tables import FILTER_BITS, bit_filter, listed_in, remove, store
from signalspark.operators.frames import attach

RUN = 50
_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)
_C = np.uint64(0xBF58476D1CE4E5B9)
PIECES = "pieces array<struct<word:int,many:int,keep:struct<doc:long,doc_id:long,body:long>,keep_word:int,n:long>>"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


#: Powers for texts of usual length; longer ones compute their own.
_FORTH, _REAR = _powers(_BASE, 1 << 14), _powers(_BACK, 1 << 14)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C
    return h ^ (h >> np.uint64(29))


def least_places(h: np.ndarray, size: int) -> np.ndarray:
    """Place of the least of each ``size`` values in a row, the first of equal ones; spans double."""
    at, span = np.arange(len(h)), 1
    while span < size:
        step = min(span, size - span)
        right = h[step:] < h[:-step]
        h, at = np.where(right, h[step:], h[:-step]), np.where(right, at[step:], at[:-step])
        span += step
    return at


class Anchors:
    """The windows of a text by seed: ``first`` window, how ``many``, hashes of the ``seed`` and of all words covered (``ctx``)."""

    def __init__(self, h: np.ndarray, run: int = RUN):
        n, size = len(h) - run + 1, run // 2
        self.run, self.first = run, np.zeros(0, np.int64)
        if n < 1:
            return
        usual = len(h) < len(_REAR)
        self.back = _REAR if usual else _powers(_BACK, len(h) + 1)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * (_FORTH[: len(h)] if usual else _powers(_BASE, len(h))), out=self.sums[1:])
        seeds = self.hashes(np.arange(len(h) - size + 1), size)
        at = least_places(seeds, run - size + 1)
        self.first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        self.many = np.diff(np.append(self.first, n))
        self.seed = seeds[at[self.first]].view(np.int64)
        place = (at[self.first] - self.first) * run + self.many
        self.ctx = _mixed(self.hashes(self.first, self.many + run - 1) + place.astype(np.uint64) * _C).view(np.int64)

    def hashes(self, start: np.ndarray, size) -> np.ndarray:
        """Hashes of ``size`` words from each start on."""
        return _mixed((self.sums[start + size] - self.sums[start]) * self.back[start])

    def windows(self, i: int) -> np.ndarray:
        return self.hashes(np.arange(self.first[i], self.first[i] + self.many[i]), self.run).view(np.int64)


def joined_pieces(df: DataFrame, keys: str) -> DataFrame:
    """Pieces (in order) that go on in the document that is kept become one."""
    names = [k.split(" ")[0] for k in keys.split(", ")]

    def run(batches):
        for b in batches:
            lists = b.column(len(names))
            pieces = lists.flatten()
            columns = dict(zip((f.name for f in pieces.type), pieces.flatten(), strict=True))
            word, many, keep_word, n = (columns[c].to_numpy() for c in ("word", "many", "keep_word", "n"))
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            new = np.zeros(len(pieces), bool)
            new[1:] = (word[1:] != word[:-1] + many[:-1]) | (keep_word[1:] != keep_word[:-1] + many[:-1])
            for c in columns["keep"].flatten():
                value, valid = c.fill_null(0).to_numpy(), c.is_valid().to_numpy(False)
                new[1:] |= (value[1:] != value[:-1]) | (valid[1:] != valid[:-1])
            new[bounds[:-1][np.diff(bounds) > 0]] = True
            at = np.flatnonzero(new)
            if len(at):
                first = pieces.take(pa.array(at))
                columns = dict(zip(columns, first.flatten(), strict=True))
                columns["many"] = pa.array(np.add.reduceat(many, at, dtype=many.dtype))
                columns["n"] = pa.array(np.maximum.reduceat(n, at))
                pieces = pa.StructArray.from_arrays(list(columns.values()), fields=list(pieces.type))
            merged = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, bounds).astype(np.int32)), pieces, type=lists.type)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), merged], [*names, "pieces"])

    return df.select(*names, "pieces").mapInArrow(run, f"{keys}, {PIECES}")


def _piece(word: Column, many: Column, n: str = "n") -> Column:
    keep = F.struct(F.col("best.doc").alias("doc"), F.col("best.doc_id").alias("doc_id"), F.col("best.body").alias("body"))
    return F.struct(word.cast("int").alias("word"), many.cast("int").alias("many"), keep.alias("keep"), F.col("best.word").alias("keep_word"), F.col(n).alias("n"))


def passing(anchors: DataFrame, listed: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A row per place whose seed ``listed`` lets pass, of rows with lists of places."""
    names = ["doc", "doc_id", "body", "first", "many", "seed", "ctx"]

    def few(batches):
        for b in batches:
            lists = [b.column(i) for i in range(3, 7)]
            ok = listed(lists[2].flatten().to_numpy())
            of, mask = pa.array(np.repeat(np.arange(b.num_rows), lists[2].value_lengths().to_numpy())[ok]), pa.array(ok)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(of) for i in range(3)), *(x.flatten().filter(mask) for x in lists)], names)

    return anchors.select(*names).mapInArrow(few, "doc long, doc_id long, body long, first int, many int, seed long, ctx long")


def shared_runs(anchors: DataFrame, documents: DataFrame, text: str, run: int = RUN) -> DataFrame:
    """Runs of ``run`` words or more that occur in several documents.

    ``anchors``: doc, doc_id, body and the lists first, many, seed, ctx.  A row is a run of
    words of a document whose windows all occur first (by doc_id, null ids
    last, and place) in one run of another document or place, or here: doc,
    doc_id, body, word, many (windows), keep, keep_word, n (places of its most
    frequent window).
    """
    spark = documents.sparkSession
    low, high = F.min("doc").alias("low"), F.max("doc").alias("high")
    seeds = passing(anchors, again_filter(anchors.select("seed"))).groupBy("seed")
    seeds = seeds.agg(low, high, (F.min("ctx") != F.max("ctx")).alias("mixed")).filter("low < high")
    seeds, seeds_path = store(seeds.select("seed", "mixed"), "seeds")
    # only what the filter lets pass is shuffled; a seed that many documents have is dealt over several tasks
    near, near_path = store(attach(passing(anchors, listed_in(seeds.select("seed"))), seeds, ["seed"], "doc"), "near")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "doc", F.col("first").alias("word"), "body")
    classes, classes_path = store(
        near.groupBy("seed", "ctx").agg(
            F.max("mixed").alias("mixed"), F.max("many").alias("many"), low, high, F.min(order).alias("best"), F.count(F.lit(1)).alias("n")
        ),
        "places",
    )
    mixed = classes.filter("mixed")
    # windows are read in the text where a place occurs first; filters of fixed size keep the other texts out
    shared = spark.sparkContext.broadcast((bit_filter(mixed.select("ctx")), bit_filter(mixed.select("best.body"))))

    def look(batches):
        (wanted, first), done = shared.value, set()
        for batch in batches:
            bit = batch.column(0).to_numpy() % FILTER_BITS
            texts = batch.column(1).filter(pa.array((first[bit >> 5] >> (bit & 31).astype(np.uint32) & 1).astype(bool)))
            for at in range(0, len(texts), 1024):
                seed, ctx, windows = [], [], []
                for h in word_hashes(texts.slice(at, 1024).to_pylist()):
                    a = Anchors(h, run)
                    if not len(a.first):
                        continue
                    bit = a.ctx % FILTER_BITS
                    for i in np.flatnonzero(wanted[bit >> 5] >> (bit & 31).astype(np.uint32) & 1).tolist():
                        key = (int(a.seed[i]), int(a.ctx[i]))
                        if key in done:
                            continue
                        if len(done) >= 1 << 19:
                            done.clear()
                        done.add(key)
                        seed.append(key[0])
                        ctx.append(key[1])
                        windows.append(a.windows(i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed, pa.int64()), pa.array(ctx, pa.int64()), pa.array(windows, pa.list_(pa.int64()))], ["seed", "ctx", "windows"]
                )

    read = documents.select(F.xxhash64(F.col(f"`{text}`")), F.col(f"`{text}`").cast("binary"))
    found = read.mapInArrow(look, "seed long, ctx long, windows array<long>")
    each = mixed.join(found.dropDuplicates(["seed", "ctx"]), ["seed", "ctx"])
    each, each_path = store(each.select("seed", "ctx", "low", "high", "best", "n", F.posexplode("windows").alias("o", "window")), "windows")
    moved = F.struct("best.last", "best.doc_id", "best.doc", (F.col("best.word") + F.col("o")).alias("word"), "best.body")
    common = each.groupBy("seed", "window").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min(moved).alias("best"), F.sum("n").alias("n"))
    common = common.filter("low < high").select("seed", "window", "best", "n")
    parts = each.select("seed", "ctx", "o", "window").join(common, ["seed", "window"]).groupBy("seed", "ctx").agg(
        F.sort_array(F.collect_list(_piece(F.col("o"), F.lit(1)))).alias("pieces")
    )
    parts = joined_pieces(parts, "seed long, ctx long").unionByName(
        classes.filter("not mixed").select("seed", "ctx", F.array(_piece(F.lit(0), F.col("many"))).alias("pieces"))
    )
    parts, parts_path = store(parts, "parts")
    remove(spark, seeds_path, classes_path, each_path)
    x = near.select("doc", "doc_id", "body", "first", "seed", "ctx").join(parts, ["seed", "ctx"])
    x = x.select("doc", "doc_id", "body", "first", F.inline("pieces"))
    piece = F.struct((F.col("first") + F.col("word")).alias("word"), "many", "keep", "keep_word", "n")
    x = x.groupBy("doc", "doc_id", "body").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    keys = "doc long, doc_id long, body long"
    runs, _ = store(joined_pieces(x, keys).select("doc", "doc_id", "body", F.inline("pieces")), "runs")
    remove(spark, near_path, parts_path)
    return runs


def places(documents: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """line, start and end (code points) of the words asked for: rows (pair, word), a pair being (doc_id, body)."""
    asked, path = store(wanted.groupBy("pair").agg(F.collect_set("word").alias("words")), "asked")
    shared = documents.sparkSession.sparkContext.broadcast(bit_filter(asked.select(F.xxhash64("pair"))))
    pair = F.struct(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("body"))
    x = documents.select(pair.alias("pair"), F.col(f"`{text}`").cast("binary").alias("text"))

    def listed(batches):
        for b in batches:
            bit = b.column(0).to_numpy() % FILTER_BITS
            ok = shared.value[bit >> 5] >> (bit & 31).astype(np.uint32) & 1
            yield b.filter(pa.array(ok.astype(bool)))

    def find(batches):
        for b in batches:
            row, out = [], []
            for i in range(b.num_rows):
                raw, words = b.column(1)[i].as_py(), np.sort(b.column(2)[i].values.to_numpy())
                a = np.frombuffer(raw.translate(PLAIN), np.uint8) != 32
                edge = np.flatnonzero(np.diff(np.concatenate([[False], a, [False]])))
                start, end = edge[::2][words], edge[1::2][words]
                chars = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)])
                lines = np.searchsorted(np.flatnonzero(np.frombuffer(raw, np.uint8) == 10), start)
                row += [i] * len(words)
                out.append(np.stack([words, lines, chars[start], chars[end]]))
            cols = np.concatenate(out, axis=1).astype(np.int64) if out else np.zeros((4, 0), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *map(pa.array, cols)], ["pair", "word", "line", "start", "end"])

    kind = "pair struct<doc_id:long,body:long>"
    x = x.select(F.xxhash64("pair").alias("h"), "pair", "text").mapInArrow(listed, f"h long, {kind}, text binary")
    x = x.select("pair", "text").join(asked, "pair").mapInArrow(find, f"{kind}, word long, line long, start long, end long")
    out, _ = store(x.dropDuplicates(["pair", "word"]), "word-places")
    remove(documents.sparkSession, path)
    return out


def run_rows(runs: DataFrame, documents: DataFrame, doc_id: str, text: str, run: int = RUN) -> DataFrame:
    """The rows of ``shared_runs`` with their places in the texts, in the columns of ``find_repeats``, and doc."""
    own, keep = F.struct("doc_id", "body"), F.struct("keep.doc_id", "keep.body")
    x = runs.select(
        "doc", own.alias("own"), F.col("word").cast("long").alias("word"), (F.col("word") + F.col("many") + run - 2).cast("long").alias("last"),
        keep.alias("kept"), F.col("keep_word").cast("long").alias("keep_word"), (F.col("many") + run - 1).cast("long").alias("n_words"),
        F.col("n").alias("group_size"), ((F.col("keep.doc") != F.col("doc")) | (F.col("keep_word") != F.col("word"))).alias("removed"),
    ).toDF("doc", "own", "word", "last", "kept", "keep_word", "n_words", "group_size", "removed")
    asked = x.select(F.col("own").alias("pair"), F.explode(F.array("word", "last")).alias("word")).unionByName(
        x.select(F.col("kept").alias("pair"), F.col("keep_word").alias("word"))
    )
    at = places(documents, asked, doc_id, text)
    x = x.join(at.select(F.col("pair").alias("own"), "word", "line", "start"), ["own", "word"])
    x = x.join(at.select(F.col("pair").alias("own"), F.col("word").alias("last"), "end"), ["own", "last"])
    x = x.join(at.select(F.col("pair").alias("kept"), F.col("word").alias("keep_word"), F.col("start").alias("keep_start")), ["kept", "keep_word"])
    return x.select(
        "doc", "own.doc_id", "own.body", "line", "start", "end", "n_words", "group_size", F.col("kept.doc_id").alias("keep_doc_id"), "keep_start", "removed",
    )
