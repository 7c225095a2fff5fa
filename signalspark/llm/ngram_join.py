"""Similarity join of documents on word shingles, exact for a Jaccard threshold.

1. Documents with equal sets are one class, named by a 64-bit hash of the set, so
   tasks agree on it without a shuffle; a task sends a class on once.
2. A class is dealt to one tile per necessary shingle: with sets ordered alike,
   frequent shingles last, two sets of the wanted similarity share one of their
   first n - ceil(t n) + 1.  Shingles of one class make no tile.
3. In a tile of at most ``SMALL`` classes all meet that sizes and positions allow.
   In a larger one the classes of a size band meet its first one.  What that links
   is joined to components, and tiles that lie in one component are done: a group of
   thousands of near copies costs a row each, not a pair each.
4. Tiles left open are cut into bands of set sizes (ratio 1.26 for a threshold of 0.8) and blocks of at
   most some ``BLOCK`` classes.  Blocks of equal and neighbouring bands meet,
   and bitmaps bound the overlap of all pairs of different components at once:
   first the best pair of two components, then, where that joined nothing, all.
5. Pairs that pass are verified by intersecting the sorted sets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from signalspark.llm.components import components
from signalspark.llm.repeats import again_filter
from signalspark.llm.shingles import WORDS, shingle_sets
from signalspark.llm.tables import keep_rows, partitions, remove, store
from signalspark.llm.textmap import with_text_columns
from signalspark.operators.frames import attach

#: Bits of a class's bitmap; each shingle flips one.  Sets over half as large have a wider one too.
BITMAP, WIDEST = 1024, 1 << 16
BLOCK = 512
#: Tiles of at most so many classes compare all of them at once: 3.5 pairs a class.
SMALL = 8
#: Buckets by which shingles are ranked, and how many of them one row packs.
RANKS, RANK_BLOCK = 1 << 24, 1 << 16
#: Shingles that are looked at together for repeated ones (some 70 MB).
LOOK = 1 << 22
#: Texts that are hashed at once.
TEXTS = 1024
FILTER_BITS = 1 << 26
#: Pairs whose bitmaps are compared at once.
PAIRS = 1 << 17


def least_overlap(n, percent: int):
    """Smallest overlap with a set of ``n`` at which the similarity can reach ``percent``."""
    return -(-n * percent // 100)


def bitmap(hashes: np.ndarray, bits: int = BITMAP) -> bytes:
    """A bit per hash value, flipped by each shingle: two bitmaps differ in no more bits than the sets do."""
    flips = np.bincount((hashes >> np.uint64(17)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def wide(hashes: np.ndarray) -> bytes | None:
    """A bitmap of at least two bits per shingle, where ``BITMAP`` has fewer; halves can be folded onto each other."""
    if 2 * len(hashes) <= BITMAP:
        return None
    return bitmap(hashes, min(WIDEST, 1 << (2 * len(hashes) - 1).bit_length()))


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ, the wider one folded to the other's width."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    size = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def frequency_ranks(documents: DataFrame, text: str, size: int) -> np.ndarray:
    """For each of ``RANKS`` buckets of shingles, how often those occur that several texts share: a power of two.

    Any order of the shingles gives the same links; this one keeps tiles small.
    The array has one size for every corpus (16 MB); a fuller one tells less apart.
    """

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(sets)
        h.sort()
        again, times = np.unique(h[1:][h[1:] == h[:-1]], return_counts=True)
        bucket = pa.array((again & np.uint64(RANKS - 1)).astype(np.int32))
        return pa.RecordBatch.from_arrays([bucket, pa.array(times + 1)], ["bucket", "n"])

    def look(batches):
        sets, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                sets += (new := shingle_sets(batch.column(0).slice(at, TEXTS).to_pylist(), size))
                held += sum(map(len, new))
                if held >= LOOK:
                    yield counted(sets)
                    sets, held = [], 0
        if sets:
            yield counted(sets)

    def pack(t: pa.Table) -> pa.Table:
        ranks = np.zeros(RANK_BLOCK, np.uint8)
        ranks[t["at"].to_numpy()] = np.log2(t["n"].to_numpy().astype(float)).astype(np.uint8)
        return pa.table({"block": t["block"].slice(0, 1), "ranks": pa.array([ranks.tobytes()], pa.binary())})

    found = documents.select(F.col(f"`{text}`").cast("binary")).mapInArrow(look, "bucket int, n long")
    found = found.groupBy("bucket").agg(F.sum("n").alias("n"))
    blocks = found.select((F.col("bucket") % RANK_BLOCK).alias("at"), F.floor(F.col("bucket") / RANK_BLOCK).alias("block"), "n")
    got = blocks.groupBy("block").applyInArrow(pack, "block long, ranks binary").toArrow()
    out = np.zeros((RANKS // RANK_BLOCK, RANK_BLOCK), np.uint8)
    for block, ranks in zip(got["block"].to_pylist(), got["ranks"].to_pylist(), strict=True):
        out[block] = np.frombuffer(ranks, np.uint8)
    return out.reshape(-1)


def shingled(documents: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """row, doc_id, body (hash of the text), n, set (hash of the set); of the first row of a set in a task also bitmaps and prefix."""
    shared = documents.sparkSession.sparkContext.broadcast(frequency_ranks(documents, text, size))

    def task():
        ranks, done = shared.value, set()

        def first(u: np.ndarray) -> np.ndarray:
            rank = ranks[(u & np.uint64(RANKS - 1)).astype(np.int64)]
            if rank.any():
                u = u[np.argsort(rank, kind="stable")]
            return u[: len(u) - least_overlap(len(u), percent) + 1].view(np.int64)

        def run(texts):
            n, sets, maps, wides, prefixes = [], [], [], [], []
            for u in shingle_sets(texts, size):
                key = xxhash.xxh3_128_digest(u.tobytes()) if len(u) else None
                n.append(len(u))
                sets.append(key)
                new = key is not None and key not in done
                if new:
                    if len(done) >= 1 << 20:
                        done.clear()
                    done.add(key)
                maps.append(bitmap(u) if new else None)
                wides.append(wide(u) if new else None)
                prefixes.append(first(u) if new else None)
            return n, sets, maps, wides, prefixes

        return run

    x = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.xxhash64(F.col(f"`{text}`")).alias("body"),
        F.col(f"`{text}`").alias("text"),
    )
    fields = "n long, set binary, bitmap binary, wide binary, prefix array<long>"
    return with_text_columns(x, task, fields, "text", ["row", "doc_id", "body"], binary=True)


def class_of(key: str = "set") -> Column:
    return F.xxhash64(key)


def band_of(n: str, percent: int):
    """Number of a set size's band; sizes within a ratio of 100 / ``percent`` lie in one band or in neighbouring ones."""
    return F.floor(F.log(n) / F.log(F.lit(100.8 / percent))).cast("int")


def crowded(rows: DataFrame, percent: int) -> DataFrame:
    """Tiles from rows (token, cls, n, pos), two kinds of results in one pass.

    Tokens of 2 to ``SMALL`` classes give pairs (leader, cls), with token null,
    that sizes and positions allow: if the token is the first that two sets share, no
    more can follow than the shorter rest holds.  Tokens of more classes keep
    their rows, with the first class of token and band as ``leader``.

    Rows arrive sorted by token, band and class, which drops a class that several
    tasks have sent; a task holds a batch and at most ``SMALL`` rows before it.
    """
    names = ["token", "cls", "n", "leader"]

    def pairs(cls, n, pos, start, count):
        """All pairs within the runs of ``count`` rows from ``start`` on."""
        first = np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        after = np.repeat(start + count, count) - first - 1
        i = np.repeat(first, after)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
        most = 1 + np.minimum(n[i] - 1 - pos[i], n[j] - 1 - pos[j])
        total = n[i] + n[j]
        most = np.minimum(most, np.minimum(n[i], n[j]))
        ok = 100 * most >= percent * (total - most)
        i, j = i[ok], j[ok]
        return pa.RecordBatch.from_arrays(
            [pa.nulls(len(i), pa.int64()), pa.array(np.maximum(cls[i], cls[j])), pa.nulls(len(i), pa.int32()), pa.array(np.minimum(cls[i], cls[j]))],
            names,
        )

    def scan(batches):
        held = large = last = None  # a run that may go on; token, band and leader of one that has shown to be large
        for batch in batches:
            if not batch.num_rows:
                continue
            token, cls = batch.column("token").to_numpy(), batch.column("cls").to_numpy()
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
            fresh[0] = last != (token[0], cls[0])
            last = (token[-1], cls[-1])
            batch = batch.filter(pa.array(fresh))
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            token, band, cls, n, pos = (t[c].to_numpy() for c in ("token", "band", "cls", "n", "pos"))
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            start = np.flatnonzero(new)
            count = np.diff(np.append(start, len(token)))
            big = count > SMALL
            big[0] |= large is not None and token[0] == large[0]
            group = new.copy()
            group[1:] |= band[1:] != band[:-1]
            leader = cls[np.maximum.accumulate(np.where(group, np.arange(len(token)), 0))]
            if large is not None:
                leader[(token == large[0]) & (band == large[1])] = large[2]
            of = np.repeat(big, count)
            if of.any():
                yield pa.RecordBatch.from_arrays([pa.array(token[of]), pa.array(cls[of]), pa.array(n[of].astype(np.int32)), pa.array(leader[of])], names)
            large = (token[-1], band[-1], leader[-1]) if big[-1] else None
            small = ~big
            small[-1] = False
            if (small & (count > 1)).any():
                yield pairs(cls, n, pos, start[small], count[small])
            held = None if big[-1] else t.slice(int(start[-1]))
        if held is not None and len(held) > 1:
            cls, n, pos = (held[c].to_numpy().astype(np.int64) for c in ("cls", "n", "pos"))
            yield pairs(cls, n, pos, np.array([0]), np.array([len(held)]))

    spark = rows.sparkSession
    x = rows.withColumn("band", band_of("n", percent)).repartition(partitions(spark), "token")
    return x.sortWithinPartitions("token", "band", "cls").mapInArrow(scan, "token long, cls long, n int, leader long")


def sets_of(documents: DataFrame, wanted: DataFrame, doc_id: str, text: str, cut: Callable) -> DataFrame:
    """cls and sorted set of the wanted classes (cls, doc_id, set), read anew from the document named there.

    ``cut`` gives a function from texts to the distinct sets of each.  A filter of
    fixed size, by id, keeps other texts out of this pass; it only saves work,
    since sets are then joined to their classes.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    got = (
        wanted.select(F.shiftright(bit, 5).cast("int").alias("word"), (bit % 32).cast("int").alias("bit"))
        .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toPandas()
    )
    words = np.zeros(FILTER_BITS // 32, np.uint32)
    words[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).astype(np.uint32)
    shared = documents.sparkSession.sparkContext.broadcast(words)

    def scan(batches):
        table, of = shared.value, cut()
        for batch in batches:
            bits = batch.column(0).to_numpy()
            ok = np.flatnonzero(table[bits >> 5] >> (bits & 31).astype(np.uint32) & 1)
            texts = batch.column(2).take(pa.array(ok)).to_pylist()
            ids = batch.column(1).take(pa.array(ok)).to_pylist()
            rows = [(i, u.tobytes()) for i, found in zip(ids, of(texts), strict=True) for u in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in rows], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(u) for _, u in rows], pa.binary()),
                    pa.array([u for _, u in rows], pa.binary()),
                ],
                ["doc_id", "set", "hashes"],
            )

    x = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    sets = x.select(bit, "doc_id", "text").mapInArrow(scan, "doc_id long, set binary, hashes binary")
    names = wanted.select("cls", F.col("doc_id").alias("_doc"), F.col("set").alias("_set"))
    same = (F.col("set") == F.col("_set")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    return sets.join(names, same).select("cls", "hashes")


def verified(pairs: DataFrame, maps: DataFrame, sets_for: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """The pairs (src, dst) of the wanted similarity: bit counts first, then sorted intersection."""

    def bounded(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(-1, BITMAP // 64) for i in (4, 5))
            total = b.column(2).to_numpy() + b.column(3).to_numpy()
            most = (total - np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)) // 2
            ok = 100 * most >= percent * (total - most)
            large = np.flatnonzero(ok & b.column(6).is_valid().to_numpy(False) & b.column(7).is_valid().to_numpy(False))
            for i in large.tolist():
                most = (int(total[i]) - differing(b.column(6)[i].as_py(), b.column(7)[i].as_py())) // 2
                ok[i] = 100 * most >= percent * (int(total[i]) - most)
            yield b.select(["src", "dst"]).filter(pa.array(ok))

    def exact(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    def joined(x, side, name, *cols):
        other = side.select(F.col("cls").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in cols])
        return x.join(other, name)

    spark, facts = pairs.sparkSession, ("n", "bitmap", "wide")
    x = joined(joined(pairs.select("src", "dst").distinct(), maps, "src", *facts), maps, "dst", *facts)
    x = x.select("src", "dst", *[f"{side}_{c}" for c in facts for side in ("src", "dst")])
    x, path = store(x.mapInArrow(bounded, "src long, dst long"), "bounded")
    # sets are read for the classes that are still in question
    cls = x.select(F.explode(F.array("src", "dst")).alias("cls")).distinct()
    sets, sets_path = store(sets_for(maps.join(cls, "cls", "left_semi")), "sets")
    y = joined(joined(x, sets, "src", "hashes"), sets, "dst", "hashes")
    out, _ = store(y.select("src", "dst", "src_hashes", "dst_hashes").mapInArrow(exact, "src long, dst long"), "links")
    remove(spark, path, sets_path)
    return out


def tiles(rows: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Open rows (token, cls, n, label) dealt to tiles of size bands, with their bitmaps.

    ``side`` tells the two blocks of a tile apart; in a tile of one block it is -1.
    """
    x = rows.withColumn("band", band_of("n", percent))
    blocks = x.groupBy("token", "band").agg(F.count(F.lit(1)).alias("c"))
    blocks = blocks.groupBy("token").agg(
        F.sum("c").alias("rows"),
        F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("c") / BLOCK).cast("int").alias("k")))).alias("ks"),
    )
    x = attach(x, blocks, ["token"], "cls")
    x = x.withColumn("i", F.pmod(F.xxhash64("cls"), F.col("ks")[F.col("band")]).cast("int"))

    # the blocks that this one meets: of its own band, of the next and of the one before
    own = (
        "transform(sequence(0, ks[band] - 1), j -> named_struct('b1', band, 'i1', least(i, j), 'b2', band, "
        "'i2', greatest(i, j), 'side', CASE WHEN i = j THEN -1 WHEN i < j THEN 0 ELSE 1 END))"
    )
    above = (
        "CASE WHEN ks[band + 1] > 0 THEN transform(sequence(0, ks[band + 1] - 1), j -> named_struct("
        "'b1', band, 'i1', i, 'b2', band + 1, 'i2', j, 'side', 0)) ELSE array() END"
    )
    below = (
        "CASE WHEN ks[band - 1] > 0 THEN transform(sequence(0, ks[band - 1] - 1), j -> named_struct("
        "'b1', band - 1, 'i1', j, 'b2', band, 'i2', i, 'side', 1)) ELSE array() END"
    )
    one = "array(named_struct('b1', 0, 'i1', 0, 'b2', 0, 'i2', 0, 'side', -1))"
    dealt = F.expr(f"CASE WHEN rows <= {BLOCK} THEN {one} ELSE concat({own}, {above}, {below}) END")
    x = x.withColumn("tile", F.explode(dealt)).select("token", "tile.*", "cls", F.col("n").cast("long").alias("n"), "label")
    return x.join(maps.select("cls", "bitmap", "wide"), "cls")


def possible(i: np.ndarray, j: np.ndarray, total: np.ndarray, wides: list[bytes | None], percent: int) -> np.ndarray:
    """Which pairs of rows their wide bitmaps allow, at the smaller width of the two."""
    width = np.array([len(w) // 8 if w else 0 for w in wides])
    both, ok = np.minimum(width[i], width[j]), np.ones(len(i), bool)
    for size in np.unique(both[both > 0]).tolist():
        of = np.flatnonzero(both == size)
        rows = np.unique(np.concatenate([i[of], j[of]]))
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(wides[r], np.uint64).reshape(-1, size), axis=0) for r in rows.tolist()])
        step = max(1, (1 << 21) // size)
        for at in range(0, len(of), step):
            k = of[at : at + step]
            x, y = folded[np.searchsorted(rows, i[k])], folded[np.searchsorted(rows, j[k])]
            most = (total[k] - np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)) // 2
            ok[k] = 100 * most >= percent * (total[k] - most)
    return ok


def close_pairs(dealt: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs of a tile, of different labels, whose bitmaps allow the similarity.

    If ``best``, one for two labels; ``held`` tells that others of the tile stand behind.
    """
    key = ["token", "b1", "i1", "b2", "i2"]

    def meet(t: pa.Table):
        cols = [t[c].to_numpy() for c in key]
        n, label, cls, side = (t[c].to_numpy() for c in ("n", "label", "cls", "side"))
        maps = np.frombuffer(b"".join(t["bitmap"].to_pylist()), np.uint64).reshape(-1, BITMAP // 64)
        wides = t["wide"].to_pylist()
        new = np.ones(len(n), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        run = np.cumsum(new) - 1
        ends = np.append(np.flatnonzero(new)[1:], len(n))[run]
        after = ends - np.arange(len(n)) - 1  # rows of the tile behind each row
        upto = np.cumsum(after)
        at = 0
        while at < len(n):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            c = after[at:stop]
            i = np.repeat(np.arange(at, stop), c)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
            total, low = n[i] + n[j], np.minimum(n[i], n[j])
            ok = (label[i] != label[j]) & (100 * low >= percent * (total - low)) & ((side[i] < 0) | (side[i] != side[j]))
            i, j, total = i[ok], j[ok], total[ok]
            most = (total - np.bitwise_count(maps[i] ^ maps[j]).sum(axis=1, dtype=np.int64)) // 2
            ok = 100 * most >= percent * (total - most)
            i, j, total, spare = i[ok], j[ok], total[ok], (most / total)[ok]
            ok = possible(i, j, total, wides, percent)
            i, j, spare = i[ok], j[ok], spare[ok]
            if best and len(i):
                a, b = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
                order = np.lexsort((-spare, b, a, run[i]))
                r, a, b = run[i][order], a[order], b[order]
                first = np.ones(len(r), bool)
                first[1:] = (r[1:] != r[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                behind = np.bincount(r[~first], minlength=run[-1] + 1) > 0
                i, j = i[order[first]], j[order[first]]
                held = behind[run[i]]
            else:
                held = np.zeros(len(i), bool)
            if len(i):
                out = [cols[0][i], np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j]), held]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, out)), ["token", "src", "dst", "held"])
            at = stop

    def scan(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            last = [t[c][len(t) - 1].as_py() for c in key]
            same = np.all([t[c].to_numpy() == v for c, v in zip(key, last, strict=True)], axis=0)
            start = int(np.flatnonzero(same)[0])
            if start:
                yield from meet(t.slice(0, start))
            held = t.slice(start)
        if held is not None:
            yield from meet(held)

    spark = dealt.sparkSession
    x = dealt.repartition(partitions(spark), *key).sortWithinPartitions(*key)
    return x.mapInArrow(scan, "token long, src long, dst long, held boolean")


def tokens_again(reps: DataFrame) -> DataFrame:
    """Rows (token, cls, n) of the tokens of ``reps`` (prefix, cls, n) that may occur again."""
    listed = again_filter(reps.select("prefix"))

    def few(batches):
        for b in batches:
            token = b.column(0).flatten().to_numpy()
            ok = listed(token)
            of = pa.array(np.repeat(np.arange(b.num_rows), b.column(0).value_lengths().to_numpy())[ok])
            yield pa.RecordBatch.from_arrays([pa.array(token[ok]), b.column(1).take(of), b.column(2).take(of)], ["token", "cls", "n"])

    return reps.select("prefix", "cls", F.col("n").cast("int").alias("n")).mapInArrow(few, "token long, cls long, n int")


def link_classes(
    table: DataFrame, sets_for: Callable[[DataFrame], DataFrame], percent: int, ordered: bool = True
) -> DataFrame:
    """node and label of the classes that have links to others.

    ``table`` has doc_id, n, set, bitmaps and prefix (the tokens on which
    classes meet; ``ordered`` if they are the first of the set in an order that all
    sets share, else bands, of which few occur again); a class is named as by
    ``class_of``.  ``sets_for`` reads the sets.
    """
    spark = table.sparkSession
    reps = table.filter("prefix is not null").withColumn("cls", class_of())
    if ordered:
        rows = reps.select(F.posexplode("prefix").alias("pos", "token"), "cls", F.col("n").cast("int").alias("n"))
    else:
        rows = tokens_again(reps).withColumn("pos", F.lit(0))
    met, met_path = store(crowded(rows, percent), "met")
    pairs = met.filter("leader <> cls").select(F.col("leader").alias("src"), F.col("cls").alias("dst"))
    shared = met.filter("token is not null").select("token", "cls", "n")
    used = met.select(F.explode(F.array("cls", "leader")).alias("cls")).distinct()
    maps, maps_path = store(
        reps.select("cls", "n", "bitmap", "wide", "doc_id", "set").join(used, "cls", "left_semi").dropDuplicates(["cls"]), "maps"
    )

    def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
        x = rows.join(labels.withColumnRenamed("node", "cls").withColumnRenamed("label", "_label"), "cls", "left")
        return x.select("token", "cls", "n", F.coalesce("_label", "cls").alias("label"))

    def still_open(rows: DataFrame) -> tuple[DataFrame, str]:
        """Rows whose token has a class of another label in their size band or one beside it."""
        rows = rows.withColumn("band", band_of("n", percent))
        x = rows.groupBy("token", "band").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        x = x.withColumn("band", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)))
        x = x.groupBy("token", "band").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high")
        return store(attach(rows, x.select("token", "band"), ["token", "band"], "cls", how="left_semi").drop("band"), "open")

    links = verified(pairs, maps, sets_for, percent)
    labels = components(links)
    left, left_path = still_open(labelled(shared, labels))
    tested, tested_path = store(close_pairs(tiles(left, maps, percent), percent, best=True), "tested")
    if not tested.isEmpty():
        links = links.union(verified(tested, maps, sets_for, percent))
        labels = components(links)
        # tiles where pairs stood behind the best one of their two labels
        again = tested.filter("held").select("token").distinct()
        if not again.isEmpty():
            rest, rest_path = still_open(labelled(attach(left, again, ["token"], "cls", how="left_semi"), labels))
            more = close_pairs(tiles(rest, maps, percent), percent, best=False).join(tested.select("src", "dst"), ["src", "dst"], "left_anti")
            more, more_path = store(more, "more")
            if not more.isEmpty():
                links = links.union(verified(more, maps, sets_for, percent))
                labels = components(links)
            remove(spark, rest_path, more_path)
    remove(spark, met_path, maps_path, left_path, tested_path)
    return labels


def find_groups(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = 80
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Words are runs between blanks, tabs and line ends, A-Z in lower case; a set
    holds the distinct runs of ``size`` words, or the whole sequence if there are
    fewer.  One row per row of ``documents``: row (a number), doc_id, body,
    n_shingles, component_id (smallest doc_id reachable by links) and ``first``
    (the component's one row that a deduplication keeps).  A text that is null
    or has no words has 0 shingles, no links, and its own id.  A null id comes
    after all others; repeated rows share a set and a component.  Other columns
    are ignored; an empty table gives an empty result.
    """
    table, _ = store(shingled(documents, doc_id, text, size, percent), "shingled")

    def cut():
        return lambda texts: [[u] if len(u) else [] for u in shingle_sets(texts, size)]

    labels = link_classes(table, lambda maps: sets_of(documents, maps, doc_id, text, cut), percent)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    first = table.filter("n > 0").groupBy("set").agg(F.min(order).alias("best"))
    named = first.withColumn("node", class_of()).join(labels, "node", "left")
    named, _ = store(named.select("set", F.coalesce("label", "node").alias("label"), "best"), "named")
    smallest = named.groupBy("label").agg(F.min("best").alias("best"))
    named, _ = store(named.select("set", "label").join(smallest, "label").select("set", "best"), "groups")
    x = table.select("row", "doc_id", "body", "n", "set").join(named, "set", "left")
    alone = F.col("best").isNull()
    return x.select(
        "row", "doc_id", "body", F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"),
        (alone | (F.col("row") == F.col("best.row"))).alias("first"),
    )


def without_near_copies(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = 80) -> DataFrame:
    """The first document of each component, with all its columns; texts without words all stay."""
    found = find_groups(documents, doc_id, text, size, percent).filter("n_shingles > 0").withColumnRenamed("first", "kept")
    return keep_rows(documents, found, doc_id, F.xxhash64(F.col(f"`{text}`")), "body")
