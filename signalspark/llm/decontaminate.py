"""Benchmark decontamination: exact containment of item windows in documents.

A window is contained only if all its shingles are, so the necessary prefix in
an order by rarity is its one rarest shingle.  Documents meet windows on that
shingle; its place in the window gives the start, which must leave room for the
whole window (positional and length bounds), and the words are then compared.

A benchmark of checked size is broadcast as an index, and documents are read in
one pass without a shuffle.  A larger one is joined: a filter of fixed size
keeps shingles that no window needs where they are read, the rest is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from signalspark.llm.shingles import rolled, word_hashes
from signalspark.llm.tables import store
from signalspark.llm.textmap import slices, with_text_columns

WINDOW = 10
SHINGLE = 5
#: Benchmarks of at most so many bytes of text are broadcast.
INDEXED_BYTES = 8 << 20
MASK_BITS = 22
FILTER_BITS = 26
#: Digits, letters in lower case and all bytes of other code points; the rest parts words (fixed values).
TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
FIELDS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def low_bits(h: np.ndarray, bits: int) -> np.ndarray:
    return (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def hashed(texts: Sequence[bytes | None]):
    """Word hashes of each text, a few hundred texts at once."""
    for at in range(0, len(texts), 256):
        yield from word_hashes(texts[at : at + 256], TABLE)


class Index:
    """Windows of items, by their rarest shingle.

    ``shingles`` are all distinct (size, hash) of windows; ``choose`` orders them
    by their count in the documents and keeps each window's rarest, the first if
    several are.
    """

    def __init__(self, items: list[tuple[int | None, bytes | None]], window: int = WINDOW, shingle: int = SHINGLE) -> None:
        place: dict[tuple, int] = {}
        self.items, self.windows = [], []  # windows: words, items that have them
        for item, text in items:
            w = words(text)
            length = min(window, len(w))
            for i in range(len(w) - length + 1 if w else 0):
                key = tuple(w[i : i + length])
                at = place.setdefault(key, len(place))
                if at == len(self.windows):
                    self.windows.append((key, set()))
                if item is not None:
                    self.windows[at][1].add(item)
        self.length = np.array([len(k) for k, _ in self.windows], np.int64)
        hashes = word_hashes([b" ".join(k) for k, _ in self.windows])
        self.full = np.array([rolled(h, len(h))[0] for h in hashes], np.uint64)
        self.size = np.minimum(self.length, shingle)
        self.parts = [rolled(h, s) for h, s in zip(hashes, self.size, strict=True)]
        self.shingles = {int(s): np.unique(np.concatenate([p for p, z in zip(self.parts, self.size, strict=True) if z == s])) for s in np.unique(self.size)}
        self.chosen: dict[int, tuple] = {}

    def lookups(self, tokens: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        out = {}
        for s, t in tokens.items():
            mask = np.zeros(1 << MASK_BITS, bool)
            mask[low_bits(t, MASK_BITS)] = True
            out[s] = (t, mask)
        return out

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        by_size: dict[int, list] = {}
        for w, (s, part) in enumerate(zip(self.size, self.parts, strict=True)):
            rare = counts[int(s)][np.searchsorted(self.shingles[int(s)], part)]
            at = int(rare.argmin())
            by_size.setdefault(int(s), []).append((int(part[at]), w, at))
        for s, rows in by_size.items():
            rows.sort()
            token = np.array([r[0] for r in rows], np.uint64)
            tokens, start, n = np.unique(token, return_index=True, return_counts=True)
            self.chosen[s] = (tokens, start, n, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        self.parts = []


def hits(hashes: np.ndarray, size: int, tokens: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a document whose shingle of ``size`` words is among the sorted tokens, and which."""
    if len(hashes) < size or not len(tokens):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = rolled(hashes, size)
    at = np.flatnonzero(mask[low_bits(h, MASK_BITS)])
    if not len(at):
        return at, at
    k = np.searchsorted(tokens, h[at])
    k[k == len(tokens)] = 0
    ok = tokens[k] == h[at]
    return at[ok], k[ok]


def shingle_counts(documents: DataFrame, index: Index, text: str) -> dict[int, np.ndarray]:
    """How often each shingle of the index occurs in all documents."""
    shared = documents.sparkSession.sparkContext.broadcast(index.lookups(index.shingles))

    def count(batches):
        found = {s: np.zeros(len(t), np.int64) for s, (t, _) in shared.value.items()}
        for batch in batches:
            texts = (t for at, n in slices(batch.column(0)) for t in hashed(batch.column(0).slice(at, n).to_pylist()))
            for hashes in texts:
                for s, (tokens, mask) in shared.value.items():
                    k = hits(hashes, s, tokens, mask)[1]
                    if len(k):
                        found[s] += np.bincount(k, minlength=len(tokens))
        for s, n in found.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), s)), pa.array(k), pa.array(n[k])], ["size", "k", "n"])

    out = documents.select(F.col(f"`{text}`").cast("binary")).mapInArrow(count, "size long, k long, n long")
    got = out.groupBy("size", "k").agg(F.sum("n").alias("n")).toPandas()
    counts = {s: np.zeros(len(t), np.int64) for s, t in index.shingles.items()}
    for s, rows in got.groupby("size"):
        counts[int(s)][rows["k"]] = rows["n"]
    return counts


def matches(text: bytes | None, hashes: np.ndarray, index: Index, lookups: dict) -> list[tuple[int, int]]:
    """(start, window) of every occurrence of a window in a document."""
    out, full, w = [], {}, None
    for s, (tokens, first, n, window, offset) in index.chosen.items():
        at, k = hits(hashes, s, tokens, lookups[s][1])
        if not len(at):
            continue
        step = np.arange(n[k].sum()) - np.repeat(np.cumsum(n[k]) - n[k], n[k])
        row = np.repeat(first[k], n[k]) + step
        found, start = window[row], np.repeat(at, n[k]) - offset[row]
        length = index.length[found]
        ok = (start >= 0) & (start + length <= len(hashes))
        for size in np.unique(length[ok]):
            if size not in full:
                full[size] = rolled(hashes, int(size))
            of = np.flatnonzero(ok & (length == size))
            of = of[full[size][start[of]] == index.full[found[of]]]
            w = words(text) if w is None and len(of) else w
            for a, x in zip(start[of].tolist(), found[of].tolist(), strict=True):
                if tuple(w[a : a + size]) == index.windows[x][0]:
                    out.append((a, x))
    return out


def summary(n: int, spans: list[tuple[int, int]], items: set) -> tuple:
    edge = np.zeros(n + 1, np.int64)
    for a, length in spans:
        edge[a] += 1
        edge[a + length] -= 1
    hit = int((np.cumsum(edge)[:n] > 0).sum())
    joined = ",".join(sorted(map(str, items)))
    return n, hit, len(items), hashlib.sha256(joined.encode()).hexdigest(), hit > 0


def by_index(documents: DataFrame, items: list, text: str, keep: list[str] | None, window: int, shingle: int) -> DataFrame:
    index = Index(items, window, shingle)
    index.choose(shingle_counts(documents, index, text))
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def task():
        index = shared.value
        lookups = index.lookups({s: c[0] for s, c in index.chosen.items()})

        def run(texts):
            rows = []
            for text, hashes in zip(texts, hashed(texts), strict=True):
                found = matches(text, hashes, index, lookups)
                items = set().union(*(index.windows[x][1] for _, x in found)) if found else set()
                rows.append(summary(len(hashes), [(a, int(index.length[x])) for a, x in found], items))
            return list(zip(*rows, strict=True)) if rows else [[]] * 5

        return run

    return with_text_columns(documents, task, FIELDS, text, keep, binary=True)


def by_join(documents: DataFrame, benchmark: DataFrame, item_id: str, text: str, keep: list[str], window: int, shingle: int) -> DataFrame:
    """The same by shuffles, for a benchmark of any size."""
    spark = documents.sparkSession

    def cut(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(text)
                length = min(window, len(w))
                for i in range(len(w) - length + 1 if w else 0):
                    part = b" ".join(w[i : i + length])
                    rows.append((item, part, length, rolled(word_hashes([part])[0], min(shingle, length)).view(np.int64)))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            types = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["item", "words", "length", "tokens"])

    windows = benchmark.select(F.col(f"`{item_id}`").cast("long"), F.col(f"`{text}`").cast("binary")).mapInArrow(
        cut, "item long, words binary, length long, tokens array<long>"
    )
    windows, _ = store(windows, "windows")
    parts = windows.select("words", "length", F.posexplode("tokens").alias("offset", "token")).distinct()
    parts, _ = store(parts, "window-shingles")
    sizes = [r[0] for r in parts.select(F.least("length", F.lit(shingle))).distinct().collect()]  # at most ``shingle`` numbers

    def mask_of(tokens: DataFrame):
        bit = F.pmod("token", F.lit(1 << FILTER_BITS))
        got = (
            tokens.select(F.shiftright(bit, 5).cast("int").alias("word"), (bit % 32).cast("int").alias("bit")).groupBy("word")
            .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toPandas()
        )
        out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
        out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).astype(np.uint32)
        return spark.sparkContext.broadcast(out)

    def positions(hashes, size, bits):
        if len(hashes) < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = rolled(hashes, size)
        low = low_bits(h, FILTER_BITS)
        at = np.flatnonzero(bits[low >> 5] >> (low & 31).astype(np.uint32) & 1)
        return at, h[at]

    all_bits = mask_of(parts)

    def count(batches):
        for batch in batches:
            found = [positions(h, s, all_bits.value)[1] for h in hashed(batch.column(0).to_pylist()) for s in sizes]
            token, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    counts = documents.select(F.col(f"`{text}`").cast("binary")).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rare = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "token")).alias("r")
    needed = parts.join(counts, "token", "left").groupBy("words", "length").agg(rare)
    needed, _ = store(needed.select("words", "length", "r.offset", "r.token"), "needed")
    bits = mask_of(needed)

    def task():
        def run(texts):
            n, found = [], []
            for text, hashes in zip(texts, hashed(texts), strict=True):
                w = words(text)
                n.append(len(w))
                rows = []
                for s in sizes:
                    for p, h in zip(*(x.tolist() for x in positions(hashes, s, bits.value)), strict=True):
                        low = max(0, p - window)
                        rows.append({"token": h - (1 << 64) * (h >> 63), "p": p, "low": low, "near": w[low : p + window]})
                found.append(rows)
            return n, found

        return run

    fields = "n_words long, found array<struct<token:long,p:long,low:long,near:array<binary>>>"
    names = [f"_k{i}" for i in range(len(keep))]  # carried columns may have any name
    numbered = documents.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)],
        F.col(f"`{text}`").alias("_words"), F.monotonically_increasing_id().alias("_row"),
    )
    base, _ = store(with_text_columns(numbered, task, fields, "_words", [*names, "_row"], binary=True), "near")
    near = base.select("_row", F.explode("found").alias("f")).select("_row", "f.*")
    salt = 8  # a needed shingle may stand in a third of all documents
    near = near.withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(salt)).cast("int"))
    dealt = needed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    x = near.join(dealt, ["token", "salt"]).withColumn("start", F.col("p") - F.col("offset")).filter("start >= 0")
    x = x.filter(F.expr("array_join(transform(slice(near, start - low + 1, length), y -> hex(y)), '20') = hex(words)"))
    x = x.select("_row", "start", "length", "words").distinct()
    spans = x.groupBy("_row").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    spans = spans.select("_row", F.expr("size(array_distinct(flatten(transform(spans, s -> sequence(s.start, s.start + s.length - 1)))))").alias("hit"))
    items = x.select("_row", "words").join(windows.select("words", "item").filter("item is not null").distinct(), "words")
    items = items.groupBy("_row").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    out = base.drop("found").join(spans, "_row", "left").join(items, "_row", "left")
    found = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    return out.select(
        *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)],
        "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), F.sha2(F.array_join(found, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def find_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    item_id: str = "item_id",
    text: str = "text",
    keep: list[str] | None = None,
    window: int = WINDOW,
    shingle: int = SHINGLE,
    indexed_bytes: int = INDEXED_BYTES,
) -> DataFrame:
    """Words of each document that lie in an occurrence of a benchmark window.

    Words hold digits, letters (A-Z in lower case) and any code point from
    U+0080; a window is ``window`` consecutive words of an item, or all of a
    shorter one.  Adds n_words, n_hit, n_items (distinct items with occurring
    windows), items_sha256 (of their ids, sorted as strings, comma-joined) and
    contaminated (n_hit > 0) to the columns in ``keep``; columns of these names
    are replaced.  Null texts have no words; items without words no windows; an
    item without id marks words but is not listed; repeated items count once.
    Empty tables: no rows, or no hits.
    """
    keep = [c for c in (documents.columns if keep is None else keep) if c not in {f.split()[0] for f in FIELDS.split(", ")}]
    size = benchmark.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("binary"))).alias("n")).first()["n"] or 0
    if size > indexed_bytes:
        return by_join(documents, benchmark, item_id, text, keep, window, shingle)
    rows = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{text}`").cast("binary").alias("t")).collect()
    return by_index(documents, [(r["i"], bytes(r["t"]) if r["t"] is not None else None) for r in rows], text, keep, window, shingle)
