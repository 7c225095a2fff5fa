"""Deduplication and decontamination against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from brute import components, copies, docs, leaks, near_groups, none_last, repeated_words, shingles, similar
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from signalspark.llm import decontaminate, exact_dedup, golomb, ngram_join, paragraph_dedup
from signalspark.llm.components import components as spark_components
from signalspark.llm.shingles import PLAIN, word_hashes


@given(st.lists(st.integers(0, 1 << 40), unique=True), st.integers(0, 1 << 20))
@settings(max_examples=100, deadline=None)
def test_golomb_round_trip(values, spare):
    x = np.array(sorted(values), np.int64)
    k, unary, rest = golomb.encode(x, int(x[-1]) + 1 + spare if len(x) else 0)
    assert golomb.decode(len(x), k, unary, rest).tolist() == x.tolist()


def test_word_hashes_follow_words():
    big = "x" * 300 + " yy" * 600_000
    texts = [None, "", " ", "A b\tC", "a b c", "é É", big, "ab" * 40, "ab" * 41]
    got = word_hashes([None if t is None else t.encode() for t in texts])
    assert [len(h) for h in got] == [len((t or "").encode().translate(PLAIN).split()) for t in texts]
    assert got[3].tolist() == got[4].tolist() and len(set(got[5].tolist())) == 2
    assert len(set(got[6].tolist())) == 2 and got[7][0] != got[8][0]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 301), (301, 301)]
    got = {r.node: r.label for r in spark_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300}


COPIES = [(5, "a  b"), (3, "a b"), (3, "a b"), (9, "a\tb"), (4, " a b"), (6, None), (7, ""), (8, " "), (1, "\n"), (None, "q"), (None, "q"), (None, "a b"), (2, "z" * 50_000), (12, "z" * 50_000)]


def test_exact_copies(spark):
    df = docs(spark, COPIES, chunk=F.lit(1), row=F.lit("x"), text_sha256=F.lit("clash"))
    got = exact_dedup.find_copies(df).collect()
    key = lambda r: none_last((r[0], r[1], r[2])) + (r[3],)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(copies(COPIES), key=key)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)
    stay = exact_dedup.without_copies(df)
    assert stay.columns == df.columns and stay.count() == len(kept)
    assert exact_dedup.find_copies(docs(spark, [])).count() == 0


def test_many_copies_over_many_chunks(spark):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i // 2}") for i in range(600)]
    got = exact_dedup.find_copies(docs(spark, rows).repartition(13)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == sorted(copies(rows))


def near_copies(seed, groups=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    rows = []
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 9, 40, 120, 900]))]
        for _ in range(rng.choice([1, 2, 5, 12])):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 12)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append(" ".join(w) + (" " + " ".join(passage) if g % 3 == 0 else ""))
    return rows


@pytest.mark.parametrize(("block", "small"), [(512, 8), (3, 1)])
def test_near_copies(spark, monkeypatch, block, small):
    """The second case sends every tile through leaders and blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SMALL", small)
    texts = [*near_copies(block), None, "", " \n", "One two", "one  TWO", "one two three", "x" * 20_000, "X" * 20_000, "é É", "É É"]
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(None, "one two"), (None, texts[0]), (500, texts[3]), (500, texts[3])]
    df = docs(spark, rows, label=F.lit(0), set=F.lit("x"), token=F.lit(1), n=F.lit(2)).repartition(5)
    got = ngram_join.find_groups(df).collect()
    want = near_groups(rows)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=none_last) == sorted(want, key=none_last)
    stay = ngram_join.without_near_copies(df)
    sets = [shingles(t) for _, t in rows]
    label = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j])])
    assert stay.columns == df.columns and stay.count() == len(set(label))


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(300)}" for _ in range(150)]
    rows = []
    for i in range(250):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    got = ngram_join.find_groups(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(near_groups(rows))


def test_near_copies_of_nothing(spark):
    assert ngram_join.find_groups(docs(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_join.find_groups(docs(spark, [None])).select("n_shingles", "component_id").collect()] == [(0, 0)]


def test_bitmaps_never_bound_too_low():
    rng = np.random.default_rng(5)
    for n in (1, 40, 600, 5000):
        a = rng.integers(0, 1 << 63, n, np.uint64)
        b = np.unique(np.concatenate([a[: n * 9 // 10], rng.integers(0, 1 << 63, n // 9 + 1, np.uint64)]))
        differ = len(np.setxor1d(a, b))
        assert ngram_join.differing(ngram_join.bitmap(a), ngram_join.bitmap(b)) <= differ
        x, y = ngram_join.wide(a), ngram_join.wide(b)
        assert (x is None) == (2 * n <= ngram_join.BITMAP) and (x is None or y is None or ngram_join.differing(x, y) <= differ)


ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"), (10, "one two three"), (2, "single"), (3, None), (4, "?!"), (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"), (None, "null item here"), (7, "same same same same same same same same same same same same"), (20, "ünï côdé wörds")]


def test_leaks_by_index_and_by_join(spark):
    item = ITEMS[0][1]
    rows = [
        (1, item), (2, "x " + item.replace(" ", "--") + " y"), (3, " ".join(item.split()[:9])), (4, "ONE, two; three four one two three"),
        (5, None), (6, ""), (7, "nothing to see"), (8, "a single word"), (9, "null item here"), (None, "same " * 30), (11, "Ünï côdé wörds ünï côdé WÖRDS"),
        (12, "pad " * 20_000 + item), (2, "x " + item.replace(" ", "--") + " y"), (13, " ".join(item.split()[1:11]) + " alpha beta"),
    ]
    want = sorted(leaks(rows, ITEMS), key=none_last)
    df = docs(spark, rows, n_hit=F.lit("clash"), token=F.lit(1), items=F.lit(2))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(3))
    for limit in (decontaminate.INDEXED_BYTES, 0):
        got = decontaminate.find_leaks(df, bench, keep=["doc_id"], indexed_bytes=limit)
        assert sorted(map(tuple, got.collect()), key=none_last) == want
    for limit in (decontaminate.INDEXED_BYTES, -1):
        assert decontaminate.find_leaks(df, bench.filter("false"), keep=["doc_id"], indexed_bytes=limit).filter("contaminated").count() == 0
        assert decontaminate.find_leaks(df.filter("false"), bench, indexed_bytes=limit).count() == 0


def test_low_thresholds_reach_across_sizes(spark):
    base = [f"b{i}" for i in range(104)]
    rows = [" ".join(base)] + [" ".join(base + [f"x{k}_{i}" for i in range(60)]) for k in range(12)] + ["something else"]
    got = {r.doc_id: r.component_id for r in ngram_join.find_groups(docs(spark, rows), percent=60).collect()}
    assert got == {i: 0 for i in range(13)} | {13: 13}


def test_repeated_paragraphs(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    para = lambda n: [rng.choice(words) for _ in range(n)]
    shared, long = para(60), para(400)
    near = list(shared)
    near[7] = "other"
    join = " ".join
    rows = [
        (10, join(para(50)) + "\n" + join(shared)), (11, join(near) + "\n" + join(para(30)) + "\n"), (12, join(shared).upper()),
        (13, join(para(80)) + "\n" + join(para(10))), (14, None), (15, ""), (16, join(long) + "\r\n" + join(para(40))), (17, "ü " + join(long)),
        (18, join(x := para(30)) + "\n" + join(x)), (19, "short line"), (20, "short line"), (None, join(shared)),
    ]
    df = docs(spark, rows, label=F.lit(0), start=F.lit(1), line=F.lit("x")).repartition(4)
    found = paragraph_dedup.find_repeats(df)
    got = {(r.doc_id, r.line): r for r in found.collect()}
    assert set(got) == {(10, 1), (11, 0), (12, 0), (None, 0), (16, 0), (17, 0)}
    assert {k for k, r in got.items() if not r.removed} == {(10, 1), (16, 0)}
    assert {r.keep_doc_id for r in got.values()} == {10, 16} and got[(11, 0)].group_size == 4
    text = dict(rows)
    assert all(text[i][r.start : r.end].count("\n") == 0 and len(text[i][r.start : r.end].split()) == r.n_words for (i, _), r in got.items())
    cut = {r.doc_id: r.text for r in paragraph_dedup.without_repeats(df, found).collect()}
    assert cut[10] == text[10] and cut[11] == text[11].partition("\n")[2] and cut[12] == "" and cut[14] is None
    assert paragraph_dedup.find_repeats(docs(spark, [])).count() == 0


def test_repeated_runs_against_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "Ü1"]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (50, 51, 59, 70, 140, 200, 49)] + [["again"] * 120]

    def text(parts, broken):
        out = ""
        for w in [w for part in parts for w in part]:
            out += (w.upper() if w.isascii() and rng.random() < 0.1 else w) + ("\n" if rng.random() < broken else " ")
        return out

    rows = [(None, None), (90, ""), (91, "a few words")]
    for i in range(40):
        filler = lambda: [rng.choice(vocabulary) for _ in range(rng.randint(0, 90))]
        parts = [filler()]
        for q in rng.sample(passages, rng.randint(0, 3)):
            a = rng.choice([0, 0, 10])
            parts += [q[a:], filler()]
        rows.append((i if i % 13 else None, text(parts, rng.choice([0, 0, 0.02, 0.2]))))
    rows += [rows[5], (200, rows[9][1]), (7, text([passages[5]], 0.1))]
    shared, later = repeated_words(rows)
    df = docs(spark, rows).repartition(3)
    found = paragraph_dedup.find_repeats(df)
    got = found.collect()
    text_of = {(r[0], r[1]): r[1] for r in rows}
    by_body = {(r.doc_id, r.body): r.text for r in df.select("doc_id", F.xxhash64("text").alias("body"), "text").collect()}
    covered, removed = {}, {}
    for r in got:
        t = by_body[r.doc_id, r.body]
        span = t[r.start : r.end]
        assert len(span.split()) == r.n_words and t[: r.start].count("\n") == r.line
        first = len(t[: r.start].split())
        covered.setdefault((r.doc_id, t), set()).update(range(first, first + r.n_words))
        if r.removed:
            removed.setdefault((r.doc_id, t), set()).update(range(first, first + r.n_words))
        if r.n_words >= 50:  # the row that is kept reads the same (rows of lines: nearly)
            assert any(k == r.keep_doc_id and shingles(span) & shingles(u[r.keep_start : r.keep_start + 2 * len(span)]) for k, u in text_of)
    for (i, w) in shared:
        assert w in covered[rows[i]]
    for (i, w) in later:
        if rows.count(rows[i]) == 1:
            assert w in removed[rows[i]]
    assert len(shared) > 2000 and any("\n" in by_body[r.doc_id, r.body][r.start : r.end].strip("\n") for r in got)
    # what is cut is held by another document
    kept = {w for r in paragraph_dedup.without_repeats(df, found).collect() for w in (r.text or "").lower().split()}
    assert kept == {w for _, t in rows for w in (t or "").lower().split()}


def test_runs_inside_longer_lines_and_broken_lines(spark):
    words = iter(f"w{i}" for i in range(10_000))
    some = lambda n: [next(words) for _ in range(n)]
    run, other = some(59), some(54)
    join = " ".join
    rows = [
        (85, join(some(40) + run + some(40))), (676, join(some(30) + run + some(54)) + "\n"),
        (39, join(some(9) + other[:15]) + "\n" + join(other[15:] + some(20))), (900, join(some(40) + other[:39]) + "\n" + join(other[39:] + some(50))),
        (1, join(some(200))),
    ]
    found = paragraph_dedup.find_repeats(docs(spark, rows))
    got = {r.doc_id: r for r in found.collect()}
    text = dict(rows)
    assert set(got) == {85, 676, 39, 900} and {i for i, r in got.items() if r.removed} == {676, 900}
    assert {i: text[i][r.start : r.end].split() for i, r in got.items()} == {85: run, 676: run, 39: other, 900: other}
    assert got[676].keep_doc_id == 85 and got[676].keep_start == got[85].start and got[676].group_size == 2
    cut = {r.doc_id: r.text for r in paragraph_dedup.without_repeats(docs(spark, rows), found).collect()}
    assert cut[676].split() == [w for w in text[676].split() if w not in run] and cut[900].split() == [w for w in text[900].split() if w not in other]
    assert cut[85] == text[85] and cut[1] == text[1]


def test_bands_find_nearly_all_pairs():
    rng = np.random.default_rng(8)
    met = 0
    for _ in range(300):
        both = rng.integers(0, 1 << 63, 80, np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 1 << 63, 10, np.uint64)]) for _ in range(2))
        met += bool(np.any(paragraph_dedup.bands(a) == paragraph_dedup.bands(b)))
    assert met >= 299


def test_rows_linked_with_nothing_all_stay(spark):
    rows = [(1, None), (1, None), (None, None), (None, None), (2, ""), (2, ""), (3, " \n"), (3, " \n"), (4, "a b c"), (4, "a b c"), (5, "a b c")]
    df = docs(spark, rows)
    kept = ngram_join.without_near_copies(df.repartition(3))
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted(rows[:8] + [(4, "a b c")], key=str)


def test_a_set_that_many_tasks_have(spark):
    """A class is sent by every task that has it, and counts once in a tile."""
    rng = random.Random(8)
    hot = [str(rng.randrange(1000)) for _ in range(60)]
    rows = [(i, " ".join(hot)) for i in range(90)] + [(100 + i, " ".join([*hot[:59], f"x{i}"])) for i in range(30)]
    rows += [(200 + i, " ".join(str(rng.randrange(1000)) for _ in range(40))) for i in range(20)]
    got = ngram_join.find_groups(docs(spark, rows).repartition(23)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(near_groups(rows))
