"""Periodic runs, repeated lines and the filter audit against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import cut_lines, docs, filter_effects, none_last, word_runs
from pyspark.sql import functions as F

from signalspark.llm import filter_audit, line_dedup, periodic, textmap
from signalspark.llm.queries import planted


def repetitive(rng):
    k, w = rng.choice([1, 2, 3, 50]), []
    for _ in range(rng.randrange(1, 7)):
        base = [rng.randrange(k) for _ in range(rng.randrange(1, rng.choice([4, 12, 40])))]
        base += [0] * rng.choice([0, 0, rng.randrange(40)])  # long stretches of period 1 inside the period
        w += (base * rng.randrange(1, 9))[: rng.randrange(1, 300)] if rng.random() < 0.7 else [rng.randrange(k) for _ in range(30)]
        w = (w * rng.choice([1, 1, 3, 4]))[:400]
    return w


@pytest.mark.parametrize("chunk", [periodic.CHUNK, 500])
def test_runs_of_many_documents_at_once(chunk):
    rng = random.Random(chunk)
    for _ in range(15):
        seqs = [repetitive(rng) for _ in range(rng.randrange(1, 9))] + [[], [7] * 23, [7] * 24]
        assert periodic.search([np.array(s, np.int32) for s in seqs]) == [word_runs(s) for s in seqs]


def test_selection_is_locally_consistent():
    """Equal contexts of 2 tau words are selected alike; every tau places outside periodic parts hold a selected one."""
    rng = random.Random(4)
    w = np.array([rng.randrange(2) for _ in range(3000)], np.int32)
    h = periodic.mix(w.astype(np.uint64))
    for size in (1, 2):
        h = periodic.paired(h, size)
    skip = periodic.periodic_starts(len(w), periodic.short_runs(w), 4)
    places = set(periodic.selected(h, skip, 4).tolist())
    known = {}
    for i in range(len(w) - 8):
        assert known.setdefault(tuple(w[i : i + 8]), i in places) == (i in places)
        assert places & set(range(i, i + 4)) or i > len(w) - 12 or skip[i : i + 4].all()


def test_find_runs(spark):
    long = " ".join(["a b c d e"] * 20_000)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x " * 24), (4, "x " * 24), (5, "x y " * 11), (None, "x y\t" * 12 + "é"), (6, long), (7, "one two three"), (8, "p q r " * 9 + "s " * 30)]
    df = docs(spark, rows, n_runs=F.lit("clash"), _text0=F.lit(1), period=F.lit("x"))
    got = periodic.find_runs(df, keep=["doc_id"], with_text=True).collect()
    for (doc, text), r in zip(rows, got, strict=True):
        words = (text or "").split()
        want = [(0, 100_000, 5)] if text == long else word_runs(words)
        assert [tuple(x) for x in r.runs] == want and r.n_runs == len(want) and r.doc_id == doc
        gone = {i for a, n, q in want for i in range(a + q, a + n)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert r.collapsed == kept and r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in want).encode()).hexdigest()
        assert (r.start is None) == (not want)
    assert [(r.start, r.length, r.period, r.exponent_milli) for r in got][3] == (0, 24, 1, 24_000)
    assert got[9].period == 1 and got[9].n_runs == 2
    assert periodic.find_runs(docs(spark, [])).count() == 0


def test_planted_repeats_follow_the_rule():
    for doc in range(400):
        h, n = zlib.crc32(str(doc).encode()), doc % 67
        words, g = list(range(n)), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        got = planted(n, h)
        assert words == (list(range(n)) if got is None else got.tolist())
    assert planted(5, None) is None


BOILER = "Subscribe to Our Newsletter"
PAGES = [
    (5, f"intro\n  {BOILER}\t\nbody of five\n{BOILER.lower()}"), (2, f"{BOILER}\nshort\n\nown words of two"), (9, f"short\n{BOILER}\r\nown words of two\n\n"),
    (9, f"short\n{BOILER}\r\nown words of two\n\n"), (None, f"{BOILER}\nnull only line"), (None, "null only line"), (3, None), (4, ""), (7, "ééééééééé"), (8, "ééééééééé"),
    (10, "éééééééééé"), (11, "éééééééééé\néééééééééé"), (12, "z" * 60_000 + "\nk"), (13, "z" * 60_000), (2, "own words of two"),
]


@pytest.mark.parametrize("rows", [PAGES, [(i, f"{BOILER}\nline number {i // 2}\n{'ab' * (i % 5)}") for i in range(300)]])
def test_repeated_lines_go(spark, rows):
    df = docs(spark, rows, h1=F.lit("x"), drop=F.lit(1), text_hash=F.lit("clash")).repartition(7)
    got = line_dedup.without_repeated_lines(df).collect()
    key = lambda r: none_last((r[0],)) + tuple(r[1:])
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got], key=key) == sorted(cut_lines(rows), key=key)
    assert all(r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest() for r in got)


def test_lines_of_more_documents(spark):
    rows = [(i, f"{BOILER}\nshared by two {i // 2}") for i in range(6)]
    got = line_dedup.without_repeated_lines(docs(spark, rows), least_documents=3).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in got) == [(0, 0)] + [(i, 1) for i in range(1, 6)]
    assert line_dedup.without_repeated_lines(docs(spark, [])).count() == 0


def audited(spark, rows, labels):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mask", F.lit("clash")).withColumn("h1", F.lit(1))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    names = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    return sorted(tuple(r[c] for c in names) for r in filter_audit.audit(df.repartition(5), lab).collect())


def test_filter_audit(spark):
    rng = random.Random(3)
    fine = " ".join(f"word{i}" for i in range(210))
    texts = [None, "", fine, fine + " A", "LOUD " * 150, "same " * 300, fine + " #", "a | b", "É" * 50, "X" + "é" * 49, "XX" + "é" * 98, fine + " hot"]
    rows = [(i if i % 11 else None, rng.choice(texts), rng.choice(["s", "t", "", None])) for i in range(150)]
    rows += [(200, fine, "rare"), (200, fine, "rare"), (201, "unique " + fine, "clean")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1)]
    assert audited(spark, rows, labels) == filter_effects(rows, labels)


def test_filter_audit_of_nothing(spark):
    assert audited(spark, [], []) == []
    assert len(audited(spark, [(1, "x", None)], [])) == 600


def test_sketch_clears_most_unique_texts_and_no_copy(spark):
    rows = [(i, f"text {i}") for i in range(3000)] + [(10_000 + i, "hot text") for i in range(1500)] + [(20_000 + i, f"text {i}") for i in range(50)]
    flags = filter_audit.flagged(docs(spark, rows).repartition(9), "doc_id", "text", "source").cache()
    maybe = {(r.h1, r.h2) for r in filter_audit.possible_repeats(flags).collect()}
    copies = {filter_audit.halves(t.encode()) for t in ["hot text"] + [f"text {i}" for i in range(50)]}
    assert copies <= maybe and len(maybe) < 400


def test_slices_are_bounded_by_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(textmap, "ROWS", 3)
    monkeypatch.setattr(textmap, "BYTES", 10)
    for texts in ([], [None] * 7, ["x" * 4] * 7, ["x" * 50, "y", "z" * 9, "", None, "w" * 11, "v"]):
        got = list(textmap.slices(pa.array(texts, pa.string())))
        assert [i for a, n in got for i in range(a, a + n)] == list(range(len(texts)))
        assert all(n == 1 or (n <= 3 and sum(len(t or "") for t in texts[a : a + n]) <= 10) for a, n in got)
