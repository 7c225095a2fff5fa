"""What the text operators shuffle and leave on disk."""

from __future__ import annotations

import random
import time

import numpy as np
from brute import docs
from pyspark.sql import functions as F

from signalspark.llm import filter_audit, ngram_join, paragraph_dedup, repeats, tables


def test_hashes_that_occur_again(spark, monkeypatch):
    rng = np.random.default_rng(31)
    monkeypatch.setattr(repeats, "HELD", 500)  # several messages a task
    once, twice = np.split(rng.integers(-(1 << 63), (1 << 63) - 1, 4000, np.int64), [3000])
    rows = rng.permutation(np.concatenate([once, twice, twice, np.repeat(twice[:3], 900)]))
    for df in (
        spark.createDataFrame([(int(v),) for v in rows], "h long").repartition(5),
        spark.createDataFrame([(rows[i : i + 20].tolist(),) for i in range(0, len(rows), 20)] + [([],)], "h array<long>").repartition(5),
    ):
        assert {r.fp for r in repeats.again(df).collect()} == set(repeats.fingerprints(twice).tolist())
        listed = repeats.again_filter(df)
        assert listed(twice).all() and listed(once).mean() < 0.01
    assert repeats.again(spark.createDataFrame([], "h long")).count() == 0


def test_bands_and_seeds_that_occur_once_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(33)
    para = lambda n: " ".join(str(rng.randrange(100_000)) for _ in range(n))
    shared = para(60)
    rows = [(i, para(40) + "\n" + (shared if i < 4 else para(70))) for i in range(60)]
    sent = []
    crowded = ngram_join.crowded
    monkeypatch.setattr(ngram_join, "crowded", lambda x, percent: sent.append(x.count()) or crowded(x, percent))
    found = paragraph_dedup.find_repeats(docs(spark, rows)).collect()
    assert {(r.doc_id, r.line, r.group_size) for r in found} == {(i, 1, 4) for i in range(4)}
    assert sent[0] <= 4 * paragraph_dedup.BANDS  # of 120 paragraphs


def test_stored_tables_leave_no_shuffle_files(spark):
    files = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()
    x = spark.range(5000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    before = files()
    table, path = tables.store(x, "test")
    for _ in range(50):  # they go in the background
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and table.count() == 1000
    assert spark.conf.get(tables.CLEANUP, None) is None
    tables.remove(spark, path)


def test_copies_and_labels_are_not_broadcast(spark, monkeypatch):
    plans, attach = [], filter_audit.attach

    def seen(*args, **kw):
        out = attach(*args, **kw)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(filter_audit, "attach", seen)
    df = docs(spark, [(i, f"text {i % 30}") for i in range(40)]).withColumn("source", F.lit("s"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = filter_audit.mask_counts(df, labels).collect()
    assert sum(r.n for r in got) == 40 and sum(r.n for r in got if r.mask & filter_audit.COPY) == 10
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans)
