"""URL filters, archives and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import tiktoken
from brute import copies, docs, leaks, near_groups
from pyspark.sql import functions as F

import corpus_pipeline
from signalspark.llm import bpe, queries, url_rules, warc

PAGES = "page_id long, url string, html string"


def fits(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for r in rules:
        name, _, tail = r.rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(r.rule) > len(best.rule)):
            best = r
    return host, path, best


URLS = [
    None, "", "x", "://", "http://", "http://net/", "http://NET/x", "http://a.net", "https://a.net?x/y", "https://Example.NET/en/a#b", "http://example.net/EN/",
    "http://notexample.net/en/", "http://example.com/de/x?y", "http://example.com/deutsch", "http://m.x.org/fr/", "http://org/fr/", "http://spam-farm.example.com/", "http://a.b/casino",
    "http://a.b/casinos", "ftp://u@h.org/fr/://x", "http://a.org/ads/1", "http://x.de/ADSERVER/1", "http://é.net/", "http://a\n.net/b", "http://x.com/" + "y" * 20_000, "http://net/", "http://net/",
]


def test_urls(spark):
    rows = [(i if i != 3 else None, u, None) for i, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("rule", F.lit("clash")).withColumn("token", F.lit(1))
    for limit in (url_rules.BROADCAST_RULES, 0):
        got = {r.page_id: r for r in url_rules.judge(pages, queries.RULES, keep=["page_id"], broadcast_rules=limit).collect()}
        assert len(got) == len(rows)
        for i, u, _ in rows:
            host, path, best = fits(u, queries.RULES)
            assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best.rule), u
            if best:
                assert got[i].verdict == best.verdict
    verdict = {u: got[i if i != 3 else None].verdict for i, u in enumerate(URLS)}
    assert [u for u in URLS if u and verdict[u] == "block" and not fits(u, queries.RULES)[2]] == [
        "http://spam-farm.example.com/", "http://a.b/casino", "http://a.org/ads/1", "http://x.de/ADSERVER/1"
    ]
    assert url_rules.judge(pages.filter("false"), queries.RULES).count() == 0


def test_rules_with_open_ends_are_always_candidates(spark):
    rules = [url_rules.Prefix("a.com/shop", "block"), url_rules.Prefix("b.com", "block"), url_rules.Pattern("*tracker*", "block"), url_rules.Pattern("/pix.gif", "block")]
    assert [r.tokens for r in rules] == [["a", "com"], ["b", "com"], [], ["pix"]]
    pages = spark.createDataFrame([(1, "http://a.com/shopping", ""), (2, "http://xtrackery.de/", ""), (3, "http://x.de/pix.gif?1", ""), (4, "http://b.com", ""), (5, "http://bb.com/", "")], PAGES)
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge(pages, rules[:2], rules[2:], keep=["page_id"]).collect()}
    assert got == {1: ("a.com/shop", "block"), 2: (None, "block"), 3: (None, "block"), 4: ("b.com", "block"), 5: (None, "allow")}


def archive_rows():
    rng = random.Random(7)
    body = lambda n: "".join(rng.choice("<p>abcdé \r\n") for _ in range(n))
    hot = body(300)
    rows = [(i, f"http://h/{i}", hot if i % 3 == 0 else body(rng.choice([0, 20, 150, 5000]))) for i in range(60)]
    return rows + [(100, None, None), (101, "http://x/a b\r\nEvil: 1", "short"), (102, "u", "short"), (None, "n", hot), (103, "\n", "\r\n\r\n" * 100), (104, "big", "z" * 500_000), (0, "http://h/0", hot)]


def test_archives_round_trip(spark):
    rows = archive_rows()
    pages = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash")).repartition(4)
    got = warc.archived_pages(pages, archive_bytes=20_000).collect()
    first = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in rows:
        h = (h or "").encode()
        to = first.get(h) if first.get(h, i) != i else None
        want.append((i, len(h), hashlib.sha256(h).hexdigest(), "response" if to is None else "revisit", to))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert warc.archived_pages(pages.filter("false")).count() == 0


def test_archives_are_checked(spark):
    records = [warc.record(i, f"http://h/{i}", b"x" * 200 + b"%d" % i, hashlib.sha256(b"x" * 200 + b"%d" % i).hexdigest(), None, "2024-01-01T00:00:00Z") for i in range(300)]
    good = warc.pack(records)
    assert good[:4] == warc.DICTIONARY and [r for _, r in warc.frames(good)] == records
    few = warc.pack(records[:1])
    assert [r for _, r in warc.frames(few)] == records[:1]
    for bad in (
        records[0].replace(b"Content-Length: 2", b"Content-Length: 3", 1), records[0].replace(b"xx", b"xy", 1), records[0][:-2], b"hello",
        records[0].replace(b"WARC-Date", b"Other"), records[0].replace(b"WARC/1.1", b"WARC/9"),
    ):
        with pytest.raises(ValueError):
            warc.page(*warc.parse(bad))
    df = spark.createDataFrame([("good", good), ("cut", good[:-20]), ("none", None), ("empty", b""), ("bad", warc.pack([records[0], b"hello"]))], "path string, content binary")
    got = warc.read_archives(df, payloads=True, strict=False).collect()
    assert sum(r.path == "good" and r.error is None for r in got) == 300 and {r.path for r in got if r.error} == {"cut", "bad"}
    assert next(r for r in got if r.path == "good").payload == b"x" * 200 + b"0"
    with pytest.raises(Exception, match="cut"):
        warc.read_archives(df.filter("path = 'cut'")).collect()


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice("the and of river house green stone".split()) + str(rng.randrange(90)) for _ in range(n))
    bench = [(1, text(15)), (2, text(12))]
    texts = [text(60) for _ in range(12)]
    near = texts[3].split()
    near[2] = "changed"
    texts += [texts[0], texts[1].replace(" ", "  "), " ".join(near), "12 34 !!", "", None, texts[5] + " " + bench[0][1]]
    rows = list(enumerate(texts)) + [(2, texts[2])]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(i, t) for i, t in rows if t and re.search(r"[^\W\d_]", t)]
    seen, kept = set(), []
    for (i, t), (_, keep, *_) in zip(left, copies(left), strict=True):
        if i == keep and i not in seen:
            kept.append((i, t))
            seen.add(i)
    kept = [x for x, (i, _, c) in zip(kept, near_groups(kept), strict=True) if i == c]
    kept = [x for x, r in zip(kept, leaks(kept, bench), strict=True) if not r[-1]]
    with open(__import__("public_tokenizers").path(bpe.RANKS), "rb") as f:
        enc = bpe.encoding(f.read())
    assert isinstance(enc, tiktoken.Encoding)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids) for r in got) == sorted((i, len(x := enc.encode_ordinary(t)), x) for i, t in kept)
    before = docs(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, before, str(tmp_path)).columns == before.columns
        assert stage(spark, before.filter("false"), str(tmp_path)).count() == 0
