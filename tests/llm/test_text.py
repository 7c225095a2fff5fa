"""Operators that judge one text at a time."""

from __future__ import annotations

import hashlib
import random
import re

import public_tokenizers
import pytest
from brute import docs
from pyspark.sql import functions as F

from signalspark.llm import bpe, langid, pii, quality

ODD = [None, "", " ", "\n\t ", "ß", "a" * 70_000, " " * 9000 + "x", "word " * 30_000 + "'s", "\U0001f600é\x85 　x", "x", "x"]


@pytest.fixture(scope="module")
def enc():
    with open(public_tokenizers.path(bpe.RANKS), "rb") as f:
        return bpe.encoding(f.read())


def test_pieces_do_not_change_tokens(enc):
    rng = random.Random(1)
    parts = ["a", "B", "é", "ß", "1", "²", "'", "'s", "'ll", " ", "  ", "\n", "\t", "\x85", "\xa0", "　", "!", "\x1c", "日", "\r\n"]
    for _ in range(500):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(80)))
        assert bpe.encode(enc, t, 7).tolist() == enc.encode_ordinary(t)
        assert bpe.decode(enc, bpe.encode(enc, t, 7), 3) == t.encode()
    for tail in ("", "x", "\nfoo"):
        t = "word" + " " * (bpe.LONG_RUN + 3) + tail
        assert bpe.encode(enc, t).tolist() == enc.encode_ordinary(t)


def test_white_space_longer_than_the_engine_takes(enc):
    assert bpe.decode(enc, bpe.encode(enc, " " * 1_000_000 + "x")) == b" " * 1_000_000 + b"x"


def test_encode_documents(spark, enc):
    df = docs(spark, [(i if i != 1 else None, t) for i, t in enumerate(ODD)], n_tokens=F.lit("clash"), ids=F.lit(1))
    got = bpe.encode_documents(df, keep=["doc_id"], with_ids=True).collect()
    assert len(got) == len(ODD)
    for r, t in zip(got, ODD, strict=True):
        ids = [x for p, one in bpe.pieces(t or "") for x in (enc._encode_single_piece(p) if one else enc.encode_ordinary(p))]
        assert (r.n_tokens, r.ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(docs(spark, [])).count() == 0


def test_base_kinds_match_plain_expressions():
    rng = random.Random(2)
    parts = ["a", "b.c", "@", "x-y", ".", "_", "%", " ", "1", "23", "192.168.0.1", "255", "256.1.2.3", "+", "(0)", "-", "4111 1111 1111 1111", "4111-1111", "+49 170 1234567", "é", "٣", "\n"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = [int(c) for c in m[0] if c in "0123456789"]
            double = [x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))]
            if 14 <= len(d) <= 19 and sum(double) % 10 == 0:
                want.append((m.start(), 2, m.end()))
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                want.append((m.start(), 3, m.end()))
        got = [(a, pii.KINDS.index(k), b) for k, a, b, _ in pii.find(t) if pii.KINDS.index(k) < pii.BASE]
        assert got == sorted(want), t


def test_added_kind_needs_its_check_digits_and_context_raises():
    good, bad = "account DE89 3704 0044 0532 0130 00 END", "account DE88 3704 0044 0532 0130 00 END"
    (span,) = [s for s in pii.find(good) if s[0] == "iban"]
    assert good[span[1] : span[2]] == "DE89 3704 0044 0532 0130 00" and span[3] == 1.0
    assert not [s for s in pii.find(bad) if s[0] == "iban"]
    assert pii.find("10.0.0.1")[0][3] < pii.find("server 10.0.0.1")[0][3]
    assert pii.redact("mail a@b.cd now", pii.find("mail a@b.cd now")) == "mail <EMAIL> now"


def test_scan_is_linear_and_takes_odd_rows(spark):
    texts = [*ODD, "1" * 200_000, "a." * 100_000, "+1" * 50_000, "@" * 50_000]
    got = pii.scan(docs(spark, texts, spans=F.lit(1)), keep=["doc_id"], with_text=True).collect()
    assert len(got) == len(texts)
    assert got[0].spans == "" and got[0].redacted is None and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.scan(docs(spark, [])).count() == 0


def test_language_of_held_out_texts(spark):
    words = {"en": "the and of to is that with for was on be at by".split(), "de": "und der die das nicht ein mit von zu auf ist".split(), "fr": "le la les des et un une que pour dans est".split()}
    rng = random.Random(3)
    rows = []
    for i in range(300):
        lang = rng.choice(list(words))
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(20)), lang if i % 7 else None, "s", 1))
    df = spark.createDataFrame([*rows, (None, None, "en", "s", 0), (900, "12 !! 34", None, "s", 0), (901, "", "de", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.train(df, F.col("doc_id") % 3 != 1)
    assert model.langs == ["de", "en", "fr"]
    got = {r.doc_id: r for r in langid.predict(df.withColumn("score", F.lit("clash")), model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, *_ in rows if lang)
    assert {got[i].lang_pred for i in (None, 900, 901)} == {"und"} and got[900].score == 0.0
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = langid.train(df.filter("false"), F.lit(True))
    assert {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"}
    assert langid.predict(df.filter("false"), model).count() == 0


def test_ngrams_of_cut_texts_add_up():
    text = "Straße nach Köln, 12 Wörter und mehr. " * 50
    whole = sorted(langid.ngrams([(0, text)])[0].tolist())
    cut = sorted(b for batch in langid.slices([text], 200) for b in langid.ngrams(batch)[0].tolist())
    assert whole == cut


def test_quality_of_held_out_texts(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice("the and of to river house green".split()) for _ in range(40)) + "."
    bad = lambda: " ".join(rng.choice("BUY NOW CHEAP".split()) + "!!" for _ in range(40))
    rows = [(i, good() if i % 4 else bad(), "en", "s", 1) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400) if i % 3] + [(None, 1), (7, None), (5, 1), (5, 1)], "doc_id long, quality int")
    weights = quality.train(df, labels)
    got = quality.score(df.withColumn("predicted", F.lit("clash")), weights).collect()
    assert sum(r.predicted == int(r.doc_id % 4 > 0) for r in got) >= 396
    odd = quality.score(docs(spark, ODD), weights, keep=["doc_id"]).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd) and odd[0].score == odd[1].score
    assert not quality.train(df, labels.filter("false")).any()
    assert quality.score(df.filter("false"), weights).count() == 0
