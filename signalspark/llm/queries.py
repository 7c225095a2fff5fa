"""Registered queries of this package and their SQL twins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from signalspark.llm import bpe, decontaminate, exact_dedup, filter_audit, langid, line_dedup, ngram_join, paragraph_dedup, periodic, pii, quality, url_rules, warc
from signalspark.plans.registry import Family

FAMILY = Family()
query = FAMILY.query


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf, "documents"), keep=["doc_id"])


def fold(buckets: int, held: int):
    """The contract's folds: crc32 of the id as text, by remainder."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(buckets)) == held


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    held = F.coalesce(fold(3, 1), F.lit(False))
    model = langid.train(documents, ~held)
    x = documents.select("doc_id", held.alias("held_out"), "text")
    return langid.predict(x, model, keep=["doc_id", "held_out"])


@query("op5_pii")
def op5_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.scan(table(spark, sf, "documents"), keep=["doc_id"]).drop("scored")


@query(
    "op6_exact_dedup",
    r"""
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
    g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM t JOIN g USING (body)
    """,
)
def op6_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf, "documents"))


@query(
    "op2_ngram_jaccard",
    r"""
    WITH RECURSIVE t AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM t),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 80 * (p.n + q.n - o)),
    r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.seen)
    SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.seen) AS component_id
    FROM t LEFT JOIN n USING (doc_id) JOIN r ON r.node = t.doc_id GROUP BY ALL
    """,
)
def op2_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.find_groups(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


@query(
    "op9_decontaminate",
    r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    k AS (SELECT DISTINCT item_id, l, array_to_string(w[p:p + l - 1], ' ') AS g FROM (
        SELECT item_id, w, least(10, len(w)) AS l, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
    g AS (SELECT r, p, l, array_to_string(w[p:p + l - 1], ' ') AS g FROM (
        SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, (SELECT DISTINCT l FROM k) WHERE len(w) >= l)),
    m AS (SELECT r, p, l, item_id FROM g JOIN k USING (l, g)),
    h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + l)) AS q FROM m) GROUP BY r),
    n AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
        FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM m WHERE item_id IS NOT NULL) GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
    """,
)
def op9_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"), keep=["doc_id"])


RULES = (
    url_rules.Prefix("net/", "block"),
    url_rules.Prefix("example.net/en/", "allow"),
    url_rules.Prefix("example.com/de/", "block"),
    url_rules.Prefix("org/fr/", "allow"),
)


def judged_sql() -> str:
    def rows(rules):
        return ", ".join("('{}', '{}', '{}')".format(*(x.replace("'", "''") for x in (r.rule, r.verdict, r.regex))) for r in rules)

    return rf"""
    WITH u AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    p(rule, verdict, regex) AS (VALUES {rows(RULES)}), q(rule, verdict, regex) AS (VALUES {rows(url_rules.PATTERNS)})
    SELECT page_id, host, path, (SELECT arg_max(rule, length(rule)) FROM p WHERE regexp_matches(host || path, regex)) AS rule,
        coalesce((SELECT arg_max(verdict, length(rule)) FROM p WHERE regexp_matches(host || path, regex)),
            CASE WHEN EXISTS (SELECT 1 FROM q WHERE regexp_matches(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), regex)) THEN 'block' ELSE 'allow' END) AS verdict
    FROM u
    """


@query("op7_url_filter", judged_sql())
def op7_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_rules.judge(table(spark, sf, "pages"), RULES, keep=["page_id"])


@query(
    "op10_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    g AS (SELECT h, min(page_id) AS f FROM p WHERE octet_length(encode(h)) >= 100 GROUP BY h)
    SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest,
        CASE WHEN f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN f <> page_id THEN f END AS refers_to
    FROM p LEFT JOIN g USING (h)
    """,
)
def op10_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf, "pages"))


@query("op8_quality")
def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    held = F.coalesce(fold(4, 2), F.lit(False))
    labels = table(spark, sf, "labels").filter(~held).select("doc_id", "quality")
    weights = quality.train(documents, labels)
    return quality.score(documents.select("doc_id", held.alias("held_out"), "text"), weights, keep=["doc_id", "held_out"])


@query("op3_paragraph_dedup")
def op3_paragraph_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return paragraph_dedup.find_repeats(table(spark, sf, "documents")).drop("body")


@query(
    "op12_line_dedup",
    r"""
    WITH l AS (SELECT r, doc_id, i, lines[i] AS line, translate(trim(lines[i], E' \t\n\x0B\f\r'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (
            SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
    k AS (SELECT key, min(doc_id) AS first_doc FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
    m AS (SELECT l.*, coalesce(doc_id > first_doc, FALSE) AS goes FROM l LEFT JOIN k USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT goes), '')) AS kept_sha256
    FROM m GROUP BY r, doc_id
    """,
)
def op12_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.without_repeated_lines(table(spark, sf, "documents"), with_text=False)


@query(
    "op13_filter_audit",
    r"""
    WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents),
    w AS (SELECT *, regexp_extract_all(body, '[^ 	-
]+') AS w FROM t),
    e AS (SELECT body, min(doc_id) AS first_doc FROM t GROUP BY body),
    f AS (SELECT w.doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
            + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
            + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) THEN 4 ELSE 0 END
            + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
            + CASE WHEN w.doc_id > first_doc THEN 16 ELSE 0 END AS mask FROM w JOIN e USING (body)),
    m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS bad
        FROM f LEFT JOIN labels USING (doc_id) GROUP BY part, mask),
    b(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
    o AS (SELECT '' AS filter_order, 0 AS seen UNION ALL SELECT filter_order || letter, seen + bit FROM o JOIN b ON seen & bit = 0),
    s AS (SELECT filter_order, step, bit, (SELECT coalesce(sum(x.bit), 0) FROM b x WHERE instr(filter_order[1:step - 1], x.letter) > 0)::INT AS before
        FROM (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o WHERE length(filter_order) = 5) JOIN b ON filter_order[step] = letter),
    c AS (SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN bad ELSE 0 END)::BIGINT AS toxic_lost
        FROM m, s GROUP BY ALL)
    SELECT * EXCLUDE (bit), sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM c
    """,
)
def op13_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


def planted(n: int, h: int | None) -> np.ndarray | None:
    """The contract's planted repeats: one document in ten, by the crc32 of its id, repeats from a word on."""
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return order


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return periodic.find_runs(table(spark, sf, "documents"), keep=["doc_id"], order=planted, order_key=crc)
