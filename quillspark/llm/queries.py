"""One query for each operator, over whole tables; SQL for DuckDB where it can express the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, divergence, hard_negatives, licenses, media, prefix_join, quotations, token_counts, toxicity, url_filters, warc, wrappers
from .util import ship

#: The rules of op7: verdict, host with its subdomains, beginning of the path.
URL_RULES = [
    url_filters.Rule("block", "com", "/en/"),
    url_filters.Rule("allow", "example.com", "/en/7"),
    url_filters.Rule("allow", "net", "/de/"),
    url_filters.Rule("block", "example.net", "/de/8"),
    url_filters.Rule("block", "org", "/es/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark, _table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(_table(spark, sf_dir, "pages"))


def op4_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.join(_table(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_read(spark, _table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link(_table(spark, sf_dir, "conversations"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"), licenses.BASE_PHRASES, licenses.TEMPLATES)
    return found.drop("places")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    moved = e.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))
    return hard_negatives.mine(moved, F.col("vec_id") % 50 == 0)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc, op2_toxicity, op3_wrappers, op4_prefix_join, op5_media_columns, op6_token_counts, op7_url_filters, op8_decontaminate, op9_byte_bpe, op10_quotations,
        op11_licenses, op12_hard_negatives, op13_source_divergence,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op4_prefix_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
        c AS (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY node)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
    """,
    "op8_decontaminate": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        q AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        v AS (SELECT DISTINCT item_id, w, array_to_string(ws[i:i + w - 1], ' ') AS k FROM (SELECT item_id, ws, least(13, len(ws)) AS w, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM q WHERE len(ws) > 0)),
        g AS (SELECT DISTINCT w FROM v),
        k AS (SELECT doc_id, i, w, array_to_string(ws[i:i + w - 1], ' ') AS k FROM (SELECT doc_id, ws, w, unnest(range(1, len(ws) - w + 2)) AS i FROM d, g WHERE len(ws) >= w)),
        h AS (SELECT doc_id, i, w, item_id FROM k JOIN v USING (w, k)),
        p AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + w)) AS at FROM h) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM h) GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(ws) AS contaminated
        FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
    "op1_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
        d AS (SELECT page_id, octet_length(raw) AS n, sha256(raw) AS digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f
    """,
    "op12_hard_negatives": """
        WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        a AS (SELECT * FROM r WHERE vec_id % 50 = 0),
        s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_dot_product(a.v::DOUBLE[], r.v::DOUBLE[]) AS BIGINT) AS score FROM a JOIN r ON a.vec_id <> r.vec_id),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
        WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 3
    """,
    "op13_source_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
        w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
        k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
        v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        ng AS (SELECT lang, source, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        nl AS (SELECT lang, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY lang),
        p AS (SELECT lang, ng.source, term, coalesce(n, 0) AS n, 1 + 1000000000 * (coalesce(n, 0) + 5) // (total + 5 * v) AS p FROM ng JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
        q AS (SELECT lang, term, 1 + 1000000000 * (n + 5) // (total + 5 * v) AS q FROM (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL) JOIN nl USING (lang) JOIN v USING (lang)),
        f AS (SELECT lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
        o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
          UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
        SELECT *, CAST(row_number() OVER w AS INTEGER) AS rank FROM o WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER w <= 50
    """,
}
