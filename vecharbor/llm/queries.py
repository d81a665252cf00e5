"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, html_text, licenses, parsing, quality, sharding, simhash, token_counts, toxicity
from .common import crc_remainder, read


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file; it is read where it lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _decided(scored: DataFrame, mod: int, held: int, threshold: float) -> DataFrame:
    """A row without doc_id is in no fold."""
    held_out = F.coalesce(crc_remainder("doc_id", mod) == held, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", decontam.items_sha256(F.col("items")).alias("items_sha256"), "contaminated")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.compared(read(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return _decided(quality.scored(docs, model), 4, 2, quality.THRESHOLD)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return _decided(toxicity.scored(docs, model), 3, 1, toxicity.THRESHOLD)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    hist = token_counts.histogram(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_counts.report(hist)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(read(spark, sf_dir, "documents"), "doc_id")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(read(spark, sf_dir, "documents"), vocabulary())


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_document_fingerprints,
        op3_quality_classifier,
        op4_simhash_near_dedup,
        op5_license_scans,
        op6_toxicity,
        op7_token_counts,
        op8_sharding,
        op9_bpe,
        op10_html_extraction,
    )
}

#: Words: runs of digits, letters and anything beyond ASCII, A-Z in lower case.
_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_TEMPLATES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.TEMPLATES.items())
_LOWER_WORDS = r"regexp_extract_all(lower({0}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_GRAMS = "unnest(list_transform(range(1, len(w) - 3), lambda i: {'h': array_to_string(list_slice(w, i, i + 4), ' '), 'i': i}))"

ORACLE_SQL: dict[str, str] = {
    "op5_license_scans": f"""
WITH t0 AS (SELECT license, {_LOWER_WORDS.format("text")} AS w FROM (VALUES {_TEMPLATES}) AS v(license, text)),
t1 AS (SELECT DISTINCT license, g.h AS h FROM (SELECT license, {_GRAMS} AS g FROM t0)),
t AS (SELECT license, h, count(*) OVER (PARTITION BY license) AS n FROM t1),
tc AS (SELECT *, CAST(pow(2, ceil(log2(n))) AS BIGINT) AS s FROM t),
d AS (SELECT row_number() OVER () AS r, doc_id, {_LOWER_WORDS.format("text")} AS w, left(lower(text), 1) AS c FROM (SELECT DISTINCT doc_id, text FROM documents) WHERE text IS NOT NULL),
d1 AS (SELECT r, doc_id, g.h AS h, g.i - 1 + CAST(NOT regexp_matches(c, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]') AS BIGINT) AS p FROM (SELECT r, doc_id, c, {_GRAMS} AS g FROM d)),
hits AS (SELECT r, doc_id, p, h FROM d1 WHERE h IN (SELECT h FROM t1)),
win AS (SELECT DISTINCT r, doc_id, s, p, h, unnest([p // s, p // s - 1 + CAST(p < 0 AS BIGINT)]) AS k FROM hits, (SELECT DISTINCT s FROM tc)),
shared AS (SELECT r, doc_id, k, license, count(DISTINCT h) / any_value(n) AS containment, min(p) AS p FROM win JOIN tc USING (s, h) GROUP BY r, doc_id, s, k, license)
SELECT doc_id, license, max(containment) AS containment, CAST(min(p) AS BIGINT) AS first_word, count(*) AS n_windows
FROM shared WHERE containment >= 0.8 GROUP BY doc_id, license""",
    "op1_benchmark_decontamination": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
wins AS (SELECT DISTINCT item, least(13, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: list_slice(w, i, i + least(13, len(w)) - 1))) AS win
    FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM wins),
pos AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
occ AS (SELECT DISTINCT pos.r, pos.i, pos.n, wins.item FROM pos JOIN d USING (r) JOIN wins ON wins.n = pos.n AND wins.win = list_slice(d.w, pos.i, pos.i + pos.n - 1)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM occ) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)""",
}
