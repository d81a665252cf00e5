"""Named queries of the vector engine, with the SQL that gives the same rows.

``embeddings`` stands for the nodes and the queries, ``events`` for a log of mutations,
``documents`` and ``labels`` for host records. Each query reads its whole tables; the vectors
whose id is divisible by 100 are the stated query set of searches.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import graph, ivf, mutate, reports, search
from ..sources import vectors as sources
from .plane import Plane, PlaneFault
from .workspace import workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The query set: every row whose id is divisible by this.
EVERY = 100
DIMS = 64


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def nodes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as live nodes."""
    rows = read(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("node_id"), F.col("vec_id").cast("string").cast("binary").alias("key"), F.lit(1).alias("status"), "embedding", "label")


STATUS = "CASE WHEN {0} % 17 = 3 THEN 2 WHEN {0} % 29 = 5 THEN 0 ELSE 1 END"


def mixed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as nodes of which some are deleted (2) and some untouched (0)."""
    return nodes_of(spark, sf_dir).withColumn("status", F.expr(STATUS.format("node_id")))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").where(F.col("vec_id") % EVERY == 0)
    return rows.select(F.col("vec_id").alias("query_id"), "embedding")


def rounded(name: str = "distance") -> Column:
    """To six places; adding zero turns a negative zero into zero."""
    return (F.round(name, 6) + 0.0).alias(name)


def shown(hits: DataFrame, *more: str) -> DataFrame:
    return hits.select("query_id", "rank", "node_id", rounded(), *more)


# ---- SQL parts ----

_E = """e AS (SELECT vec_id, label, embedding AS f, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
n AS (SELECT *, 1 / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1.17549435e-38) AS inv FROM e)"""
_ROUND = "round(distance, 6) + 0.0 AS distance"


def _code(limit: int) -> str:
    """Codes of each vector: step, float reciprocal, rounding half away from zero."""
    return f"""s AS (SELECT *, list_max(list_transform(f, lambda x: abs(x))) AS peak FROM n),
c0 AS (SELECT *, CAST(CASE WHEN peak = 0 THEN 1 ELSE peak / CAST({limit} AS FLOAT) END AS FLOAT) AS scale FROM s),
c AS (SELECT *, list_transform(f, lambda x: CAST(greatest(least(round(x * (CAST(1 AS FLOAT) / scale)), {limit}), -{limit}) AS DOUBLE)) AS code FROM c0)"""


def _pairs(metric: str, where: str = "true", ask: str = f"q.vec_id % {EVERY} = 0") -> str:
    """CTE d (query_id, node_id, distance) by the metric."""
    if metric == "exact":
        return f"{_E}, d AS (SELECT q.vec_id AS query_id, n.vec_id AS node_id, 1 - list_dot_product(q.v, n.v) * q.inv * n.inv AS distance FROM n, n AS q WHERE {ask} AND {where})"
    if metric == "int8":
        return f"{_E}, {_code(127)}, d AS (SELECT q.vec_id AS query_id, n.vec_id AS node_id, 1 - list_dot_product(q.v, n.code) * q.inv * (CAST(n.scale AS DOUBLE) * n.inv) AS distance FROM c AS n, c AS q WHERE {ask} AND {where})"
    return f"{_E}, {_code(32767)}, d AS (SELECT q.vec_id AS query_id, n.vec_id AS node_id, 1 - list_dot_product(q.code, n.code) * (CAST(q.scale AS DOUBLE) * q.inv) * (CAST(n.scale AS DOUBLE) * n.inv) AS distance FROM c AS n, c AS q WHERE {ask} AND {where})"


def _hits(k: int, name: str = "h", source: str = "d") -> str:
    return f"{name} AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, node_id) AS INTEGER) AS rank, node_id, distance FROM {source} QUALIFY rank <= {k})"


def knn_sql(k: int = 10, metric: str = "exact", where: str = "true") -> str:
    return f"WITH {_pairs(metric, where)}, {_hits(k)} SELECT query_id, rank, node_id, {_ROUND} FROM h"


_N = f"n0 AS (SELECT vec_id AS node_id, CAST(vec_id AS VARCHAR) AS key, {STATUS.format('vec_id')} AS status, label FROM embeddings)"

# ---- scans and probes ----


@query(f"WITH {_N} SELECT node_id, key, label FROM n0 WHERE status = 1")
def scan_live(spark, sf_dir):
    return search.live(mixed_nodes(spark, sf_dir)).select("node_id", F.col("key").cast("string").alias("key"), "label")


@query("SELECT vec_id AS node_id, CAST(i - 1 AS INTEGER) AS pos, round(CAST(embedding[i] AS DOUBLE), 6) AS value FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE vec_id = 42")
def point_lookup(spark, sf_dir):
    row = nodes_of(spark, sf_dir).where("node_id = 42").select("node_id", F.posexplode("embedding").alias("pos", "x"))
    return row.select("node_id", "pos", F.round(F.col("x").cast("double"), 6).alias("value"))


@query(f"WITH {_E} SELECT vec_id AS node_id, round(inv, 6) AS inv_mag FROM n")
def vector_norms(spark, sf_dir):
    return nodes_of(spark, sf_dir).select("node_id", F.round(vectors.inv_magnitude("embedding"), 6).alias("inv_mag"))


@query(f"WITH {_N} SELECT node_id, status = 1 AS alive, status <> 0 AS touched FROM n0")
def liveness_probes(spark, sf_dir):
    return mixed_nodes(spark, sf_dir).select("node_id", (F.col("status") == 1).alias("alive"), (F.col("status") != 0).alias("touched"))


@query(f"WITH {_N} SELECT CAST(max(node_id) + 1 AS BIGINT) AS high_water FROM n0")
def high_water(spark, sf_dir):
    return mutate.high_water(mixed_nodes(spark, sf_dir))


# ---- exact search ----


@query(knn_sql())
def knn_exact_top10(spark, sf_dir):
    return shown(search.knn(nodes_of(spark, sf_dir), asked(spark, sf_dir), 10))


@query(knn_sql())
def knn_exact_top10_expressions(spark, sf_dir):
    return shown(search.knn(nodes_of(spark, sf_dir), asked(spark, sf_dir), 10, backend="sql"))


@query("SELECT vec_id AS query_id, CAST(1 AS INTEGER) AS rank, vec_id AS node_id, 0.0::DOUBLE AS distance FROM embeddings")
def knn_self_query(spark, sf_dir):
    every = nodes_of(spark, sf_dir)
    return shown(search.knn(every, every.select(F.col("node_id").alias("query_id"), "embedding"), 1))


@query(knn_sql())
def knn_slice_merge(spark, sf_dir):
    """The k best of each of four slices, merged."""
    nodes, queries = nodes_of(spark, sf_dir), asked(spark, sf_dir)
    parts = [search.knn(nodes.where(F.col("node_id") % 4 == i), queries, 10) for i in range(4)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return shown(search.top(merged.drop("rank"), 10))


@query(knn_sql(k=5))
def knn_ef_bound(spark, sf_dir):
    """Never more hits than ef."""
    return shown(search.knn(nodes_of(spark, sf_dir), asked(spark, sf_dir), 10, ef=5))


@query(knn_sql(k=1))
def knn_ef_zero(spark, sf_dir):
    return shown(search.knn(nodes_of(spark, sf_dir), asked(spark, sf_dir), 10, ef=0))


@query(knn_sql(where=f"({STATUS.format('n.vec_id')}) = 1"))
def knn_live_only(spark, sf_dir):
    return shown(search.knn(mixed_nodes(spark, sf_dir), asked(spark, sf_dir), 10))


# ---- codecs ----


def _codes_sql(limit: int) -> str:
    return f"WITH {_E}, {_code(limit)} SELECT vec_id AS node_id, CAST(i - 1 AS INTEGER) AS pos, CAST(code[i] AS INTEGER) AS code FROM c, (SELECT unnest(range(1, 65)) AS i)"


def _codes(spark, sf_dir, precision):
    rows = search.encoded(nodes_of(spark, sf_dir), precision).select("node_id", F.posexplode("code").alias("pos", "code"))
    return rows.select("node_id", "pos", F.col("code").cast("int").alias("code"))


@query(_codes_sql(127))
def quantize_int8_codes(spark, sf_dir):
    return _codes(spark, sf_dir, "int8")


@query(_codes_sql(32767))
def quantize_int16_codes(spark, sf_dir):
    return _codes(spark, sf_dir, "int16")


@query(f"WITH {_E}, {_code(127)} SELECT vec_id AS node_id, CAST(scale AS DOUBLE) AS scale, round(inv, 6) AS inv_mag FROM c")
def quantize_scale(spark, sf_dir):
    return search.encoded(nodes_of(spark, sf_dir), "int8").select("node_id", F.col("scale").cast("double").alias("scale"), F.round("inv_mag", 6).alias("inv_mag"))


@query(f"WITH {_E}, {_code(127)} SELECT vec_id AS node_id, round(list_max(list_transform(list_zip(code, v), lambda p: abs(p[1] * scale - p[2]))), 6) AS worst FROM c")
def dequantize_error(spark, sf_dir):
    rows = search.encoded(nodes_of(spark, sf_dir), "int8").withColumn("back", vectors.decoded("code", "scale"))
    return rows.select("node_id", F.round(F.expr("array_max(zip_with(back, embedding, (x, y) -> abs(x - double(y))))"), 6).alias("worst"))


@query(knn_sql(metric="int8"))
def asym_int8_top10(spark, sf_dir):
    return shown(search.knn(nodes_of(spark, sf_dir), asked(spark, sf_dir), 10, metric="int8"))


@query(knn_sql(metric="int16"))
def asym_int16_top10(spark, sf_dir):
    return shown(search.knn(nodes_of(spark, sf_dir), asked(spark, sf_dir), 10, metric="int16"))


def _stored_sql(limit: int) -> str:
    return f"WITH {_E}, {_code(limit)} SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_dot_product(a.code, b.code) * (CAST(a.scale AS DOUBLE) * a.inv) * (CAST(b.scale AS DOUBLE) * b.inv), 6) + 0.0 AS distance FROM c AS a JOIN c AS b ON b.vec_id = a.vec_id + 1"


def _stored(spark, sf_dir, precision):
    nodes = search.encoded(nodes_of(spark, sf_dir), precision)
    pairs = nodes.select(F.col("node_id").alias("a"), (F.col("node_id") + 1).alias("b"))
    return search.stored_pairs(pairs, nodes).select("a", "b", rounded())


@query(_stored_sql(127))
def sym_int8_pairs(spark, sf_dir):
    return _stored(spark, sf_dir, "int8")


@query(_stored_sql(32767))
def sym_int16_pairs(spark, sf_dir):
    return _stored(spark, sf_dir, "int16")


@query(f"WITH {_E}, {_N}, d AS (SELECT q.vec_id AS query_id, n.vec_id AS node_id, 1 - list_dot_product(q.v, n.v) * q.inv * n.inv AS distance FROM n JOIN n AS q ON q.vec_id % {EVERY} = 0 AND n.vec_id BETWEEN q.vec_id * 3 AND q.vec_id * 3 + 4 JOIN n0 ON n0.node_id = n.vec_id AND status = 1) SELECT query_id, node_id, {_ROUND} FROM d")
def distance_by_id(spark, sf_dir):
    """Distances to ids asked for; dead and unknown ids give no row."""
    wanted = asked(spark, sf_dir).select("query_id", F.col("embedding").alias("q"), F.explode(F.sequence(F.col("query_id") * 3, F.col("query_id") * 3 + 4)).alias("node_id"))
    nodes = search.live(mixed_nodes(spark, sf_dir)).select("node_id", F.col("embedding").alias("v"))
    return wanted.join(nodes, "node_id").select("query_id", "node_id", (F.round(vectors.cosine_distance("q", "v"), 6) + 0.0).alias("distance"))


def _agree_sql(metric: str) -> str:
    exact = _pairs("exact").replace(", d AS (", ", dx AS (")
    other = _pairs(metric)[len(_E) + 2 :]
    return f"WITH {exact}, {other}, {_hits(10, 'hx', 'dx')}, {_hits(10)}"


def _agree(spark, sf_dir, metric):
    nodes, queries = nodes_of(spark, sf_dir), asked(spark, sf_dir)
    return search.knn(nodes, queries, 10), search.knn(nodes, queries, 10, metric=metric)


_DISAGREE = " SELECT count(*) AS ranks, count(*) FILTER (h.node_id <> hx.node_id) AS disagreements FROM h JOIN hx USING (query_id, rank)"


@query(_agree_sql("int8") + _DISAGREE)
def rank_disagreement_int8(spark, sf_dir):
    return reports.rank_disagreement(*_agree(spark, sf_dir, "int8"))


@query(_agree_sql("int16") + _DISAGREE)
def rank_disagreement_int16(spark, sf_dir):
    return reports.rank_disagreement(*_agree(spark, sf_dir, "int16"))


@query(_agree_sql("int8") + " SELECT count(h.node_id) AS found, count(*) AS wanted, round(count(h.node_id) / count(*), 6) AS recall FROM hx LEFT JOIN h USING (query_id, node_id)")
def recall_int8_at_10(spark, sf_dir):
    return reports.recall(*_agree(spark, sf_dir, "int8")).select("found", "wanted", F.round("recall", 6).alias("recall"))


@query(f"WITH {_pairs('int8')}, {_hits(50)}, r AS (SELECT h.query_id, h.node_id, 1 - list_dot_product(q.v, n.v) * q.inv * n.inv AS distance FROM h JOIN n AS q ON q.vec_id = h.query_id JOIN n ON n.vec_id = h.node_id), {_hits(10, 'f', 'r')} SELECT query_id, rank, node_id, {_ROUND} FROM f")
def rerank_int8_then_exact(spark, sf_dir):
    nodes, queries = nodes_of(spark, sf_dir), asked(spark, sf_dir)
    return shown(search.rerank(search.knn(nodes, queries, 50, metric="int8"), nodes, queries, 10))


@query(f"WITH {_E}, {_code(32767)} SELECT vec_id AS node_id, len(list_filter(code, lambda x: x = -32768)) = 0 AS in_domain, len(list_filter(v, lambda x: NOT isfinite(x))) = 0 AS finite FROM c")
def domain_checks(spark, sf_dir):
    rows = search.encoded(nodes_of(spark, sf_dir), "int16")
    return rows.select("node_id", vectors.in_domain("code").alias("in_domain"), vectors.is_finite("embedding").alias("finite"))


# ---- filters ----


@query(knn_sql(where="n.vec_id % 2 = 0"))
def filter_even_ids(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    return shown(search.knn(nodes, asked(spark, sf_dir), 10, allowed=nodes.where("node_id % 2 = 0").select("node_id")))


@query(knn_sql(where="n.vec_id < 128 AND n.vec_id % 3 <> 1"))
def filter_short_bitset(spark, sf_dir):
    """Ids beyond the bitset are denied."""
    bits = bytearray(16)
    for i in range(128):
        if i % 3 != 1:
            bits[i // 8] |= 1 << i % 8
    return shown(search.knn(nodes_of(spark, sf_dir), asked(spark, sf_dir), 10, allowed=bytes(bits)))


@query(knn_sql(where="n.label <> 0"))
def filter_label(spark, sf_dir):
    return shown(search.knn(nodes_of(spark, sf_dir), asked(spark, sf_dir), 10, where=F.col("label") != 0))


@query(knn_sql(where="n.vec_id % 3 = 0"))
def predicate_mod3(spark, sf_dir):
    """A vectorised callback over ids and keys; no verdict is a denial."""
    @F.pandas_udf("boolean")
    def third(ids: pd.Series, keys: pd.Series) -> pd.Series:
        return (ids % 3 == 0) & keys.notna()

    return shown(search.knn(nodes_of(spark, sf_dir), asked(spark, sf_dir), 10, predicate=third))


@query(knn_sql(where="n.vec_id IN (3, 250, 301)"))
def filter_selective_short(spark, sf_dir):
    """Fewer admitted nodes than k."""
    return shown(search.knn(nodes_of(spark, sf_dir), asked(spark, sf_dir), 10, where="node_id IN (3, 250, 301)"))


# ---- keys and host records ----


@query(f"WITH {_pairs('exact')}, {_hits(10)} SELECT query_id, rank, node_id, CAST(node_id AS VARCHAR) AS key FROM h")
def hits_with_keys(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    hits = search.gather_keys(search.knn(nodes, asked(spark, sf_dir), 10), nodes)
    return hits.select("query_id", "rank", "node_id", F.col("key").cast("string").alias("key"))


@query(f"WITH {_N} SELECT i AS node_id, coalesce(key, '') AS key FROM (SELECT unnest(range(0, 40)) AS i) LEFT JOIN n0 ON node_id = i AND status = 1")
def gather_missing_keys(spark, sf_dir):
    wanted = spark.range(40).select(F.col("id").alias("node_id"))
    return search.gather_keys(wanted, mixed_nodes(spark, sf_dir)).select("node_id", F.col("key").cast("string").alias("key"))


@query(f"WITH {_pairs('exact')}, {_hits(10)} SELECT query_id, rank, node_id, lang, source FROM h JOIN documents ON doc_id = node_id")
def hits_join_documents(spark, sf_dir):
    hits = search.knn(nodes_of(spark, sf_dir), asked(spark, sf_dir), 10)
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "lang", "source")
    return hits.join(docs, "node_id").select("query_id", "rank", "node_id", "lang", "source")


@query(f"WITH {_pairs('exact')}, {_hits(10)} SELECT query_id, rank, node_id, quality, toxic FROM h JOIN labels ON doc_id = node_id")
def hits_join_labels(spark, sf_dir):
    hits = search.knn(nodes_of(spark, sf_dir), asked(spark, sf_dir), 10)
    return hits.join(read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "node_id"), "node_id").select("query_id", "rank", "node_id", "quality", "toxic")


# ---- batch inserts ----

_FREE = ((3, 0), (7, 1), (9, 2))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as input records, of which some have faults."""
    rows = read(spark, sf_dir, "embeddings")
    broken = F.expr("CASE WHEN vec_id % 50 = 7 THEN transform(embedding, (x, i) -> IF(i = 5, float('nan'), x)) WHEN vec_id % 50 = 11 THEN slice(embedding, 1, 63) ELSE embedding END")
    key = F.expr("CAST(CASE WHEN vec_id % 50 = 13 THEN repeat('x', 70000) WHEN vec_id % 3 = 0 THEN repeat('k', 100) ELSE concat('r', vec_id) END AS BINARY)")
    return rows.select(F.col("vec_id").alias("seq"), broken.alias("embedding"), key.alias("key"))


_RECORDS = """r AS (SELECT vec_id AS seq, CASE WHEN vec_id % 50 = 11 THEN 'dimension-mismatch' WHEN vec_id % 50 = 13 THEN 'key-unstorable' WHEN vec_id % 50 = 7 THEN 'not-finite' END AS fault, vec_id % 3 = 0 AND vec_id % 50 <> 13 AS long FROM embeddings),
free AS (SELECT node_id, row_number() OVER (ORDER BY s DESC) AS rank FROM (VALUES (3, 0), (7, 1), (9, 2)) AS t(node_id, s))"""


def _numbered_sql(source: str, high_water: int, max_nodes: int) -> str:
    return f"""i AS (SELECT seq, row_number() OVER (ORDER BY seq) AS rank FROM {source}),
a AS (SELECT i.seq, CAST(CASE WHEN free.node_id IS NOT NULL THEN free.node_id WHEN {high_water} + i.rank - 4 < {max_nodes} THEN {high_water} + i.rank - 4 END AS BIGINT) AS node_id FROM i LEFT JOIN free ON free.rank = i.rank)"""


def _outcome_sql(high_water: int, max_nodes: int) -> str:
    return f"""WITH {_RECORDS}, {_numbered_sql("(SELECT seq FROM r WHERE fault IS NULL)", high_water, max_nodes)}
SELECT r.seq, coalesce(a.node_id, -1) AS node_id, CASE WHEN fault IS NULL AND a.node_id IS NULL THEN 'full' ELSE fault END AS code FROM r LEFT JOIN a USING (seq)"""


def _outcome(spark, sf_dir, max_nodes, arena_bytes=None):
    free = spark.createDataFrame(list(_FREE), "node_id bigint, seq bigint")
    out = mutate.insert_batch(records(spark, sf_dir), free, dims=DIMS, key_cap=16, high_water=1000, max_nodes=max_nodes, arena_bytes=arena_bytes)
    return out.select("seq", F.coalesce("node_id", F.lit(-1)).alias("node_id"), "code")


@query(_outcome_sql(1000, 1_000_000))
def batch_outcome(spark, sf_dir):
    return _outcome(spark, sf_dir, 1_000_000)


@query(_outcome_sql(1000, 1200))
def batch_full(spark, sf_dir):
    return _outcome(spark, sf_dir, 1200)


@query(f"""WITH {_RECORDS}, l AS (SELECT seq, row_number() OVER (ORDER BY seq) AS n FROM r WHERE fault IS NULL AND long),
{_numbered_sql("(SELECT r.seq FROM r LEFT JOIN l USING (seq) WHERE fault IS NULL AND coalesce(n, 0) <= 40)", 1000, 1_000_000)}
SELECT r.seq, coalesce(a.node_id, -1) AS node_id, CASE WHEN fault IS NULL AND l.n > 40 THEN 'key-arena-full' ELSE fault END AS code FROM r LEFT JOIN a USING (seq) LEFT JOIN l USING (seq)""")
def batch_arena_full(spark, sf_dir):
    """Keys of 100 bytes take two classes of 64; forty of them fit."""
    return _outcome(spark, sf_dir, 1_000_000, 128 * 40)


@query("SELECT code, record_fault FROM (VALUES ('dimension-mismatch', true), ('key-unstorable', true), ('not-finite', true), ('full', false), ('key-arena-full', true)) AS t(code, record_fault)")
def fault_codes(spark, sf_dir):
    rows = spark.createDataFrame([(c,) for c in mutate.REASONS], "code string")
    return rows.select("code", F.col("code").isin(*mutate.RECORD_FAULTS).alias("record_fault"))


@query(f"""WITH {_E}, {_code(127)} SELECT vec_id AS node_id, CASE WHEN vec_id >= 450 THEN 'id-out-of-range' WHEN vec_id % 40 = 1 THEN 'dimension-mismatch' WHEN vec_id % 40 = 2 THEN 'code-out-of-domain' WHEN vec_id % 40 = 3 THEN 'not-finite' WHEN vec_id % 40 = 4 THEN 'neighbor-out-of-range' END AS fault FROM c""")
def raw_write_validation(spark, sf_dir):
    rows = search.encoded(nodes_of(spark, sf_dir), "int8").select(
        "node_id",
        F.expr("CASE node_id % 40 WHEN 1 THEN slice(code, 1, 63) WHEN 2 THEN transform(CAST(code AS ARRAY<SMALLINT>), (c, i) -> IF(i = 0, CAST(-128 AS SMALLINT), c)) ELSE CAST(code AS ARRAY<SMALLINT>) END").alias("code"),
        F.expr("IF(node_id % 40 = 3, float('inf'), scale)").alias("scale"),
        "inv_mag",
        F.expr("IF(node_id % 40 = 4, array(450L), array(0L, 449L))").alias("neighbors"),
    )
    return rows.select("node_id", mutate.raw_fault(DIMS, 450, "int8").alias("fault"))


# ---- mutations replayed from a log ----


def log(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """Events as mutations: node_id, seq, key (signups only) and the vector of the event.

    Vectors are dealt to events in turn, all of them.
    """
    many = read(spark, sf_dir, "embeddings").count()
    events = read(spark, sf_dir, "events").where(F.col("event_type").isin(*kinds))
    vector = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("at"), "embedding")
    key = F.when(F.col("event_type") == "signup", F.concat_ws("-", F.lit("u"), "user_id", "event_id").cast("binary"))
    rows = events.select(F.col("user_id").alias("node_id"), F.col("event_id").alias("seq"), key.alias("key"), (F.col("event_id") % many).alias("at"))
    return rows.join(vector, "at").select("node_id", "seq", "embedding", "key")


_BASE = f"b AS (SELECT node_id, CASE WHEN status = 1 THEN key END AS key, status FROM ({_N.replace('n0 AS (', '', 1)[:-1]}))"


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed_nodes(spark, sf_dir)
    return rows.select("node_id", F.when(F.col("status") == 1, F.col("key")).alias("key"), "status", "embedding")


_FREED = f"{_BASE}, del AS (SELECT user_id AS node_id, min(event_id) AS seq FROM events WHERE event_type = 'error' GROUP BY user_id), fr AS (SELECT node_id, seq FROM del JOIN b USING (node_id) WHERE status = 1)"


def _deletes(spark, sf_dir):
    events = read(spark, sf_dir, "events").where("event_type = 'error'")
    return events.select(F.col("user_id").alias("node_id"), F.col("event_id").alias("seq"))


@query(f"WITH {_FREED} SELECT b.node_id, CASE WHEN fr.node_id IS NOT NULL THEN 2 ELSE status END AS status, coalesce(fr.seq, -1) AS seq FROM b LEFT JOIN fr USING (node_id)")
def delete_tombstones(spark, sf_dir):
    after, freed = mutate.delete(base(spark, sf_dir), _deletes(spark, sf_dir))
    return after.join(freed, "node_id", "left").select("node_id", "status", F.coalesce("seq", F.lit(-1)).alias("seq"))


@query(f"""WITH {_FREED}, st AS (SELECT node_id, row_number() OVER (ORDER BY seq DESC) AS rank FROM fr), i AS (SELECT vec_id AS seq, row_number() OVER (ORDER BY vec_id) AS rank FROM embeddings),
c AS (SELECT count(*) AS n, (SELECT max(vec_id) + 1 FROM embeddings) AS top FROM fr) SELECT i.seq, CAST(coalesce(st.node_id, c.top + i.rank - c.n - 1) AS BIGINT) AS node_id FROM i CROSS JOIN c LEFT JOIN st USING (rank)""")
def freelist_reuse_ids(spark, sf_dir):
    """Inserts take the ids freed last first, then new ones."""
    nodes = base(spark, sf_dir)
    _, freed = mutate.delete(nodes, _deletes(spark, sf_dir))
    top = mutate.high_water(nodes).first().high_water
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq"))
    return mutate.assigned(rows, freed, top, 4 * top).select("seq", "node_id")


_MIRROR = f"""{_BASE}, ev AS (SELECT user_id AS node_id, event_id AS seq, event_type, CASE WHEN event_type = 'signup' THEN concat_ws('-', 'u', user_id, event_id) END AS key, event_id % (SELECT count(*) FROM embeddings) AS pick FROM events WHERE event_type IN ('signup', 'purchase')),
la AS (SELECT node_id, max(seq) AS seq, arg_max(pick, seq) AS pick FROM ev GROUP BY node_id), ke AS (SELECT node_id, arg_max(key, seq) AS key FROM ev WHERE key IS NOT NULL GROUP BY node_id)"""


@query(f"""WITH {_MIRROR} SELECT la.node_id, 1 AS status, round(CAST(e.embedding[1] AS DOUBLE), 6) AS x FROM la JOIN embeddings e ON e.vec_id = la.pick
UNION ALL SELECT b.node_id, status, round(CAST(e.embedding[1] AS DOUBLE), 6) AS x FROM b JOIN embeddings e ON e.vec_id = b.node_id WHERE b.node_id NOT IN (SELECT node_id FROM la)""")
def mirror_upsert_latest(spark, sf_dir):
    after = mutate.mirror(base(spark, sf_dir), log(spark, sf_dir, "signup", "purchase"))
    return after.select("node_id", "status", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("x"))


@query(f"""WITH {_MIRROR} SELECT la.node_id, coalesce(ke.key, b.key) AS key FROM la LEFT JOIN ke USING (node_id) LEFT JOIN b USING (node_id) UNION ALL SELECT node_id, key FROM b WHERE node_id NOT IN (SELECT node_id FROM la)""")
def key_keep_on_omit(spark, sf_dir):
    """A write without a key keeps the newest key there is."""
    after = mutate.mirror(base(spark, sf_dir), log(spark, sf_dir, "signup", "purchase"))
    return after.select("node_id", F.col("key").cast("string").alias("key"))


@query(f"""WITH {_BASE}, ev AS (SELECT user_id AS node_id, event_id AS seq FROM events WHERE event_type = 'view')
SELECT ev.node_id, ev.seq, coalesce(b.status, 0) = 0 AND row_number() OVER (PARTITION BY ev.node_id ORDER BY ev.seq) = 1 AS written FROM ev LEFT JOIN b USING (node_id)""")
def write_if_absent(spark, sf_dir):
    return mutate.if_absent(base(spark, sf_dir), log(spark, sf_dir, "view")).select("node_id", "seq", "written")


@query(f"""WITH {_BASE}, ev AS (SELECT DISTINCT user_id AS node_id FROM events WHERE event_type = 'click' AND user_id < 2 * (SELECT max(vec_id) + 1 FROM embeddings))
SELECT coalesce(b.node_id, ev.node_id) AS node_id, CASE WHEN ev.node_id IS NOT NULL THEN 2 ELSE status END AS status FROM b FULL JOIN ev ON b.node_id = ev.node_id""")
def clear_node(spark, sf_dir):
    nodes = base(spark, sf_dir)
    return mutate.clear(nodes, log(spark, sf_dir, "click"), 2 * mutate.high_water(nodes).first().high_water).select("node_id", "status")


# ---- levels, entry, geometry ----

_LEVEL = "CAST(least(8, floor(-ln(greatest(CAST(xor(x, x >> 33) AS DOUBLE) / 18446744073709551616.0, 2.2250738585072014e-308)) / ln(16.0))) AS INTEGER)"
_LEVELS = f"lv AS (SELECT node_id, {_LEVEL} AS level FROM (SELECT vec_id AS node_id, (CAST(vec_id AS UHUGEINT) * 11400714819323198485::UHUGEINT + 2685821657736338717::UHUGEINT) % 18446744073709551616::UHUGEINT AS x FROM embeddings))"


def levelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_nodes(spark, sf_dir).withColumn("level", vectors.level("node_id"))


@query(f"WITH {_LEVELS} SELECT * FROM lv")
def level_assignment(spark, sf_dir):
    return levelled(spark, sf_dir).select("node_id", "level")


@query(f"WITH {_LEVELS} SELECT level, count(*) AS nodes FROM lv GROUP BY level")
def level_histogram(spark, sf_dir):
    return levelled(spark, sf_dir).groupBy("level").agg(F.count("*").alias("nodes"))


@query(f"WITH {_LEVELS}, {_N} SELECT node_id, level FROM lv JOIN n0 USING (node_id) WHERE status = 1 ORDER BY level DESC, node_id LIMIT 1")
def entry_election(spark, sf_dir):
    return mutate.elect_entry(levelled(spark, sf_dir))


_GRID = "(VALUES (128, 32, 40, 'int8'), (128, 64, 40, 'int8'), (128, 128, 40, 'int8'), (768, 32, 0, 'int8'), (768, 64, 0, 'int8'), (768, 128, 0, 'int8'), (1536, 32, 0, 'int8'), (1536, 32, 0, 'int16'), (25, 16, 0, 'int8'), (64, 32, 16, 'int16'))"


@query(f"""WITH g AS (SELECT * FROM {_GRID} AS t(dims, cap, key_cap, precision)), r AS (SELECT *, 20 + 4 * ((dims * CASE precision WHEN 'int16' THEN 2 ELSE 1 END + 3) // 4) + 4 * cap + CASE WHEN key_cap > 0 THEN 4 + key_cap ELSE 0 END AS raw FROM g),
s AS (SELECT *, 64 * ((raw + 63) // 64) AS slot_size FROM r)
SELECT dims, cap, key_cap, precision, CAST(raw AS BIGINT) AS raw, CAST(slot_size AS BIGINT) AS slot_size, CAST(CASE WHEN slot_size <= 4096 AND 4096 - (4096 // slot_size) * slot_size <= 128 THEN 4096 // slot_size ELSE 0 END AS BIGINT) AS slots_per_page FROM s""")
def slot_geometry(spark, sf_dir):
    grid = spark.sql(f"SELECT * FROM {_GRID.replace('(VALUES', 'VALUES', 1)[:-1]} AS t(dims, cap, key_cap, precision)")
    return grid.select("*", *(c.alias(name) for name, c in vectors.slot_geometry("dims", "cap", "key_cap", "precision").items()))


# ---- graphs ----

_KNN16 = f"""{_pairs("exact", "n.vec_id <> q.vec_id", "true")}, {_hits(16)}, g AS (SELECT query_id AS src, rank AS pos, node_id AS dst, distance FROM h)"""


@query(f"WITH {_KNN16} SELECT src, pos, dst, {_ROUND} FROM g")
def knn_graph_edges(spark, sf_dir):
    return graph.knn_edges(nodes_of(spark, sf_dir), 16).select("src", "pos", "dst", rounded())


_CAPPED = f"""{_KNN16}, bo AS (SELECT src, dst, min(distance) AS distance FROM (SELECT src, dst, distance FROM g UNION ALL SELECT dst, src, distance FROM g) GROUP BY src, dst),
ca AS (SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS INTEGER) AS pos, dst FROM bo QUALIFY pos <= 24)"""


def _capped(spark, sf_dir):
    return graph.reversed_capped(graph.knn_edges(nodes_of(spark, sf_dir), 16), 24)


@query(f"WITH {_CAPPED} SELECT * FROM ca")
def reverse_edges_capped(spark, sf_dir):
    return _capped(spark, sf_dir).select("src", "pos", "dst")


@query(f"""WITH {_CAPPED}, dg AS (SELECT count(*) AS d FROM ca GROUP BY src), o AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM dg)
SELECT max(n) AS nodes, round(avg(d), 6) AS mean, max(d) FILTER (i = n * 50 // 100) AS p50, max(d) FILTER (i = n * 90 // 100) AS p90, max(d) FILTER (i = n * 99 // 100) AS p99, max(d) AS max,
round(count(*) FILTER (d <= 32) / count(*), 6) AS le32, round(count(*) FILTER (d <= 48) / count(*), 6) AS le48, round(count(*) FILTER (d <= 64) / count(*), 6) AS le64 FROM o""")
def degree_report(spark, sf_dir):
    out = reports.degrees(_capped(spark, sf_dir), nodes_of(spark, sf_dir))
    return out.select("nodes", F.round("mean", 6).alias("mean"), "p50", "p90", "p99", "max", *(F.round(c, 6).alias(c) for c in ("le32", "le48", "le64")))


@query(f"WITH {_KNN16} SELECT DISTINCT q.vec_id AS query_id, dst AS node_id FROM g JOIN embeddings q ON q.vec_id = src WHERE q.vec_id % {EVERY} = 0")
def adjacency_expand_1hop(spark, sf_dir):
    frontier = asked(spark, sf_dir).select("query_id", F.col("query_id").alias("node_id"))
    return graph.expand(frontier, graph.knn_edges(nodes_of(spark, sf_dir), 16))


@query(f"""WITH {_KNN16}, o AS (SELECT DISTINCT src AS query_id, dst AS node_id FROM g WHERE src % {EVERY} = 0), t AS (SELECT DISTINCT query_id, dst AS node_id FROM o JOIN g ON src = node_id)
SELECT * FROM t EXCEPT (SELECT * FROM o UNION SELECT vec_id, vec_id FROM embeddings WHERE vec_id % {EVERY} = 0)""")
def visited_antijoin_2hop(spark, sf_dir):
    edges = graph.knn_edges(nodes_of(spark, sf_dir), 16)
    start = asked(spark, sf_dir).select("query_id", F.col("query_id").alias("node_id"))
    one = graph.expand(start, edges)
    return graph.unvisited(graph.expand(one, edges), start.unionByName(one))


@query(f"WITH {_KNN16} SELECT src, pos, dst FROM g WHERE NOT (src % 5 = 0 AND dst % 2 = 0)")
def remove_edges(spark, sf_dir):
    edges = graph.knn_edges(nodes_of(spark, sf_dir), 16)
    return graph.without(edges, edges.where("src % 5 = 0 AND dst % 2 = 0")).select("src", "pos", "dst")


@query(f"WITH {_KNN16} SELECT src, pos, dst FROM g WHERE pos <= 4")
def truncate_edges(spark, sf_dir):
    return graph.truncated(graph.knn_edges(nodes_of(spark, sf_dir), 16), 4).select("src", "pos", "dst")


@query(f"WITH {_KNN16}, {_N} SELECT src, pos, dst FROM g JOIN n0 a ON a.node_id = src AND a.status = 1 JOIN n0 b ON b.node_id = dst AND b.status = 1")
def compact_edges(spark, sf_dir):
    return mutate.compacted(graph.knn_edges(nodes_of(spark, sf_dir), 16).select("src", "pos", "dst"), mixed_nodes(spark, sf_dir))


@query()
def coverage_pruned_graph(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    return graph.pruned(graph.knn_edges(nodes, 32), nodes, 16).select("src", "pos", "dst", rounded())


@query()
def routing_selected_graph(spark, sf_dir):
    return graph.routed(graph.knn_edges(nodes_of(spark, sf_dir), 32)).select("src", "pos", "dst", rounded())


@query()
def graph_top10(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    return shown(graph.search(nodes, graph.build(nodes, 4), asked(spark, sf_dir), 10, 128, 4))


@query()
def graph_filtered_budget_top10(spark, sf_dir):
    """Even ids only, and no more than 1,000 visits of the lowest layer in a shard."""
    nodes = nodes_of(spark, sf_dir)
    allowed = nodes.where("node_id % 2 = 0")
    return shown(graph.search(nodes, graph.build(nodes, 4), asked(spark, sf_dir), 10, 128, 4, allowed=allowed, budget=1000))


@query()
def ivf_top10(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    centre = ivf.fit_cells(nodes, 16)
    return shown(ivf.search(ivf.with_cells(nodes, centre), asked(spark, sf_dir), centre, 10, 12))


@query("SELECT method, true AS enough FROM (VALUES ('graph'), ('graph, even ids'), ('ivf')) AS t(method)")
def index_recall(spark, sf_dir):
    """Whether each index finds at least nine tenths of the true ten nearest, by brute force."""
    nodes, queries = nodes_of(spark, sf_dir), asked(spark, sf_dir)
    even = nodes.where("node_id % 2 = 0")
    edges = graph.build(nodes, 4)
    centre = ivf.fit_cells(nodes, 16)
    found = {
        "graph": (nodes, graph.search(nodes, edges, queries, 10, 128, 4)),
        "graph, even ids": (even, graph.search(nodes, edges, queries, 10, 128, 4, allowed=even, budget=128 * graph.FILTER_EXPANSION)),
        "ivf": (nodes, ivf.search(ivf.with_cells(nodes, centre), queries, centre, 10, 12)),
    }
    parts = [reports.recall(search.knn(among, queries, 10), hits).select(F.lit(name).alias("method"), (F.col("recall") >= 0.9).alias("enough")) for name, (among, hits) in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- planes, sources, streams ----


def _small_plane(spark: SparkSession, sf_dir: str, **options: object) -> Plane:
    plane = Plane.create(spark, workspace(spark, "plane"), DIMS, max_nodes=1_000_000, key_cap=16, **options)
    rows = read(spark, sf_dir, "embeddings")
    plane.insert_batch(rows.select(F.col("vec_id").alias("seq"), "embedding", F.concat(F.lit("r"), F.col("vec_id")).cast("binary").alias("key")))
    return plane


@query(f"WITH {_pairs('int16', 'n.vec_id NOT IN (5, 6)')}, {_hits(10)} SELECT query_id, rank, node_id, {_ROUND}, 'r' || node_id AS key FROM h")
def plane_search(spark, sf_dir):
    """Create, insert, delete, flush, open again and search."""
    plane = _small_plane(spark, sf_dir, precision="int16")
    plane.remove(spark.createDataFrame([(5, 0), (6, 1)], "node_id bigint, seq bigint"))
    plane.flush(7)
    again = Plane.open(spark, plane.path)
    return again.search(asked(spark, sf_dir), 10).select("query_id", "rank", "node_id", rounded(), F.col("key").cast("string").alias("key"))


@query("SELECT method, count(*) AS found FROM (VALUES ('exact'), ('graph'), ('ivf')) AS t(method), embeddings WHERE vec_id % 2 = 1 GROUP BY method")
def search_after_writes(spark, sf_dir):
    """Vectors written after the indexes were built, found by their own vector: all, by each method."""
    plane = Plane.create(spark, workspace(spark, "plane"), DIMS, max_nodes=1_000_000, key_cap=16)
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq"), "embedding", F.concat(F.lit("r"), F.col("vec_id")).cast("binary").alias("key"))
    plane.insert_batch(rows.where("seq % 2 = 0"))
    plane.build_graph(4)
    plane.build_cells(16)
    late = rows.where("seq % 2 = 1")
    plane.insert_batch(late)
    queries = late.select(F.col("seq").alias("query_id"), "embedding")
    found = [plane.search(queries, 1, method=m, metric="exact", nprobe=2, ef=16).where("key = CAST(concat('r', query_id) AS BINARY)").agg(F.count("*").alias("found")).select(F.lit(m).alias("method"), "found") for m in ("exact", "graph", "ivf")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"""WITH {_LEVELS}, en AS (SELECT node_id, level FROM lv ORDER BY level DESC, node_id LIMIT 1)
SELECT 8 AS version, 'int8' AS precision, 64 AS dims, 64 AS layer0_cap, CAST(1000000 AS BIGINT) AS max_nodes, 16 AS key_cap, node_id AS entry_id, level AS entry_level,
(SELECT count(*) FROM embeddings) AS id_high_water, CAST(0 AS BIGINT) AS watermark, true AS clean, false AS invalidated, CAST(1 AS BIGINT) AS write_epoch FROM en""")
def plane_meta(spark, sf_dir):
    return _small_plane(spark, sf_dir).meta()


@query("SELECT vec_id AS seq, CASE WHEN vec_id < 100 THEN vec_id ELSE -1 END AS node_id, CASE WHEN vec_id < 100 THEN '' ELSE 'full' END AS code, CASE WHEN vec_id < 100 THEN '' ELSE 'plane is full' END AS reason FROM embeddings")
def plane_full(spark, sf_dir):
    """A batch that runs a plane full: what landed and what did not."""
    plane = Plane.create(spark, workspace(spark, "plane"), DIMS, max_nodes=100)
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq"), "embedding", F.lit(None).cast("binary").alias("key"))
    try:
        out = plane.insert_batch(rows)
    except PlaneFault as fault:
        out = fault.outcome
    return out.select("seq", F.coalesce("node_id", F.lit(-1)).alias("node_id"), F.coalesce("code", F.lit("")).alias("code"), F.coalesce("reason", F.lit("")).alias("reason"))


@query("SELECT step, CAST(watermark AS BIGINT) AS watermark FROM (VALUES ('1 created', 0), ('2 flush 7', 7), ('3 flush', 7), ('4 flush 9', 9), ('5 opened', 9), ('6 invalidated', 0)) AS t(step, watermark)")
def plane_watermarks(spark, sf_dir):
    """The watermark moves only with a flush that names one, and reads zero once invalidated."""
    plane = Plane.create(spark, workspace(spark, "plane"), DIMS, max_nodes=100)
    seen = [("1 created", plane.watermark)]
    for step, mark in (("2 flush 7", 7), ("3 flush", None), ("4 flush 9", 9)):
        plane.flush(mark)
        seen.append((step, plane.watermark))
    plane = Plane.open(spark, plane.path)
    seen.append(("5 opened", plane.watermark))
    plane.invalidate()
    seen.append(("6 invalidated", plane.watermark))
    return spark.createDataFrame(seen, "step string, watermark bigint")


@query("SELECT step, CAST(entry_id AS BIGINT) AS entry_id, entry_level FROM (VALUES ('1 empty', -1, -1), ('2 claimed', 0, 0), ('3 equal keeps', 0, 0), ('4 higher takes over', 236, 2), ('5 lower keeps', 236, 2), ('6 deleted', 469, 2), ('7 set by hand', 12, 8)) AS t(step, entry_id, entry_level)")
def entry_rules(spark, sf_dir):
    """Who is the entry point as nodes come and go: mirror writes under chosen ids."""
    plane = Plane.create(spark, workspace(spark, "plane"), 2, max_nodes=1000)
    seen: list[tuple] = []

    def note(step: str) -> None:
        seen.append((step, *(plane.entry_point or (-1, -1))))

    def write(node_id: int) -> None:
        plane.mirror(spark.createDataFrame([(node_id, 0, [1.0, 0.5], None)], "node_id bigint, seq bigint, embedding array<float>, key binary"))

    note("1 empty")
    for step, node_id in (("2 claimed", 0), ("3 equal keeps", 1), ("4 higher takes over", 236), ("5 lower keeps", 2)):
        write(node_id)
        note(step)
    write(469)
    plane.remove(spark.createDataFrame([(236, 0)], "node_id bigint, seq bigint"))
    note("6 deleted")
    plane.set_entry_point(12, 11)
    note("7 set by hand")
    return spark.createDataFrame(seen, "step string, entry_id bigint, entry_level int")


@query("SELECT rank, CAST(node_id AS BIGINT) AS node_id FROM (VALUES (1, 4), (2, 2), (3, 3), (4, 1), (5, 0)) AS t(rank, node_id)")
def total_order(spark, sf_dir):
    """Hits in total order: negative distances first, ties by id, NaN after all."""
    rows = [(0, 0, float("nan")), (0, 1, float("inf")), (0, 2, 0.5), (0, 3, 0.5), (0, 4, -0.001)]
    return search.top(spark.createDataFrame(rows, search.HITS), 5).select("rank", "node_id")


@query(f"WITH {_MIRROR} SELECT la.node_id, 1 AS status, coalesce(ke.key, '') AS key FROM la LEFT JOIN ke USING (node_id)")
def stream_ingest(spark, sf_dir):
    """Mirror writes streamed from files, each batch once; the table after them."""
    from ..streaming.ingest import ingest

    source = workspace(spark, "stream")
    log(spark, sf_dir, "signup", "purchase").repartition(4, "node_id").write.parquet(source)
    plane = Plane.create(spark, workspace(spark, "plane"), DIMS, max_nodes=1_000_000, key_cap=16)
    stream = spark.readStream.schema("node_id bigint, seq bigint, embedding array<float>, key binary").parquet(source)
    ingest(plane, stream, workspace(spark, "progress")).awaitTermination()
    return plane.nodes().select("node_id", "status", F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"))


@query()
def gaussian_mixture(spark, sf_dir):
    return sources.gaussian_mixture(spark, 1000, 32)


def _vector_file(spark: SparkSession, sf_dir: str, header: bool) -> str:
    """The vectors in a file of records, by way of one writer: a fixture for the readers."""
    import numpy as np

    path = workspace(spark, "vectors")
    raw = bytearray()
    for r in read(spark, sf_dir, "embeddings").orderBy("vec_id").toLocalIterator():
        raw += (np.int32(DIMS).tobytes() if header else b"") + np.array(r.embedding, "<f4").tobytes()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    stream.write(raw)
    stream.close()
    return path


_EXPLODED = "SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(CAST(embedding[i] AS DOUBLE), 6) AS value FROM embeddings, (SELECT unnest(range(1, 65)) AS i)"


def _exploded(df: DataFrame) -> DataFrame:
    rows = df.select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return rows.select("vec_id", "pos", F.round(F.col("x").cast("double"), 6).alias("value"))


@query(_EXPLODED)
def fvecs_source(spark, sf_dir):
    """Vectors written as records of a dimension and floats, and read back."""
    return _exploded(sources.read_fvecs(spark, _vector_file(spark, sf_dir, True)))


@query(_EXPLODED)
def raw_pool_source(spark, sf_dir):
    """Vectors written as floats alone, and read back."""
    return _exploded(sources.read_raw(spark, _vector_file(spark, sf_dir, False), DIMS))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact top 10 of the query set among nodes whose label is not 0, with host keys."""
    nodes = nodes_of(spark, sf_dir)
    hits = search.gather_keys(search.knn(nodes, asked(spark, sf_dir), 10, where=F.col("label") != 0), nodes)
    return hits.select("query_id", "rank", "node_id", "distance", F.col("key").cast("string").alias("key")).orderBy("query_id", "rank")
