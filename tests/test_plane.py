import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecharbor.operators import graph, ivf, mutate, reports, search
from vecharbor.plans.plane import Plane, PlaneError, PlaneFault, invalidate_plane, stale_path_for
from vecharbor.sources import vectors as sources
from vecharbor.streaming.ingest import apply_batch, ingest

RECORD = "seq bigint, embedding array<float>, key binary"


@pytest.fixture(scope="module")
def mixture(spark):
    return sources.gaussian_mixture(spark, 400, 16).cache()


def batch(spark, rows):
    return spark.createDataFrame(rows, RECORD)


def records(mixture, key="k"):
    return mixture.select(F.col("vec_id").alias("seq"), "embedding", F.concat(F.lit(key), F.col("vec_id")).cast("binary").alias("key"))


@pytest.fixture
def plane(spark, tmp_path):
    return Plane.create(spark, str(tmp_path / "p"), 4, max_nodes=100, key_cap=8)


def axis(i):
    return [float(i % 4 == d) for d in range(4)]


def test_ids_in_order_and_reused_last_freed_first(spark, plane):
    out = plane.insert_batch(batch(spark, [(i, axis(i), None) for i in range(8)]))
    assert [r.node_id for r in out.orderBy("seq").collect()] == list(range(8))
    plane.remove(spark.createDataFrame([(5, 0), (6, 1), (6, 2), (77, 3)], "node_id bigint, seq bigint"))
    assert [plane.insert(axis(1)) for _ in range(3)] == [6, 5, 8]
    assert plane.id_high_water == 9
    assert plane.nodes().where("status = 1").count() == 9


def test_faults_consume_no_id(spark, plane):
    rows = [(0, axis(0), None), (1, [math.nan, 0.0, 0.0, 0.0], None), (2, [1.0, 2.0], None), (3, axis(1), b"x" * 70_000), (4, [math.inf, 0.0, 0.0, 0.0], None), (5, axis(2), b"ok"), (6, None, None)]
    out = {r.seq: (r.node_id, r.code) for r in plane.insert_batch(batch(spark, rows)).collect()}
    assert out == {0: (0, None), 1: (None, "not-finite"), 2: (None, "dimension-mismatch"), 3: (None, "key-unstorable"), 4: (None, "not-finite"), 5: (1, None), 6: (None, "dimension-mismatch")}


def test_full_plane_lands_exactly_its_capacity(spark, tmp_path):
    plane = Plane.create(spark, str(tmp_path / "p"), 4, max_nodes=10)
    with pytest.raises(PlaneFault, match="full") as fault:
        plane.insert_batch(batch(spark, [(i, axis(i), None) for i in range(16)]))
    assert fault.value.outcome.where("node_id IS NOT NULL").count() == 10
    assert plane.nodes().count() == 10


def test_keys_on_a_keyless_plane_cannot_be_stored(spark, tmp_path):
    plane = Plane.create(spark, str(tmp_path / "p"), 4, max_nodes=10)
    with pytest.raises(PlaneError, match="key"):
        plane.insert(axis(0), b"k")


def test_arena_holds_as_many_long_keys_as_fit(spark, tmp_path):
    plane = Plane.create(spark, str(tmp_path / "p"), 4, max_nodes=8, key_cap=8, key_arena_bytes_per_node=128)
    out = plane.insert_batch(batch(spark, [(i, axis(i), b"k" * 200) for i in range(6)]))
    assert [r.code for r in out.orderBy("seq").collect()] == [None] * 4 + ["key-arena-full"] * 2


def test_batches_match_a_sequential_stack(spark):
    rng = np.random.default_rng(3)
    free, high, alive = [], 0, set()
    stack = spark.createDataFrame([], "node_id bigint, seq bigint")
    for _ in range(2):
        gone = [int(x) for x in rng.permutation(sorted(alive))[:5]]
        deletes = spark.createDataFrame([(x, 1000 + i) for i, x in enumerate(gone)], "node_id bigint, seq bigint")
        free += gone
        stack = spark.createDataFrame([(x, i) for i, x in enumerate(free)], "node_id bigint, seq bigint")
        assert deletes.count() == len(gone)
        n = int(rng.integers(3, 12))
        want = [free.pop() if free else (high := high + 1) - 1 for _ in range(n)]
        first_high = high - sum(1 for w in want if w not in gone)
        got = mutate.assigned(spark.range(n).withColumnRenamed("id", "seq"), stack, first_high, 10_000)
        assert [r.node_id for r in got.orderBy("seq").collect()] == want
        alive = (alive - set(gone)) | set(want)


def test_mirror_keeps_keys_and_the_newest_write(spark, plane):
    ops = "node_id bigint, seq bigint, embedding array<float>, key binary"
    plane.mirror(spark.createDataFrame([(3, 0, axis(0), b"a"), (3, 2, axis(2), None), (3, 1, axis(1), b"b")], ops))
    row = plane.nodes().where("node_id = 3").first()
    assert (bytes(row.key), row.embedding, row.level) == (b"b", axis(2), 0)
    plane.mirror(spark.createDataFrame([(3, 9, axis(3), None)], ops))
    assert bytes(plane.nodes().where("node_id = 3").first().key) == b"b"
    plane.clear_nodes(spark.createDataFrame([(4,), (4,), (1000,)], "node_id bigint"))
    out = plane.mirror_if_absent(spark.createDataFrame([(3, 0, axis(0), None), (4, 0, axis(0), None), (5, 0, axis(0), b"c"), (5, 1, axis(1), b"d")], ops))
    assert {(r.node_id, r.seq) for r in out.where("written").collect()} == {(5, 0)}
    assert {r.node_id: r.status for r in plane.nodes().collect()} == {3: 1, 4: 2, 5: 1}
    assert plane.id_high_water == 6
    with pytest.raises(PlaneError, match="range"):
        plane.mirror(spark.createDataFrame([(100, 0, axis(0), None)], ops))


RAW_LINKS = "node_id bigint, seq bigint, code array<smallint>, scale float, level int, neighbors array<bigint>, upper array<array<bigint>>, key binary"


def test_raw_writes_keep_the_hosts_codes_levels_and_links(spark, tmp_path):
    plane = Plane.create(spark, str(tmp_path / "p"), 2, max_nodes=20, layer0_cap=2, key_cap=8)

    def write(node_id, code, level, neighbors, upper, seq=0):
        plane.mirror(spark.createDataFrame([(node_id, seq, code, 0.5, level, neighbors, upper, None)], RAW_LINKS))

    def links(node_id):
        return sorted((r.level, r.pos, r.dst) for r in plane.links().where(F.col("src") == node_id).collect())

    write(9, [3, -4], 1, [1, 2, 3], [[7]])
    row = plane.nodes().first()
    assert (row.code, row.scale, row.embedding, row.level) == ([3, -4], 0.5, [1.5, -2.0], 1) and math.isclose(row.inv_mag, 1 / 2.5)
    assert links(9) == [(0, 1, 1), (0, 2, 2), (1, 1, 7)]
    # A rewrite at the lowest level leaves nothing of the layers above.
    write(9, [127, 0], 0, [], [], seq=1)
    assert links(9) == [] and plane.nodes().first().level == 0
    for bad in ((20, [1, 1], 0, [], []), (1, [128, 1], 0, [], []), (1, [1, 1], 0, [20], []), (1, [1, 1], 1, [], [[-1]])):
        with pytest.raises(PlaneError, match="range"):
            write(*bad)
    first = spark.createDataFrame([(9, 0, [1, 1], 1.0, 0, [], [], None), (4, 0, [1, 1], 1.0, 0, [9], None, b"k")], RAW_LINKS)
    assert {r.node_id for r in plane.mirror_if_absent(first).where("written").collect()} == {4}
    assert links(4) == [(0, 1, 9)]


def test_search_follows_the_hosts_links(spark, tmp_path, mixture):
    plane = Plane.create(spark, str(tmp_path / "p"), 16, max_nodes=1000, key_cap=8)
    nodes = mixture.where("vec_id < 200").select(F.col("vec_id").alias("node_id"), F.lit(0).alias("seq"), "embedding").cache()
    near = graph.reversed_capped(graph.knn_edges(nodes, 10), 40).groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"]).alias("neighbors"))
    # A ring over all nodes, so that every one can be reached.
    ring = F.array(((F.col("node_id") + 1) % 200).cast("bigint"))
    plane.mirror(nodes.join(near, F.col("src") == F.col("node_id")).select("node_id", "seq", "embedding", F.concat("neighbors", ring).alias("neighbors")))
    queries = nodes.where("node_id % 10 = 0").select(F.col("node_id").alias("query_id"), "embedding")
    truth = plane.search(queries, 5, metric="exact")
    assert reports.recall(truth, plane.search(queries, 5, method="links", ef=40)).first().recall >= 0.95
    # Deleted nodes and nodes that are filtered out lead on; a node without links is found too.
    plane.clear_nodes(queries.select(F.col("query_id").alias("node_id")))
    plane.mirror(queries.where("query_id = 30").select((F.col("query_id") + 200).alias("node_id"), F.lit(1).alias("seq"), "embedding"))
    got = plane.search(queries, 5, method="links", ef=40, where="node_id % 2 = 0").collect()
    want = plane.search(queries, 5, metric="exact", where="node_id % 2 = 0").collect()
    assert all(r.node_id % 10 or r.node_id == 230 for r in got) and all(r.node_id % 2 == 0 for r in got)
    assert (30, 1, 230) in {(r.query_id, r.rank, r.node_id) for r in got}
    assert len({(r.query_id, r.node_id) for r in got} & {(r.query_id, r.node_id) for r in want}) >= 0.95 * len(want)


def test_room_of_long_keys_is_given_back(spark, tmp_path):
    plane = Plane.create(spark, str(tmp_path / "p"), 4, max_nodes=8, key_cap=8)
    raw = "node_id bigint, seq bigint, embedding array<float>, key binary"
    for i in range(2):
        plane.mirror(spark.createDataFrame([(0, i, axis(i), bytes([97 + i]) * 200)], raw))
        assert plane.state["arena_used"] == 256
    plane.mirror(spark.createDataFrame([(0, 3, axis(0), b"y" * 300)], raw))
    plane.mirror(spark.createDataFrame([(0, 4, axis(0), None)], raw))
    assert plane.state["arena_used"] == 320
    # Four nodes of 256 bytes fit 1,024; a fifth does not, and is not written.
    with pytest.raises(PlaneError, match="long keys"):
        plane.mirror(spark.createDataFrame([(i, 5, axis(i), b"z" * 200) for i in range(5)], raw))
    assert plane.nodes().count() == 1 and plane.state["arena_used"] == 320
    plane.clear_nodes(spark.createDataFrame([(0,), (7,)], "node_id bigint"))
    plane.clear_nodes(spark.createDataFrame([(0,)], "node_id bigint"))
    assert plane.state["arena_used"] == 0
    other = Plane.create(spark, str(tmp_path / "q"), 4, max_nodes=8, key_cap=8)
    for i in range(2):
        assert other.insert(axis(i), b"k" * 700) == 0
        other.remove(spark.createDataFrame([(0, i)], "node_id bigint, seq bigint"))
    assert other.state["arena_used"] == 0


def test_lifecycle(spark, tmp_path, plane):
    plane.flush(7)
    plane.flush()
    assert Plane.open(spark, plane.path).watermark == 7
    with pytest.raises(PlaneError, match="exists"):
        Plane.create(spark, plane.path, 4, max_nodes=5)
    other = Plane.open(spark, plane.path)
    other.flush(8)
    with pytest.raises(PlaneError, match="another writer"):
        plane.flush(9)
    other.invalidate()
    assert other.invalidated and other.watermark == 0
    with pytest.raises(PlaneError, match="invalidated"):
        Plane.open(spark, plane.path)
    done = invalidate_plane(spark, plane.path)
    assert done.latched and done.marked and invalidate_plane(spark, plane.path).marked
    assert stale_path_for("/a/b/") == "/a/b.stale"
    with pytest.raises(PlaneError, match="stale"):
        Plane.create(spark, plane.path, 4, max_nodes=5)


@pytest.mark.parametrize("bad", [{"dims": 0}, {"dims": 70_000}, {"max_nodes": 0}, {"layer0_cap": 0}, {"key_cap": 3}, {"precision": "f32"}, {"key_cap": 8, "key_arena_bytes_per_node": 10}])
def test_geometry_is_checked(spark, tmp_path, bad):
    with pytest.raises(PlaneError):
        Plane.create(spark, str(tmp_path / "p"), **({"dims": 4, "max_nodes": 10} | bad))


def test_searches(spark, tmp_path, mixture):
    plane = Plane.create(spark, str(tmp_path / "p"), 16, max_nodes=1000, key_cap=8)
    plane.insert_batch(records(mixture))
    queries = mixture.where("vec_id < 40").select(F.col("vec_id").alias("query_id"), "embedding")
    truth = plane.search(queries, 10, metric="exact").cache()
    first = truth.where("rank = 1").collect()
    assert all(r.node_id == r.query_id and bytes(r.key) == f"k{r.node_id}".encode() for r in first)
    plane.build_graph(2)
    plane.build_cells(12)
    for options in ({"method": "graph", "ef": 64}, {"method": "ivf", "nprobe": 6}, {"metric": "int8"}, {"metric": "int16"}):
        hits = plane.search(queries, 10, **options)
        assert reports.recall(truth, hits).first().recall >= 0.95, options
    even = plane.nodes().where("node_id % 2 = 0").select("node_id")
    for options in ({}, {"method": "graph"}, {"method": "ivf"}):
        got = plane.search(queries, 5, allowed=even, **options).collect()
        assert got and all(r.node_id % 2 == 0 for r in got)
    plane.remove(spark.createDataFrame([(0, 0), (1, 1)], "node_id bigint, seq bigint"))
    for method in ("exact", "graph", "ivf"):
        assert plane.search(queries, 10, method=method).where("node_id < 2").isEmpty()
    with pytest.raises(Exception, match="dims"):
        plane.search(queries.withColumn("embedding", F.slice("embedding", 1, 3)), 3).collect()
    edges = graph.knn_edges(plane.nodes(), 8)
    start = plane.nodes().where("status = 1").select("node_id").limit(8)
    found = graph.beam_rounds(plane.nodes(), edges, queries, start, 10, 64)
    assert reports.recall(truth, found).first().recall >= 0.9


def test_indexes_find_what_was_written_since(spark, tmp_path, mixture):
    plane = Plane.create(spark, str(tmp_path / "p"), 16, max_nodes=1000, key_cap=8)
    early, late = mixture.where("vec_id < 300"), mixture.where("vec_id >= 300")
    plane.insert_batch(records(early))
    plane.build_graph(2)
    plane.build_cells(12)
    plane.insert_batch(records(late))
    queries = late.select(F.col("vec_id").alias("query_id"), "embedding")
    for method in ("exact", "graph", "ivf"):
        got = plane.search(queries, 1, method=method, metric="exact", nprobe=1, ef=1).collect()
        assert sorted(r.node_id for r in got) == list(range(300, 400)), method
    plane.extend_cells()
    assert plane.search(queries, 1, method="ivf", nprobe=2).where("node_id >= 300").count() == 100
    # A rewritten vector is found where it now is, and only there.
    plane.mirror(spark.createDataFrame([(7, 0, [float(d == 3) for d in range(16)], None)], "node_id bigint, seq bigint, embedding array<float>, key binary"))
    there = spark.createDataFrame([(0, [float(d == 3) for d in range(16)])], "query_id bigint, embedding array<float>")
    for method in ("exact", "graph", "ivf"):
        hits = plane.search(there, 3, method=method, metric="exact").collect()
        assert [r.node_id for r in hits].count(7) == 1 and min(hits, key=lambda r: r.rank).node_id == 7
    with pytest.raises(PlaneError, match="method"):
        plane.search(there, 3, method="tree")


def test_a_filtered_graph_search_has_a_default_budget(spark, tmp_path, mixture, monkeypatch):
    plane = Plane.create(spark, str(tmp_path / "p"), 16, max_nodes=1000)
    plane.insert_batch(records(mixture).withColumn("key", F.lit(None).cast("binary")))
    plane.build_graph(1)
    asked = mixture.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    seen = []
    real = graph.search
    monkeypatch.setattr(graph, "search", lambda *a, **k: seen.append((k["budget"], k["entry"])) or real(*a, **k))
    plane.search(asked, 3, method="graph", ef=10)
    plane.search(asked, 3, method="graph", ef=10, where="node_id % 2 = 0")
    plane.search(asked, 3, method="graph", ef=10, where="node_id % 2 = 0", visit_budget=0)
    assert [b for b, _ in seen] == [None, 240, 1] and {e for _, e in seen} == {plane.entry_point[0]}


def test_clean_flag_and_two_writers(spark, tmp_path, plane):
    assert plane.opened_clean
    plane.insert(axis(0))
    assert not Plane.open(spark, plane.path).opened_clean
    plane.flush()
    one, two = Plane.open(spark, plane.path), Plane.open(spark, plane.path)
    assert one.opened_clean
    one.insert(axis(1))
    with pytest.raises(PlaneError, match="another writer"):
        two.insert(axis(2))
    assert Plane.open(spark, plane.path).nodes().count() == 2


def test_late_stream_rows_do_not_overwrite_newer_ones(spark, plane):
    schema = "node_id bigint, seq bigint, embedding array<float>, key binary"
    assert apply_batch(plane, spark.createDataFrame([(1, 10, axis(1), b"a"), (2, 3, axis(2), None)], schema), 0)
    assert apply_batch(plane, spark.createDataFrame([(1, 9, axis(3), b"old"), (2, 4, axis(3), None), (3, 1, axis(0), None)], schema), 1)
    got = {r.node_id: (r.embedding, r.key and bytes(r.key), r.seq) for r in plane.nodes().collect()}
    assert got == {1: (axis(1), b"a", 10), 2: (axis(3), None, 4), 3: (axis(0), None, 1)}


def test_a_late_key_counts_where_it_is_the_newest(spark, plane):
    schema = "node_id bigint, seq bigint, embedding array<float>, key binary"
    apply_batch(plane, spark.createDataFrame([(1, 10, axis(1), None), (2, 10, axis(2), None), (2, 5, axis(0), b"c"), (3, 10, axis(3), None)], schema), 0)
    apply_batch(plane, spark.createDataFrame([(1, 8, axis(3), b"a"), (1, 9, axis(2), None), (2, 4, axis(3), b"old"), (3, 12, axis(0), None), (3, 9, axis(1), b"d")], schema), 1)
    apply_batch(plane, spark.createDataFrame([(1, 7, axis(0), b"old")], schema), 2)
    got = {r.node_id: (r.embedding, bytes(r.key), r.seq, r.key_seq) for r in plane.nodes().collect()}
    assert got == {1: (axis(1), b"a", 10, 8), 2: (axis(2), b"c", 10, 5), 3: (axis(0), b"d", 12, 9)}
    plane.clear_nodes(spark.createDataFrame([(3,)], "node_id bigint"))
    apply_batch(plane, spark.createDataFrame([(3, 11, axis(1), b"e")], schema), 3)
    assert plane.nodes().where("node_id = 3").first().status == 2


def test_arena_matches_a_fold(spark):
    rng = np.random.default_rng(8)
    for room, most in ((5_000, 600), (40_000, 3_000), (64, 200), (0, 200), (10**7, 900)):
        rows = [(i, b"k" * int(n)) for i, n in enumerate(rng.integers(1, most, 300))] + [(300, None)]
        left, want = room, []
        for seq, key in rows:
            need = -(-len(key or b"") // 64) * 64
            ok = len(key or b"") <= 16 or need <= left
            left -= need if ok and len(key or b"") > 16 else 0
            want.append((seq, ok))
        frame = spark.createDataFrame(rows, "seq bigint, key binary").repartition(5)
        got = mutate.arena_faults(frame, 16, room).select("seq", "arena_ok").collect()
        assert sorted(tuple(r) for r in got) == want


def test_empty_plane_gives_no_hits(spark, plane):
    queries = spark.createDataFrame([(1, axis(0))], "query_id bigint, embedding array<float>")
    assert plane.search(queries, 3).isEmpty()
    assert plane.search(queries.where("false"), 3).isEmpty()


def test_zero_vectors_are_at_distance_one(spark):
    nodes = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0])], "node_id bigint, embedding array<float>")
    queries = spark.createDataFrame([(0, [1.0, 1.0]), (1, [0.0, 0.0])], "query_id bigint, embedding array<float>")
    for backend in ("arrow", "sql"):
        got = {(r.query_id, r.node_id): round(r.distance, 6) for r in search.knn(nodes, queries, 2, backend=backend).collect()}
        assert got == {(0, 0): 1.0, (0, 1): round(1 - math.sqrt(0.5), 6), (1, 0): 1.0, (1, 1): 1.0}


def test_many_equal_vectors_tie_by_id(spark):
    nodes = spark.range(5000).select(F.col("id").alias("node_id"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"))
    queries = spark.createDataFrame([(0, [1.0, 2.0])], "query_id bigint, embedding array<float>")
    got = search.knn(nodes, queries, 4).orderBy("rank").collect()
    assert [r.node_id for r in got] == [0, 1, 2, 3]


def test_memory_of_a_product_is_bounded():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12_000, 8))
    x[:100] = x[7]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = rng.permutation(len(x))
    search.nearest(x[:2], x[:64], ids[:64], 3)
    tracemalloc.start()
    q, d, n = search.nearest(x, x, ids, 17)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20  # All distances at once would be 1,152 MB.
    for i in (0, 99, 100, 5_000, 11_999):
        distance = 1 - (x[i] * x).sum(axis=1)
        order = np.lexsort((ids, distance))[:17]
        assert n[q == i].tolist() == ids[order].tolist() and d[q == i] == pytest.approx(distance[order])


def test_nearest_puts_what_is_not_a_number_last():
    x = np.array([[1.0, 0.0], [np.nan, 0.0], [0.0, 1.0], [np.nan, 1.0]])
    q, d, n = search.nearest(x[:2], x, np.array([4, 3, 2, 1]), 3)
    assert n.tolist() == [4, 2, 1, 1, 2, 3] and np.isnan(d[2:]).all()


@pytest.mark.parametrize("metric", ["exact", "int8", "int16"])
def test_many_queries_go_to_blocks_of_nodes(spark, mixture, metric):
    nodes = sources.nodes_of(mixture)
    queries = nodes.select(F.col("node_id").alias("query_id"), "embedding")
    for among, way in ((nodes, True), (nodes.unionByName(nodes.withColumn("node_id", F.col("node_id") + 1000)), False)):
        stored = search.encoded(among, metric) if metric != "exact" else among
        assert (search._by_nodes(stored, queries, 5, metric, 90 * 16 * 8) is not None) == way
        want = search.knn(among, queries, 5, metric=metric).drop("distance").collect()
        assert sorted(search.knn(among, queries, 5, metric=metric, block_bytes=90 * 16 * 8).drop("distance").collect()) == sorted(want)
    blocks = list(search._node_blocks(search.live(nodes), "exact", 90 * 16 * 8))
    assert [len(ids) for ids, _ in blocks] == [90, 90, 90, 90, 40]


def test_codes_round_half_away_from_zero(spark):
    v = spark.createDataFrame([(0, [127.0, 2.5, -2.5, 0.5, -0.49])], "node_id bigint, embedding array<float>")
    assert search.encoded(v, "int8").first().code == [127, 3, -3, 1, 0]
    from vecharbor.functions.codec import encode_block

    assert encode_block(np.array([[127.0, 2.5, -2.5, 0.5, -0.49]]), "int8")[0].tolist() == [[127, 3, -3, 1, 0]]


def test_int16_ranks_disagree_far_less_than_int8(spark, mixture):
    nodes = sources.nodes_of(mixture)
    queries = mixture.where("vec_id < 100").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = search.knn(nodes, queries, 10)
    wrong = {m: reports.rank_disagreement(exact, search.knn(nodes, queries, 10, metric=m)).first().disagreements for m in ("int8", "int16")}
    assert wrong["int16"] * 20 < wrong["int8"] and wrong["int16"] <= 2


def plain_cover(near, pair, cap):
    """The rule of the inventory: of the farthest 16, from the end, the first that one of the nearest 16
    before them covers goes, else the farthest."""
    kept = list(range(len(near)))
    while len(kept) > cap:
        first = max(len(kept) - 16, 0)
        covered = [i for i in range(first, len(kept)) if any(pair[kept[i]][k] < near[kept[i]] for k in kept[: min(16, first)])]
        del kept[covered[-1] if covered else -1]
    return kept


def plain_route(near, lists, m, r):
    """Rules of the inventory over whole neighbour lists; candidates are 0..n-1, others negative."""
    kept, drop = [], []
    for i in range(min(len(near), 2 * m)):
        found, skip = [], False
        for i2, (other, link) in enumerate(lists[i]):
            if other in kept:
                if near[i] * (1 + r * (1 + 0.5 * i / m)) > near[other] + link:
                    skip = True
                    break
                if link * (1 + r * (1 + 0.5 * i2 / m)) > near[i] + near[other]:
                    found.append((i, other))
        if not skip:
            kept.append(i)
            drop += found
    return kept, drop


def test_choices_match_the_plain_rules():
    rng = np.random.default_rng(5)
    dropped = 0
    for n, cap in ((32, 16), (40, 24), (20, 5), (70, 64), (17, 16)) * 20:
        x = rng.normal(size=(n, 8)) + 1.5 * rng.integers(0, 2, (n, 1))
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        base = rng.normal(size=8)
        near = 1 - unit @ (base / np.linalg.norm(base))
        order = np.argsort(near)
        near, pair = near[order], 1 - unit[order] @ unit[order].T
        assert graph.coverage_choice(near, pair, cap) == plain_cover(near, pair, cap)
        lists = [sorted(((int(j) if rng.random() < 0.7 else -1 - int(j), float(pair[i, j])) for j in rng.permutation(n)[:12] if j != i), key=lambda t: t[1]) for i in range(n)]
        around = {i: [(place, j, d) for place, (j, d) in enumerate(own) if j >= 0] for i, own in enumerate(lists)}
        got = graph.route_choice(near, around, 8)
        assert got == plain_route(near, lists, 8, 0.5)
        dropped += len(got[1])
    assert dropped > 20


def test_routing_drops_links_at_both_ends(spark):
    rng = np.random.default_rng(4)
    nodes = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=6)]) for i in range(80)], "node_id bigint, embedding array<float>")
    edges = graph.knn_edges(nodes, 16).cache()
    lists = {}
    for e in edges.orderBy("src", "pos").collect():
        lists.setdefault(e.src, []).append((e.dst, e.distance))
    kept, gone = set(), set()
    for src, own in lists.items():
        at = {dst: i for i, (dst, _) in enumerate(own)}
        inner = [[(at.get(x, -1 - x), d) for x, d in sorted(lists[dst], key=lambda t: (t[1], t[0]))] for dst, _ in own]
        chosen, drop = plain_route([d for _, d in own], inner, 16, 0.5)
        kept |= {(src, own[i][0]) for i in chosen}
        gone |= {pair for i, j in drop for pair in ((own[i][0], own[j][0]), (own[j][0], own[i][0]))}
    got = {(r.src, r.dst) for r in graph.routed(edges).collect()}
    assert got == kept - gone and kept & gone


def test_coverage_choice_keeps_the_far_neighbour_that_nothing_covers():
    near = np.array([0.1 + i / 1000 for i in range(20)] + [0.9])
    pair = np.full((21, 21), 0.01)
    pair[20] = pair[:, 20] = 1
    kept = graph.coverage_choice(near, pair, 18)
    assert 20 in kept and len(kept) == 18
    assert graph.coverage_choice(near, pair, 30) == list(range(21))


def test_route_choice_without_weight_is_the_plain_top():
    assert graph.route_choice(np.arange(9.0), {}, 2, 0)[0] == [0, 1, 2, 3]
    assert graph.route_choice(np.arange(9.0), {}, 2, 0, 2)[0] == [0, 1]
    kept, _ = graph.route_choice(np.array([0.1, 0.4]), {1: [(0, 0, 0.1)]}, 4)
    assert kept == [0]


def test_beam_stops_at_ties_and_budget():
    links = {i: [i - 1, i + 1] for i in range(1, 99)} | {0: [1], 99: [98]}
    found = graph.beam(lambda i: float(99 - i), lambda i: links[i], [0], 4)
    assert [n for _, n in found] == [99, 98, 97, 96]
    assert len(graph.beam(lambda i: float(99 - i), lambda i: links[i], [0], 4, budget=3)) <= 4


def test_many_queries_of_a_graph_go_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    nodes = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=6)]) for i in range(120)], "node_id bigint, embedding array<float>")
    queries = nodes.select(F.col("node_id").alias("query_id"), "embedding")
    edges = graph.build(nodes, 2).cache()
    want = sorted(graph.search(nodes, edges, queries, 5, 16, 2).collect())
    sizes, real = [], graph._query_blocks

    def seen(*args):
        for ids, block in real(*args):
            sizes.append(len(ids))
            yield ids, block

    monkeypatch.setattr(graph, "_query_blocks", seen)
    monkeypatch.setattr(graph, "BEAM_QUERIES", 50)
    assert sorted(graph.search(nodes, edges, queries, 5, 16, 2).collect()) == want
    assert sorted(sizes) == [20, 50, 50]


def test_beam_takes_distances_of_many_nodes_at_once():
    links = {i: [j % 60 for j in (i + 1, i + 7, i + 1, i - 1)] for i in range(60)}
    far = np.random.default_rng(2).random(60).tolist()
    for budget in (None, 9):
        want = graph.beam(lambda i: far[i], links.__getitem__, [0, 3], 5, lambda i: i % 4, budget)
        assert graph.beam(None, links.__getitem__, [0, 3], 5, lambda i: i % 4, budget, lambda rows: [far[i] for i in rows]) == want


def test_stream_batches_apply_once(spark, tmp_path, plane):
    rows = spark.createDataFrame([(1, 0, axis(1), b"a")], "node_id bigint, seq bigint, embedding array<float>, key binary")
    assert apply_batch(plane, rows, 0) and not apply_batch(plane, rows, 0)
    assert plane.watermark == 1
    source = str(tmp_path / "in")
    rows.withColumn("node_id", F.lit(2).cast("bigint")).write.parquet(source)
    other = Plane.create(spark, str(tmp_path / "q"), 4, max_nodes=9, key_cap=8)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    ingest(other, stream, str(tmp_path / "c")).awaitTermination()
    ingest(other, stream, str(tmp_path / "c")).awaitTermination()
    assert [r.node_id for r in other.nodes().collect()] == [2]


def test_vector_files(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(3, 4)
    (tmp_path / "x.fvecs").write_bytes(b"".join(np.int32(4).tobytes() + r.tobytes() for r in x))
    (tmp_path / "x.raw").write_bytes(x.tobytes())
    for df in (sources.read_fvecs(spark, str(tmp_path / "x.fvecs")), sources.read_raw(spark, str(tmp_path / "x.raw"), 4)):
        assert [r.embedding for r in df.orderBy("vec_id").collect()] == x.tolist()
    assert sources.read_fvecs(spark, str(tmp_path / "x.fvecs"), 2).count() == 2


def test_sql_functions(spark):
    from vecharbor.functions.registry import register

    register(spark)
    row = spark.sql("SELECT cosine_distance(array(1f, 0f), array(0f, 1f)) AS d, quantize_int8(array(1f, -0.5f)) AS c, graph_level(236) AS l").first()
    assert (row.d, row.c, row.l) == (1.0, [127, -64], 2)


def test_knn_in_sql(spark, mixture):
    from vecharbor.functions.registry import register

    register(spark)
    nodes = sources.nodes_of(mixture).repartition(5)
    nodes.createOrReplaceTempView("nodes_for_knn")
    q = mixture.where("vec_id = 17").first().embedding
    text = ", ".join(f"CAST({x!r} AS FLOAT)" for x in q)
    got = spark.sql(f"SELECT * FROM knn(TABLE(SELECT node_id, embedding FROM nodes_for_knn), array({text}), 10) ORDER BY distance, node_id LIMIT 10").collect()
    want = search.knn(nodes, spark.createDataFrame([(0, q)], "query_id bigint, embedding array<float>"), 10).orderBy("rank").collect()
    assert [r.node_id for r in got] == [r.node_id for r in want] and got[0].node_id == 17
    assert [r.distance for r in got] == pytest.approx([r.distance for r in want], abs=1e-6)
    assert spark.sql("SELECT * FROM knn(TABLE(SELECT node_id, embedding FROM nodes_for_knn), array(1f), 10)").isEmpty()


def test_cells_of_few_nodes(spark):
    nodes = sources.nodes_of(sources.gaussian_mixture(spark, 3, 4))
    centre = ivf.fit_cells(nodes, 8)
    queries = nodes.select(F.col("node_id").alias("query_id"), "embedding")
    assert ivf.search(ivf.with_cells(nodes, centre), queries, centre, 2, 9).count() == 6


def test_beam_rounds_go_on_until_nothing_is_left(spark):
    rows = [(i, 1, [math.cos(1.5 - i / 10), math.sin(1.5 - i / 10)]) for i in range(12)]
    nodes = spark.createDataFrame(rows, "node_id bigint, status int, embedding array<float>")
    edges = spark.createDataFrame([(i, i + 1) for i in range(11)], "src bigint, dst bigint")
    asked = spark.createDataFrame([(0, [math.cos(0.4), math.sin(0.4)])], "query_id bigint, embedding array<float>")
    assert graph.beam_rounds(nodes, edges, asked, nodes.where("node_id = 0"), 1, 1).first().node_id == 11
