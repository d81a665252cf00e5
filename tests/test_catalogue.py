import pytest
from oracle import same

from vecharbor.operators import search
from vecharbor.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    same(spark, sf_dir, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


#: Queries that ask with as many vectors as there are nodes.
ALL_PAIRS = ["knn_graph_edges", "degree_report", "knn_self_query", "adjacency_expand_1hop", "compact_edges", "remove_edges", "truncate_edges", "visited_antijoin_2hop", "reverse_edges_capped"]


@pytest.mark.parametrize("name", ALL_PAIRS)
def test_all_pairs_go_by_blocks_of_nodes(spark, sf_dir, name, monkeypatch):
    used, real = [], search._by_nodes

    def seen(nodes, queries, k, metric, block_bytes):
        parts = real(nodes, queries, k, metric, 200 * 64 * 8)
        used.append(parts is not None)
        return parts

    want = sorted(catalogue.QUERIES[name](spark, sf_dir).collect())
    monkeypatch.setattr(search, "_by_nodes", seen)
    if name in catalogue.ORACLE_SQL:
        same(spark, sf_dir, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])
    assert sorted(catalogue.QUERIES[name](spark, sf_dir).collect()) == want
    assert used and all(used)


@pytest.mark.parametrize("name", ["coverage_pruned_graph", "routing_selected_graph"])
def test_choices_stream_the_sources(spark, sf_dir, name):
    """No call of Python a node; lists cut by the ends of batches are whole."""
    chosen = catalogue.QUERIES[name](spark, sf_dir)
    assert "InPandas" not in chosen._jdf.queryExecution().toString()
    want = sorted(chosen.collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "45")
    try:
        assert sorted(catalogue.QUERIES[name](spark, sf_dir).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())
