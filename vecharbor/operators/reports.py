"""Reports: recall, rank agreement, degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall(truth: DataFrame, hits: DataFrame) -> DataFrame:
    """Share of the true (query_id, node_id) pairs that the hits hold, over all queries."""
    found = truth.select("query_id", "node_id").join(hits.select("query_id", "node_id", F.lit(1).alias("hit")), ["query_id", "node_id"], "left")
    return found.agg(F.count("hit").alias("found"), F.count("*").alias("wanted"), (F.count("hit") / F.count("*")).alias("recall"))


def rank_disagreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ranks at which two hit lists name different nodes."""
    both = a.select("query_id", "rank", F.col("node_id").alias("x")).join(b.select("query_id", "rank", F.col("node_id").alias("y")), ["query_id", "rank"])
    return both.agg(F.count("*").alias("ranks"), F.count_if(F.col("x") != F.col("y")).alias("disagreements"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean, percentiles (the value at index n*p/100, rounded down, in ascending order), maximum and shares.

    Nodes are first counted by degree, so the ranking holds one row a degree, not one a node.
    """
    own = nodes.select(F.col("node_id").alias("src")).join(edges.groupBy("src").agg(F.count("*").alias("degree")), "src", "left").select(F.coalesce("degree", F.lit(0)).alias("degree"))
    hist = own.groupBy("degree").agg(F.count("*").alias("n"))
    summed = hist.withColumn("upto", F.sum("n").over(Window.orderBy("degree"))).withColumn("total", F.sum("n").over(Window.partitionBy()))

    def at(p: int):
        return F.min(F.when(F.col("upto") > F.floor(F.col("total") * p / 100), F.col("degree")))

    def share(c: int):
        return F.sum(F.when(F.col("degree") <= c, F.col("n")).otherwise(0)) / F.max("total")

    return summed.agg(
        F.max("total").alias("nodes"),
        (F.sum(F.col("degree") * F.col("n")) / F.max("total")).alias("mean"),
        at(50).alias("p50"),
        at(90).alias("p90"),
        at(99).alias("p99"),
        F.max("degree").alias("max"),
        share(32).alias("le32"),
        share(48).alias("le48"),
        share(64).alias("le64"),
    )
