"""Approximate search by inverted cells: the default index beyond exact search.

Centroids are fitted on a bounded sample; every node is put in its nearest cell by one map.
A query probes its nearest cells; nodes are scanned once, each cell's rows being compared with
the queries that probe it. Where nodes lie in files by cell, only probed cells are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.codec import inverse_magnitude, list_matrix
from .search import HELD, HITS, QUERY_BLOCK, _best, _query_blocks, live, nearest, node_side, query_side, top

#: Rows of the sample on which centroids are fitted.
SAMPLE = 50_000


def unit(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) * inverse_magnitude(x)[:, None]


def fit_cells(nodes: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """Unit centroids by spherical k-means on at most ``sample`` nodes, taken by hash of the id."""
    first = live(nodes).orderBy(F.xxhash64("node_id"), "node_id").select("embedding").limit(sample)
    rows = [np.array(r[0], np.float32) for r in first.toLocalIterator()]
    if not rows:
        return np.zeros((0, 0))
    x = unit(np.array(rows))
    cells = min(cells, len(x))
    centre = x[:: max(1, len(x) // cells)][:cells].copy()
    for _ in range(rounds):
        own = (x @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(size > 0, total / np.maximum(size, 1e-12), centre)
    return centre


def with_cells(nodes: DataFrame, centre: np.ndarray) -> DataFrame:
    """``nodes`` with the column ``cell``; no shuffle."""
    shared = nodes.sparkSession.sparkContext.broadcast(centre)
    schema = StructType([*nodes.schema.fields, StructField("cell", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = (unit(list_matrix(batch.column("embedding"))) @ shared.value.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "cell"])

    return nodes.mapInArrow(run, schema)


def search(nodes: DataFrame, queries: DataFrame, centre: np.ndarray, k: int, nprobe: int, metric: str = "exact", block_bytes: int = QUERY_BLOCK) -> DataFrame:
    """Hits of each query among nodes (with ``cell``) of its ``nprobe`` nearest cells."""
    columns = ["node_id", "cell", *(["embedding"] if metric == "exact" else ["code", "scale", "inv_mag"])]
    spark = nodes.sparkSession
    out = None
    for ids, block in _query_blocks(queries, block_bytes, max(1, HELD // max(k, 1))):
        near = unit(block) @ centre.T
        probes = np.argpartition(-near, min(nprobe, near.shape[1]) - 1, axis=1)[:, :nprobe]
        by_cell: dict[int, np.ndarray] = {int(c): np.flatnonzero((probes == c).any(axis=1)) for c in np.unique(probes)}
        shared = spark.sparkContext.broadcast((ids, query_side(block, metric), by_cell))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, side, by_cell = shared.value
            held = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                node, cell = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node_id", "cell"))
                stored = node_side(batch, metric)
                for c in np.unique(cell):
                    asked = by_cell.get(int(c))
                    if asked is None:
                        continue
                    rows = np.flatnonzero(cell == c)
                    q, d, n = nearest(side[asked], stored[rows], node[rows], k)
                    new = (asked[q], d, n)
                    held = _best(*(new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))), k)
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[2]), pa.array(held[1])], names=["query_id", "node_id", "distance"])

        probed = live(nodes).where(F.col("cell").isin([int(c) for c in by_cell]))
        part = probed.select(*columns).mapInArrow(run, HITS)
        out = part if out is None else out.unionByName(part)
    return top(out if out is not None else spark.createDataFrame([], HITS), k)
