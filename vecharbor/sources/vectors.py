"""Readers of vector files and a generator of clustered vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VECTORS = "vec_id bigint, embedding array<float>"


def _rows(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    offsets = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(x, np.float32).ravel()))
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), lists], names=["vec_id", "embedding"])


def read_fvecs(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Records of a 32-bit dimension and as many floats, little-endian; ids in order of the file.

    Spark reads the bytes, so any store it knows will do; the record length is the dimension's,
    which the first record gives.
    """
    dims = _first_int(spark, path)
    if dims <= 0:
        raise ValueError(f"dims {dims} in {path}")
    return _fixed(spark, path, 4 + 4 * dims, 4, limit)


def read_raw(spark: SparkSession, path: str, dims: int, limit: int | None = None) -> DataFrame:
    """Rows of ``dims`` floats without a header."""
    return _fixed(spark, path, 4 * dims, 0, limit)


def _first_int(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return int.from_bytes(bytes(stream.read() & 0xFF for _ in range(4)), "little", signed=True)
    finally:
        stream.close()


def _fixed(spark: SparkSession, path: str, size: int, skip: int, limit: int | None) -> DataFrame:
    records = spark.sparkContext.binaryRecords(path, size)
    numbered = records.zipWithIndex() if limit is None else records.zipWithIndex().filter(lambda x: x[1] < limit)
    rows = numbered.map(lambda x: (x[1], bytearray(x[0])))
    df = spark.createDataFrame(rows, "vec_id bigint, raw binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([np.frombuffer(r, "<f4", offset=skip) for r in batch.column("raw").to_pylist()])
                yield _rows(batch.column("vec_id").to_numpy(), x)

    return df.mapInArrow(run, VECTORS)


def gaussian_mixture(spark: SparkSession, n: int, dims: int, seed: int = 1, cosine: float = 0.75) -> DataFrame:
    """``n`` unit vectors around max(8, n / 500) unit centroids; inside a cluster the mean cosine is ``cosine``**2 or so.

    Each row depends on its id and the seed alone, so any partitioning gives the same table.
    """
    clusters = max(8, n // 500)
    spread = np.sqrt((1 / cosine**2 - 1) / dims)

    def centroid(c: int) -> np.ndarray:
        x = np.random.default_rng((seed, 1, c)).standard_normal(dims)
        return x / np.linalg.norm(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            ids = batch.column("id").to_numpy()
            rows = np.empty((len(ids), dims))
            for i, at in enumerate(ids):
                c = int(at) % clusters
                if c not in known:
                    known[c] = centroid(c)
                rows[i] = known[c] + spread * np.random.default_rng((seed, 2, int(at))).standard_normal(dims)
            if len(ids):
                yield _rows(ids, rows / np.linalg.norm(rows, axis=1, keepdims=True))

    return spark.range(n).mapInArrow(run, VECTORS)


def nodes_of(df: DataFrame, vec_id: str = "vec_id", key: str | None = None) -> DataFrame:
    """(node_id, key, status, embedding) of a table of vectors; all live."""
    name = F.col(key).cast("binary") if key else F.col(vec_id).cast("string").cast("binary")
    return df.select(F.col(vec_id).alias("node_id"), name.alias("key"), F.lit(1).alias("status"), "embedding")
