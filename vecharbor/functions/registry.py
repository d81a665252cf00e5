"""SQL names for the vector functions: ``register(spark)`` makes them callable from SQL."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from .codec import encode_block
from .vectors import HASH_FACTOR, HASH_STEP, LEVEL_M, MAX_LEVEL


def _matrix(s: pd.Series) -> np.ndarray:
    return np.array(s.tolist(), np.float64).reshape(len(s), -1)


def cosine_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y = _matrix(a), _matrix(b)
    tiny = np.finfo(np.float32).tiny
    size = np.maximum(np.linalg.norm(x, axis=1), tiny) * np.maximum(np.linalg.norm(y, axis=1), tiny)
    return pd.Series(1 - (x * y).sum(axis=1) / size)


def quantize_int8(v: pd.Series) -> pd.Series:
    return pd.Series(list(encode_block(_matrix(v).astype(np.float32), "int8")[0]))


def quantize_int16(v: pd.Series) -> pd.Series:
    return pd.Series(list(encode_block(_matrix(v).astype(np.float32), "int16")[0]))


class Knn:
    """Table function: the k nearest of its part of the table; what is asked for is the k least of all parts.

    ``SELECT * FROM knn(TABLE(SELECT node_id, embedding FROM t), array(1f, 0f), 10) ORDER BY
    distance, node_id LIMIT 10``. Each partition of the table keeps k rows, so the order runs over
    few. Rows without a vector, or of other dimensions, are no hits.
    """

    def __init__(self) -> None:
        self.best: list[tuple[float, int]] = []
        self.query, self.k = None, 0

    def eval(self, row: Row, query: list[float], k: int) -> None:
        if self.query is None:
            x = np.array(query, np.float64)
            self.query, self.k = x / max(np.linalg.norm(x), np.finfo(np.float32).tiny), k
        node_id, vector = row[0], row[1]
        if vector is None or len(vector) != len(self.query) or k < 1:
            return
        x = np.array(vector, np.float64)
        distance = float(1 - x @ self.query / max(np.linalg.norm(x), np.finfo(np.float32).tiny))
        push = heapq.heappush if len(self.best) < k else heapq.heappushpop
        push(self.best, (-distance, -node_id))

    def terminate(self) -> Iterator[tuple[int, float]]:
        for distance, node_id in self.best:
            yield -node_id, -distance


def register(spark: SparkSession) -> None:
    spark.udtf.register("knn", udtf(Knn, returnType="node_id bigint, distance double"))
    for f, kind in ((cosine_distance, "double"), (quantize_int8, "array<smallint>"), (quantize_int16, "array<smallint>")):
        spark.udf.register(f.__name__, pandas_udf(f, kind))
    spun = f"pmod(CAST(id AS DECIMAL(20,0)) * {HASH_FACTOR}BD + {HASH_STEP}BD, 18446744073709551616BD)"
    signed = f"CAST(IF({spun} >= 9223372036854775808BD, {spun} - 18446744073709551616BD, {spun}) AS BIGINT)"
    mixed = f"({signed} ^ shiftrightunsigned({signed}, 33))"
    unit = f"(IF({mixed} < 0, double({mixed}) + 18446744073709551616D, double({mixed})) / 18446744073709551616D)"
    body = f"CAST(least({MAX_LEVEL}, floor(-ln(greatest({unit}, 2.2250738585072014E-308D)) / ln({LEVEL_M}D))) AS INT)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION graph_level(id BIGINT) RETURNS INT RETURN {body}")
