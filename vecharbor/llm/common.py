"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one Arrow batch are handled in slices of about this many bytes of text.
SLICE_BYTES = 8 << 20
#: Parts in which the texts of one doc_id are ranked.
RANK_PARTS = 64
#: Temporary folders of applications without spark.checkpoint.dir.
_OWN: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Without that setting a local session takes a temporary folder; on a cluster, whose machines
    share none, that is an error.
    """
    app = spark.sparkContext.applicationId
    folder = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(app)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _OWN[app] = tempfile.mkdtemp(prefix="vecharbor-")
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it once to the shared folder and read it back.

    Survives the loss of any executor, unlike a cache or a local checkpoint.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces whose ``column`` holds about ``limit`` bytes.

    A text longer than the limit makes a piece of its own.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        values = batch.column(column)
        if values.nbytes <= limit:
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start, n - start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array | list]]],
    schema: str,
    text: str = "text",
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Map ``df`` by a kernel over Arrow batches; no shuffle.

    ``make`` runs once a task and returns the kernel, which gets a piece of a batch and
    returns the output columns by name, as ``schema`` lists them.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for piece in slices(batches, text, limit):
            out = kernel(piece)
            yield pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _array(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def keep_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[bool]]], text: str = "text") -> DataFrame:
    """Rows of ``df`` for which the kernel says True; all columns pass unchanged, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for piece in slices(batches, text):
            yield piece.filter(pa.array(kernel(piece), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def crc_remainder(key: str | Column, mod: int) -> Column:
    """crc32 of the key's text, modulo ``mod``; null for a null key."""
    col = F.col(key) if isinstance(key, str) else key
    return F.crc32(col.cast("string").cast("binary")) % F.lit(mod)


def labelled_texts(docs: DataFrame, known: DataFrame, *bounds: tuple[str, int]) -> DataFrame:
    """(text, label) of labelled rows of ``docs``: for each (condition on label, n) at most n rows.

    ``known`` has one (doc_id, label) for each doc_id. Repeated rows count once. The first text
    of each doc_id comes before the second of any, then the hash of doc_id decides; so no doc_id
    crowds out others, and all its texts are taken where the bound leaves room. Rows are chosen
    by hashes alone; texts are read after that. A doc_id's texts are ranked in parts first, so
    that only what may be chosen meets in one task. Rows without a doc_id have no label.
    """
    most = max(n for _, n in bounds)
    with_hash = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("h"))
    texts = with_hash.select("doc_id", "h").distinct().withColumn("part", F.pmod("h", F.lit(RANK_PARTS)))
    for keys in (("doc_id", "part"), ("doc_id",)):
        texts = texts.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("place") <= most)
    rows = known.join(texts.drop("part"), "doc_id")
    chosen = reduce(DataFrame.unionByName, (rows.where(c).orderBy("place", F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in bounds))
    return with_hash.join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("text", "label")


def unused(name: str, names: list[str]) -> str:
    """``name``, or a like name that none of ``names`` is."""
    lower = {x.lower() for x in names}
    while name in lower:
        name += "_"
    return name
