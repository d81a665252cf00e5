"""A plane: one vector index, kept as immutable segments and a manifest.

Every mutation writes new files first and then claims the next manifest: manifests are numbered,
and a number is taken by one rename that fails if it is there. So readers see the old state or the
new, a lost driver leaves the old one, and of two writers one is refused. Segments are appended:
inserts of fresh ids are plain rows; rewrites of known ids are rows with a higher ``txn``, and a
view keeps the newest row of each rewritten id. ``compact`` folds the segments into one.

All paths go through Hadoop's file system interface, so they may lie in any shared store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import graph, ivf, mutate, search

FORMAT = {"int8": 8, "int16": 9}
NODES = "node_id bigint, key binary, status int, level int, embedding array<float>, code array<smallint>, scale float, inv_mag double, seq bigint, key_seq bigint, links array<array<bigint>>, txn bigint"
#: Columns of a raw write; those that a call leaves out are null.
RAW = "node_id bigint, seq bigint, embedding array<float>, key binary, code array<smallint>, scale float, inv_mag double, level int, neighbors array<bigint>, upper array<array<bigint>>"
FREE = "node_id bigint, seq bigint"
MAX_DIMS = 65_535


class PlaneError(Exception):
    """A plane cannot be made, opened or used as asked."""


class PlaneFault(PlaneError):
    """A batch stopped at a fault of the plane; ``outcome`` holds what became of each record."""

    def __init__(self, code: str, outcome: DataFrame):
        super().__init__(mutate.REASONS[code])
        self.code, self.outcome = code, outcome


@dataclass
class Invalidation:
    latched: bool
    marked: bool


class Files:
    """The few file operations a manifest needs."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False if it is there already."""
        try:
            stream = self.fs.create(self.path(name), False)
        except Exception as e:
            if self.exists(name):
                return False
            raise e
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def claim(self, name: str, text: str, overwrite: bool = False) -> bool:
        """Write beside, then rename in one step; False if the name is taken and not to be replaced."""
        beside = f"{name}.{uuid.uuid4().hex}"
        self.create(beside, text)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        array = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        array[0] = rename.OVERWRITE if overwrite else rename.NONE
        try:
            context.rename(self.path(beside), self.path(name), array)
        except Exception as e:
            self.fs.delete(self.path(beside), False)
            if not overwrite and self.exists(name):
                return False
            raise e
        return True


def stale_path_for(path: str) -> str:
    """The marker beside a plane that says it must not be used."""
    return path.rstrip("/") + ".stale"


def _filled(df: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema``, null where ``df`` lacks them."""
    fields = [f.split(" ") for f in schema.split(", ")]
    return df.select(*((F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name) for name, kind in fields))


def _manifest_path(path: str, txn: int | None = None) -> str:
    """The manifest of a number; without one, the file that names a number to begin at."""
    return path.rstrip("/") + ("/_manifest.json" if txn is None else f"/_manifest-{txn:012d}.json")


def _newest(files: Files, path: str) -> dict:
    """The state of the highest number."""
    txn = int(files.read(_manifest_path(path)))
    while files.exists(_manifest_path(path, txn + 1)):
        txn += 1
    return json.loads(files.read(_manifest_path(path, txn)))


def _claimed(files: Files, path: str, state: dict) -> bool:
    """Make ``state`` the newest; False if another writer took its number."""
    if not files.claim(_manifest_path(path, state["txn"]), json.dumps(state)):
        return False
    files.claim(_manifest_path(path), str(state["txn"]), overwrite=True)
    return True


def invalidate_plane(spark: SparkSession, path: str) -> Invalidation:
    """Latch the manifest, then write the marker; fails only if neither could be done. Idempotent."""
    files, latched, marked, last = Files(spark, path), False, False, None
    try:
        while files.exists(_manifest_path(path)) and not latched:
            state = _newest(files, path)
            latched = state["invalidated"] or _claimed(files, path, state | {"invalidated": True, "watermark": 0, "txn": state["txn"] + 1})
    except Exception as e:
        last = e
    try:
        files.create(stale_path_for(path), "stale")
        marked = True
    except Exception as e:
        last = e
    if not latched and not marked:
        raise PlaneError(f"plane at {path} could not be invalidated") from last
    return Invalidation(latched, marked)


class Plane:
    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path, self.state = spark, path.rstrip("/"), state
        self.files = Files(spark, path)
        #: Whether the last flush came after the last change when the plane was opened.
        self.opened_clean: bool = state["clean"]

    # ---- lifecycle ----

    @classmethod
    def create(cls, spark: SparkSession, path: str, dims: int, *, layer0_cap: int = 64, max_nodes: int, key_cap: int = 0, key_arena_bytes_per_node: int | None = None, precision: str = "int8") -> Plane:
        if precision not in FORMAT:
            raise PlaneError(f"unknown precision {precision!r}")
        if not 1 <= dims <= MAX_DIMS:
            raise PlaneError(f"dims {dims} out of range")
        if not 1 <= layer0_cap <= 65_535:
            raise PlaneError(f"layer0_cap {layer0_cap} out of range")
        if not 1 <= max_nodes < 2**32 - 1:
            raise PlaneError(f"max_nodes {max_nodes} out of range")
        if key_cap and not 8 <= key_cap <= 65_535:
            raise PlaneError(f"key_cap {key_cap} out of range")
        arena = key_arena_bytes_per_node if key_arena_bytes_per_node is not None else max(128, 4 * key_cap)
        if key_cap and arena < 64:
            raise PlaneError(f"key_arena_bytes_per_node {arena} out of range")
        files = Files(spark, path)
        if files.exists(stale_path_for(path)):
            raise PlaneError(f"plane at {path} is stale: remove its marker first")
        state = {
            "version": FORMAT[precision], "precision": precision, "dims": dims, "layer0_cap": layer0_cap, "max_nodes": max_nodes, "key_cap": key_cap,
            "arena_per_node": arena, "arena_used": 0, "segments": [], "free": None, "edges": None, "shards": 0, "linked": 0, "cells": None, "entry": None, "previous_entry": None,
            "high_water": 0, "watermark": 0, "clean": True, "invalidated": False, "txn": 0,
        }
        if not _claimed(files, path, state):
            raise PlaneError(f"plane at {path} exists")
        return cls(spark, path, state)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Plane:
        files = Files(spark, path)
        if files.exists(stale_path_for(path)):
            raise PlaneError(f"plane at {path} is invalidated: stale marker")
        if not files.exists(_manifest_path(path)):
            raise PlaneError(f"no plane at {path}")
        state = _newest(files, path)
        if FORMAT.get(state.get("precision")) != state.get("version"):
            raise PlaneError(f"unsupported plane format {state.get('version')}")
        if state["invalidated"]:
            raise PlaneError(f"plane at {path} is invalidated")
        if state["high_water"] > state["max_nodes"]:
            raise PlaneError("more ids in use than the plane has")
        return cls(spark, path, state)

    def _publish(self, **changes: object) -> None:
        """Make a change the newest state; it is not clean until a flush."""
        if self.invalidated:
            self.state["invalidated"] = True
            raise PlaneError(f"plane at {self.path} is invalidated")
        state = self.state | {"clean": False} | changes | {"txn": self.state["txn"] + 1}
        if not _claimed(self.files, self.path, state):
            raise PlaneError("another writer has changed the plane")
        self.state = state

    # ---- properties ----

    dims = property(lambda self: self.state["dims"])
    precision = property(lambda self: self.state["precision"])
    layer0_cap = property(lambda self: self.state["layer0_cap"])
    key_cap = property(lambda self: self.state["key_cap"])
    id_high_water = property(lambda self: self.state["high_water"])

    @property
    def invalidated(self) -> bool:
        return _newest(self.files, self.path)["invalidated"] or self.files.exists(stale_path_for(self.path))

    @property
    def watermark(self) -> int:
        return 0 if self.invalidated else self.state["watermark"]

    @watermark.setter
    def watermark(self, value: int) -> None:
        self._publish(watermark=int(value))

    @property
    def entry_point(self) -> tuple[int, int] | None:
        return tuple(self.state["entry"]) if self.state["entry"] else None

    def set_entry_point(self, node_id: int, level: int) -> None:
        """The id is not checked; the level is bounded."""
        self._publish(entry=[node_id, min(level, vectors.MAX_LEVEL)], previous_entry=self.state["entry"])

    def meta(self) -> DataFrame:
        s = self.state
        entry = s["entry"] or [None, None]
        row = (s["version"], s["precision"], s["dims"], s["layer0_cap"], s["max_nodes"], s["key_cap"], entry[0], entry[1], s["high_water"], self.watermark, self.opened_clean, self.invalidated, s["txn"])
        return self.spark.createDataFrame([row], "version int, precision string, dims int, layer0_cap int, max_nodes bigint, key_cap int, entry_id bigint, entry_level int, id_high_water bigint, watermark bigint, clean boolean, invalidated boolean, write_epoch bigint")

    # ---- tables ----

    def nodes(self) -> DataFrame:
        """The newest row of each node."""
        fresh = [s["path"] for s in self.state["segments"] if s["fresh"]]
        again = [s["path"] for s in self.state["segments"] if not s["fresh"]]
        read = self.spark.read.schema(NODES).parquet
        rows = read(*fresh) if fresh else self.spark.createDataFrame([], NODES)
        if not again:
            return rows
        newest = mutate.latest(read(*again), "node_id", by="txn").select(*rows.columns)
        return rows.join(newest.select("node_id"), "node_id", "left_anti").unionByName(newest)

    def links(self) -> DataFrame:
        """(level, src, pos, dst) of the links that raw writes gave."""
        layers = self.nodes().select(F.col("node_id").alias("src"), F.posexplode("links").alias("level", "ends"))
        return layers.select("level", "src", F.posexplode("ends").alias("pos", "dst")).withColumn("pos", F.col("pos") + 1)

    def free(self) -> DataFrame:
        return self.spark.read.schema(FREE).parquet(self.state["free"]) if self.state["free"] else self.spark.createDataFrame([], FREE)

    def _written(self, df: DataFrame, kind: str) -> str:
        path = f"{self.path}/{kind}-{self.state['txn'] + 1:08d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return path

    def _segment(self, df: DataFrame, fresh: bool) -> list[dict]:
        rows = _filled(df.withColumn("txn", F.lit(self.state["txn"] + 1).cast("bigint")), NODES)
        return [*self.state["segments"], {"path": self._written(rows, "nodes"), "fresh": fresh, "txn": self.state["txn"] + 1}]

    def _room(self, nodes: DataFrame) -> int:
        """Bytes that the long keys of ``nodes``, some of the plane's own, take."""
        if not self.state["arena_used"]:
            return 0
        long = nodes.where(F.octet_length("key") > self.key_cap)
        return long.agg(F.coalesce(F.sum(mutate.key_bytes()), F.lit(0))).first()[0]

    def _coded(self, df: DataFrame) -> DataFrame:
        coded = search.encoded(df, self.precision)
        return coded.withColumn("code", F.col("code").cast("array<smallint>")).withColumn("level", vectors.level("node_id"))

    def compact(self) -> None:
        """One segment in place of all; edges to dead nodes go."""
        nodes = self.spark.read.schema(NODES).parquet(self._written(self.nodes(), "nodes"))
        changes: dict = {"segments": [{"path": nodes.inputFiles()[0].rsplit("/", 1)[0] if nodes.inputFiles() else self._written(nodes, "nodes"), "fresh": True, "txn": max((x["txn"] for x in self.state["segments"]), default=0)}]}
        if self.state["edges"]:
            changes["edges"] = self._written(mutate.compacted(self.spark.read.parquet(self.state["edges"]), nodes), "edges")
        self._publish(**changes)

    # ---- mutations ----

    def insert_batch(self, records: DataFrame) -> DataFrame:
        """Insert records (seq, embedding, key); returns seq, node_id, code and reason of each.

        Raises ``PlaneFault`` with the outcome if the plane ran full.
        """
        s = self.state
        free = self.free()
        arena = s["arena_per_node"] * s["max_nodes"] - s["arena_used"] if s["key_cap"] else None
        outcome = mutate.insert_batch(records, free, dims=s["dims"], key_cap=s["key_cap"], high_water=s["high_water"], max_nodes=s["max_nodes"], arena_bytes=arena)
        path = self._written(outcome, "outcome")
        outcome = self.spark.read.schema(outcome.schema).parquet(path)
        landed = outcome.where("node_id IS NOT NULL").select("node_id", "key", F.lit(1).alias("status"), "embedding")
        sums = landed.agg(F.count("*").alias("n"), F.max("node_id").alias("top"), F.sum(F.when(F.octet_length("key") > s["key_cap"], mutate.key_bytes())).alias("bytes"), F.count(F.when(F.col("node_id") < s["high_water"], 1)).alias("reused")).first()
        if sums.n:
            left = free.join(landed.select("node_id"), "node_id", "left_anti") if sums.reused else free
            nodes = self._coded(landed)
            entry = self._better_entry(nodes)
            self._publish(
                segments=self._segment(nodes, fresh=not sums.reused), free=self._written(left, "free") if sums.reused else s["free"],
                high_water=max(s["high_water"], sums.top + 1), arena_used=s["arena_used"] + (sums.bytes or 0), entry=entry, previous_entry=s["entry"] if entry != s["entry"] else s["previous_entry"],
            )
        result = outcome.select("seq", "node_id", "code", "reason")
        if not result.where("code = 'full'").isEmpty():
            raise PlaneFault("full", result)
        return result

    def _better_entry(self, nodes: DataFrame) -> list | None:
        """The best of new nodes takes over only on a higher level."""
        best = mutate.elect_entry(nodes).first()
        now = self.state["entry"]
        return [best.node_id, best.level] if best and (now is None or best.level > now[1]) else now

    def insert(self, vector: list[float], key: bytes | None = None) -> int:
        row = self.spark.createDataFrame([Row(seq=0, embedding=[float(x) for x in vector], key=key)], "seq bigint, embedding array<float>, key binary")
        out = self.insert_batch(row).first()
        if out.node_id is None:
            raise PlaneError(out.reason)
        return out.node_id

    def remove(self, ids: DataFrame) -> None:
        """Delete nodes (node_id, optionally seq); unknown ids are ignored. Room of long keys is given back."""
        ids = ids if "seq" in ids.columns else mutate.running(ids, "node_id", "seq")
        marked, freed = mutate.delete(self.nodes(), ids)
        freed = self.spark.read.schema(FREE).parquet(self._written(freed.select("node_id", F.col("seq").cast("bigint")), "freed"))
        if freed.isEmpty():
            return
        gone = marked.join(freed.select("node_id"), "node_id", "left_semi")
        base = self.free().agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
        least = freed.agg(F.min("seq")).first()[0]
        stack = self.free().unionByName(freed.withColumn("seq", F.col("seq") - least + base))
        segments, free = self._segment(gone, fresh=False), self._written(stack, "free")
        entry = self.state["entry"]
        if entry and not freed.where(F.col("node_id") == entry[0]).isEmpty():
            best = mutate.elect_entry(self.nodes().join(freed.select("node_id"), "node_id", "left_anti")).first()
            entry = [best.node_id, best.level] if best else None
        gone = self.spark.read.schema(NODES).parquet(segments[-1]["path"])
        self._publish(segments=segments, free=free, entry=entry, arena_used=self.state["arena_used"] - self._room(gone))

    def mirror(self, ops: DataFrame, ordered: bool = False) -> None:
        """Raw writes under the host's ids: the columns of ``RAW``, of which node_id, seq and a vector are needed.

        A vector comes as ``embedding``, or in the plane's codec as ``code`` with ``scale`` and,
        if known, ``inv_mag``; without ``level`` a node has the level of its id's hash.
        ``neighbors`` (of the lowest layer) and ``upper`` (of the layers above) replace all the
        links the node had. Without a key the node keeps the one it has.

        ``ordered``: ``seq`` is one order over all calls, so what is older than the node's vector
        or key does not replace it.
        """
        ops = self._raw(ops)
        now = self.nodes()
        if ordered:
            ops = self._in_order(ops, now)
        last = ops.groupBy("node_id").agg(F.max("seq").alias("seq"), F.max(F.when(F.col("key").isNotNull(), F.col("seq"))).alias("key_seq"))
        held = now.select("node_id", F.col("seq").alias("held"), F.col("key_seq").alias("key_held"))
        stamp = last.join(held, "node_id", "left").select("node_id", (F.greatest("seq", "held") if ordered else F.col("seq")).alias("seq"), F.coalesce("key_seq", "key_held").alias("key_seq"))
        self._write_raw(mutate.mirror(now.drop("seq", "key_seq"), ops).join(stamp, "node_id"))

    def mirror_if_absent(self, ops: DataFrame) -> DataFrame:
        """Raw writes to ids never touched; returns node_id, seq and written of each."""
        verdict = mutate.if_absent(self.nodes(), self._raw(ops))
        verdict = self.spark.read.schema(verdict.schema).parquet(self._written(verdict, "outcome"))
        rows = verdict.where("written").withColumn("status", F.lit(1)).withColumn("key_seq", F.when(F.col("key").isNotNull(), F.col("seq")))
        self._write_raw(rows)
        return verdict.select("node_id", "seq", "written")

    def _raw(self, ops: DataFrame) -> DataFrame:
        """Raw writes with all their columns, checked; links as one list of lists, lowest layer first."""
        ops = _filled(ops, RAW)
        ops = ops.withColumn("embedding", F.when(F.col("code").isNotNull(), vectors.decoded("code", "scale").cast("array<float>")).otherwise(F.col("embedding")))
        upper = F.coalesce("upper", F.array().cast("array<array<bigint>>"))
        every = ops.withColumn("neighbors", F.concat(F.coalesce("neighbors", F.array().cast("array<bigint>")), F.flatten(upper)))
        given = F.when(F.col("code").isNotNull(), mutate.raw_fault(self.dims, self.state["max_nodes"], self.precision))
        away = (F.col("node_id") < 0) | (F.col("node_id") >= self.state["max_nodes"]) | F.exists("neighbors", lambda x: (x < 0) | (x >= self.state["max_nodes"]))
        if not every.where(away | F.coalesce(given, mutate.record_fault(self.dims, self.key_cap)).isNotNull()).isEmpty():
            raise PlaneError("a raw write is out of range, of other dims, not finite or has a key that cannot be stored")
        lowest = F.array(F.slice("neighbors", 1, self.layer0_cap))
        above = F.transform(F.slice(upper, 1, vectors.MAX_LEVEL), lambda x: F.slice(x, 1, graph.UPPER_CAP))
        return ops.withColumn("links", F.when(F.col("neighbors").isNotNull(), F.concat(lowest, above))).withColumn("level", F.when(F.col("level") > vectors.MAX_LEVEL, vectors.MAX_LEVEL).otherwise(F.col("level"))).drop("neighbors", "upper")

    def _in_order(self, ops: DataFrame, now: DataFrame) -> DataFrame:
        """Writes without what is older than the table: of a late write only a key counts, if that is newer."""
        state = [c for c in ops.columns if c not in ("node_id", "seq", "key")]
        held = now.where("seq IS NOT NULL").select("node_id", F.struct("status", "seq", "key_seq", *state).alias("held"))
        joined = ops.join(held, "node_id", "left")
        late = F.coalesce(F.col("seq") < F.col("held.seq"), F.lit(False))
        joined = joined.withColumn("late", late).withColumn("key", F.when(F.coalesce(F.col("seq") >= F.col("held.key_seq"), F.lit(True)), F.col("key")))
        joined = joined.where(~F.col("late") | F.col("key").isNotNull() & (F.col("held.status") == 1))
        return joined.select("node_id", "seq", "key", *(F.when(F.col("late"), F.col("held")[c]).otherwise(F.col(c)).alias(c) for c in state))

    def _write_raw(self, rows: DataFrame) -> None:
        host = rows.select("node_id", "key", "status", "embedding", "seq", "key_seq", "links", F.struct("code", "scale", "inv_mag", "level").alias("host"))
        coded = self._coded(host)
        given = {c: F.when(F.col("host.code").isNotNull(), F.coalesce(F.col("host")[c], F.col(c))).otherwise(F.col(c)) for c in ("code", "scale", "inv_mag")}
        segments = self._segment(coded.withColumns(given | {"level": F.coalesce(F.col("host.level"), F.col("level"))}), fresh=False)
        written = self.spark.read.schema(NODES).parquet(segments[-1]["path"])
        top, room = written.agg(F.max("node_id"), F.sum(F.when(F.octet_length("key") > self.key_cap, mutate.key_bytes()))).first()
        if top is None:
            return
        before = self.state["arena_used"]
        used = before + (room or 0) - self._room(self.nodes().where("status = 1").join(written.select("node_id"), "node_id", "left_semi"))
        if used > max(self.state["arena_per_node"] * self.state["max_nodes"], before):
            raise PlaneError(mutate.REASONS["key-arena-full"])
        self._publish(segments=segments, high_water=max(self.id_high_water, top + 1), entry=self._better_entry(written), arena_used=used)

    def clear_nodes(self, ids: DataFrame) -> None:
        """Mark ids deleted without freeing them, even ids never written. Room of long keys is given back."""
        now = self.nodes()
        after = mutate.clear(now, ids, self.state["max_nodes"]).join(ids.select("node_id").distinct(), "node_id", "left_semi")
        segments = self._segment(after, fresh=False)
        written = self.spark.read.schema(NODES).parquet(segments[-1]["path"])
        top = written.agg(F.max("node_id")).first()[0]
        if top is not None:
            room = self._room(now.where("status = 1").join(written.select("node_id"), "node_id", "left_semi"))
            self._publish(segments=segments, high_water=max(self.id_high_water, top + 1), arena_used=self.state["arena_used"] - room)

    def flush(self, watermark: int | None = None) -> None:
        """Publish a watermark over what is written; without one it stays as it is."""
        self._publish(**({} if watermark is None else {"watermark": int(watermark)}), clean=True)

    def invalidate(self) -> None:
        """Latch in the manifest; never undone."""
        self._publish(invalidated=True, watermark=0)

    def invalidate_file(self) -> Invalidation:
        return invalidate_plane(self.spark, self.path)

    # ---- search ----

    def build_graph(self, shards: int = 1) -> None:
        """Graphs over all live nodes; more shards than asked for where one would not fit a task."""
        nodes = self.nodes().where("status = 1")
        shards = graph.shards_for(nodes, shards)
        self._publish(edges=self._written(graph.build(nodes, shards, cap=self.layer0_cap), "edges"), shards=shards, linked=self.state["txn"])

    def build_cells(self, cells: int) -> None:
        """Centroids and a copy of the live nodes laid out by cell, so that probes prune files."""
        nodes = self.nodes().where("status = 1")
        centre = ivf.fit_cells(nodes, cells)
        self._publish(cells={"paths": [self._celled(nodes, centre)], "centre": centre.tolist(), "txn": self.state["txn"]})

    def extend_cells(self) -> None:
        """Put nodes written since into the cells there are; nothing else is read or moved."""
        cells = self._cells()
        new = self.nodes().where((F.col("status") == 1) & (F.col("txn") > cells["txn"]))
        self._publish(cells=cells | {"paths": [*cells["paths"], self._celled(new, np.array(cells["centre"]))], "txn": self.state["txn"]})

    def _cells(self) -> dict:
        if not self.state["cells"]:
            raise PlaneError("no cells are built")
        return self.state["cells"]

    def _celled(self, nodes: DataFrame, centre: np.ndarray) -> str:
        path = f"{self.path}/cells-{self.state['txn'] + 1:08d}-{uuid.uuid4().hex[:8]}"
        ivf.with_cells(nodes, centre).write.partitionBy("cell").parquet(path)
        return path

    def search(
        self,
        queries: DataFrame,
        k: int,
        *,
        ef: int | None = None,
        allowed: DataFrame | bytes | None = None,
        where: Column | str | None = None,
        predicate: Callable | None = None,
        visit_budget: int | None = None,
        filter_expansion: int = graph.FILTER_EXPANSION,
        method: str = "exact",
        metric: str | None = None,
        nprobe: int = 8,
    ) -> DataFrame:
        """Hits with keys: query_id, rank, node_id, distance, key. ``method``: exact, ivf, graph or links.

        ``links`` follows the links of raw writes from the entry point, round by round, without a
        budget; nodes without links are searched exactly. Nodes written since the graph or the cells were built are searched exactly, and the hits
        merged, so no write is missed. A filtered search of a graph visits ``ef *
        filter_expansion`` nodes at most unless ``visit_budget`` (1 at least) says otherwise.
        """
        if self.invalidated:
            raise PlaneError(f"plane at {self.path} is invalidated")
        queries = search.check_dims(queries, self.dims)
        nodes = self.nodes()
        if where is not None:
            nodes = nodes.where(where)
        if method == "exact":
            hits = search.knn(nodes, queries, k, ef=ef, allowed=allowed, predicate=predicate, metric=metric or self.precision)
            return self._with_keys(hits)
        filtered = allowed is not None or predicate is not None or where is not None
        admitted = search.allow(nodes.where("status = 1"), allowed)
        admitted = search.judged(admitted, predicate) if predicate is not None else admitted
        if method == "links":
            return self._with_keys(self._by_links(queries, k, ef or 128, admitted if filtered else None))
        if method == "graph":
            if not self.state["edges"]:
                raise PlaneError("no graph is built")
            ef, since = ef or 128, self.state["linked"]
            budget = max(visit_budget, 1) if visit_budget is not None else ef * filter_expansion if filtered else None
            entry = self.state["entry"]
            hits = graph.search(
                self.nodes(), self.spark.read.parquet(self.state["edges"]), queries, k, ef, self.state["shards"], allowed=admitted.select("node_id") if filtered else None, budget=budget, entry=entry[0] if entry else None
            )
            metric = "exact"
        elif method == "ivf":
            cells = self._cells()
            metric, since = metric or "exact", cells["txn"]
            rows = self.spark.read.schema(f"{NODES}, cell int")
            parts = [rows.parquet(path) for path in cells["paths"]]
            every = parts[0]
            for part in parts[1:]:
                every = every.unionByName(part)
            hits = ivf.search(every.join(admitted.select("node_id", "txn"), ["node_id", "txn"], "left_semi"), queries, np.array(cells["centre"]), k, nprobe, metric)
        else:
            raise PlaneError(f"unknown method {method!r}")
        if any(s["txn"] > since for s in self.state["segments"]):
            late = search.knn(admitted.where(F.col("txn") > since), queries, k, ef=ef, metric=metric)
            # A rewritten node may come both ways.
            both = hits.unionByName(late).groupBy("query_id", "node_id").agg(F.min("distance").alias("distance"))
            hits = search.top(both, min(k, max(ef, 1)) if ef is not None else k)
        return self._with_keys(hits)

    def _by_links(self, queries: DataFrame, k: int, ef: int, admitted: DataFrame | None) -> DataFrame:
        nodes = self.nodes()
        alone = search.knn((nodes.where("status = 1") if admitted is None else admitted).where("links IS NULL"), queries, k)
        if not self.state["entry"]:
            return alone
        start = nodes.where(F.col("node_id") == self.state["entry"][0])
        hits = graph.beam_rounds(nodes, self.links(), queries, start, k, ef, allowed=admitted)
        both = hits.select("query_id", "node_id", "distance").unionByName(alone.select("query_id", "node_id", "distance"))
        return search.top(both.groupBy("query_id", "node_id").agg(F.min("distance").alias("distance")), k)

    def _with_keys(self, hits: DataFrame) -> DataFrame:
        return search.gather_keys(hits, self.nodes()).select("query_id", "rank", "node_id", "distance", "key")

    def search_sync(self, queries: DataFrame, k: int, ef: int | None = None) -> list[Row]:
        return self.search(queries, k, ef=ef).orderBy("query_id", "rank").collect()
