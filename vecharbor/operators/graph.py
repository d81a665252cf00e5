"""Layered proximity graphs: adjacency as an edge table, bulk build, beam search by shard.

An index is cut into shards of bounded size. A shard's graph is built in bulk by one task:
nearest candidates, then neighbour choice that prefers routes over clusters, reverse edges, and
coverage pruning beyond a cap. A search asks every shard (a beam per layer, as in hierarchical
navigable small worlds) and merges the shards' k best. Edge tables that are made by exact
search serve as the oracle-checked path.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.codec import inverse_magnitude, list_matrix
from .search import HELD, HITS, QUERY_BLOCK, _query_blocks, knn, live, top

# Fixed values of the graph.
M = 16
OPTIMIZE_ROUTING = 0.5
DESCENT_WIDTH = 16
PRUNE_WINDOW = 16
UPPER_CAP = 64
FILTER_EXPANSION = 24

#: Nodes of a shard, and distances that are held at once while one is built.
SHARD_ROWS = 20_000
DISTANCES = 1 << 23
#: Queries that one task asks of a shard; more of them are further tasks.
BEAM_QUERIES = 8192
#: Sources whose lists are sent back from Python at once.
SOURCES = 512

EDGES = "level int, src bigint, pos int, dst bigint"


# ---- edge tables ----


def knn_edges(nodes: DataFrame, k: int) -> DataFrame:
    """(src, pos, dst, distance): the k nearest other nodes of each node, nearest first."""
    queries = live(nodes).select(F.col("node_id").alias("query_id"), "embedding")
    hits = knn(nodes, queries, k + 1).where("query_id <> node_id")
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "node_id"))
    return hits.withColumn("pos", pos).where(F.col("pos") <= k).select(F.col("query_id").alias("src"), "pos", F.col("node_id").alias("dst"), "distance")


def reversed_capped(edges: DataFrame, cap: int) -> DataFrame:
    """Edges and their reverses, the ``cap`` nearest of each node."""
    both = edges.select("src", "dst", "distance").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance"))
    once = both.groupBy("src", "dst").agg(F.min("distance").alias("distance"))
    pos = F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))
    return once.withColumn("pos", pos).where(F.col("pos") <= cap).select("src", "pos", "dst", "distance")


def without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges but those named by (src, dst)."""
    return edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti").select(*edges.columns)


def truncated(edges: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` neighbours of each node, by their order."""
    return edges.where(F.col("pos") <= cap)


def expand(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbours (query_id, node_id) of a frontier, each once a query."""
    return frontier.join(edges.select(F.col("src").alias("node_id"), "dst"), "node_id").select("query_id", F.col("dst").alias("node_id")).distinct()


def unvisited(found: DataFrame, visited: DataFrame) -> DataFrame:
    return found.join(visited.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")


# ---- neighbour choice ----


def route_choice(near: np.ndarray, around: dict[int, list[tuple[int, int, float]]], m: int, r: float = OPTIMIZE_ROUTING, most: int | None = None) -> tuple[list[int], list[tuple[int, int]]]:
    """Candidates kept of those in ascending distance ``near``, and links between them to drop.

    ``around`` gives for a candidate the neighbours that are candidates too: their place in its
    whole list, candidate and distance, in the list's order. A candidate is passed over if it can
    be had through one chosen before: its distance, weighted by rank, exceeds the way through that
    one. If instead the link between the two is the longer way, it is to be dropped. Weights grow
    with rank, so that far links must be worth more. Without weight (``r`` 0) the ``most`` nearest
    are kept.
    """
    if not r:
        return list(range(min(len(near), 2 * m if most is None else most))), []
    kept, drop, chosen = [], [], set()
    for i in range(min(len(near), 2 * m)):
        weight = 1 + r * (1 + 0.5 * i / m)
        cut = []
        for place, j, link in around.get(i, ()):
            if j not in chosen:
                continue
            if near[i] * weight > near[j] + link:
                break
            if link * (1 + r * (1 + 0.5 * place / m)) > near[i] + near[j]:
                cut.append((i, j))
        else:
            kept.append(i)
            chosen.add(i)
            drop += cut
    return kept, drop


def coverage_choice(near: np.ndarray, pair: np.ndarray, cap: int, window: int = PRUNE_WINDOW) -> list[int]:
    """At most ``cap`` of the neighbours in ascending distance ``near``; ``pair`` their mutual distances.

    While there are too many, the farthest of the last ``window`` goes for which one of the first
    ``window`` before these is nearer than the base; failing that, the farthest of all.
    """
    kept = list(range(len(near)))
    if len(kept) <= cap:
        return kept
    # Bit k of number e: whether k is nearer to e than the base.
    nearer = [int.from_bytes(bits.tobytes(), "little") for bits in np.packbits(pair < near[:, None], axis=1, bitorder="little")]
    while len(kept) > cap:
        tail = max(len(kept) - window, 0)
        head = sum(1 << k for k in kept[: min(window, tail)])
        for e in reversed(kept[tail:]):
            if nearer[e] & head:
                kept.remove(e)
                break
        else:
            kept.pop()
    return kept


# ---- shards ----


def _adjacency(unit: np.ndarray, ids: np.ndarray, m: int, cap: int, r: float, most: int) -> list[np.ndarray]:
    """Neighbour lists (row numbers, nearest first) of one layer of a shard."""
    n = len(ids)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    width = min(n - 1, 2 * m)
    near_ids = np.empty((n, width), np.int64)
    near = np.empty((n, width))
    step = max(1, DISTANCES // n)
    for at in range(0, n, step):
        distance = 1 - unit[at : at + step] @ unit.T
        rows = np.arange(len(distance))
        distance[rows, at + rows] = np.inf
        part = np.argpartition(distance, width - 1, axis=1)[:, :width]
        d = np.take_along_axis(distance, part, axis=1)
        order = np.lexsort((ids[part], d), axis=1)
        near_ids[at : at + step] = np.take_along_axis(part, order, axis=1)
        near[at : at + step] = np.take_along_axis(d, order, axis=1)
    known = [list(zip(near_ids[i].tolist(), near[i].tolist(), strict=True)) for i in range(n)]
    gone: set[tuple[int, int]] = set()
    links: list[dict[int, float]] = [{} for _ in range(n)]
    for i in range(n):
        at = {int(x): p for p, x in enumerate(near_ids[i])}
        around = {p: [(place, at[y], d) for place, (y, d) in enumerate(known[x]) if y in at] for x, p in at.items()}
        kept, drop = route_choice(near[i], around, m, r, most)
        for p in kept:
            j = int(near_ids[i, p])
            links[i][j] = links[j][i] = float(near[i, p])
        gone.update((int(near_ids[i, p]), int(near_ids[i, q])) for p, q in drop)
    for i, j in gone:
        links[i].pop(j, None)
        links[j].pop(i, None)
    _connect(links, unit)
    out = []
    for i in range(n):
        rows = np.array(sorted(links[i], key=lambda j: (links[i][j], ids[j])), np.int64)
        if len(rows) > cap:
            d = np.array([links[i][int(j)] for j in rows])
            rows = rows[coverage_choice(d, 1 - unit[rows] @ unit[rows].T, cap)]
        out.append(rows)
    return out


def _connect(links: list[dict[int, float]], unit: np.ndarray) -> None:
    """Link each component to the first by its nearest pair of heads, so that all can be reached."""
    seen, heads = np.zeros(len(links), bool), []
    for start in range(len(links)):
        if seen[start]:
            continue
        heads.append(start)
        stack = [start]
        seen[start] = True
        while stack:
            for j in links[stack.pop()]:
                if not seen[j]:
                    seen[j] = True
                    stack.append(j)
    for a, b in zip(heads, heads[1:], strict=False):
        links[a][b] = links[b][a] = float(1 - unit[a] @ unit[b])


def shards_for(nodes: DataFrame, least: int = 1) -> int:
    """Shards that hold ``SHARD_ROWS`` live nodes each at most, on average; ``least`` or more."""
    return max(least, -(-live(nodes).count() // SHARD_ROWS))


def build(nodes: DataFrame, shards: int, *, m: int = M, cap: int = 64, r: float = OPTIMIZE_ROUTING) -> DataFrame:
    """(shard, level, src, pos, dst) of the graphs of all shards; ``shards_for`` gives their number."""
    rows = live(nodes).select("node_id", "embedding", vectors.level("node_id", m).alias("level"), F.pmod(F.xxhash64("node_id"), F.lit(shards)).cast("int").alias("shard"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id")
        ids, level = pdf["node_id"].to_numpy(), pdf["level"].to_numpy()
        x = np.array(pdf["embedding"].tolist(), np.float64)
        unit = x * inverse_magnitude(x)[:, None]
        parts = []
        for layer in range(int(level.max()) + 1):
            own = np.flatnonzero(level >= layer)
            for i, rows in enumerate(_adjacency(unit[own], ids[own], m, cap if layer == 0 else min(2 * m, UPPER_CAP), r, m if layer else 2 * m)):
                if len(rows):
                    parts.append(pd.DataFrame({"shard": pdf["shard"].iloc[0], "level": layer, "src": ids[own[i]], "pos": np.arange(1, len(rows) + 1), "dst": ids[own[rows]]}))
        return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in ("shard", "level", "src", "pos", "dst")})

    return rows.groupBy("shard").applyInPandas(run, f"shard int, {EDGES}")


def beam(distance, neighbours, start: list[int], width: int, admitted=None, budget: int | None = None, distances=None) -> list[tuple[float, int]]:
    """Best-first search of one layer: ascending (distance, node), at most ``width``.

    ``admitted`` says which nodes may be results; the others still lead on. A node joins only if
    it is strictly nearer than the worst of a full result. ``budget`` bounds visits.
    ``distances``, if given, has the distances of many nodes at once.
    """
    distances = distances or (lambda rows: [distance(j) for j in rows])
    seen, queue, best = set(start), [], []
    for s, d in zip(start, distances(start), strict=True):
        heapq.heappush(queue, (d, s))
        if admitted is None or admitted(s):
            heapq.heappush(best, (-d, -s))
    visits = 0
    while queue:
        d, node = heapq.heappop(queue)
        if len(best) >= width and d > -best[0][0] or budget is not None and visits >= budget:
            break
        new = [j for j in dict.fromkeys(neighbours(node)) if j not in seen]
        if not new:
            continue
        seen.update(new)
        visits += len(new)
        for j, dj in zip(new, distances(new), strict=True):
            if len(best) < width or dj < -best[0][0]:
                heapq.heappush(queue, (dj, j))
                if admitted is None or admitted(j):
                    heapq.heappush(best, (-dj, -j))
                    if len(best) > width:
                        heapq.heappop(best)
    return sorted((-d, -n) for d, n in best)


def search(
    nodes: DataFrame, edges: DataFrame, queries: DataFrame, k: int, ef: int, shards: int, *, allowed: DataFrame | None = None, budget: int | None = None, entry: int | None = None, block_bytes: int = QUERY_BLOCK
) -> DataFrame:
    """Hits by beam search of every shard; queries go to the shards in blocks of bounded bytes.

    Deleted nodes still lead on, but are no hits. Search of a shard begins at ``entry`` where the
    shard's top layer has it, else at the least node of that layer. A budget counts visits of the
    lowest layer only, after the descent.
    """
    side = nodes.select("node_id", "embedding", (F.col("status") == 1 if "status" in nodes.columns else F.lit(True)).alias("ok"), F.pmod(F.xxhash64("node_id"), F.lit(shards)).cast("int").alias("shard"))
    side = side.where("embedding IS NOT NULL")
    if allowed is not None:
        side = side.join(allowed.select("node_id", F.lit(True).alias("may")).distinct(), "node_id", "left").withColumn("ok", F.col("ok") & F.coalesce("may", F.lit(False))).drop("may")
    out = None
    for ids, block in _query_blocks(queries, block_bytes, max(1, min(BEAM_QUERIES, HELD // max(k, 1)))):
        shared = nodes.sparkSession.sparkContext.broadcast((ids, block))

        part = side.groupBy("shard").cogroup(edges.groupBy("shard")).applyInPandas(_shard_search(shared, k, ef, budget, entry), HITS)
        out = part if out is None else out.unionByName(part)
    return top(out if out is not None else nodes.sparkSession.createDataFrame([], HITS), min(k, max(ef, 1)))


def _shard_search(shared: Broadcast, k: int, ef: int, budget: int | None, entry: int | None) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    return lambda left, right: _shard_hits(left, right, *shared.value, k, ef, budget, entry)


def _shard_hits(left: pd.DataFrame, right: pd.DataFrame, query_ids: np.ndarray, block: np.ndarray, k: int, ef: int, budget: int | None, entry: int | None) -> pd.DataFrame:
    left = left.sort_values("node_id")
    ids = left["node_id"].to_numpy()
    rows: list[tuple[int, int, float]] = []
    if len(ids):
        x = np.array(left["embedding"].tolist(), np.float64)
        unit = x * inverse_magnitude(x)[:, None]
        ok = left["ok"].to_numpy()
        right = right[right["src"].isin(ids) & right["dst"].isin(ids)].sort_values(["level", "src", "pos"])
        at = dict(zip(ids.tolist(), range(len(ids)), strict=True))
        layers: dict[int, dict[int, list[int]]] = {}
        level = right["level"].to_numpy()
        src, dst = (np.searchsorted(ids, right[c].to_numpy()) for c in ("src", "dst"))
        ends = [*(np.flatnonzero((np.diff(level) != 0) | (np.diff(src) != 0)) + 1).tolist(), len(src)]
        for i, end in zip([0, *ends], ends, strict=False):
            if i < end:
                layers.setdefault(int(level[i]), {})[int(src[i])] = dst[i:end].tolist()
        height = max(layers, default=0)
        first = layers.get(height, {})
        begin = at[entry] if entry in at and at[entry] in first else min(first, default=0)
        base = layers.get(0, {})
        asked = block.astype(np.float64) * inverse_magnitude(block)[:, None]
        for query_id, q in zip(query_ids.tolist(), asked, strict=True):

            def distances(rows: list[int], q=q) -> list[float]:
                return (1 - (unit[rows] * q).sum(axis=1)).tolist()

            start = [begin]
            for lv in range(height, 0, -1):
                start = [beam(None, lambda i, g=layers[lv]: g.get(i, ()), start, DESCENT_WIDTH, distances=distances)[0][1]]
            found = beam(None, lambda i: base.get(i, ()), start, max(ef, 1), lambda i: bool(ok[i]), budget, distances)
            rows += [(query_id, int(ids[i]), d) for d, i in found[:k]]
    return pd.DataFrame(rows, columns=["query_id", "node_id", "distance"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one source at a time, of batches that are sorted by source."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        src = batch.column("src").to_numpy()
        ends = [*(np.flatnonzero(np.diff(src)) + 1).tolist(), len(src)]
        for at, end in zip([0, *ends], ends, strict=False):
            if at == end:
                continue
            if held and src[at] != last:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(at, end - at))
            last = src[at]
    if held:
        yield pa.concat_batches(held)


def _by_source(rows: DataFrame, choose: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]], schema: str) -> DataFrame:
    """Columns that ``choose`` gives of each source's rows, which come nearest first.

    Sources are streamed through a task in order, so that it holds one source's rows and a batch.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[np.ndarray, ...]] = []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made, strict=True)], names=names)

        for own in _lists(batches):
            made.append(choose(own))
            if len(made) == SOURCES:
                yield packed()
                made = []
        if made:
            yield packed()

    return rows.repartition("src").sortWithinPartitions("src", "distance", "dst").mapInArrow(run, schema)


def pruned(edges: DataFrame, nodes: DataFrame, cap: int) -> DataFrame:
    """Neighbour lists (src, pos, dst, distance) cut to ``cap`` by coverage."""
    vector = nodes.select(F.col("node_id").alias("dst"), "embedding")
    rows = edges.select("src", "dst", "distance").join(vector, "dst")

    def choose(own: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        x = list_matrix(own.column("embedding"), np.float64)
        unit = x * inverse_magnitude(x)[:, None]
        near = own.column("distance").to_numpy()
        kept = np.array(coverage_choice(near, 1 - unit @ unit.T, cap), np.int64)
        return own.column("src").to_numpy()[kept], np.arange(1, len(kept) + 1, dtype=np.int32), own.column("dst").to_numpy()[kept], near[kept]

    return _by_source(rows, choose, "src bigint, pos int, dst bigint, distance double")


def routed(edges: DataFrame, m: int = M, r: float = OPTIMIZE_ROUTING) -> DataFrame:
    """Neighbour lists (src, pos, dst, distance) thinned by routing; ``edges`` as of ``knn_edges``.

    Links that some node's choice drops are gone from both their ends' lists.
    """
    around = edges.groupBy(F.col("src").alias("dst")).agg(F.array_sort(F.collect_list(F.struct(F.col("distance").alias("hop"), F.col("dst").alias("via")))).alias("around"))
    lists = around.select("dst", F.col("around.hop").alias("hop"), F.col("around.via").alias("via"))
    rows = edges.select("src", "dst", "distance").join(lists, "dst", "left")

    def choose(own: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        dst, near = own.column("dst").to_numpy(), own.column("distance").to_numpy()
        many = own.column("via").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        via, hop = (own.column(c).flatten().to_numpy() for c in ("via", "hop"))
        i, place = np.repeat(np.arange(len(dst)), many), np.arange(len(via)) - np.repeat(np.cumsum(many) - many, many)
        order = np.argsort(dst)
        j = order[np.minimum(np.searchsorted(dst, via, sorter=order), len(dst) - 1)]
        # Only candidates before i can have been chosen before it.
        inner = np.flatnonzero((dst[j] == via) & (j < i))
        around: dict[int, list[tuple[int, int, float]]] = {}
        for a, *link in zip(*(x[inner].tolist() for x in (i, place, j, hop)), strict=True):
            around.setdefault(a, []).append(tuple(link))
        kept, drop = route_choice(near, around, m, r)
        ends = np.array(drop, np.int64).reshape(-1, 2)
        ends = np.concatenate([ends, ends[:, ::-1]])
        src = own.column("src").to_numpy()
        return (
            np.concatenate([src[kept], dst[ends[:, 0]]]),
            np.concatenate([dst[kept], dst[ends[:, 1]]]),
            np.concatenate([near[kept], np.full(len(ends), np.inf)]),
            np.arange(len(kept) + len(ends)) >= len(kept),
        )

    chosen = _by_source(rows, choose, "src bigint, dst bigint, distance double, gone boolean")
    both = chosen.groupBy("src", "dst").agg(F.min("distance").alias("distance"), F.max("gone").alias("gone")).where("NOT gone")
    pos = F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))
    return both.select("src", pos.alias("pos"), "dst", "distance")


def beam_rounds(nodes: DataFrame, edges: DataFrame, queries: DataFrame, start: DataFrame, k: int, ef: int, allowed: DataFrame | None = None) -> DataFrame:
    """Beam search as joins: each round expands what is not yet expanded and has fewer than ``ef``
    possible hits before it, until nothing is left to expand.

    Deleted nodes, and nodes not in ``allowed``, lead on, but are no hits. Lineage is cut each
    round by a checkpoint in the shared folder. Visits a superset of the sequential beam's nodes.
    """
    ok = F.col("status") == 1 if "status" in nodes.columns else F.lit(True)
    vector = nodes.where("embedding IS NOT NULL").select("node_id", F.col("embedding").alias("v"), ok.alias("ok"))
    if allowed is not None:
        vector = vector.join(allowed.select("node_id", F.lit(True).alias("may")).distinct(), "node_id", "left").withColumn("ok", F.col("ok") & F.coalesce("may", F.lit(False))).drop("may")
    asked = queries.select("query_id", F.col("embedding").alias("q"))

    def scored(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(vector, "node_id").join(asked, "query_id")
        return joined.select("query_id", "node_id", "ok", vectors.cosine_distance("q", "v").alias("distance"))

    nearer = Window.partitionBy("query_id").orderBy("distance", "node_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("ok").cast("int")).over(nearer), F.lit(0))
    visited = scored(queries.select("query_id").crossJoin(F.broadcast(start.select("node_id").limit(DESCENT_WIDTH)))).withColumn("done", F.lit(False)).checkpoint()
    while True:
        best = visited.withColumn("before", before)
        frontier = best.where((F.col("before") < ef) & ~F.col("done")).select("query_id", "node_id").checkpoint()
        if frontier.isEmpty():
            break
        found = scored(unvisited(expand(frontier, edges), visited)).withColumn("done", F.lit(False))
        marked = visited.join(frontier.withColumn("now", F.lit(True)), ["query_id", "node_id"], "left").select("query_id", "node_id", "ok", "distance", (F.col("done") | F.coalesce("now", F.lit(False))).alias("done"))
        visited = marked.unionByName(found).checkpoint()
    return top(visited.where("ok").select("query_id", "node_id", "distance"), k)
