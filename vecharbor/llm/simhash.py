"""SimHash near-duplicates: fingerprints of word shingles, joined by a binary trie.

Distinct fingerprints are dealt by pigeonhole: two 64-bit values that differ in at most
three bits agree on one of four disjoint blocks, so each value goes to four groups, one a
block. In a group the values form a binary trie below the shared block; pairs of trie nodes
are walked together, differing bits add up, and a pair of nodes is dropped as soon as its
sum passes the budget. A group beyond ``GROUP_LIMIT`` is dealt again by four blocks of its
remaining bits, which loses no pair, until groups are small.

A group hands out a spanning star for each of its components instead of its pairs, and
star contraction (large-star, small-star) over those links yields the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import as_bytes, map_texts, materialize, slices, unused

SHINGLE_WORDS = 3
SEED = 42
BUDGET = 3
#: Values in one trie before the group is dealt again.
GROUP_LIMIT = 4096
#: Width in bits of each of the four blocks, by level of dealing.
BLOCK_BITS = (16, 12, 9, 6, 5, 4)
#: Node pairs of a frontier that are expanded at once.
FRONTIER = 1 << 20
#: Parts into which the members of one component are dealt when they learn its id.
ROOT_SALTS = 16
#: Hot group ids are broadcast up to this many.
HOT_BROADCAST = 100_000
#: Rows whose repeats a task drops before it forgets them.
REMEMBERED = 200_000


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of one text: majority of each bit over the shingles' XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        shingles: object = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS)), strict=False))
    raw = b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED)))
    rows = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(rows), 60_000):
        ones += np.unpackbits(rows[at : at + 60_000], axis=1).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big")


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long) of each row; one map, no shuffle."""

    def make():
        def kernel(batch: pa.RecordBatch) -> dict:
            fps = np.array([fingerprint(t) for t in as_bytes(batch.column("text"))], dtype=np.uint64)
            return {"doc_id": batch.column("doc_id"), "fp": pa.array(fps.view(np.int64))}

        return kernel

    return map_texts(docs.select("doc_id", "text"), make, "doc_id bigint, fp bigint")


class Stars:
    """Components of rows 0..n-1 that are told pair by pair."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                jump = label[label]
                if (jump == label).all():
                    break
                label[:] = jump


def trie_links(values: np.ndarray, group: np.ndarray, depth: int = 0, budget: int = BUDGET) -> np.ndarray:
    """Component label (a row number) of each row, by links within ``budget`` bits inside groups.

    ``values`` are unsigned 64-bit, distinct inside a group, rows sorted by group, then value.
    ``depth`` leading bits are equal inside each group.
    """
    n = len(values)
    stars = Stars(n)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], n]
    many = ends - starts > 1
    lo, hi = starts[many], ends[many]
    stack = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    zeros: dict[int, np.ndarray] = {}
    while stack:
        bit, alo, ahi, blo, bhi, diff = stack.pop()
        if not len(alo):
            continue
        if len(alo) > FRONTIER:
            h = len(alo) // 2
            stack += [(bit, *(x[s] for x in (alo, ahi, blo, bhi, diff))) for s in (slice(0, h), slice(h, None))]
            continue
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            a, b = alo[single], blo[single]
            near = np.bitwise_count(values[a] ^ values[b]) <= budget
            stars.add(a[near], b[near])
            alo, ahi, blo, bhi, diff = (x[~single] for x in (alo, ahi, blo, bhi, diff))
        if bit >= 64 or not len(alo):
            continue
        if bit not in zeros:
            zeros[bit] = np.r_[0, np.cumsum(values >> np.uint64(63 - bit) & np.uint64(1) == 0)]
        z = zeros[bit]
        amid, bmid = alo + z[ahi] - z[alo], blo + z[bhi] - z[blo]
        own = alo == blo
        parts = [(alo, amid, blo, bmid, diff, None), (amid, ahi, bmid, bhi, diff, None), (alo, amid, bmid, bhi, diff + 1, None), (amid, ahi, blo, bmid, diff + 1, ~own)]
        kept = []
        for pl, ph, ql, qh, d, only in parts:
            ok = (ph > pl) & (qh > ql) & (d <= budget) & ~((pl == ql) & (ph - pl == 1))
            if only is not None:
                ok &= only
            kept.append(tuple(x[ok] for x in (pl, ph, ql, qh, d)))
        stack.append((bit + 1, *(np.concatenate(x) for x in zip(*kept, strict=True))))
    return stars.label


def _rotated(value: F.Column, width: int, shift: int) -> F.Column:
    """The lowest ``width`` bits rotated left by ``shift``; higher bits stay."""
    if not shift:
        return value
    if width == 64:
        return F.shiftleft(value, shift).bitwiseOR(F.shiftrightunsigned(value, 64 - shift))
    mask = (1 << width) - 1
    low = value.bitwiseAND(F.lit(mask))
    turned = F.shiftleft(low, shift).bitwiseOR(F.shiftrightunsigned(low, width - shift)).bitwiseAND(F.lit(mask))
    return value.bitwiseAND(F.lit(-(mask + 1))).bitwiseOR(turned)


def _dealt(rows: DataFrame, level: int) -> DataFrame:
    """Each row goes to four groups that share one more block of bits; (gid, v, fp)."""
    bits, used = BLOCK_BITS[level], sum(BLOCK_BITS[:level])
    width = 64 - used
    turns = F.array(*(F.struct(F.lit(b).alias("b"), _rotated(F.col("v"), width, b * bits).alias("v")) for b in range(BUDGET + 1)))
    out = rows.select("gid", "fp", F.explode(turns).alias("t")).select("gid", "fp", "t.b", "t.v")
    return out.select(F.xxhash64("gid", "b", F.shiftrightunsigned("v", width - bits)).alias("gid"), "v", "fp")


def links(distinct: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that span every component within groups."""
    spark = distinct.sparkSession
    rows = _dealt(distinct.select(F.lit(0).cast("bigint").alias("gid"), F.col("fp").alias("v"), "fp"), 0)
    done = []
    for level in range(1, len(BLOCK_BITS) + 1):
        last = level == len(BLOCK_BITS)
        hot = None if last else materialize(rows.groupBy("gid").count().where(F.col("count") > group_limit).select("gid"), "simhash-hot")
        many = 0 if last else hot.count()
        if not many:
            done.append(_spanned(rows, sum(BLOCK_BITS[:level])))
            break
        hot = F.broadcast(hot) if many <= HOT_BROADCAST else hot
        done.append(_spanned(rows.join(hot, "gid", "left_anti"), sum(BLOCK_BITS[:level])))
        rows = _dealt(rows.join(hot, "gid", "left_semi"), level)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return materialize(out.distinct(), "simhash-links") if spark else out


def _spanned(rows: DataFrame, depth: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush(parts: list) -> pa.RecordBatch | None:
            gid, v, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((v.view(np.uint64), gid))
            gid, v, fp = gid[order], v[order], fp[order]
            label = trie_links(v.view(np.uint64), gid, depth)
            far = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(fp[far]), pa.array(fp[label[far]])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            gid, v, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("gid", "v", "fp"))
            held.append((gid, v, fp))
            count += len(gid)
            if count >= 200_000:
                # Rows come sorted by group: all but the last group are whole.
                parts = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.searchsorted(parts[0], parts[0][-1], side="left"))
                if cut:
                    yield flush([tuple(x[:cut] for x in parts)])
                held, count = [tuple(x[cut:] for x in parts)], len(parts[0]) - cut
        if held:
            yield flush(held)

    return rows.repartition("gid").sortWithinPartitions("gid").mapInArrow(run, "a bigint, b bigint")


def _with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
    """``rows`` (u, v) with ``m`` of their u, as ``least`` (u, m) has it; the rows of a u are dealt over parts."""
    parts = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(ROOT_SALTS - 1))).alias("salt")).repartition("u", "salt")
    return rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(ROOT_SALTS)).cast("int")).join(parts, ["u", "salt"]).drop("salt")


def star_components(edges: DataFrame) -> DataFrame:
    """(u, root) for each node ``u`` of ``edges`` (a, b) other than the least of its component.

    A node of very many edges is joined in parts.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e, seen = materialize(e, "stars"), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = materialize(small.distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select("u", F.col("v").alias("root"))
        seen = now


def _classes(sims: DataFrame, group_limit: int) -> DataFrame:
    """(doc_id, fp, root, component_id) of each row of ``sims`` (doc_id, fp), a table that is read
    twice; ``root`` names the component by its least fingerprint."""
    least = sims.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    stars = star_components(links(least.select("fp"), group_limit))
    # Only linked fingerprints take part in joins by root; a root of many members is salted.
    heads = stars.select(F.col("root").alias("fp")).distinct().select("fp", F.col("fp").alias("root"))
    members = stars.select(F.col("u").alias("fp"), "root").unionByName(heads)
    ids = members.join(least, "fp").groupBy("root").agg(F.min("least_id").alias("component_id"))
    # The parts leave the task that made them, so that members of one root are found in many tasks.
    salts = ids.select("root", "component_id", F.explode(F.sequence(F.lit(0), F.lit(ROOT_SALTS - 1))).alias("salt")).repartition("root", "salt")
    linked = members.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(ROOT_SALTS)).cast("int")).join(salts, ["root", "salt"]).select("fp", "root", "component_id")
    named = least.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"))
    # Read back from a table, both sides of the join are plain exchanges, so that the rows of a
    # fingerprint with very many copies can be split over tasks.
    return sims.join(materialize(named, "simhash-named"), "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) of each row of ``docs`` (doc_id, text).

    Null and empty texts have fingerprint zero and link like any other. Repeated rows give
    repeated rows. ``component_id`` is the least doc_id that is reachable (null only where
    all doc_ids of the component are null). An empty table gives an empty result; columns
    other than doc_id and text are not read.
    """
    return _classes(materialize(with_fingerprints(docs), "simhash-fps"), group_limit).drop("root")


def _with_first_rows(docs: DataFrame, fp: str) -> DataFrame:
    """Rows of ``docs`` with their fingerprint as ``fp``; of rows that share doc_id and fingerprint
    each task drops repeats it still remembers, so that copies of a row are not all shuffled."""
    schema = StructType([*docs.schema.fields, StructField(fp, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int | None, int]] = set()
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(t) for t in as_bytes(batch.column("text"))], dtype=np.uint64).view(np.int64)
            keys = list(zip(batch.column("doc_id").to_pylist(), fps.tolist(), strict=True))
            keep = [not (k in seen or seen.add(k)) for k in keys]
            if len(seen) > REMEMBERED:
                seen.clear()
            whole = pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], names=[*batch.schema.names, fp])
            yield whole.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(run, schema)


def one_of_each(docs: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row of ``docs`` for each component: one with the least doc_id; all columns stay.

    Null and empty texts have fingerprint zero. A component without any doc_id keeps one row too;
    of equal doc_ids and fingerprints any one row stays; an empty table stays empty. Columns may
    have any names. Fingerprints are computed once and written beside the rows. The kept
    (doc_id, fingerprint) pairs travel to the rows in one shuffle by both, each ahead of its rows.
    """
    names = docs.columns
    fp = unused("fp", names)
    tag = unused("fp_first", [*names, fp])
    rows = materialize(_with_first_rows(docs, fp), "simhash-rows")
    sims = rows.select("doc_id", F.col(fp).alias("fp"))
    first = _classes(sims, group_limit).where("doc_id <=> component_id").groupBy("root", "doc_id").agg(F.min("fp").alias("fp"))
    marks = first.select(*(F.col("doc_id") if c == "doc_id" else F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in names), F.col("fp").alias(fp), F.lit(0).alias(tag))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, wanted = None, False
        for batch in slices(batches, "text"):
            keep = []
            for doc_id, value, kind in zip(*(batch.column(c).to_pylist() for c in ("doc_id", fp, tag)), strict=True):
                if (doc_id, value) != now:
                    now, wanted = (doc_id, value), False
                keep.append(bool(kind) and wanted)
                # The mark asks for one row, the first that follows it.
                wanted = not kind
            yield batch.filter(pa.array(keep, type=pa.bool_())).select(names)

    both = rows.withColumn(tag, F.lit(1)).unionByName(marks)
    return both.repartition("doc_id", fp).sortWithinPartitions("doc_id", fp, tag).mapInArrow(run, docs.schema)
