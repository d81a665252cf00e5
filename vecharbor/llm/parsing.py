"""Document fingerprints by locally consistent parsing.

A text is parsed in levels. Each level first names runs of one symbol, then tosses
deterministic coins: a symbol's label is the place and value of the lowest bit in which it
differs from its left neighbour; four rounds turn 64-bit names into labels 0 to 5, and a phrase
starts at each local maximum. A phrase is named by a hash of its symbols, and the names are the
next level's text. Where phrases start depends on a few symbols around, never on the offset, so
equal substrings give equal phrases but for some at their edges.

The fingerprint samples the set of phrase names from ``LEAST_LEVEL`` up, and the name of the
whole text, whatever its level: one-permutation min-hashing in ``BINS`` bins, four hex digits
each. The share of equal bins among those that
either text fills estimates the overlap of the two sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

LEAST_LEVEL = 2
BINS = 64
ROUNDS = 4
_EMPTY = 0xFFFF
#: Code points that are parsed at once.
BLOCK_POINTS = 1 << 20

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijection (the finaliser of a public hash)."""
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


def _lowest_bit(x: np.ndarray) -> np.ndarray:
    """Place of the lowest set bit (64 for zero)."""
    return np.bitwise_count(~x & (x - np.uint64(1)))


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0..5 of a sequence without equal neighbours; ``first`` marks starts of texts."""
    label = x
    for turn in range(ROUNDS):
        one = label.dtype.type(1)
        differ = np.empty_like(label)
        differ[1:] = label[1:] ^ label[:-1]
        differ[first] = one
        if turn == 0:
            place = _lowest_bit(differ)
            bit = (label >> place.astype(label.dtype)) & one
            label = (2 * place + bit.astype(np.uint8)).astype(np.uint8)
        else:
            place = _PLACE[differ]
            label = 2 * place + ((label >> place) & one)
    return label


_PLACE = np.array([8, *(((k & -k).bit_length() - 1) for k in range(1, 256))], np.uint8)


def parse(x: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, names, text of each name) of the phrases of several texts laid end to end.

    ``starts`` are the texts' first places; none is empty. A text of one symbol ends there.
    """
    x = _mix(x.astype(np.uint64) + np.uint64(1))
    owner = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(x)]))
    level = 0
    yield level, x, owner
    while len(x):
        first = np.r_[True, owner[1:] != owner[:-1]]
        # Runs of one symbol take a name of their own.
        head = np.flatnonzero(first | np.r_[True, x[1:] != x[:-1]])
        length = np.diff(np.r_[head, len(x)])
        x, owner, first = x[head], owner[head], first[head]
        many = length > 1
        x[many] = _mix(x[many] + _mix(length[many].astype(np.uint64)))
        label = _labels(x, first).astype(np.int8)
        left = np.r_[np.int8(-1), label[:-1]]
        # A text's last symbol starts no phrase, whatever text comes after.
        right = np.r_[np.where(first[1:], np.int8(127), label[1:]), np.int8(127)]
        cut = np.flatnonzero(first | ((label > left) & (label > right)))
        length = np.diff(np.r_[cut, len(x)])
        place = (np.arange(len(x)) - np.repeat(cut, length)).astype(np.uint64)
        names = _mix(np.add.reduceat(_mix(x ^ (place * _M1)), cut) + length.astype(np.uint64))
        level += 1
        yield level, names, owner[cut]
        owner = owner[cut]
        size = np.bincount(owner, minlength=int(owner[-1]) + 1)
        going = size[owner] > 1
        x, owner = names[going], owner[going]


def fingerprints(texts: list[str]) -> np.ndarray:
    """Rows of ``BINS`` 16-bit values; an empty text has only empty bins."""
    out = np.full((len(texts), BINS), _EMPTY, np.uint16)
    at, block, size = 0, [], 0
    for i, t in enumerate(texts):
        block.append(i)
        size += len(t)
        if size >= BLOCK_POINTS or i == len(texts) - 1:
            _sketch(texts, block, out)
            block, size = [], 0
    return out


def _sketch(texts: list[str], block: list[int], out: np.ndarray) -> None:
    full = np.array([i for i in block if texts[i]], np.int64)
    if not len(full):
        return
    raw = "".join([texts[i] for i in full]).encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(raw, np.uint32)
    sizes = np.array([len(texts[i]) for i in full])
    names, owners = [], []
    for level, name, owner in parse(points, np.r_[0, np.cumsum(sizes)[:-1]]):
        if level and level < LEAST_LEVEL:
            # A text that is one phrase already is named whole.
            whole = np.bincount(owner, minlength=len(full))[owner] == 1
            name, owner = name[whole], owner[whole]
        if level:
            names.append(name)
            owners.append(owner)
    name, owner = np.concatenate(names), np.concatenate(owners)
    name = _mix(name)
    bins = (name >> np.uint64(58)).astype(np.int64)
    value = np.minimum((name >> np.uint64(20)) & np.uint64(0xFFFF_FFFF), np.uint64(0xFFFF_FFFE)).astype(np.uint32)
    least = np.full(len(full) * BINS, 0xFFFF_FFFF, np.uint32)
    np.minimum.at(least, owner * BINS + bins, value)
    # The least value's low bits are spread evenly; its high bits are not.
    kept = np.where(least == 0xFFFF_FFFF, _EMPTY, np.minimum(least & np.uint32(0xFFFF), _EMPTY - 1))
    out[full] = kept.reshape(-1, BINS).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bins among those that either row fills; 1 for two empty rows."""
    filled = (a != _EMPTY) | (b != _EMPTY)
    n = filled.sum(axis=1)
    return np.where(n == 0, 1.0, ((a == b) & filled).sum(axis=1) / np.maximum(n, 1))


def shown(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows.astype(">u2")]


def _hot_ids(rows: DataFrame, buckets: int) -> DataFrame:
    """(hot_id, parts): ids of more rows than a bucket should have, null included; fewer than ``buckets``."""
    counted = rows.groupBy("doc_id").count()
    least = rows.count() / buckets
    return counted.where((F.col("count") > least) & (F.col("count") > 1)).select(F.col("doc_id").alias("hot_id"), F.ceil(F.col("count") / max(least, 1)).alias("parts"))


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows in order of descending doc_id inside buckets of a range each, ready for a streaming pass.

    One shuffle of the texts. The first row of each bucket also goes to the bucket before it (that
    of the first bucket to the last), marked as seen from there, so each row's successor is beside
    it. Nulls come last; rows of one doc_id are ordered by a hash of their text, and a doc_id that
    has more rows than a bucket should (or null) is cut in ranges of that hash.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.col("doc_id").cast("double").alias("d"))
    # Fewer rows than buckets.
    hot = spark.createDataFrame(_hot_ids(docs.select("doc_id"), buckets).collect(), "hot_id bigint, parts bigint")
    probs = [i / buckets for i in range(1, buckets)]
    cuts = set(rows.where("d IS NOT NULL").approxQuantile("d", probs, 0.2 / buckets)) if probs else set()
    for r in hot.where("hot_id IS NOT NULL").collect():
        # A range of its own, so that its parts fall between other ids' buckets.
        cuts |= {float(r.hot_id), math.nextafter(float(r.hot_id), math.inf)}
    cuts = sorted(cuts)
    if cuts:
        binned = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="d", outputCol="b", handleInvalid="keep").transform(rows)
    else:
        binned = rows.withColumn("b", F.lit(0))
    # Descending: the highest range is bucket 0; null ids come after all.
    top = len(cuts)
    # The hash's place among all hashes, from 0 to 1.
    place = (F.col("tie").cast("double") + 2.0**63) / 2.0**64
    part = F.coalesce(F.least(F.floor(place * F.col("parts")), F.col("parts") - 1), F.lit(0))
    binned = binned.join(F.broadcast(hot), F.col("doc_id").eqNullSafe(F.col("hot_id")), "left")
    at = F.when(F.col("d").isNull(), top + 1).otherwise(top - F.col("b").cast("int")).cast("bigint")
    rows = binned.select("doc_id", "text", "tie", F.shiftleft(at, 32).bitwiseOR(part).alias("bucket"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id").cast("decimal(20,0)")).alias("down"), "tie", "doc_id")
    firsts = rows.groupBy("bucket").agg(F.min(order).alias("o")).select("bucket", F.col("o.doc_id").alias("doc_id"), F.col("o.tie").alias("tie")).orderBy("bucket").collect()
    # A row a bucket: bounded by the number of buckets.
    before = [(r.doc_id, r.tie, firsts[i - 1].bucket) for i, r in enumerate(firsts)]
    seen = spark.createDataFrame(before, "first_id bigint, first_tie bigint, seen_from bigint")
    joined = rows.join(F.broadcast(seen), rows.doc_id.eqNullSafe(F.col("first_id")) & rows.tie.eqNullSafe(F.col("first_tie")), "left")
    both = F.array_compact(F.array(F.struct("bucket", F.lit(0).alias("kind")), F.when(F.col("seen_from").isNotNull(), F.struct(F.col("seen_from").alias("bucket"), F.lit(1).alias("kind")))))
    dealt = joined.select("doc_id", "text", "tie", F.explode(both).alias("to")).select("to.bucket", "to.kind", "doc_id", "tie", "text")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "kind", F.col("doc_id").desc_nulls_last(), "tie")


def edited(text: str, following: str) -> str:
    """The last half of ``text`` (code points, rounded down) replaced by as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how they compare.

    One row for each row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. The next row is that of the next lower doc_id,
    after the last the first; a single row is its own next. Null texts count as empty. Ids that
    repeat are ordered by a hash of the text, null ids come last. An empty table gives no rows.
    Texts stream through in blocks of bounded size.
    """
    if buckets is None:
        buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, object, str]] = []
        size = 0

        def out(rows: list[tuple[int, int, object, str]]) -> pa.RecordBatch:
            texts = [r[3] for r in rows]
            at = [i for i in range(len(rows) - 1) if not rows[i][1]]
            changed = [edited(texts[i], texts[i + 1]) for i in at]
            own, new = fingerprints(texts), fingerprints(changed)
            mine, following = own[at], own[[i + 1 for i in at]]
            columns = [
                [rows[i][2] for i in at],
                [len(texts[i]) for i in at],
                [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
                shown(mine),
                shown(new),
                likeness(mine, new).tolist(),
                likeness(mine, following).tolist(),
            ]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

        for batch in slices(batches, "text", 4 << 20):
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "doc_id", "text")), strict=True):
                # Only the first row that is seen from before closes a bucket.
                if row[1] and held and held[-1][1]:
                    if held[-1][0] == row[0]:
                        continue
                held.append((*row[:3], row[3] or ""))
                size += len(held[-1][3])
                if size >= BLOCK_POINTS:
                    yield out(held)
                    held, size = held[-1:], len(held[-1][3])
        if held:
            yield out(held)

    return with_next(docs, buckets).mapInArrow(run, schema)
