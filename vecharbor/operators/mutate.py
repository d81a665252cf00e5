"""Mutations of a node table as set operations over one batch.

A batch runs its deletes first, then its inserts, both in order of ``seq``. Mirror writes keep
the host's ids and do not use the list of free ids; the two families are not mixed on a plane.
Everything is a projection, an anti-join or a ranking; nothing walks rows in sequence.

Node status: 0 never touched, 1 live, 2 deleted.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors

#: Longest key in bytes; longer ones, or any key on a plane without keys, cannot be stored.
MAX_KEY = 65_535
#: Overflow keys take room in classes of so many bytes.
KEY_CLASS = 64

#: Reasons by code, in the order in which a record is examined.
REASONS = {
    "dimension-mismatch": "vector does not have the plane's dims",
    "key-unstorable": "key is longer than a plane stores",
    "not-finite": "vector is not finite",
    "full": "plane is full",
    "key-arena-full": "no room is left for long keys",
}
#: Faults of a record; the others stop the batch.
RECORD_FAULTS = ("dimension-mismatch", "key-unstorable", "not-finite", "key-arena-full")


def reason(code: Column) -> Column:
    out = F.when(code == "full", REASONS["full"])
    for name, text in REASONS.items():
        out = out.when(code == name, text)
    return out


def record_fault(dims: int, key_cap: int, vector: str = "embedding", key: str = "key") -> Column:
    """First fault of an input record by itself: its code, or null."""
    length = F.coalesce(F.octet_length(key), F.lit(0))
    unstorable = (length > MAX_KEY) | (F.lit(key_cap == 0) & (length > 0))
    return (
        F.when(F.col(vector).isNull() | (F.size(vector) != dims), "dimension-mismatch")
        .when(unstorable, "key-unstorable")
        .when(~vectors.is_finite(vector), "not-finite")
    )


def running(df: DataFrame, order: str, name: str, buckets: int | None = None, value: str | None = None) -> DataFrame:
    """``df`` with the running number of each row by the numeric column ``order``, or the running
    sum of ``value``.

    Rows are numbered inside ranges of ``order``; each range starts at the sum of those before
    it, so no task ranks all rows. The ranges' bounds are fixed numbers: a task that runs again
    after the loss of an executor finds the same ranges.
    """
    if buckets is None:
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at, part = F.col(order).cast("double"), "__part"
    cuts = sorted(set(df.select(at.alias("v")).approxQuantile("v", [i / buckets for i in range(1, buckets)], 0.25 / buckets))) if buckets > 1 else []
    ranged = df.withColumn("__v", at)
    if cuts:
        ranged = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="__v", outputCol=part).transform(ranged).withColumn(part, F.col(part).cast("int"))
    else:
        ranged = ranged.withColumn(part, F.lit(0))
    sizes = dict(ranged.groupBy(part).agg(F.sum(value).cast("bigint") if value else F.count("*")).collect())
    starts, total = [], 0
    for i in range(len(cuts) + 1):
        starts.append(total)
        total += sizes.get(i) or 0
    window = Window.partitionBy(part).orderBy(order)
    inside = F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)) if value else F.row_number().over(window)
    return ranged.withColumn(name, inside + F.get(F.array(*map(F.lit, starts)), F.col(part))).drop(part, "__v")


def delete(nodes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes after deletes (node_id, seq), and what they add to the list of free ids (node_id, seq).

    Unknown and dead ids change nothing; of several deletes of a node the first counts.
    """
    first = ids.groupBy("node_id").agg(F.min("seq").alias("seq"))
    freed = first.join(nodes.where("status = 1").select("node_id"), "node_id", "left_semi")
    marked = nodes.join(freed.select("node_id", F.lit(True).alias("__gone")), "node_id", "left")
    return marked.withColumn("status", F.when(F.col("__gone"), F.lit(2)).otherwise(F.col("status"))).drop("__gone"), freed


def assigned(valid: DataFrame, free: DataFrame, high_water: int, max_nodes: int) -> DataFrame:
    """``valid`` rows (seq) with their node_id: freed ids from the last freed on, then new ones.

    A row for which no id is left gets null: the plane is full from there on.
    """
    ranked = running(valid, "seq", "ins_rank")
    stack = running(free.select("node_id", (-F.col("seq")).alias("down")), "down", "ins_rank").select(F.col("node_id").alias("reused"), "ins_rank")
    n_free = free.count()
    fresh = F.lit(high_water - n_free - 1) + F.col("ins_rank")
    joined = ranked.join(stack, "ins_rank", "left")
    node_id = F.coalesce(F.col("reused"), F.when(fresh < max_nodes, fresh))
    return joined.withColumn("node_id", node_id.cast("bigint")).drop("reused", "ins_rank")


def key_bytes(key: str | Column = "key") -> Column:
    """Room that an overflow key takes."""
    return (KEY_CLASS * F.ceil(F.octet_length(key) / KEY_CLASS)).cast("bigint")


def arena_faults(records: DataFrame, key_cap: int, arena_bytes: int, used: int = 0) -> DataFrame:
    """``records`` (seq, key) with ``arena_ok``: whether each long key found room, in order of seq.

    A key that does not fit takes no room, so later shorter ones may still fit. All keys up to the
    first that does not fit are settled by running sums on executors. What is left then is less
    than one key needs. Of each size only the first keys can still fit, as many as would fill what
    is left, for once one of a size is turned down all later ones are: these few go to the driver,
    ``MAX_KEY / KEY_CLASS`` sizes with some thousands of keys together at most.
    """
    room = arena_bytes - used
    long = records.where(F.octet_length("key") > key_cap).select("seq", key_bytes().alias("bytes"))
    summed = running(long, "seq", "upto", value="bytes")
    front = F.col("upto") <= room
    state = summed.agg(F.max(F.when(front, F.col("upto"))).alias("taken"), F.min(F.when(~front, F.col("seq"))).alias("first")).first()
    left = room - (state.taken or 0)
    rank = F.row_number().over(Window.partitionBy("bytes").orderBy("seq"))
    tail = summed.where(~front & (F.col("bytes") <= left)).withColumn("n", rank).where(F.col("n") * F.col("bytes") <= left)
    accepted = []
    for seq, need in tail.select("seq", "bytes").orderBy("seq").collect() if state.first is not None and left >= KEY_CLASS else ():
        if need <= left:
            accepted.append((seq,))
            left -= need
    late = records.sparkSession.createDataFrame(accepted, "seq bigint").withColumn("__late", F.lit(True))
    ok = F.coalesce(F.octet_length("key"), F.lit(0)) <= key_cap
    if state.first is not None:
        # The front's end is a seq: no join is needed to know who stands before it.
        ok |= F.col("seq") < F.lit(state.first)
    else:
        ok |= F.lit(True)
    joined = records.join(F.broadcast(late), "seq", "left")
    return joined.withColumn("arena_ok", ok | F.coalesce("__late", F.lit(False))).drop("__late")


def insert_batch(records: DataFrame, free: DataFrame, *, dims: int, key_cap: int, high_water: int, max_nodes: int, arena_bytes: int | None = None) -> DataFrame:
    """Outcome of each record (seq, embedding, key): seq, node_id (null if it did not land), code, reason.

    A record with a fault consumes no id. ``full`` stops the batch: no later record lands.
    """
    judged = records.withColumn("code", record_fault(dims, key_cap))
    valid = judged.where("code IS NULL")
    if arena_bytes is not None:
        valid = arena_faults(valid, key_cap, arena_bytes)
        late = valid.where("NOT arena_ok").withColumn("code", F.lit("key-arena-full")).drop("arena_ok")
        valid = valid.where("arena_ok").drop("arena_ok")
    else:
        late = valid.where("false")
    landed = assigned(valid, free, high_water, max_nodes)
    landed = landed.withColumn("code", F.when(F.col("node_id").isNull(), "full"))
    bad = judged.where("code IS NOT NULL").unionByName(late).withColumn("node_id", F.lit(None).cast("bigint"))
    every = landed.unionByName(bad)
    return every.withColumn("reason", reason(F.col("code")))


def latest(ops: DataFrame, *keys: str, by: str = "seq") -> DataFrame:
    """The row of the highest ``by`` for each key; the sums run by partial aggregation."""
    others = [c for c in ops.columns if c not in keys]
    best = ops.groupBy(*keys).agg(F.max_by(F.struct(*others), by).alias("__row"))
    return best.select(*keys, *(F.col("__row")[c].alias(c) for c in others))


def mirror(nodes: DataFrame, ops: DataFrame) -> DataFrame:
    """Nodes after raw writes (node_id, seq, embedding, key): the last write of each id wins.

    A write without a key keeps the newest key of the id, from earlier writes or the table.
    """
    new = latest(ops, "node_id")
    keyed = ops.where("key IS NOT NULL").groupBy("node_id").agg(F.max_by("key", "seq").alias("__new_key"))
    old = nodes.select("node_id", F.col("key").alias("__old_key"))
    filled = new.join(keyed, "node_id", "left").join(old, "node_id", "left")
    written = filled.withColumn("key", F.coalesce("__new_key", "__old_key")).withColumn("status", F.lit(1))
    kept = nodes.join(new.select("node_id"), "node_id", "left_anti")
    columns = nodes.columns
    rows = written.select(*(c if c in written.columns else F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in columns))
    return kept.unionByName(rows)


def if_absent(nodes: DataFrame, ops: DataFrame) -> DataFrame:
    """(node_id, written) of each write: only ids never touched, deleted ones counting as touched."""
    first = ops.groupBy("node_id").agg(F.min("seq").alias("__first"))
    touched = nodes.where("status <> 0").select("node_id", F.lit(True).alias("__touched"))
    joined = ops.join(first, "node_id").join(touched, "node_id", "left")
    return joined.withColumn("written", F.col("__touched").isNull() & (F.col("seq") == F.col("__first"))).drop("__first", "__touched")


def clear(nodes: DataFrame, ids: DataFrame, max_nodes: int) -> DataFrame:
    """Nodes with the ids marked deleted, even ids never written; ids beyond the plane are ignored."""
    wanted = ids.select("node_id").distinct().where(F.col("node_id") < max_nodes)
    kept = nodes.join(wanted.select("node_id", F.lit(True).alias("__clear")), "node_id", "left")
    marked = kept.withColumn("status", F.when(F.col("__clear"), F.lit(2)).otherwise(F.col("status"))).drop("__clear")
    fresh = wanted.join(nodes.select("node_id"), "node_id", "left_anti")
    rows = fresh.select(*("node_id" if c == "node_id" else F.lit(2 if c == "status" else None).cast(nodes.schema[c].dataType).alias(c) for c in nodes.columns))
    return marked.unionByName(rows)


def raw_fault(dims: int, max_nodes: int, precision: str) -> Column:
    """Fault of a raw write (node_id, code, scale, inv_mag, neighbors), or null."""
    limit = vectors.CODE_LIMIT[precision]
    return (
        F.when((F.col("node_id") < 0) | (F.col("node_id") >= max_nodes), "id-out-of-range")
        .when(F.size("code") != dims, "dimension-mismatch")
        .when(F.expr(f"exists(code, c -> c < -{limit} OR c > {limit})"), "code-out-of-domain")
        .when(F.isnan("scale") | (F.abs("scale") == float("inf")) | F.isnan("inv_mag") | (F.abs("inv_mag") == float("inf")), "not-finite")
        .when(F.expr(f"exists(neighbors, x -> x < 0 OR x >= {max_nodes})"), "neighbor-out-of-range")
    )


def elect_entry(nodes: DataFrame, prefer: int | None = None) -> DataFrame:
    """(node_id, level) of the live node of the highest level: the preferred one on a tie, else the least id."""
    rank = F.struct("level", F.coalesce(F.col("node_id") == F.lit(prefer), F.lit(False)).alias("p"), (-F.col("node_id")).alias("down"))
    return nodes.where("status = 1").agg(F.max(rank).alias("b")).where("b IS NOT NULL").select((-F.col("b.down")).alias("node_id"), F.col("b.level").alias("level"))


def compacted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both live."""
    alive = nodes.where("status = 1").select("node_id")
    return edges.join(alive.withColumnRenamed("node_id", "src"), "src", "left_semi").join(alive.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(*edges.columns)


def high_water(nodes: DataFrame) -> DataFrame:
    """One more than the largest id that was ever used."""
    return nodes.agg(F.coalesce(F.max("node_id") + 1, F.lit(0)).cast("bigint").alias("high_water"))
