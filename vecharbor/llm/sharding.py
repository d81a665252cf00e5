"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size: an offset
and a step, both hashed from its name. The shards take turns; at its turn a shard claims the
first slot on its list that is free. So shards get equal shares to within one slot, and when a
shard comes or goes few slots change owner. The table (``SLOTS`` rows, whatever the data's
size) is broadcast, and a row is placed by one look-up at its key's hash.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = 256


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def table(names: list[str], slots: int = SLOTS) -> np.ndarray:
    """Owner (a place in ``names``) of each slot."""
    if not _prime(slots) or not 0 < len(names) <= slots or len(set(names)) < len(names):
        raise ValueError("slots must be prime, and names distinct, at least one and at most as many as slots")
    offset = [xxhash.xxh64_intdigest(x, 1) % slots for x in names]
    step = [xxhash.xxh64_intdigest(x, 2) % (slots - 1) + 1 for x in names]
    at = offset[:]
    owner = np.full(slots, -1, np.int32)
    free = slots
    while free:
        for k in range(len(names)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                break
    return owner


def slot_of(*keys: str, slots: int = SLOTS) -> Column:
    """Slot of a row by its keys' text; null counts as an empty text."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    return F.pmod(F.xxhash64(text), F.lit(slots)).cast("int")


def placed(df: DataFrame, *keys: str, shards: int | list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The keys of each row with its slot and shard number; no shuffle.

    Rows of equal keys go to one shard; name further key columns to spread a frequent one.
    Null keys count as empty ones, keys of any length are hashed whole, repeated rows give repeated
    rows, an empty table none. Columns other than the keys are not read; keys may not be called
    slot or shard.
    """
    names = [f"shard-{i:05d}" for i in range(shards)] if isinstance(shards, int) else shards
    owners = table(names, slots)
    lookup = df.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(owners)], "slot int, shard int")
    return df.select(*keys, slot_of(*keys, slots=slots).alias("slot")).join(F.broadcast(lookup), "slot").select(*keys, "slot", "shard")
