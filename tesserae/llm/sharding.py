"""Operator 2: place rows on shards by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537  # a prime


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{salt}:{name}".encode(), digest_size=8).digest(), "little")


def lookup_table(shards: list[str], slots: int = SLOTS, turns: dict[str, int] | None = None) -> np.ndarray:
    """Which shard each slot belongs to.

    Every shard prefers the slots in an order of its own: a start and a stride from hashes of its name, which
    reaches every slot since their number is prime. Shards take turns and claim the first slot of their order
    that is still free (``turns`` gives a shard more than one turn a round), so shares differ by at most a slot a
    turn, and a shard that joins or leaves moves little else.
    """
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be one or more different names, no more than there are slots")
    if any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    start = [_number(x, "start") % slots for x in shards]
    stride = [_number(x, "stride") % (slots - 1) + 1 for x in shards]
    share = [max(1, (turns or {}).get(x, 1)) for x in shards]
    table, next_, left = [-1] * slots, [0] * len(shards), slots
    while left:
        for k in range(len(shards)):
            for _ in range(share[k]):
                if not left:
                    break
                at = (start[k] + next_[k] * stride[k]) % slots
                while table[at] >= 0:
                    next_[k] += 1
                    at = (start[k] + next_[k] * stride[k]) % slots
                table[at] = k
                next_[k] += 1
                left -= 1
    return np.array(table, np.int32)


def slot_of(keys: list[Column], slots: int = SLOTS) -> Column:
    """The slot of a row: a hash of its key columns; nulls hash to a value of their own."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def place(rows: DataFrame, keys: list[str], shards: list[str], slots: int = SLOTS, turns: dict[str, int] | None = None) -> DataFrame:
    """Add ``slot`` and ``shard`` to every row, with built-in functions and one broadcast lookup of ``slots`` rows.

    Equal keys share a shard. A key that holds very many rows fills its shard: give a further column in ``keys``
    to spread it. Columns of the same names are replaced, also where they are keys. An empty table gives no rows.
    """
    table = lookup_table(shards, slots, turns)
    where = [(int(k), shards[int(s)]) for k, s in enumerate(table)]
    small = rows.sparkSession.createDataFrame(where, "slot int, shard string")
    others = [f"`{c}`" for c in rows.columns if c.lower() not in ("slot", "shard")]
    placed = rows.select(*others, slot_of([F.col(k) for k in keys], slots).alias("slot"))
    return placed.join(F.broadcast(small), "slot").select(*others, "slot", "shard")
