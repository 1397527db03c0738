"""Sharding by a permutation-filled lookup table.

The shards take turns claiming slots of a table of prime size. Each walks its own permutation of
the slots and claims the first free one, so shards hold equally many slots (one more or less),
and adding or removing a shard moves few slots besides its own. A row's key hashes to a slot,
and the slot names the shard.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A prime over a hundred times the shards keeps their shares within one part in a hundred.
SHARDS = 32
SLOTS = 4099
# The table is broadcast; a larger one than this is refused (8 MB of shards).
MOST_SLOTS = 1_000_003


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: int = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard of every slot."""
    if not is_prime(slots) or not 0 < shards <= slots <= MOST_SLOTS:
        raise ValueError("slots must be prime, at least as many as shards, and bounded")
    place = [_number(f"offset:{s}") % slots for s in range(shards)]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in range(shards)]
    table = [-1] * slots
    for turn in range(slots):
        s = turn % shards
        while table[place[s]] >= 0:
            place[s] = (place[s] + skip[s]) % slots
        table[place[s]] = s
    return table


def slot_of(key, slots: int = SLOTS):
    """The slot of a text key."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % slots


def assign_shards(
    docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with the columns slot and shard; columns of these names are replaced.

    Rows with equal keys share a shard. Rows without a key are placed by their text, rows with
    neither by the empty text. Nothing is dropped; an empty table gives an empty result. The
    only data sent around is the table of ``slots`` rows, which is bounded.
    """
    table = docs.sparkSession.createDataFrame(
        list(enumerate(lookup_table(shards, slots))), "slot bigint, shard int"
    )
    by = F.coalesce(F.col(key).cast("string"), F.col(text), F.lit(""))
    placed = docs.drop("slot", "shard").withColumn("slot", slot_of(by, slots))
    return placed.join(F.broadcast(table), "slot").select(*placed.columns, "shard")
