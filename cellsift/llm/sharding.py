"""Placement of rows on shards by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of the table (a prime, well above the number of shards) and shards.
SLOTS, SHARDS, MOST_SLOTS = 65_537, 64, 1_000_003


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of its shard: shards take turns, each claiming the first free slot it prefers.

    A shard prefers the slots offset, offset + skip, offset + 2 skip, ... modulo the prime ``slots``, both numbers from
    hashes of its name. Shards get equal shares up to one slot, and few slots move when a shard comes or goes.
    """
    if not shards or len(set(shards)) < len(shards) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"distinct shards, at least one, and as many to {MOST_SLOTS} slots are needed")
    if any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)) or slots < 2:
        raise ValueError("the number of slots must be a prime")
    spot = [_hash(s, "offset") % slots for s in shards]
    skip = [_hash(s, "skip") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while table[spot[i]] >= 0:
                spot[i] = (spot[i] + skip[i]) % slots
            table[spot[i]] = i
            free -= 1
            if not free:
                return table


def slot_of(id_col: str, text_col: str, slots: int = SLOTS) -> Column:
    """The slot of a row: a hash of its id; rows without an id spread by their text."""
    own = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("\x00"), F.col(text_col)), F.lit("\x00"))
    return F.pmod(F.xxhash64(own), F.lit(slots))


def place(docs: DataFrame, shards: list[str] | None = None, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", name: str = "shard") -> DataFrame:
    """``docs`` with one more column, the shard of each row; a column ``name`` that is there already is replaced.

    The table has one row per slot, at most 1,000,003, and is broadcast; rows are not shuffled. Rows with the same id
    share a shard. Null ids spread by text; null texts among them share a shard. Names of shards default to
    ``shard-000`` to ``shard-063``.
    """
    shards = shards or [f"shard-{i:03d}" for i in range(SHARDS)]
    table = docs.sparkSession.createDataFrame(
        [(s, shards[i]) for s, i in enumerate(lookup_table(shards, slots))], "slot_ long, shard_ string")
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    inner = docs.select(*[F.col(f"`{c}`") for c in kept], slot_of(id_col, text_col, slots).alias("llm_slot_"))
    return inner.join(F.broadcast(table), F.col("llm_slot_") == F.col("slot_"), "left").select(
        *[F.col(f"`{c}`") for c in kept], F.col("shard_").alias(name))


def placements(docs: DataFrame, shards: list[str] | None = None, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, slot, shard, n_bytes), one row per row of ``docs``; bytes of the text, null: 0. See ``place``."""
    read = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return place(read, shards, slots, "id").select(
        F.col("id").alias(id_col), slot_of("id", "text", slots).alias("slot"), "shard",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write ``docs`` as Parquet with a folder per shard; a shard's rows may lie in many files."""
    place(docs, **options).write.partitionBy("shard").mode("overwrite").parquet(path)
