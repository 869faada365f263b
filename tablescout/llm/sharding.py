"""Sharding by a permutation-filled lookup table.

Each shard has an order of preference over the slots of a table of prime size: offset + i * skip. Shards take turns; at its turn a shard
claims the first slot of its order that is still free. Slots are then spread evenly (the numbers differ by one at most), and when a shard
leaves or joins, few slots change hands between the others. A row is placed by hashing its key to a slot.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 4099


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    """The first 15 hexadecimal digits of the md5 of a text."""
    return int(md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The index of the shard that owns each slot. The work is bounded by the two parameters, not by any table.

    Raises for no shards, repeated names, a size that is no prime, or more shards than slots.
    """
    if not shards or len(set(shards)) < len(shards) or len(shards) > size or not _is_prime(size):
        raise ValueError("sharding needs distinct shard names and a prime table size of at least their number")
    place = [_number(f"offset:{name}") % size for name in shards]
    skip = [_number(f"skip:{name}") % (size - 1) + 1 if size > 2 else 1 for name in shards]
    owner = [-1] * size
    free = size
    while free:
        for i in range(len(shards)):
            while owner[place[i]] >= 0:
                place[i] = (place[i] + skip[i]) % size
            owner[place[i]] = i
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: its md5 modulo the table size. A null key is the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def slot_table(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard) for all slots."""
    owner = ",".join(map(str, fill_table(shards, size)))
    names = F.array(*[F.lit(name) for name in shards])
    slots = spark.range(1).select(F.posexplode(F.split(F.lit(owner), ",").cast("array<int>")).alias("slot", "owner"))
    return slots.select("slot", F.element_at(names, F.col("owner") + 1).alias("shard"))


def assign_shards(df: DataFrame, key: Column, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """`df` with `slot` and `shard` of each row's key.

    The table has `size` rows, whatever the data, so it is broadcast: placing a row is one look-up, and no row is moved. Equal keys share a
    shard; a hot key is one shard's load, as sharding by key means. Input columns named `slot` or `shard` are replaced.
    """
    keyed = df.withColumn("__slot", slot_of(key, size)).drop("slot", "shard").withColumnRenamed("__slot", "slot")
    table = F.broadcast(slot_table(df.sparkSession, shards, size))
    return keyed.join(table, "slot").select(*[c for c in keyed.columns if c != "slot"], "slot", "shard")


def shard_sizes(placed: DataFrame) -> DataFrame:
    """Rows of each shard."""
    return placed.groupBy("shard").agg(F.count("*").alias("n_rows"))
