"""Shard placement by a permutation-filled lookup table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SHARDS = 16
TABLE_SIZE = 2039  # a prime, over a hundred slots for each shard


def _number(text: Column) -> Column:
    """60 bits of the text's MD5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def lookup_table(spark: SparkSession, shards: int = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard), one row per slot of the table.

    Each shard prefers the slots in the order offset, offset + skip, offset + 2 skip, ... modulo the
    prime ``size``, a permutation of all slots. The shards take turns; in its turn a shard claims the
    first slot of its order that is still free, until none is. One fold over the turns with the array
    of owners as its state. The size is a setting, so the table never grows with the data.
    """
    if shards < 1 or size < shards or any(size % k == 0 for k in range(2, int(size ** 0.5) + 1)):
        raise ValueError("the table size must be a prime of at least the number of shards")
    turns = F.sequence(F.lit(0), F.lit(size - 1))

    def claim(state: Column, turn: Column) -> Column:
        shard, owners = turn % shards, state["owners"]
        offset, skip = F.get(state["offsets"], shard), F.get(state["skips"], shard)
        order = F.transform(turns, lambda k: ((offset + k * skip) % size).cast("int"))
        free = F.filter(order, lambda s: F.get(owners, s) == -1)
        # the slot is bound once, as the variable of a one-element transform
        taken = F.transform(F.slice(free, 1, 1), lambda s: F.concat(
            F.slice(owners, F.lit(1), s), F.array(shard), F.slice(owners, s + 2, F.lit(size))))
        return F.struct(F.get(taken, F.lit(0)).alias("owners"), state["offsets"].alias("offsets"), state["skips"].alias("skips"))

    ids = F.sequence(F.lit(0), F.lit(shards - 1))
    offsets = F.transform(ids, lambda s: _number(F.concat(F.lit("offset:"), s.cast("string"))) % size)
    skips = F.transform(ids, lambda s: _number(F.concat(F.lit("skip:"), s.cast("string"))) % (size - 1) + 1)
    start = F.struct(F.array_repeat(F.lit(-1), size).alias("owners"), offsets.alias("offsets"), skips.alias("skips"))
    owners = spark.range(1).select(F.aggregate(turns, start, claim)["owners"].alias("owners"))
    return owners.select(F.posexplode("owners").alias("slot", "shard"))


def assign_shards(docs: DataFrame, spark: SparkSession, key: str = "doc_id",
                  shards: int = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` of the hashed key; columns of those names are replaced.

    The table (``size`` rows, a setting) is broadcast, so placement is one hash and one probe for each
    row, with no shuffle. Rows with equal keys share a shard; a null key counts as the empty one.
    """
    table = lookup_table(spark, shards, size)
    at = (_number(F.coalesce(F.col(key).cast("string"), F.lit(""))) % size).cast("int")
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ("slot", "shard")])
    rows = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("doc"), at.alias("at"))
    return rows.join(F.broadcast(table), F.col("at") == F.col("slot")).select("doc.*", "slot", "shard")


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder for each shard under ``path``."""
    placed.write.partitionBy("shard").parquet(path)
