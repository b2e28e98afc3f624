"""Helpers that several training-data operators share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from verdant.session import partitions_for, scratch_path

# The white space that separates words, as characters and as a regex class.
BLANKS = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table cuts the lineage: later stages, and retries after a lost executor, read
    the files instead of running the plan again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_by_key(df: DataFrame, key: str, name: str, bytes_each: int = 64 << 20) -> DataFrame:
    """``df`` as a table of the shared folder, bucketed by ``key``: joins and groupings on it leave its rows in place.

    The buckets follow the size of the data read, and are no fewer than the shuffle partitions, or Spark would
    deal the table anew. Only the files stay; the catalog entry, needed to write buckets, is dropped at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = os.path.basename(path).replace("-", "_")
    n = partitions_for(df, bytes_each)
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(table)
    rows = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return rows


def whole_text(col: str = "text") -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def carried(docs: DataFrame, **named: Column) -> DataFrame:
    """``docs`` with all its columns in one struct ``doc``, beside the ``named`` ones, so that no column of the
    input can clash with one of ours; ``doc.*`` gives them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                       *[c.alias(name) for name, c in named.items()])


def row_name(doc_id: Column, text: Column) -> Column:
    """128 bits of a row's doc_id and text; a null id is like no other."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("none")), text)))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, UPPER.lower())


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Add ``rank``: the 0-based position of a row in its group under ``order`` (a total order).

    The rows are range-partitioned by group and order, so a group that holds a third of all rows
    spreads over many tasks; each task numbers its own slice and adds the rows of the group in
    earlier slices, which a small table (partitions + groups rows) holds.
    """
    by = [F.col(g) for g in group]
    cut = df.repartitionByRange(*(by + order)).withColumn("_slice", F.spark_partition_id())
    cut = staged(cut, name)
    from pyspark.sql import Window
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("_slice", *group).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_slice", *group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_slice", *group).orderBy(*order)
    numbered = cut.withColumn("_at", F.row_number().over(within) - 1)
    renamed = offsets.select(F.col("_slice").alias("_s"), F.col("_before"),
                             *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)])
    on = F.col("_slice") == F.col("_s")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return (numbered.join(renamed, on)
            .withColumn("rank", F.col("_at") + F.col("_before"))
            .drop("_slice", "_s", "_at", "_before", *[f"_g{i}" for i in range(len(group))]))


def follow_leaders(leaders: DataFrame, followers: DataFrame, key: list[str], fn, schema: str) -> DataFrame:
    """Run ``fn`` over rows dealt by ``key``, each key's leaders directly before its followers.

    ``leaders`` and ``followers`` share one schema. ``fn`` gets an iterator of pandas frames with
    the added column ``role`` (0 leader, 1 follower); a key may span frames, so ``fn`` carries the
    current leaders along. Nothing but the leaders of one key stays in memory.
    """
    rows = leaders.withColumn("role", F.lit(0)).unionByName(followers.withColumn("role", F.lit(1)))
    return rows.repartition(*key).sortWithinPartitions(*key, "role").mapInPandas(fn, schema)


def fit_to_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (a staged table of ids) with a broadcast hint if it has at most ``rows`` rows.

    Beyond that the join shuffles; the result is the same.
    """
    return F.broadcast(df) if df.count() <= rows else df
