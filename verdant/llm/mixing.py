"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from verdant.llm.common import WORD, carried, fit_to_broadcast, ranked, staged, whole_text

WEIGHTS = (5, 2, 1)   # of the sources in code-point order, repeating
MAX_EPOCHS = 3        # a source is taken at most so many times
SEED = 20


def word_count(col: str = "text") -> Column:
    return F.regexp_count(whole_text(col), F.lit(WORD)).cast("long")


def _unit(text: Column) -> Column:
    """A number in [0, 1) from the text's MD5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(16 ** 12))


def _product(col: str, number: int) -> Column:
    return F.col(col).cast("decimal(19,0)") * F.lit(number).cast("decimal(19,0)")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) from per-document (source, size).

    The sources share the total size by weight. Every source whose share is above ``max_epochs`` times
    its size is clamped there, and the others share what is left, until none is above. A round is one
    aggregate of the source table that brings three numbers to the driver; the sources clamped in a
    round are exactly those above the level, and the level only rises, so the rounds end, after at most as
    many as there are sources (in practice a few). Products are decimals, so that no size overflows.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = ranked(sources, [], [F.col("source").asc_nulls_last()], "mix-sources")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    sources = staged(sources.select("source", "source_size", weight.cast("long").alias("weight"),
                                    (F.col("source_size") * max_epochs).alias("cap")), "mix-weights")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    spare, shares = total, None
    while True:
        above = F.lit(False) if shares is None else _product("weight", spare) > _product("cap", shares)
        row = sources.agg(F.sum(F.when(above, F.col("cap")).otherwise(0)).alias("caps"),
                          F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weights")).first()
        now = (total - (row["caps"] or 0), row["weights"] or 0)
        if now == (spare, shares) or not now[1]:
            break
        spare, shares = now
    share = _product("weight", spare).cast("double") / F.lit(float(shares or 1))
    target = F.when(_product("weight", spare) > _product("cap", shares or 1), F.col("cap").cast("double")).otherwise(share)
    return sources.select("source", "source_size", "weight", target.cast("double").alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``docs``.

    A source whose target is r times its size takes each document floor(r) times, and one copy more of
    a seeded systematic sample with rate r - floor(r): the source's documents in order of size (then of
    a seeded hash) are counted off, so every size has its share and the words taken differ from the
    target by less than the largest document. Null text has size 0, a null source is one source,
    the last; a null doc_id draws as an empty one. Other columns of ``docs`` are not looked at. Rows that
    repeat a document count each.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       word_count().alias("size"))
    return _mixed(rows, weights, max_epochs, seed).drop("name")


def _mixed(rows: DataFrame, weights: tuple, max_epochs: int, seed: int) -> DataFrame:
    """``mix`` of rows (doc_id, source, size[, name]); ``name`` stays."""
    names = [c for c in ("name",) if c in rows.columns]
    size = staged(rows.withColumn("draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))), "mix-sizes")
    targets = source_targets(size, weights, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = F.lit(0.4) + F.lit(0.2) * _unit(F.concat_ws(":", F.lit(str(seed)), F.lit("start"), F.col("source")))
    plan = targets.select(F.col("source").alias("of"), "source_size", "target",
                          F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("part"), start.alias("start"))
    numbered = ranked(size, ["source"], [F.col("size").desc(), F.col("draw"), F.col("doc_id")], "mix-ranks")
    numbered = numbered.join(plan, F.col("source").eqNullSafe(F.col("of")))
    extra = F.floor((F.col("rank") + 1) * F.col("part") + F.col("start")) - F.floor(F.col("rank") * F.col("part") + F.col("start"))
    copies = (F.col("whole") + extra).cast("long")
    return numbered.select(*names, "doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                           (copies * F.col("size")).alias("taken"))


BROADCAST_ROWS = 1_000_000  # rows of the plan, of a name of 16 bytes and two numbers each


def _row_name(docs: DataFrame) -> Column:
    """128 bits of all columns of a row, nulls told apart from values."""
    parts = []
    for field in docs.schema.fields:
        c = F.col(f"`{field.name}`")
        parts += [c.isNull(), c if field.dataType.typeName() not in ("array", "map", "struct", "variant") else F.to_json(F.struct(c))]
    return F.concat(F.unhex(F.hex(F.xxhash64(F.lit(1), *parts))), F.unhex(F.hex(F.xxhash64(F.lit(2), *parts))))


def take(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs``, with all its columns, as often as ``mix`` takes it.

    Rows that are equal in every column are one row, taken as often as all of them; rows that differ in any
    column, or in having an id, are never confused.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       word_count().alias("size"), _row_name(docs).alias("name"))
    plan = _mixed(rows, weights, max_epochs, seed).groupBy("name").agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    plan = staged(plan.where("copies > 0").withColumnRenamed("name", "of"), "mix-plan")
    found = carried(docs, name=_row_name(docs)).join(fit_to_broadcast(plan, BROADCAST_ROWS), F.col("name") == F.col("of"))
    if not plan.where("rows > 1").isEmpty():
        found = found.where("rows = 1").unionByName(found.where("rows > 1").dropDuplicates(["name"]))
    again = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("again")
    return found.select("doc", again).select("doc.*")
