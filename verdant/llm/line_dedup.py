"""Line deduplication by the number of distinct sites that show a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from verdant.llm.common import row_name, staged, whole_text

MIN_SITES = 10      # a line on so many sites is boilerplate
LG_K = 8            # 2^8 registers for each sketch
BAND = 0.25         # relative distance from the threshold within which sites are counted exactly
TRIM = " \t\r"


def line_key(line: Column) -> Column:
    """128 bits of the line without white space at its ends."""
    return F.unhex(F.md5(F.btrim(line, F.lit(TRIM))))


def exploded(docs: DataFrame, site: str) -> DataFrame:
    """(line, site) for every line that is not blank."""
    lines = docs.select(F.col(site).cast("string").alias("site"), F.explode(F.split(whole_text(), "\n")).alias("line"))
    return lines.where(F.btrim("line", F.lit(TRIM)) != "").select(line_key(F.col("line")).alias("line"), "site")


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """The keys of the lines that at least ``min_sites`` distinct sites show; a null site counts for none.

    One HyperLogLog sketch for each line, merged on both sides of the shuffle, so a line that every
    document shows is one row from each task. An estimate beyond the band decides alone (the band is
    about four standard errors of the sketch, and sketches of few sites are exact lists); a line
    within it gets an exact distinct count.
    """
    lines = exploded(docs, site).where(F.col("site").isNotNull())
    spread = staged(lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sites"))
                    .select("line", F.hll_sketch_estimate("sites").alias("sites"))
                    .where(F.col("sites") >= min_sites * (1 - BAND)), "line-spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + BAND)).select("line")
    near = spread.where(F.col("sites") <= min_sites * (1 + BAND)).select(F.col("line").alias("near"))
    exact = (lines.join(near, F.col("line") == F.col("near"), "left_semi").distinct()
             .groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("line"))
    return staged(sure.unionByName(exact), "line-boilerplate")


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(doc_id, text, n_lines, n_removed): every row of ``docs`` without its boilerplate lines.

    Lines are compared without white space at their ends; blank lines stay. Null text gives a null text
    with no lines, the empty text one empty line. A document that holds no boilerplate keeps its text
    byte for byte; one of nothing but boilerplate becomes empty. Rows that repeat a document lose the
    same lines. Other columns of ``docs`` are not looked at.
    """
    lines = boilerplate(docs, site, min_sites).select(F.col("line").alias("bad"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    # (document, position) of every line to go; documents are told apart by id and text
    name = row_name(F.col("doc_id"), whole_text())
    at = (rows.select(name.alias("name"), F.posexplode(F.split(whole_text(), "\n")).alias("at", "line"))
          .where(F.btrim("line", F.lit(TRIM)) != "").select("name", "at", line_key(F.col("line")).alias("line")))
    gone = (at.join(lines, F.col("line") == F.col("bad"), "left_semi")
            .groupBy("name").agg(F.collect_set("at").alias("gone")).withColumnRenamed("name", "gone_name"))
    kept = F.filter(F.split(F.col("text"), "\n"), lambda line, i: ~F.array_contains(F.col("gone"), i))
    joined = rows.withColumn("name", name).join(gone, F.col("name") == F.col("gone_name"), "left")
    return joined.select("doc_id",
                         F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
                         F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
                         F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
