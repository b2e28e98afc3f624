"""File-listing queries over ``documents`` (as a listing of sizes) and ``pages.url``:
S14, S15, W3, G4, G12."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verdant.functions import generic as G
from verdant.operators import windows as W
from verdant.plans.registry import query
from verdant.sources import files as FS
from verdant.sources.adapters import base_table, documents_listing, view, with_views

# Size budget of the sampler in this fixture (characters stand in for bytes).
SAMPLE_CAP = 1_000_000
SEED = 42
_ORDER_SQL = "md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id"


@query("dir_size", "SELECT CAST(sum(n_chars) AS BIGINT) AS total_bytes, sum(n_chars) / 1073741824e0 AS total_gib,"
                   " count(*) AS n_files FROM documents")
def q_dir_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total size of a listing."""
    return FS.dir_size(documents_listing(spark, sf_dir))


@query("running_size", f"SELECT doc_id, CAST(sum(n_chars) OVER (ORDER BY {_ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING"
                       " AND CURRENT ROW) AS BIGINT) AS running_size FROM documents")
def q_running_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running total of sizes in the seeded shuffle order (two-level prefix sum)."""
    df = FS.with_shuffle_key(documents_listing(spark, sf_dir), "doc_id", SEED)
    out = W.running_total(df, "length", ["_sk", "doc_id"], name="running_size")
    return out.select("doc_id", F.col("running_size").cast("bigint").alias("running_size"))


@query("sample_by_size_prefix", f"SELECT doc_id, n_chars AS length FROM (SELECT doc_id, n_chars, sum(n_chars) OVER"
                                f" (ORDER BY {_ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run"
                                f" FROM documents) WHERE run <= {SAMPLE_CAP}")
def q_sample_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S15 (prefix variant): the shuffled prefix that fits the cap."""
    return FS.sample_by_size(documents_listing(spark, sf_dir), "doc_id", SAMPLE_CAP, SEED, greedy=False)


@query("sample_by_size", (
    "WITH RECURSIVE o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY " + _ORDER_SQL + ") AS rn FROM documents),"
    " g(rn, total, taken) AS (SELECT 0::BIGINT, 0::HUGEINT, false UNION ALL SELECT o.rn,"
    f" CASE WHEN g.total + o.n_chars <= {SAMPLE_CAP} THEN g.total + o.n_chars ELSE g.total END,"
    f" g.total + o.n_chars <= {SAMPLE_CAP} FROM g JOIN o ON o.rn = g.rn + 1)"
    " SELECT o.doc_id, o.n_chars AS length FROM g JOIN o ON o.rn = g.rn WHERE g.taken"))
def q_sample_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact greedy size-capped sample (take a file iff it still fits, skip it otherwise)."""
    return FS.sample_by_size(documents_listing(spark, sf_dir), "doc_id", SAMPLE_CAP, SEED, greedy=True)


@query("unit_convert", "SELECT doc_id, n_chars / 1073741824e0 AS gib, n_chars / 1000e0 AS per_thousand,"
                       " 100e0 * (n_chars / 1073741824e0) AS percent_of_gib FROM documents")
def q_unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes -> GiB, per-thousand and percent."""
    df = documents_listing(spark, sf_dir)
    return df.select("doc_id", G.bytes_to_gib("length").alias("gib"), G.per_thousand("length").alias("per_thousand"),
                     G.percent(G.bytes_to_gib("length")).alias("percent_of_gib"))


_PATH = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z]+://[^/]*', '')"
_BASE = f"regexp_extract({_PATH}, '[^/]*$', 0)"


@query("path_parts", (
    f"SELECT page_id, {_PATH} AS path, {_BASE} AS base_name,"
    f" CASE WHEN contains({_BASE}, '.') THEN regexp_extract({_BASE}, '^(.*)\\.[^.]*$', 1) ELSE {_BASE} END AS stem,"
    f" CASE WHEN contains({_BASE}, '.') THEN lower(regexp_extract({_BASE}, '[^.]*$', 0)) ELSE '' END AS extension,"
    f" regexp_extract({_PATH}, '^(.*)/[^/]*$', 1) AS parent,"
    " regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS host,"
    f" replace(regexp_replace({_PATH}, '^/', ''), '/', '_') AS flat_name FROM pages"))
def q_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, base name, stem, extension, parent, host and flattened name of each URL."""
    df = base_table(spark, sf_dir, "pages")
    return df.select("page_id", *[v.alias(k) for k, v in G.path_parts("url").items()])


# --- table sources (S1, S3) ---------------------------------------------------------------------

@query("read_table", "SELECT * FROM part")
def q_read_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table read through the source layer (parquet here; CSV with header + inference likewise)."""
    from verdant.sources.tables import read_table
    return read_table(spark, f"{sf_dir.rstrip('/')}/part.parquet")


SENSOR_TYPES = {"event_id": "bigint", "station_id": "bigint", "temperature": "double", "humidity": "double",
                "rainfall": "double", "soil_moisture": "double", "solar_radiation": "double", "wind_speed": "double"}


@query("read_dir_concat", with_views("SELECT * FROM sensor_readings", "sensor_readings"))
def q_read_dir_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: one folder of CSV files whose headers differ (column order), appended by name,
    timestamp parsed, sorted. The older and the newer half are written as part files of one header each."""
    from verdant.session import scratch_path
    from verdant.sources.tables import read_dir_concat
    r = view(spark, sf_dir, "sensor_readings")
    folder = scratch_path(spark, "csv-history")
    cut = r.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    fmt = {"header": True, "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
    r.filter(F.col("event_id") <= cut).write.options(**fmt).csv(folder)
    (r.filter(F.col("event_id") > cut).select(*reversed(r.columns))  # same fields, other header order
      .write.mode("append").options(**fmt).csv(folder))
    df = read_dir_concat(spark, folder, ts="event_time", tie="event_id")
    return df.select(*[F.col(c).cast(SENSOR_TYPES.get(c, "timestamp")).alias(c) for c in r.columns])


@query("read_dir", with_views(
    "SELECT 'farm_carbon' AS table_name, count(*) AS n_rows, 8 AS n_columns FROM farm_carbon"
    " UNION ALL SELECT 'farm_water', count(*), 8 FROM farm_water", "farm_carbon", "farm_water"))
def q_read_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every CSV of a folder as a table named by its stem (two views written as CSV folders)."""
    import os

    from verdant.session import scratch_path
    from verdant.sources.tables import read_dir
    folder = scratch_path(spark, "csv-dir")
    for name in ("farm_carbon", "farm_water"):  # a folder of part files per table, named by the table
        view(spark, sf_dir, name).write.option("header", True).csv(os.path.join(folder, f"{name}.csv"))
    tables = read_dir(spark, folder)
    rows = [(n, t.count(), len(t.columns)) for n, t in sorted(tables.items())]
    return spark.createDataFrame(rows, "table_name string, n_rows bigint, n_columns int")


@query("read_or_default", with_views("SELECT * FROM farm_water", "farm_water"))
def q_read_or_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An absent path falls back to the default table (here the water view)."""
    from verdant.sources.tables import read_or_default
    return read_or_default(spark, f"{sf_dir.rstrip('/')}/no_such_table.csv", lambda: view(spark, sf_dir, "farm_water"))


@query("read_or_default_existing", with_views(
    "SELECT 'good' AS file, farm_id, machinery_hours FROM farm_carbon UNION ALL SELECT 'bad', farm_id, -1e0 FROM farm_carbon", "farm_carbon"))
def q_read_or_default_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An existing file whose rows all parse is the table; one with a single bad row gives the default."""
    from verdant.session import scratch_path
    from verdant.sources.tables import read_or_default, write_csv
    df = view(spark, sf_dir, "farm_carbon").select("farm_id", "machinery_hours")
    last = df.agg(F.max("farm_id")).first()[0]
    text = F.when(F.col("farm_id") == last, F.lit("broken")).otherwise(F.col("machinery_hours").cast("string"))
    out = None
    for name, rows in (("good", df), ("bad", df.withColumn("machinery_hours", text))):
        path = write_csv(rows, scratch_path(spark, f"csv-{name}"))
        got = read_or_default(spark, path, lambda: df.withColumn("machinery_hours", F.lit(-1.0)), schema=df.schema)
        got = got.select(F.lit(name).alias("file"), "farm_id", "machinery_hours")
        out = got if out is None else out.unionByName(got)
    return out


@query("write_csv", with_views("SELECT * FROM farm_water", "farm_water"))
def q_write_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 + S1: a table written as CSV (header, no index) and read back with the same types."""
    from verdant.session import scratch_path
    from verdant.sources.tables import read_table, write_csv
    df = view(spark, sf_dir, "farm_water")
    path = write_csv(df, scratch_path(spark, "csv-out"))
    return read_table(spark, path, schema=df.schema)


@query("write_snapshot", with_views(
    "SELECT *, '20250101_000000' AS snapshot_ts FROM farm_env UNION ALL"
    " SELECT *, '20250102_000000' AS snapshot_ts FROM farm_env", "farm_env"))
def q_write_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only timestamped copies; a retried snapshot overwrites only itself."""
    from verdant.session import scratch_path
    from verdant.sources.tables import write_snapshot
    df = view(spark, sf_dir, "farm_env")
    base = scratch_path(spark, "snapshots")
    for stamp in ("20250101_000000", "20250102_000000", "20250102_000000"):
        write_snapshot(df, base, stamp)
    out = spark.read.parquet(base)
    return out.select(*df.columns, F.col("snapshot_ts").cast("string").alias("snapshot_ts"))
