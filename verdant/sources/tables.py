"""Table sources and sinks."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def list_files(spark: SparkSession, directory: str, suffix: str = ".csv", folders: bool = False) -> list[str]:
    """File paths (not contents) directly under ``directory`` with the suffix, sorted; with ``folders`` also
    the folders so named, each a table of part files."""
    fs, p = _fs(spark, directory)
    if not fs.exists(p):
        return []
    return sorted(str(s.getPath().toString()) for s in fs.listStatus(p)
                  if (folders or s.isFile()) and s.getPath().getName().lower().endswith(suffix))


def read_table(spark: SparkSession, path: str, schema=None, fmt: str | None = None,
               null_value: str | None = None, mode: str | None = None) -> DataFrame:
    """A CSV with header (types inferred unless ``schema``) or a parquet/json table."""
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
        if mode:
            reader = reader.option("mode", mode)
        if null_value is not None:
            reader = reader.option("nullValue", null_value)
        return reader.csv(path)
    return reader.format(fmt).load(path)


def read_dir(spark: SparkSession, directory: str, strict: bool = False) -> dict[str, DataFrame]:
    """Every ``*.csv`` in a directory, a file or a folder of part files, as a table named by its stem;
    unreadable ones skipped (``strict``: raised).

    Raises ``FileNotFoundError`` when there is no CSV at all.
    """
    files = list_files(spark, directory, folders=True)
    if not files:
        raise FileNotFoundError(f"no CSV files in {directory}")
    out = {}
    for f in files:
        name = os.path.splitext(os.path.basename(f))[0]
        try:
            df = read_table(spark, f)
            df.schema  # noqa: B018  (forces the header / inference read)
            out[name] = df
        except Exception as e:  # noqa: BLE001 - the reference reports and skips unreadable files
            if strict:
                raise
            print(f"skipping {f}: {type(e).__name__}")
    return out


def read_dir_concat(spark: SparkSession, directory: str, ts: str = "timestamp", tie: str | None = None
                    ) -> DataFrame | None:
    """S3: all CSVs of a directory appended by column name (missing -> null), timestamp parsed, sorted.

    Files are read one by one (their headers may differ) and unioned by name; any error -> None.
    """
    try:
        tables = list(read_dir(spark, directory, strict=True).values())
    except Exception:  # noqa: BLE001 - one unreadable file: no table rather than part of one
        return None
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    if ts in df.columns:
        df = df.withColumn(ts, F.try_to_timestamp(F.col(ts).cast("string")))
        df = df.orderBy(F.col(ts), *([F.col(tie)] if tie else []))
    return df


def read_or_default(spark: SparkSession, path: str | None, default, schema=None) -> DataFrame:
    """The table at ``path`` if it exists and every row of it parses, else ``default()`` (a callable).

    With a schema each row is read in FAILFAST mode once, all columns, before the table is handed out;
    types that Spark infers from all rows fit them by construction.
    """
    if path and path_exists(spark, path):
        try:
            df = read_table(spark, path, schema, mode="FAILFAST" if schema is not None else None)
            if schema is not None:
                df.write.format("noop").mode("overwrite").save()
            return df
        except Exception:  # noqa: BLE001
            pass
    return default()


def inline_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A literal table."""
    return spark.createDataFrame(rows, schema)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with header, no index (a directory of part files)."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def snapshot_stamp(now: datetime | None = None) -> str:
    return (now or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")


def write_snapshot(df: DataFrame, base: str, stamp: str | None = None, fmt: str = "parquet") -> str:
    """Append-only timestamped copy, as partition ``snapshot_ts=<stamp>`` of ``base``.

    Only the new partition is written (dynamic partition overwrite makes a retry idempotent).
    """
    stamp = stamp or snapshot_stamp()
    (df.withColumn("snapshot_ts", F.lit(stamp)).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_ts").format(fmt).save(base))
    return f"{base.rstrip('/')}/snapshot_ts={stamp}"


def save_metadata(spark: SparkSession, path: str, target: str, task: str, params: dict,
                  created_at: str | None = None) -> DataFrame:
    """Model metadata as a one-row JSON table (params as a string map; NaN kept as text)."""
    created_at = created_at or datetime.now(timezone.utc).isoformat(timespec="seconds")
    row = [(target, task, {k: json.dumps(v) for k, v in params.items()}, created_at)]
    df = spark.createDataFrame(row, "target_column string, task_type string, params map<string,string>, "
                                    "created_at string")
    df.coalesce(1).write.mode("overwrite").json(path)
    return df


def copy_first_csv(spark: SparkSession, src_dir: str, dst: str) -> str | None:
    """The first CSV of a folder written under a standard name; an existing output is kept."""
    files = list_files(spark, src_dir)
    if not files:
        return None
    read_table(spark, files[0]).write.mode("ignore").option("header", True).csv(dst)
    return dst
