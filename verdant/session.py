"""Session construction and cluster-level settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every verdant job relies on: UTC wall clock (the reference's timestamps are
# naive), ANSI arithmetic, and adaptive execution with skew-join splitting.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # pinned frames are reliable checkpoints: delete their files once nothing references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "verdant", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the verdant base settings.

    On a cluster ``master`` is left to spark-submit; tests pass ``local[*]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for reliable checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, whose executors are the
    driver, gets a private scratch folder when that is unset.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="verdant-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, one for all sessions (tests: the session's own)."""
    own = checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written intermediate table."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{os.urandom(6).hex()}")


TARGET_PARTITION_BYTES = 512 * 1024 * 1024
_UNKNOWN_SIZE = 2 ** 62  # statistics-free leaves report the default size (Long.MaxValue)


def input_bytes(df) -> int | None:
    """Bytes of the relations ``df`` reads (sum over the plan's leaves with a known size).

    Output-size estimates of joins without statistics are products of both sides and useless
    for sizing; the scanned input is a stable proxy for the data volume."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    except Exception:  # noqa: BLE001
        return None
    known = [x for x in sizes if x < _UNKNOWN_SIZE]
    return sum(known) if known else None


def partitions_for(df, target_bytes: int = TARGET_PARTITION_BYTES) -> int:
    """Partition count for an explicit repartition of ``df``: scanned input bytes over
    ``target_bytes``, never fewer than ``spark.sql.shuffle.partitions``.

    Explicit ``repartitionByRange(n, ...)`` counts are not resized by AQE, so they must grow
    with the data (about 200,000 partitions of 512 MB for 100 TB).
    """
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    if size is None:
        return floor
    return int(max(floor, -(-size // target_bytes)))


def pin(df):
    """Write ``df`` once to the shared folder and read it back: the plan runs one time, later reads (and
    retries after a lost executor) see the same rows and columns in the files."""
    path = scratch_path(df.sparkSession, "pinned")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
