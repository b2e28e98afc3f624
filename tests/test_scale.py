"""Plans and splits that keep a task, or the driver, from holding what grows with the input."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdant.functions.domain import SENSOR_FIELDS
from verdant.ml import stages as P
from verdant.ml import train as T
from verdant.ml import trees as R
from verdant.operators import stats as S
from verdant.operators.windows import sliding_windows, stored_windows
from verdant.streaming import sensor as ST


def test_forecast_never_broadcasts_windows(spark, monkeypatch):
    rows = spark.range(120).select(
        F.col("id").alias("event_id"), (F.col("id") % 2).alias("station_id"), F.timestamp_seconds("id").alias("event_time"),
        *[((F.col("id") * (7 + i)) % 11).cast("double").alias(c) for i, c in enumerate(SENSOR_FIELDS)],
        ((F.col("id") * 5) % 13).cast("double").alias("yield"))
    windows = sliding_windows(rows, ["event_id", *SENSOR_FIELDS], ["event_time", "event_id"], "station_id", 5)
    seen = []
    monkeypatch.setattr(P, "ensure_parallelism", lambda df: seen.append(df) or df)
    assert T.forecast_sequence(windows, SENSOR_FIELDS).metrics.count() == 3
    plan = seen[0]._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, plan


def test_spread_deals_the_rows_of_one_row_group(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(1000).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    assert P.spread(df).rdd.getNumPartitions() == df.rdd.getNumPartitions()
    monkeypatch.setattr(P, "SPREAD_BYTES", P.input_bytes(df) // 40)
    sizes = P.spread(df).rdd.glom().map(len).collect()
    assert len(sizes) >= 40 and sum(sizes) == 1000 and max(sizes) < 100


def test_bootstrap_sums_draws_in_the_task_that_makes_them(spark, monkeypatch):
    rows = [(i if i % 9 else None, None if i % 7 == 3 else "ab"[i % 2], None if i % 5 == 0 else float(i)) for i in range(40)]
    df = spark.createDataFrame(rows + [(100, "empty", None)], "k long, d string, x double")
    monkeypatch.setattr(S, "DRAWN_ROWS", 2)  # sums are given out and begun again
    out = S.bootstrap_mean(df, "d", "x", "k", replicates=20)
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString()  # no row for each draw
    got = {r.d: r for r in out.collect()}
    assert set(got) == {"a", "b", None, "empty"} and got["empty"].ci_low is None and got["empty"].n == 0
    limits = S.poisson_limits()
    for d in ("a", "b", None):
        means = []
        for j in range(20):
            total = n = 0
            for k, e, x in rows:
                if e == d and x is not None:
                    key = f"42:{j // 8}" + ("" if k is None else f":{k}")
                    draw = hashlib.md5(key.encode()).hexdigest()[4 * (j % 8):4 * (j % 8) + 4]
                    w = sum(draw >= at for at in limits)
                    total, n = total + w * x, n + w
            means += [total / n] if n else []
        assert [got[d].ci_low, got[d].ci_high] == pytest.approx(np.percentile(means, [2.5, 97.5]))


def test_only_the_smaller_of_two_children_is_added_up(monkeypatch):
    rng = np.random.default_rng(3)
    levels = [40, 2, 2, 3, 2, 1, 2]
    x = np.column_stack([rng.integers(0, n, 2000) for n in levels]).astype(np.uint8)
    layout = R.Layout([np.arange(n - 1) + 0.5 for n in levels])
    g = R.on_grid(rng.normal(size=2000) + x[:, 0] / 10 - x[:, 1], 2.0 ** -30)
    h, node = R.on_grid(rng.uniform(0.1, 1, 2000), 2.0 ** -30), rng.integers(0, 3, 2000)
    assert sorted(map(len, layout.groups)) == [1, 6]  # flags share a code
    hist = R.histograms(x, node, 3, g, h, layout)
    for f, n in enumerate(levels):
        for b in range(n):
            for k in range(3):
                m = (x[:, f] == b) & (node == k)
                assert hist[:, k, layout.starts[f] + b].tolist() == [g[m].sum(), h[m].sum(), m.sum()]
    added, whole = [], R.code_histograms
    monkeypatch.setattr(R, "code_histograms", lambda codes, rows, *rest: added.append(len(rows)) or whole(codes, rows, *rest))
    s, columns = R.TreeSettings(True, min_rows=2), np.ones(len(levels), bool)
    tree = R.grow(x, g, h, s, layout, columns, 5)
    assert len(added) == 5 and added[0] == 2000 and max(added[1:]) <= 1000
    monkeypatch.setattr(R, "CACHE_CELLS", 1)  # a node at a time: every one is added up
    each = R.grow(x, g, h, s, layout, columns, 5)
    for name, _ in R.Tree.DTYPES:
        assert sorted(getattr(tree, name)) == sorted(getattr(each, name))
    assert tree.values(x).tolist() == each.values(x).tolist()
    monkeypatch.setattr(R, "SHALLOW_NODES", 0)
    assert tree.values(x).tolist() == each.values(x).tolist()


def test_a_round_over_blocks_starts_from_the_margins_of_the_round_before(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector
    df = spark.range(300).select("id", array_to_vector(F.array((F.col("id") % 7).cast("double"), (F.col("id") % 5).cast("double"))).alias("features"),
                                 (F.col("id") % 7 + F.col("id") % 3).cast("double").alias("y"))
    t = R.bin_table(df, "y", F.col("id"), F.lit(-1), bins=8)
    seen, grow = [], R._Grower.grow_levels
    monkeypatch.setattr(R._Grower, "grow_levels", lambda self, blocks, *rest: seen.append(blocks) or grow(self, blocks, *rest))
    monkeypatch.setattr(R, "LOCAL_ROWS", 10)
    monkeypatch.setattr(R, "STAGE_ROUNDS", 3)
    R.train(t, [R.Fit(R.TreeSettings(True, trees=5, depth=2))])
    assert ["margin" in b.columns for b in seen] == [False, True, True, True, True]
    assert not any(b.storageLevel.useMemory for b in seen)  # none is left in the cache


def test_stream_keeps_runs_of_readings_not_windows(spark, tmp_path):
    """One station of many runs, some of a few readings, late readings, and one with fewer than a window needs."""
    rows = spark.range(900).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 10 < 8, 1).when(F.col("id") % 100 == 9, 3).otherwise(2).cast("bigint").alias("station_id"),
        F.timestamp_seconds("id").alias("event_time"),
        *[((F.col("id") * (7 + i)) % 11).cast("double").alias(c) for i, c in enumerate(SENSOR_FIELDS)])
    base, n = str(tmp_path), 12
    parts = ST.write_message_files(rows, f"{base}/parts", 3)
    good, _ = ST.sensor_stream(ST.file_source(spark, f"{base}/feed"))
    for _ in ST.arrivals(spark, parts, f"{base}/feed"):
        out = ST.run_windows(good, base, n)
    want = sliding_windows(rows, ["event_id", *SENSOR_FIELDS], ["event_time", "event_id"], "station_id", n, include_current=True).drop("_pos")
    assert out.columns == want.columns
    by = lambda df: sorted(df.collect(), key=lambda r: r.event_id)
    assert by(out) == by(want) and out.count() > 700
    stored = spark.read.parquet(f"{base}/out").agg(F.sum(F.size("run")).alias("n"), F.max(F.size("run")).alias("longest")).first()
    assert stored.n < 1.6 * 900 and stored.longest <= 5 * n  # the windows hold more than 8,000 readings


def readings_of(spark, n=400):
    """Rows with a repeated time, a null station and stations of unlike size."""
    station = F.when(F.col("id") % 29 == 0, None).otherwise(F.when(F.col("id") < n // 2, 1).otherwise(F.col("id") % 7))
    return spark.range(n).select(
        F.col("id").alias("event_id"), station.cast("long").alias("station_id"), F.timestamp_seconds(F.floor(F.col("id") / 2)).alias("event_time"),
        *[((F.col("id") * (7 + i)) % 11).cast("double").alias(c) for i, c in enumerate(SENSOR_FIELDS)],
        ((F.col("id") * 5) % 13).cast("double").alias("yield"))


@pytest.mark.parametrize("current", [False, True])
def test_stored_windows_are_the_sliding_windows(spark, tmp_path, current):
    df, how = readings_of(spark), (["event_id", *SENSOR_FIELDS], ["event_time", "event_id"], "station_id", 5, current)
    want = sliding_windows(df, *how)
    got = stored_windows(df, *how, path=str(tmp_path / "t"))
    assert got.select(*want.columns).schema.simpleString() == want.schema.simpleString()
    order = lambda t: sorted(map(repr, t.select(*want.columns).collect()))
    assert order(got) == order(want) and want.count() > 300
    sizes = want.groupBy("station_id").agg(F.min("_pos").alias("a"), F.max("_pos").alias("b")).collect()
    ends = got.select("station_id", F.col("_first").alias("a"), F.col("_last").alias("b")).distinct().collect()
    assert sorted(map(repr, ends)) == sorted(map(repr, sizes))


@pytest.mark.parametrize("twice", [False, True])
def test_forecast_of_stored_windows_moves_no_window(spark, monkeypatch, twice):
    df, how = readings_of(spark), (["event_id", *SENSOR_FIELDS], ["event_time", "event_id"], "station_id", 5)
    if twice:  # a reading that came twice
        df = df.unionByName(df.where("event_id % 50 = 3"))
    want = {r.metric: r.value for r in T.forecast_sequence(sliding_windows(df, *how), SENSOR_FIELDS).metrics.collect()}
    scored, score = [], T.forecast_predict
    monkeypatch.setattr(T, "forecast_predict", lambda w, res: scored.append(w) or score(w, res))
    monkeypatch.setattr(P, "ensure_parallelism", lambda df: pytest.fail("windows were moved"))
    got = {r.metric: r.value for r in T.forecast_sequence(stored_windows(df, *how), SENSOR_FIELDS).metrics.collect()}
    assert got == pytest.approx(want)
    assert twice or "Join" not in scored[0]._jdf.queryExecution().optimizedPlan().toString()
