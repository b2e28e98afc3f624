"""Structured Streaming properties: stream = batch, restart-safe, dead letters, late rows, exact flushes."""

import os
import tempfile

from pyspark.sql import functions as F

from verdant.plans.sensors import readings
from verdant.streaming import sensor as ST

SF = "/root/testdata/sf0.001"


def _dir(name):
    return tempfile.mkdtemp(prefix=f"verdant-{name}-")


def _feed(spark, rows, base, n):
    parts = ST.write_message_files(rows, os.path.join(base, "parts"), n)
    good, _ = ST.sensor_stream(ST.file_source(spark, os.path.join(base, "feed")))
    return good, ST.arrivals(spark, parts, os.path.join(base, "feed"))


def test_ingest_equals_batch_and_restart_adds_nothing(spark):
    base = _dir("ingest")
    src = readings(spark, SF)
    good, arrivals = _feed(spark, src, base, 4)
    pipe, ck = ST.SensorIngest(spark, base), os.path.join(base, "ck")
    for _ in arrivals:
        ST.run_ingest(good, pipe, ck)
    hist = ST.history_view(spark, pipe.history)
    assert hist.count() == src.count()
    assert hist.exceptAll(src).count() == 0 and src.exceptAll(hist).count() == 0
    log = pipe.log().orderBy("batch_id").collect()
    assert [r[0] for r in log] == [0, 1, 2, 3] and log[-1][2] == src.count()
    # a restart from the checkpoint with no new files processes nothing new
    again = ST.SensorIngest(spark, base)
    ST.run_ingest(good, again, ck)
    assert ST.history_view(spark, pipe.history).count() == src.count() and again.log().orderBy("batch_id").collect() == log


def test_replayed_batch_counts_once(spark):
    base = _dir("replay")
    rows = readings(spark, SF).where("event_id < 60")
    pipe = ST.SensorIngest(spark, base, initial=readings(spark, SF).where("event_id >= 60 and event_id < 80"))
    pipe(rows, 0)
    pipe(rows, 0)
    n = rows.count()
    assert [tuple(r)[1:3] for r in pipe.log().collect()] == [(n, n + pipe.initial_rows)]


def test_initial_history_trains_at_start_and_the_last_model_is_saved(spark):
    base, seen, saved = _dir("initial"), [], []
    initial = readings(spark, SF).where("event_id < 200")
    pipe = ST.SensorIngest(spark, base, train=lambda h: seen.append(h.count()) or len(seen), snapshot_every=5, length=30,
                           save=lambda m, path: saved.append((m, os.path.basename(path))), initial=initial)
    assert seen == [initial.count()] and pipe.model == 1
    pipe(readings(spark, SF).where("event_id >= 200 and event_id < 900"), 1)
    assert pipe.log().orderBy(F.desc("batch_id")).first()["retrained"] and seen[-1] == readings(spark, SF).where("event_id < 900").count() and saved == []
    pipe.close()
    assert saved == [(2, "v=1")]


def test_kafka_waits_for_a_least_number_and_takes_all():
    options = ST.kafka_options("host:9092", "readings")
    assert options["minOffsetsPerTrigger"] == "100" and "maxTriggerDelay" in options
    assert not any(k.startswith("maxOffsets") for k in options)


def test_poison_messages_go_to_dead_letter(spark):
    base = _dir("poison")
    feed = os.path.join(base, "feed")
    os.makedirs(feed)
    with open(os.path.join(feed, "a.json"), "w") as f:
        f.write('{"event_id": 1, "station_id": 2, "event_time": "2024-01-01T00:00:00.000000", "temperature": 20.5}\n')
        f.write("{bad\n")
        f.write('{"event_id": "x", "station_id": 3}\n')  # wrong-typed field -> null field, row kept
        f.write('{"event_id": 4, "station_id": 5, "extra": 1}\n')  # extra field ignored
        f.write('{"event_id": 6} junk\n5\nnull\n[1]\n{"event_id": 7}{"event_id": 8}\n{"event_id": 9},{"event_id": 9}\n{"event_id": 9}] x\n')
    good, bad = ST.sensor_stream(ST.file_source(spark, feed))
    g = ST.run_to_table(good, os.path.join(base, "g"), os.path.join(base, "ckg"))
    b = ST.run_to_table(bad, os.path.join(base, "b"), os.path.join(base, "ckb"))
    assert sorted(r.station_id for r in g.collect()) == [2, 3, 5]
    assert sorted(r._corrupt_record for r in b.collect()) == sorted([
        "{bad", '{"event_id": 6} junk', "5", "null", "[1]", '{"event_id": 7}{"event_id": 8}', '{"event_id": 9},{"event_id": 9}', '{"event_id": 9}] x'])
    assert g.filter(F.col("station_id") == 2).first().temperature == 20.5


def test_late_rows_reach_the_history_and_their_windows(spark):
    base = _dir("late")
    src = readings(spark, SF).filter(F.col("station_id") == 7)
    pipe = ST.SensorIngest(spark, base)
    windows = ST.BatchWindows(spark, base, 2)
    late = src.withColumn("event_time", F.col("event_time") - F.expr("INTERVAL 60 DAYS")).withColumn("event_id", F.col("event_id") + 1_000_000)
    for k, rows in enumerate((src, late)):
        pipe(rows, k)
        assert windows(rows, k).count() == src.count() - 1
        assert windows(rows, k).count() == src.count() - 1  # a replay starts from the same rows
    assert ST.history_view(spark, pipe.history).count() == 2 * src.count()


def test_count_trigger_flushes_exactly(spark):
    base = _dir("count")
    src = readings(spark, SF).withColumn("shard", F.lit(0).cast("bigint")).drop("station_id")
    n = src.count()
    good, arrivals = _feed(spark, readings(spark, SF), base, 3)
    sh = good.withColumn("shard", F.lit(0).cast("bigint")).drop("station_id")
    for _ in arrivals:
        out = ST.run_to_table(ST.count_trigger(sh, "shard", 100), os.path.join(base, "o"), os.path.join(base, "ck"))
    assert out.count() == (n // 100) * 100
    sizes = [r["count"] for r in out.groupBy("flush").count().collect()]
    assert set(sizes) == {100}


def test_count_trigger_numbers_rows_without_python_state(spark):
    rows = [(None if k == "x" else int(k), i) for i, k in enumerate("0" * 25 + "1" * 9 + "x" * 11)]
    base, fired = _dir("rest"), []
    trigger = ST.count_trigger(spark.createDataFrame(rows, "key long, event_id long"), "key", 10)
    out, left = os.path.join(base, "o"), os.path.join(base, "l")
    for batch_id, part in enumerate([rows[::2], rows[1::2]]):
        for _ in range(2):  # a replay counts once
            trigger.write(spark.createDataFrame(part, "key long, event_id long"), batch_id, out, left)
    for r in spark.read.parquet(out).groupBy("key", "flush").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("d")).collect():
        fired.append((r.key, r.flush, r.n, r.d))
    assert sorted(fired, key=str) == [(0, 0, 10, 10), (0, 1, 10, 10), (None, 0, 10, 10)]
    assert spark.read.parquet(os.path.join(left, "rows", "v=1")).count() == 5 + 9 + 1


def test_retrain_rule():
    assert not ST.retrain_due(130, 10, False)
    assert ST.retrain_due(131, 10, False)
    assert not ST.retrain_due(1000, 500, True)
    assert ST.retrain_due(1000, 501, True)


def test_ingest_resumes_from_latest_model_version(spark):
    from verdant.functions.domain import SENSOR_FIELDS
    from verdant.ml import train as T
    from verdant.operators.windows import sliding_windows
    base = _dir("resume")
    hist = readings(spark, "/root/testdata/sf0.01").withColumn("yield", F.col("temperature"))
    w = sliding_windows(hist, ["event_id", *SENSOR_FIELDS], ["event_time", "event_id"], "station_id", 5)
    res = T.forecast_sequence(w, SENSOR_FIELDS, "yield")
    T.save_forecaster(res, os.path.join(base, "models", "v=3"))
    T.save_forecaster(res, os.path.join(base, "models", "v=12"))
    pipe = ST.SensorIngest(spark, base, load=lambda p: (p, T.load_forecaster(spark, p)))
    path, loaded = pipe.model
    assert path.endswith("v=12") and loaded.extra["stats"] == {k: tuple(v) for k, v in res.extra["stats"].items()}
    a = T.forecast_predict(w.orderBy("event_id").limit(20), res).select("event_id", "prediction").orderBy("event_id").collect()
    b = T.forecast_predict(w.orderBy("event_id").limit(20), loaded).select("event_id", "prediction").orderBy("event_id").collect()
    assert [r.prediction for r in a] == [r.prediction for r in b]


def test_compaction_and_replay_leave_the_same_history(spark):
    base, src = _dir("compact"), readings(spark, SF)
    batches = [src.where(F.col("event_id") % 7 == i) for i in range(7)]
    pipe = ST.SensorIngest(spark, base, compact_every=3)
    for i, batch in enumerate(batches):
        pipe(batch, i)
        pipe(batch, i)  # replayed, also after the compaction of batches 2 and 5
        seen = src.where(F.col("event_id") % 7 <= i)
        assert ST.history_view(spark, pipe.history).exceptAll(seen).isEmpty()
        assert ST.history_view(spark, pipe.history).count() == seen.count()
    assert ST.complete_versions(spark, pipe.history + "_whole") == [2, 5]
    left = {n for n in os.listdir(pipe.history) if n.startswith("batch_id=")}
    assert left == {"batch_id=3", "batch_id=4", "batch_id=5", "batch_id=6"}  # 0 to 2 went with the second compaction
    # a table that was not written to its end, and an entry that was not, do not count
    os.makedirs(os.path.join(pipe.history + "_whole", "v=6"))
    os.makedirs(os.path.join(pipe.manifest, "v=7"))
    assert ST.history_view(spark, pipe.history).count() == src.count()
    log = pipe.log().orderBy("batch_id").collect()
    assert [r.batch_id for r in log] == list(range(7)) and log[-1].history_rows == src.count()
    assert [r.rows for r in log] == [b.count() for b in batches]
    again = ST.SensorIngest(spark, base)
    again(src.limit(0), 7)
    assert again.log().where("batch_id = 7").first().history_rows == src.count()


def test_old_versions_go_but_not_those_a_replay_needs(spark):
    base, src = _dir("versions"), readings(spark, SF)
    windows = ST.BatchWindows(spark, base, 5)
    first = {}
    for i in range(5):
        batch = src.where(F.col("event_id") % 5 == i)
        first[i] = windows(batch, i).count()
        assert windows(batch, i).count() == first[i]
        assert ST.complete_versions(spark, windows.tails) == list(range(max(0, i - 1), i + 1))
