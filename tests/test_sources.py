"""Sources and sinks: round trips on small folders."""

import os
import tempfile

from pyspark.sql import functions as F

from verdant.sources import files as FS
from verdant.sources import tables as TB


def _dir(name):
    return tempfile.mkdtemp(prefix=f"verdant-{name}-")


def _csv(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_read_table_and_write_csv_round_trip(spark):
    d = _dir("csv")
    df = spark.createDataFrame([(1, "a", 2.5), (2, "b", None)], "id int, s string, x double")
    TB.write_csv(df, os.path.join(d, "out"))
    back = TB.read_table(spark, os.path.join(d, "out"))
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a", 2.5), (2, "b", None)]
    assert dict(back.dtypes)["x"] == "double"


def test_read_dir_skips_and_names_by_stem(spark):
    d = _dir("dir")
    _csv(os.path.join(d, "alpha.csv"), "a,b\n1,2\n")
    _csv(os.path.join(d, "beta.csv"), "c\nx\n")
    _csv(os.path.join(d, "notes.txt"), "ignored")
    tables = TB.read_dir(spark, d)
    assert sorted(tables) == ["alpha", "beta"]
    empty = _dir("empty")
    try:
        TB.read_dir(spark, empty)
        raise AssertionError("expected FileNotFoundError")
    except FileNotFoundError:
        pass


def test_read_dir_reads_a_folder_of_part_files_as_one_table(spark):
    d = _dir("parts")
    spark.range(100).repartition(4).write.option("header", True).csv(os.path.join(d, "alpha.csv"))
    _csv(os.path.join(d, "beta.csv"), "c\nx\n")
    assert {n: t.count() for n, t in TB.read_dir(spark, d).items()} == {"alpha": 100, "beta": 1}


def test_directory_queries_write_in_parallel(spark, monkeypatch):
    from pyspark.sql import DataFrame
    from verdant.plans import files
    one = []
    for cls in {DataFrame, type(spark.range(0))}:
        monkeypatch.setattr(cls, "coalesce", lambda self, n: one.append(n) or self)
    files.q_read_dir(spark, "/root/testdata/sf0.001")
    files.q_read_dir_concat(spark, "/root/testdata/sf0.001")
    assert not one


def test_read_dir_concat_aligns_headers_and_sorts(spark):
    d = _dir("concat")
    _csv(os.path.join(d, "a.csv"), "timestamp,temperature\n2024-01-02 00:00:00,1.5\n")
    _csv(os.path.join(d, "b.csv"), "humidity,timestamp\n40,2024-01-01 00:00:00\n")
    df = TB.read_dir_concat(spark, d)
    rows = df.collect()
    assert [r.humidity for r in rows] == [40, None] and [r.temperature for r in rows] == [None, 1.5]
    assert dict(df.dtypes)["timestamp"] == "timestamp"


def test_read_or_default(spark):
    fallback = lambda: spark.createDataFrame([(0,)], "z int")
    assert TB.read_or_default(spark, "/no/such/path.csv", fallback).columns == ["z"]
    d = _dir("rod")
    _csv(os.path.join(d, "t.csv"), "q\n1\n")
    assert TB.read_or_default(spark, os.path.join(d, "t.csv"), fallback).columns == ["q"]


def test_snapshot_append_only(spark):
    d = os.path.join(_dir("snap"), "hist")
    df = spark.createDataFrame([(1,)], "v int")
    TB.write_snapshot(df, d, "20250101_000000")
    TB.write_snapshot(df, d, "20250102_000000")
    TB.write_snapshot(df, d, "20250102_000000")  # a retry overwrites only its own snapshot
    out = spark.read.parquet(d)
    assert sorted(r.snapshot_ts for r in out.collect()) == ["20250101_000000", "20250102_000000"]


def test_metadata_and_copy_first(spark):
    d = _dir("meta")
    TB.save_metadata(spark, os.path.join(d, "m"), "Crop_Impact", "regression", {"n_estimators": 100, "gamma": None})
    m = spark.read.json(os.path.join(d, "m")).first()
    assert m.target_column == "Crop_Impact" and m.params["n_estimators"] == "100"
    src = _dir("src")
    _csv(os.path.join(src, "b.csv"), "k\n2\n")
    _csv(os.path.join(src, "a.csv"), "k\n1\n")
    dst = os.path.join(d, "std")
    TB.copy_first_csv(spark, src, dst)
    TB.copy_first_csv(spark, src, dst)  # an existing output is kept
    assert [r.k for r in TB.read_table(spark, dst).collect()] == [1]


def test_image_folder_labels_without_reading_bytes(spark):
    d = _dir("img")
    for split, cls, name in [("train", "healthy", "a.jpg"), ("train", "rust", "b.PNG"), ("val", "rust", "c.tif"),
                             ("train", "rust", "skip.txt")]:
        os.makedirs(os.path.join(d, split, cls), exist_ok=True)
        with open(os.path.join(d, split, cls, name), "wb") as f:
            f.write(b"x" * 10)
    df = FS.image_folder(spark, d)
    rows = sorted((r.split, r.label, r.class_index, r.length) for r in df.collect())
    assert rows == [("train", "healthy", 0, 10), ("train", "rust", 1, 10), ("val", "rust", 1, 10)]
    assert "content" not in df.columns
    assert FS.dir_size(df).first().total_bytes == 30
