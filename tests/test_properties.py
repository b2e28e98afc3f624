"""Property tests of the distributed operators against brute force on small fixtures."""

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from verdant.ml import features as M
from verdant.operators import joins as J
from verdant.operators import stats as S
from verdant.operators import windows as W
from verdant.sources import files as FS

SETTINGS = dict(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 1000)), min_size=1, max_size=60, unique_by=lambda t: t[1]),
       st.integers(1, 7))
def test_dense_index_matches_row_number(spark, rows, parts):
    # group 0 is hot: it holds most rows
    df = spark.createDataFrame(rows, "g int, k int")
    out = W.dense_index(df, ["k"], ["g"], name="ix", num_partitions=parts).toPandas()
    ref = pd.DataFrame(rows, columns=["g", "k"])
    ref["ix"] = ref.groupby("g")["k"].rank(method="first").astype(int) - 1
    m = out.merge(ref, on=["g", "k"], suffixes=("", "_ref"))
    assert len(m) == len(rows) and (m.ix == m.ix_ref).all()


@settings(**SETTINGS)
@given(st.lists(st.integers(0, 2), min_size=0, max_size=50), st.integers(2, 6), st.integers(1, 9))
def test_sliding_windows_with_chunks(spark, stations, length, chunk):
    rows = [(i, s, float(i)) for i, s in enumerate(stations)]
    df = spark.createDataFrame(rows, "event_id long, station_id int, v double")
    for include_current in (False, True):
        out = W.sliding_windows(df, ["event_id"], ["event_id"], "station_id", length,
                                include_current=include_current, chunk_rows=max(chunk, length + 1))
        got = {r.event_id: [x.event_id for x in r.window] for r in out.collect()}
        want = {}
        for s in set(stations):
            ids = [i for i, t in enumerate(stations) if t == s]
            for p, i in enumerate(ids):
                lo, hi = (p - length + 1, p + 1) if include_current else (p - length, p)
                if lo >= 0:
                    want[i] = ids[lo:hi]
        assert got == want


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 3)), max_size=15),
       st.lists(st.tuples(st.sampled_from(["a", "c", None]), st.integers(0, 3)), max_size=15))
def test_merge_common_matches_brute_force(spark, left, right):
    ldf = spark.createDataFrame(left, "k string, x int")
    rdf = spark.createDataFrame(right, "k string, y int")
    got = sorted((tuple(r) for r in J.merge_common(ldf, rdf, ["k"]).select("k", "x", "y").collect()), key=str)
    want = []  # pandas outer merge: null keys match each other
    for k, x in left:
        ys = [y for k2, y in right if k2 == k]
        want += [(k, x, y) for y in ys] or [(k, x, None)]
    want += [(k, None, y) for k, y in right if k not in {k1 for k1, _ in left}]
    assert got == sorted(want, key=str)


def _outer_merge(left, right):
    want = []
    for k, x in left:
        ys = [y for k2, y in right if k2 == k]
        want += [(k, x, y) for y in ys] or [(k, x, None)]
    return sorted(want + [(k, None, y) for k, y in right if k not in {k1 for k1, _ in left}], key=str)


@settings(**SETTINGS)
@given(st.lists(st.sampled_from([0.0, -0.0, 1.5, 2.0, None]), max_size=25),
       st.lists(st.sampled_from([0.0, 1.5, 3.0, None]), max_size=25), st.integers(2, 9))
def test_merge_common_with_heavy_keys(spark, left, right, parts):
    """Pieces of few rows, so that most keys are heavy on one side or both; -0.0 is the key 0.0."""
    left, right = [(k, i) for i, k in enumerate(left)], [(k, i) for i, k in enumerate(right)]
    ldf = spark.createDataFrame(left, "k double, x int")
    rdf = spark.createDataFrame(right, "k double, y int")
    out = J.merge_common(ldf, rdf, ["k"], parts=parts, least=1)
    assert out.columns == ["k", "x", "y"]
    assert sorted(((k if k is None else k + 0.0, x, y) for k, x, y in out.collect()), key=str) == _outer_merge(
        [(k if k is None else k + 0.0, x) for k, x in left], right)


def test_merge_common_spreads_a_key_with_a_third_of_both_sides(spark):
    """The null key and one value are heavy on both sides; another on the left only. Two keys of unlike types,
    columns named as the plan's own."""
    left = spark.range(600).selectExpr("id a", "case when id % 3 = 0 then null when id % 3 = 1 then 'h' else 'k' || id end s",
                                       "cast(7 as int) n", "id a_own")
    right = spark.range(300).selectExpr("id b", "case when id % 3 = 0 then null when id % 3 = 1 then 'h' else 'q' || id end s",
                                        "cast(7 as bigint) n", "id b_across")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = J.merge_common(left, right, ["s", "n"], parts=16, least=1)
        assert out.columns == ["a", "s", "n", "a_own", "b", "b_across"]
        rows = out.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(rows) == 2 * 200 * 100 + 200 + 100
    for key in (None, "h"):
        mine = [r for r in rows if r.s == key]
        assert len({(r.a, r.b) for r in mine}) == len(mine) == 200 * 100
        by_task = pd.Series([r.task for r in mine]).value_counts()
        assert len(by_task) == 8 and by_task.max() < len(mine) / 3


@pytest.mark.parametrize("n_left,n_right", [(7, 3), (3, 3), (2, 5), (4, 0)])
def test_merge_positional_wraps(spark, n_left, n_right):
    left = spark.createDataFrame([(i, i * 10) for i in range(n_left)], "id int, a int")
    right = spark.createDataFrame([(j, j * 100) for j in range(n_right)], "rid int, b int")
    out = {r.id: r.b for r in J.merge_positional(left, right, "id", "rid", drop_common=False).collect()}
    assert len(out) == n_left
    for i, b in out.items():
        assert b == ((i % n_right) * 100 if n_right else None)


@settings(**SETTINGS)
@given(st.lists(st.integers(1, 50), min_size=0, max_size=40), st.integers(0, 200))
def test_greedy_sample_matches_brute_force(spark, sizes, cap):
    rows = [(i, s) for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, length long")
    got = sorted(r.doc_id for r in FS.sample_by_size(df, "doc_id", cap, 42, greedy=True).collect())
    keyed = FS.with_shuffle_key(df, "doc_id", 42).orderBy("_sk", "doc_id").collect()
    total, want = 0, []
    for r in keyed:
        if total + r.length <= cap:
            total += r.length
            want.append(r.doc_id)
    assert got == sorted(want)
    assert sum(sizes[i] for i in got) <= cap


@pytest.mark.parametrize("few", [0, 40])
@pytest.mark.parametrize("cap", [-1, 0, 1, 37, 1000, 4096, 10 ** 9])
def test_greedy_sample_by_bands(spark, monkeypatch, few, cap):
    """Many misfits, empty files, a null length; whole on the cluster, and ended on the driver."""
    monkeypatch.setattr(FS, "FEW_FILES", few)
    rng = random.Random(cap)
    sizes = [rng.choice([0, 1, 2, 3, 15, 16, 17, 255, 256, 700, 5000]) for _ in range(120)] + [None]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long").repartition(5)
    got = {r.doc_id for r in FS.sample_by_size(df, "doc_id", cap).collect()}
    room, want = cap, set()
    for r in FS.with_shuffle_key(df, "doc_id", 42).orderBy("_sk", "doc_id").collect():
        if (r.length or 0) <= room:
            room -= r.length or 0
            want.add(r.doc_id)
    assert got == want


def test_positions_with_null_groups_ties_and_no_rows(spark):
    rows = [(i % 3 or None, i // 2, i) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, t int, id int").repartition(7)
    for n in (1, 2, 5, 16):
        out = W.dense_index(df, ["t", "id"], ["g"], name="at", num_partitions=n, with_group_size=True).collect()
        for g in (None, 1, 2):
            mine = sorted((r.at, r.id, r.at_group_size) for r in out if r.g == g)
            ids = sorted(i for x, _, i in rows if x == g)
            assert mine == [(p, i, len(ids)) for p, i in enumerate(ids)]
        tied = W.dense_index(df, ["t"], name="at", num_partitions=n).collect()
        assert sorted(r.at for r in tied) == list(range(400))
        assert [r.t for r in sorted(tied, key=lambda r: r.at)] == sorted(t for _, t, _ in rows)
        total = W.running_total(df, "g", ["t", "id"], num_partitions=n).orderBy("id").collect()
        assert [r.running_total or 0 for r in total] == list(np.cumsum([g or 0 for g, _, _ in rows]))
    assert W.dense_index(df.limit(0), ["id"], ["g"]).collect() == []


def test_positional_merge_with_an_empty_right_side(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "x int, k string")
    right = spark.createDataFrame([], "y int")
    got = J.merge_positional(left, right, "x", "y").orderBy("x").collect()
    assert [tuple(r) for r in got] == [(1, "a", None), (2, "b", None)]


def test_bootstrap_mean_matches_brute_force(spark):
    """A null category, null measures, a category without a value, one row; in any layout."""
    rows = [(i, None if i % 7 == 0 else f"c{i % 3}", None if i % 5 == 0 else float(i * i % 91)) for i in range(120)]
    rows += [(900, "none", None), (901, "one", 5.0)]
    df = spark.createDataFrame(rows, "id long, c string, v double")
    out = {r.c: r for r in S.bootstrap_mean(df.repartition(5), "c", "v", "id", replicates=37).collect()}
    assert set(out) == {"c0", "c1", "c2", None, "none", "one"}
    pmf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
    for c, r in out.items():
        mine = [(i, v) for i, d, v in rows if d == c and v is not None]
        means = []
        for rep in range(37):
            block, j = divmod(rep, 8)
            w = []
            for i, _ in mine:
                draw = int(hashlib.md5(f"42:{block}:{i}".encode()).hexdigest()[4 * j:4 * j + 4], 16)
                w.append(sum(draw >= round(x * 65536) for x in pmf[:8]))
            if sum(w):
                means.append(sum(a * v for a, (_, v) in zip(w, mine)) / sum(w))
        assert r.n == len(mine)
        if mine:
            assert np.allclose([r.ci_low, r.ci_high], np.quantile(means, [0.025, 0.975]))
            assert np.isclose(r.mean, np.mean([v for _, v in mine]))
        else:
            assert (r.mean, r.ci_low, r.ci_high) == (None, None, None)


def test_bootstrap_interval_is_near_the_normal_one(spark):
    df = spark.range(4000).selectExpr("id", "'a' c", "cast(id % 100 as double) v")
    got, normal = S.bootstrap_mean(df, "c", "v", "id").first(), S.mean_by(df, "c", "v").first()
    assert abs(got.ci_low - normal.ci_low) < 0.15 and abs(got.ci_high - normal.ci_high) < 0.15


def test_split_stable_under_repartition(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    a = {r.k: r.split for r in M.train_test_split(df, "k").collect()}
    b = {r.k: r.split for r in M.train_test_split(df.repartition(7), "k").collect()}
    assert a == b
    frac = sum(v == "test" for v in a.values()) / len(a)
    assert 0.15 < frac < 0.25


def test_minmax_inverse_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (2.0, 5.0)], "x double, c double")
    stats = M.fit_minmax(df, ["x", "c"])
    out = M.apply_minmax(df, stats).withColumn("back", M.minmax_inverse("x", stats)).collect()
    assert [r.c for r in out] == [0.0, 0.0, 0.0]  # constant -> 0 (MLlib would give 0.5)
    assert sorted(r.back for r in out) == pytest.approx([1.0, 2.0, 3.0])


def test_standard_scale_population_sigma(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    stats = M.fit_standard(df, ["x"])
    assert stats["x"][1] == pytest.approx(np.std([1, 2, 3, 10]))


@settings(**SETTINGS)
@given(st.lists(st.floats(-100, 100, allow_nan=False), min_size=1, max_size=30))
def test_exact_quantiles_match_numpy(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = {r.prob: r.quantile for r in S.exact_quantiles(df, ["x"], [0.25, 0.5, 0.75]).collect()}
    for p in (0.25, 0.5, 0.75):
        assert got[p] == pytest.approx(float(np.percentile(xs, p * 100)), abs=1e-9)


def test_median_is_exact_not_lower(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert S.exact_quantiles(df, ["x"], [0.5]).first().quantile == 2.5


def test_stratified_folds_balanced(spark):
    rnd = random.Random(3)
    rows = [(i, "hot" if rnd.random() < 0.6 else "cold") for i in range(400)]
    df = spark.createDataFrame(rows, "k long, label string")
    out = M.stratified_kfold(df, "k", "label", 5).groupBy("label", "fold").count().collect()
    by = {}
    for r in out:
        by.setdefault(r.label, []).append(r["count"])
    for counts in by.values():
        assert max(counts) - min(counts) <= 1


def test_hot_group_is_spread_over_partitions(spark):
    # one station holds a third of the rows: its positions must come from several tasks
    rows = [(i, 0 if i % 3 == 0 else 1 + i % 50) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, station_id int")
    out = W.dense_index(df, ["event_id"], ["station_id"], name="pos", num_partitions=8)
    hot = out.filter(F.col("station_id") == 0).withColumn("pid", F.spark_partition_id())
    assert hot.select("pid").distinct().count() >= 2
    got = sorted((r.event_id, r.pos) for r in hot.collect())
    assert [p for _, p in got] == list(range(1000))


@pytest.mark.parametrize("few", [5_000, 20, 1])
def test_order_statistics_by_brackets(spark, monkeypatch, few):
    """Runs of equal values, infinities and rounds of narrowing: every rank as in a full sort."""
    import random
    monkeypatch.setattr(S, "COLLECTED_VALUES", few)
    monkeypatch.setattr(S, "SKETCH_ACCURACY", 50)
    rng = random.Random(few)
    x = [7.0] * 1500 + [rng.gauss(0, 1) for _ in range(1200)] + [float("inf")] * 5 + [float("-inf")] * 3 + [-0.5] * 700
    y = [float(rng.randrange(6)) for _ in range(len(x) - 40)] + [None] * 20 + [float("nan")] * 20
    rng.shuffle(x)
    rng.shuffle(y)
    df = spark.createDataFrame(list(zip(x, y)), "x double, `y.z` double").repartition(5)
    for c, values in (("x", sorted(x)), ("y.z", sorted(v for v in y if v is not None and v == v))):
        ranks = sorted({0, 1, 2, 3, 700, 1200, 1899, 1900, len(values) // 2, len(values) - 7, len(values) - 1})
        got = S.order_statistics(df, {c: ranks}, {c: len(values)})
        assert got == {(c, r): values[r] for r in ranks}


def test_quantiles_of_empty_and_all_null_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 4.0)], "a double, b double")
    assert [tuple(r) for r in S.exact_quantiles(df, ["a", "b"], [0.5]).collect()] == [("b", 0.5, 2.5)]
    assert S.exact_quantiles(df.limit(0), ["a", "b"], [0.5]).collect() == []
