"""Whitening against an eigendecomposition of the exact covariance."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from verdant.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return df.withColumns({c: F.lit(c) for c in ("x", "n", "d", "deviation", "whitened", "component", "sums", "ids", "at")})


def expected(vectors):
    x = np.floor(np.array(vectors, np.float32).astype(float) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, v = np.linalg.eigh((c - c.mean(axis=0)).T @ c / n)
    return n, ((n * x - s) ** 2).sum(axis=1), c, e[::-1], v[:, ::-1]


def check(spark, vectors, ids=None, components=32, extra=()):
    ids = ids or list(range(len(vectors)))
    rows = [(i, [float(c) for c in v]) for i, v in zip(ids, vectors)] + list(extra)
    out = whitening.whiten(table(spark, rows).repartition(3), components=components).collect()
    n, deviation, c, e, v = expected(vectors)
    rank = int((e > 1e-9 * e.sum()).sum())
    assert len(out) == n * min(components, rank)
    place = {i: k for k, i in enumerate(ids)}
    signs = {}
    for r in out:
        k, m = place[r.vec_id], r.component - 1
        want = c[k] @ v[:, m] / np.sqrt(e[m])
        if abs(want) > 1e-3:
            signs.setdefault(m, np.sign(want * r.whitened))
        assert abs(signs.get(m, 1) * r.whitened - want) < 1e-6 * max(1, abs(want))
        assert r.n == n and r.deviation == deviation[k]
        assert abs(r.explained - e[m] / e.sum()) < 1e-9
        assert r.identity_error < 1e-8
    assert {r.component for r in out} == set(range(1, min(components, rank) + 1))


def test_equals_the_eigendecomposition(spark):
    rng = np.random.default_rng(1)
    check(spark, rng.normal(size=(700, 36)) * rng.uniform(0.1, 1, 36) + 5)


def test_few_dimensions_and_few_rows(spark):
    rng = np.random.default_rng(2)
    check(spark, rng.normal(size=(50, 5)))
    check(spark, rng.normal(size=(4, 9)))        # rank 3
    check(spark, [[0.0], [1.0], [2.0]])
    check(spark, rng.normal(size=(300, 8)), components=3)


def test_deficient_rank(spark):
    rng = np.random.default_rng(3)
    flat = np.round(rng.normal(size=(200, 3)), 1)
    check(spark, np.column_stack([flat, flat[:, :1] * 0 + 7, flat[:, :2], flat]))


def test_equal_variances(spark):
    """Four points on each axis: one variance for every component, of which any rotation is right."""
    vectors = np.vstack([np.eye(6), -np.eye(6)]).tolist()
    out = whitening.whiten(table(spark, list(enumerate(vectors)))).collect()
    assert len(out) == 12 * 6 and all(r.identity_error < 1e-8 and abs(r.explained - 1 / 6) < 1e-9 for r in out)


def test_unusable_rows_repeats_and_null_ids(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(60, 6))
    extra = [(900, None), (901, [1.0] * 5 + [None]), (902, [1.0] * 5 + [float("nan")]), (903, [float("inf")] + [0.0] * 5),
             (904, [0.5] * 3), (905, []), (906, [3e38] + [0.0] * 5)]
    check(spark, vectors, extra=extra)
    rows = [(7, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [3.0, 1.0]), (None, [0.0, 5.5])]
    out = whitening.whiten(table(spark, rows)).collect()
    assert len(out) == 8 and sorted(str(r.vec_id) for r in out) == ["7"] * 4 + ["None"] * 4


def test_no_variance_gives_no_rows(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        out = whitening.whiten(table(spark, rows))
        assert out.collect() == [] and out.columns[:3] == ["vec_id", "component", "n"]


def test_large_entries_stay_exact(spark):
    vectors = [[float(2 ** 44 + 2 ** 24 * i), float(i)] for i in range(9)]
    out = whitening.whiten(table(spark, [(i, v) for i, v in enumerate(vectors)])).collect()
    x = [[int(c * 64) + 1_000_000 for c in v] for v in vectors]
    s = [sum(r[j] for r in x) for j in (0, 1)]
    want = {i: sum((9 * r[j] - s[j]) ** 2 for j in (0, 1)) for i, r in enumerate(x)}
    assert {r.vec_id: r.deviation for r in out} == {i: d if d < 2 ** 63 else None for i, d in want.items()}


@pytest.mark.parametrize("components", [1, 6])
def test_steps_end_when_the_wanted_values_settle(spark, components):
    """With a steep spectrum fewer steps than dimensions are needed."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(400, 60)) * (0.5 ** np.arange(60) * 300 + 0.01)
    blocks = whitening.stage_blocks(table(spark, [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]))
    fit = whitening.bidiagonalise(blocks, components)
    assert fit.steps <= 60 and (components > 1 or fit.steps < 40)
    _, _, _, e, _ = expected(vectors)
    assert np.allclose(fit.variances, e[:len(fit.variances)], rtol=1e-9, atol=1e-12 * e[0])
