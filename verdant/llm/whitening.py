"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of their centred rows."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from verdant.llm.common import staged

# How an entry becomes a whole number, and the components returned.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32

BLOCK_ROWS = 1024             # vectors of one stored block
ENTRY_LIMIT = float(2 ** 52)  # entries of this size and more have no exact whole number
SEED = 12

BLOCKS = "d int, n long, ids array<long>, x binary, sums array<long>"


@dataclass
class Fit:
    """What the bidiagonalisation finds: components (columns), variances, and the exact sums of the fit list."""

    n: int
    base: np.ndarray       # whole part of the means
    rest: np.ndarray       # sums minus n times the whole part, Python integers
    components: np.ndarray
    variances: np.ndarray
    trace: float
    steps: int

    def centre(self) -> np.ndarray:
        """The means less their whole part."""
        return np.array([float(Decimal(int(r)) / Decimal(self.n)) for r in self.rest])


def whole_numbers(rows: DataFrame, vector: str) -> DataFrame:
    """(vec_id, x) of the usable rows: x = floor(64 c) + 1000000 as longs."""
    entries = F.transform(F.col(vector), lambda c: c.cast("double"))
    usable = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(
        entries, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) * SCALE < ENTRY_LIMIT), F.lit(False)))
    return rows.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(
        entries, lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def _blocks(batches):
    """Vectors of one length, BLOCK_ROWS at a time, as one binary matrix with its ids and column sums."""
    for batch in batches:
        lists = batch.column("x")
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(sizes):
            part = batch.filter(pa.array(sizes == d))
            for at in range(0, part.num_rows, BLOCK_ROWS):
                piece = part.slice(at, BLOCK_ROWS)
                x = piece.column("x").flatten().to_numpy().astype(np.int64).reshape(-1, d)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(d)], pa.int32()), pa.array([len(x)], pa.int64()),
                     pa.array([piece.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                     pa.array([x.tobytes()], pa.binary()), pa.array([x.sum(axis=0)], pa.list_(pa.int64()))],
                    ["d", "n", "ids", "x", "sums"])


def stage_blocks(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The usable vectors of the greatest length, in blocks, written to the shared folder."""
    blocks = staged(whole_numbers(rows, vector).mapInArrow(_blocks, BLOCKS), "vector-blocks")
    longest = blocks.agg(F.max("d")).first()[0]
    return blocks.where(F.col("d") == F.lit(longest or 0))


def _sums(blocks: DataFrame, fn) -> dict[int, float]:
    """The sums over all blocks of the numbers that ``fn`` (matrix of whole numbers -> array) makes of each.

    A task adds its blocks up; of each task one row a number goes through the shuffle.
    """
    def run(batches):
        total = None
        for batch in batches:
            for d, raw in zip(batch.column("d").to_pylist(), batch.column("x").to_pylist()):
                part = fn(np.frombuffer(raw, np.int64).reshape(-1, d))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())],
                                             ["at", "value"])

    parts = blocks.select("d", "x").mapInArrow(run, "at int, value double")
    return {r["at"]: r["value"] for r in parts.groupBy("at").agg(F.sum("value").alias("value")).collect()}


def _vector(sums: dict[int, float], n: int) -> np.ndarray:
    return np.array([sums.get(i, 0.0) for i in range(n)])


def _orthogonal(w: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``w`` without its part along the columns of ``basis``; twice, so that rounding leaves none."""
    for _ in range(2):
        w = w - basis @ (basis.T @ w)
    return w


def bidiagonalise(blocks: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Components and variances of the vectors in ``blocks``; None without vectors.

    Step k makes u = Xv - beta u' and then X'u of the centred rows X, both in one pass over the blocks. The
    left vectors are kept as combinations p of the rows (u = Xp), so a pass forms all of them row by row and
    the new one is made orthogonal to every one before it; the right vectors, as long as a row, are made
    orthogonal on the driver. The small bidiagonal matrix has the singular values of X. Where a vector
    vanishes a fresh one continues, so equal variances and deficient ranks are found too. The steps end when
    the right vectors span all dimensions, or when the wanted singular values no longer change.

    The driver holds matrices of a row's length squared; rows never reach it.
    """
    head = blocks.agg(F.sum("n").alias("n"), F.max("d").alias("d")).first()
    if not head["n"]:
        return None
    n, d = int(head["n"]), int(head["d"])
    totals = blocks.select(F.posexplode("sums")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()
    total = np.zeros(d, object)
    for r in totals:
        total[r["pos"]] = int(r["s"])
    fit = Fit(n, np.array([int(t // n) for t in total], np.int64), np.array([int(t % n) for t in total], object),
              np.zeros((d, 0)), np.zeros(0), 0.0, 0)
    base, centre = fit.base, fit.centre()

    def centred(x):
        return (x - base).astype(np.float64) - centre

    fit.trace = float(_sums(blocks, lambda x: np.array([(centred(x) ** 2).sum()])).get(0, 0.0)) / n
    if not fit.trace:
        return fit
    random = np.random.default_rng(SEED)
    tiny = np.finfo(float).eps * np.sqrt(fit.trace * n) * d

    right = np.zeros((d, 0))                    # v
    left = np.zeros((d, 0))                     # p with u = Xp
    back = np.zeros((d, 0))                     # X'u
    alphas, betas = [], []
    v = random.normal(size=d)
    v /= np.linalg.norm(v)
    while True:
        k = right.shape[1]
        right = np.column_stack([right, v])
        beta = betas[-1] if betas else 0.0
        q = v - beta * left[:, -1] if k else v

        def products(x, q=q, left=left):
            rows = centred(x)
            y = rows @ q
            us = rows @ left
            return np.concatenate([[y @ y], us.T @ y, rows.T @ y])

        got = _vector(_sums(blocks, products), 1 + k + d)
        along, xy = got[1:1 + k], got[1 + k:]
        alpha = np.sqrt(max(got[0] - along @ along, 0.0))
        if alpha > tiny:
            p, xu = (q - left @ along) / alpha, (xy - back @ along) / alpha
        else:
            alpha, p, xu = 0.0, np.zeros(d), np.zeros(d)
        left, back = np.column_stack([left, p]), np.column_stack([back, xu])
        alphas.append(alpha)
        small = np.diag(alphas) + np.diag(betas, 1)
        ls, values, rs = np.linalg.svd(small)
        if k + 1 == d:
            break
        w = _orthogonal(xu - alpha * v, right)
        beta = float(np.linalg.norm(w))
        if k + 1 > components and (beta * np.abs(ls[-1, :components]) <= 1e-15 * values[0]).all() and beta > tiny:
            break
        if beta <= tiny:
            beta, w = 0.0, _orthogonal(random.normal(size=d), right)
        betas.append(beta)
        v = w / np.linalg.norm(w)
    fit.steps = len(alphas)
    variances = values ** 2 / n
    keep = variances[:components] > (np.finfo(float).eps * d) ** 2 * fit.trace
    # below the square root of the rounding error of X'X a variance is zero
    found = right @ rs.T[:, :components][:, keep]
    found /= np.linalg.norm(found, axis=0)
    sign = np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    fit.components, fit.variances = found * sign, variances[:components][keep]
    return fit


ROWS = "vec_id long, deviation decimal(38,0), whitened array<double>"


def _deviations(x: np.ndarray, fit: Fit) -> list[Decimal]:
    """Exact sum over dimensions of (n x - S)^2."""
    off = x - fit.base
    if float(np.abs(off).max(initial=0) + 1) ** 2 * float(fit.n) ** 2 * x.shape[1] < 2.0 ** 62:
        gap = off * fit.n - fit.rest.astype(np.int64)
        return [Decimal(int(v)) for v in (gap * gap).sum(axis=1)]
    gap = off.astype(object) * fit.n - fit.rest
    return [Decimal(int(v)) for v in (gap * gap).sum(axis=1)]


def apply_fit(blocks: DataFrame, fit: Fit) -> DataFrame:
    """(vec_id, deviation, whitened) for every vector of ``blocks``: its centred row on each component over the
    component's standard deviation."""
    centre, turn = fit.centre(), fit.components / np.sqrt(fit.variances)

    def run(batches):
        for batch in batches:
            for d, ids, raw in zip(*(batch.column(c).to_pylist() for c in ("d", "ids", "x"))):
                x = np.frombuffer(raw, np.int64).reshape(-1, d)
                w = ((x - fit.base).astype(np.float64) - centre) @ turn
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(_deviations(x, fit), pa.decimal128(38, 0)), lists],
                                                 ["vec_id", "deviation", "whitened"])

    return blocks.select("d", "ids", "x").mapInArrow(run, ROWS)


def identity_error(blocks: DataFrame, fit: Fit) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows."""
    centre, turn = fit.centre(), fit.components / np.sqrt(fit.variances)
    r = turn.shape[1]

    def products(x):
        w = ((x - fit.base).astype(np.float64) - centre) @ turn
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    got = _vector(_sums(blocks, products), r + r * r) / fit.n
    covariance = got[r:].reshape(r, r) - np.outer(got[:r], got[:r])
    return float(np.abs(covariance - np.eye(r)).max())


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every usable row of ``rows``
    and every component, numbered from 1 by falling variance.

    A vector is usable if it has no null, NaN or infinite entry, none of 2^52 / 64 or more in size (which has
    no exact whole number), and is as long as the longest: a shorter one lacks entries, which count as null.
    Components of variance zero cannot be whitened and are left out, so equal vectors, or one alone, give no
    row. Rows that repeat a vec_id and rows without one count and are reported each; ``deviation`` is null
    where it does not fit a long. Other columns are not looked at. Every step is one pass over the stored
    blocks; their tasks return a few numbers each.
    """
    spark = rows.sparkSession
    blocks = stage_blocks(rows, vector)
    fit = bidiagonalise(blocks, components)
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    if fit is None or not len(fit.variances):
        return spark.createDataFrame([], StructType.fromDDL(schema))
    error = identity_error(blocks, fit)
    explained = F.array(*[F.lit(float(e) / fit.trace) for e in fit.variances])
    found = apply_fit(blocks, fit).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return found.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"),
                        _as_long(F.col("deviation")).alias("deviation"), "whitened",
                        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def _as_long(value: Column) -> Column:
    return value.try_cast("long")
