"""Aggregations, sorts and top-k (§2.6, O1-O5).

All statistics are single aggregate passes with partial (map-side) aggregation. Exact
quantiles are found by bracketed selection (``exact_quantiles``): a few aggregates of one row,
no sort, and no value buffer in one task, unlike ``percentile``.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType, DecimalType

from verdant.operators.windows import dense_index, top_per_group
from verdant.session import partitions_for


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns (any NumericType but decimal); timestamps are not numeric."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, DecimalType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def columns_by_type(df: DataFrame) -> DataFrame:
    """P2 as a table: (position, column_name, kind) with kind numeric / string / other."""
    num, txt = set(numeric_columns(df)), set(string_columns(df))
    rows = [(i, c, "numeric" if c in num else "string" if c in txt else "other")
            for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, kind string")


def long_values(df: DataFrame, cols: list[str], value_type: str = "double") -> DataFrame:
    """Unpivot ``cols`` into (column_name, value) rows."""
    return df.select(*[F.col(c).cast(value_type).alias(c) for c in cols]).unpivot(
        [], cols, "column_name", "value")


SKETCH_ACCURACY = 2_000   # rank error of the quantile sketch: one part in so many
COLLECTED_VALUES = 5_000  # values between two bounds that are few enough to be looked at one by one


@dataclass
class _Search:
    """The value of 0-based ``rank`` among a column's values strictly between ``low`` and ``high`` (None: no
    bound), ``n`` of them; ``value`` once it is known."""

    column: str
    rank: int
    n: int
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def inside(self, x: Column) -> Column:
        ok = x.isNotNull() & ~F.isnan(x)
        if self.low is not None:
            ok = ok & (x > F.lit(self.low))
        if self.high is not None:
            ok = ok & (x < F.lit(self.high))
        return ok

    def narrow(self, a: float, b: float, below: int, at_a: int, between: int, at_b: int) -> None:
        """Step to one side of, between, or onto two values of the column, by how many values lie where."""
        steps = [(below, None, (self.low, a)), (at_a, a, None), (between, None, (a, b)), (at_b, b, None),
                 (self.n - below - at_a - between - at_b, None, (b, self.high))]
        for count, value, bounds in steps:
            if self.rank < count:
                self.value = value
                if bounds:
                    self.low, self.high = bounds
                    self.n = count
                return
            self.rank -= count
        raise AssertionError("a rank beyond the values")


def order_statistics(df: DataFrame, ranks: dict[str, list[int]], counts: dict[str, int]) -> dict[tuple[str, int], float]:
    """The values of the given 0-based ranks of each (double) column, nulls and NaN left out.

    A mergeable quantile sketch brackets every rank; one aggregate counts the values below, between and equal
    to the ends of the brackets, which settles ranks within runs of equal values and narrows the others. A
    round leaves a few thousandths of the values, so few rounds are needed at any size; the last few thousand
    between two bounds are collected. Every pass is one aggregate of one row, no sort and no shuffle of values.
    """
    todo = {(c, r): _Search(c, r, counts[c]) for c, rs in ranks.items() for r in rs}

    def aggregate(searches: list[_Search], of) -> list:
        """``of(search, values inside its bounds)`` for each search, many in one pass."""
        out = []
        for at in range(0, len(searches), 64):
            some = searches[at:at + 64]
            cols = [F.struct(*[c.alias(f"v{j}") for j, c in enumerate(of(s, F.when(s.inside(F.col(f"`{s.column}`")), F.col(f"`{s.column}`"))))])
                    .alias(f"s{i}") for i, s in enumerate(some)]
            row = df.agg(*cols).first()
            out += [tuple(row[i]) for i in range(len(some))]
        return out

    while True:
        wide = [s for s in todo.values() if s.value is None and s.n > COLLECTED_VALUES]
        if not wide:
            break
        margin = 2.0 / SKETCH_ACCURACY
        ends = aggregate(wide, lambda s, x: [F.percentile_approx(x, [
            max(0.0, s.rank / s.n - margin), min(1.0, (s.rank + 1) / s.n + margin)], SKETCH_ACCURACY)])
        bracket = {id(s): e[0] for s, e in zip(wide, ends)}

        def places(s, x):
            a, b = (F.lit(v) for v in bracket[id(s)])
            same = a.eqNullSafe(b)
            return [F.count_if(x < a), F.count_if(x == a), F.count_if((x > a) & (x < b)), F.count_if((x == b) & ~same)]

        for s, found in zip(wide, aggregate(wide, places)):
            s.narrow(*bracket[id(s)], *found)
    few = [s for s in todo.values() if s.value is None]
    for s, (values,) in zip(few, aggregate(few, lambda s, x: [F.sort_array(F.collect_list(x))])):
        s.value = values[s.rank]
    return {key: s.value for key, s in todo.items()}


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """Exact linear-interpolation quantiles of each column (nulls and NaN ignored).

    Returns (column_name, prob, quantile) for columns with a value: ``lo + (hi - lo) * frac`` of the two ranks
    around each position, which ``order_statistics`` finds by bracketed selection.
    """
    values = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    counted = values.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`"))).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    counts = {c: counted[i] for i, c in enumerate(cols) if counted[i]}
    at = {(c, p): float(p) * (n - 1) for c, n in counts.items() for p in probs}
    ranks = {c: sorted({f(at[c, p]) for p in probs for f in (math.floor, math.ceil)}) for c in counts}
    found = order_statistics(values, ranks, counts)
    rows = []
    for (c, p), pos in at.items():
        lo, hi = found[c, math.floor(pos)], found[c, math.ceil(pos)]
        rows.append((c, float(p), lo if lo == hi else lo + (hi - lo) * (pos - math.floor(pos))))
    return df.sparkSession.createDataFrame(rows, "column_name string, prob double, quantile double")


def describe_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A1: count, mean, sample std, min, exact quartiles, max per numeric column."""
    cols = cols or numeric_columns(df)
    vals = long_values(df, cols)
    basic = vals.groupBy("column_name").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    qw = q.groupBy("column_name").pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("quantile"))
    qw = qw.withColumnsRenamed({"0.25": "p25", "0.5": "p50", "0.75": "p75"})
    return basic.join(qw, "column_name", "left")


def value_counts(df: DataFrame, cols: list[str] | None = None, k: int = 5, max_cols: int = 5) -> DataFrame:
    """A2: top-k values with counts for the first ``max_cols`` string columns (nulls excluded).

    Ties are broken by the value (the reference leaves them undefined).
    """
    cols = (cols or string_columns(df))[:max_cols]
    counts = (long_values(df, cols, "string").filter(F.col("value").isNotNull())
              .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count")))
    return top_per_group(counts, "column_name", [F.desc("count"), F.asc("value")], k)


def null_counts(df: DataFrame) -> DataFrame:
    """A3: missing values per column (NaN counts as missing, as in pandas)."""
    def miss(f):
        c = F.col(f.name)
        if f.dataType.typeName() in ("double", "float"):
            return (c.isNull() | F.isnan(c)).cast("bigint")
        return c.isNull().cast("bigint")
    wide = df.agg(*[F.sum(miss(f)).alias(f.name) for f in df.schema.fields])
    return wide.unpivot([], df.columns, "column_name", "null_count")


def table_profile(df: DataFrame) -> DataFrame:
    """A4: number of rows and columns (the schema and a sample are ``df.dtypes`` / ``limit``)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def column_means(df: DataFrame, cols: list[str]) -> DataFrame:
    """A5: one row of column means (nulls skipped)."""
    return df.agg(*[F.avg(c).alias(c) for c in cols])


def summary_report(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """One row per metric: Mean, Median (exact), Min, Max. ``cols`` maps metric -> column."""
    names = list(cols.values())
    vals = long_values(df, names)
    basic = vals.groupBy("column_name").agg(F.avg("value").alias("Mean"), F.min("value").alias("Min"),
                                            F.max("value").alias("Max"))
    med = exact_quantiles(df, names, [0.5]).select("column_name", F.col("quantile").alias("Median"))
    label = F.create_map(*[x for k, v in cols.items() for x in (F.lit(v), F.lit(k))])
    return (basic.join(med, "column_name", "left")
                 .select(label[F.col("column_name")].alias("Metric"), "Mean", "Median", "Min", "Max"))


def mean_by(df: DataFrame, dim: str, measure: str) -> DataFrame:
    """Mean per category with sample sd, count and a normal 95% interval (mean +- 1.96 sd/sqrt(n))."""
    out = df.groupBy(dim).agg(F.avg(measure).alias("mean"), F.stddev_samp(measure).alias("std"),
                              F.count(measure).alias("n"))
    half = F.lit(1.96) * F.col("std") / F.sqrt(F.col("n"))
    return out.withColumn("ci_low", F.col("mean") - half).withColumn("ci_high", F.col("mean") + half)


DRAWS = 8         # Poisson draws in one MD5, of four hex digits each
DRAWN_ROWS = 512  # rows whose draws a task holds at once, and categories whose sums it holds


def poisson_limits() -> list[str]:
    """Hex limits of a 16-bit draw: below the k-th it is a Poisson(1) count of k."""
    total, term, limits = 0.0, math.exp(-1.0), []
    for k in range(1, 9):
        total, term = total + term, term / k
        limits.append(f"{round(total * 65536):04x}")
    return limits


def bootstrap_mean(df: DataFrame, dim: str, measure: str, key: str, replicates: int = 1000, level: float = 0.95,
                   seed: int = 42) -> DataFrame:
    """Mean per category and its percentile bootstrap interval (dim, mean, n, ci_low, ci_high).

    Poisson bootstrap in one pass, ``replicates`` draws a row: in each replicate a row counts as often as a
    Poisson(1) draw from the MD5 of (seed, block, row key) says, so the draws do not depend on the layout and the weighted sums are merged
    map-side: a task ships (categories x replicates) sums at most, however many rows it reads. Null measures are
    skipped; a replicate that draws no row of a category is left out for it; a category without a value has nulls.
    """
    blocks = -(-replicates // DRAWS)
    rows = df.select(F.col(dim).alias("d"), F.col(measure).cast("double").alias("x"), F.col(key).cast("string").alias("k"))
    limits = np.array([int(x, 16) for x in poisson_limits()])
    counts = np.searchsorted(limits, np.arange(65536), side="right").astype(float)
    starts = [f"{seed}:{b}".encode() for b in range(blocks)]

    def draw(frames):
        sums: dict = {}

        def done():
            for d, (drawn, total) in sums.items():
                yield pd.DataFrame({"d": pd.Series([d] * replicates, dtype=object), "j": np.arange(replicates), "w": drawn, "wx": total})

        for pdf in frames:
            pdf = pdf[pdf["known"]]
            for at in range(0, len(pdf), DRAWN_ROWS):
                some = pdf.iloc[at:at + DRAWN_ROWS]
                ends = [b"" if k is None else b":" + k.encode() for k in some["k"]]
                digests = b"".join([hashlib.md5(start + end).digest() for end in ends for start in starts])
                weights = counts[np.frombuffer(digests, ">u2").reshape(len(some), -1)[:, :replicates]]
                x, (code, names) = some["x"].to_numpy(float), pd.factorize(some["d"], use_na_sentinel=False)
                for i, d in enumerate(names):
                    mine = code == i
                    drawn, total = sums.setdefault(None if pd.isna(d) else d, np.zeros((2, replicates)))
                    drawn += weights[mine].sum(axis=0)
                    total += x[mine] @ weights[mine]
                if len(sums) > DRAWN_ROWS:
                    yield from done()
                    sums.clear()
        yield from done()

    # every row costs as many draws as there are replicates, so the narrow rows are dealt evenly before that
    dealt = rows.select(F.col("d").cast("string").alias("d"), F.coalesce("x", F.lit(0.0)).alias("x"), F.col("x").isNotNull().alias("known"), "k").repartition(partitions_for(df), "k")
    drawn = dealt.mapInPandas(draw, "d string, j int, w double, wx double")
    means = drawn.groupBy("d", "j").agg(F.try_divide(F.sum("wx"), F.sum("w")).alias("m"))
    tail = (1 - level) / 2
    ends = means.groupBy(F.col("d").alias("e")).agg(F.percentile("m", F.lit(tail)).alias("ci_low"),
                                                    F.percentile("m", F.lit(1 - tail)).alias("ci_high"))
    base = rows.groupBy("d").agg(F.avg("x").alias("mean"), F.count("x").alias("n"))
    return base.join(ends, F.col("d").cast("string").eqNullSafe(F.col("e")), "left").select(F.col("d").alias(dim), "mean", "n", "ci_low", "ci_high")


def regression_metrics(df: DataFrame, y: str = "y_true", p: str = "y_pred", group=None) -> DataFrame:
    """MSE, RMSE, MAE, R^2 = 1 - SSE/SST in one aggregate."""
    e = F.col(y) - F.col(p)
    aggs = [F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
            F.sum(e * e).alias("_sse"), F.count(F.col(y)).alias("_n"), F.var_pop(y).alias("_vp")]
    base = df.groupBy(*([group] if isinstance(group, str) else (group or []))).agg(*aggs)
    return (base.withColumn("rmse", F.sqrt("mse"))
                .withColumn("r2", F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_n") * F.col("_vp")))
                .drop("_sse", "_n", "_vp"))


def residual_stats(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Mean and sample standard deviation of y - p."""
    r = F.col(y) - F.col(p)
    return df.agg(F.avg(r).alias("residual_mean"), F.stddev_samp(r).alias("residual_std"))


def accuracy(df: DataFrame, label: str = "label", pred: str = "predicted") -> DataFrame:
    """A10: percentage of rows with predicted == label."""
    return df.agg((F.lit(100.0) * F.avg((F.col(pred) == F.col(label)).cast("double"))).alias("accuracy"))


def class_list(df: DataFrame, *cols: str) -> list:
    """Sorted distinct classes over the given columns (a label set: small by nature)."""
    vals = reduce(lambda a, b: a.union(b), [df.select(F.col(c).cast("string").alias("c")) for c in cols])
    return [r.c for r in vals.filter(F.col("c").isNotNull()).distinct().orderBy("c").collect()]


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "predicted") -> DataFrame:
    """Dense (label, predicted, n) over the sorted classes, zeros included."""
    classes = class_list(df, label, pred)
    counts = df.groupBy(F.col(label).alias("label"), F.col(pred).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.createDataFrame([(a, b) for a in classes for b in classes],
                                           "label string, predicted string")
    return (grid.join(counts, ["label", "predicted"], "left")
                .withColumn("n", F.coalesce(F.col("n"), F.lit(0)).cast("bigint")))


def classification_report(df: DataFrame, label: str = "label", pred: str = "predicted") -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and weighted averages."""
    cm = confusion_matrix(df, label, pred)
    per = cm.groupBy("label").agg(
        F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum("n").alias("support"))
    predicted_n = cm.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("pred_n"))
    per = per.join(predicted_n, "label")
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("pred_n")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    per = per.withColumn("precision", prec).withColumn("recall", rec)
    per = per.withColumn("f1_score", F.coalesce(F.try_divide(
        F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    classes = per.select(F.col("label").alias("class"), "precision", "recall", "f1_score",
                         F.col("support").cast("bigint").alias("support"))
    tot = per.agg(F.sum("tp").alias("tp"), F.sum("support").alias("n"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
                  (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                  (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                  (F.sum(F.col("f1_score") * F.col("support")) / F.sum("support")).alias("wf"))
    acc = F.col("tp").cast("double") / F.col("n")
    def row(name, p, r, f):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1_score"), F.col("n").cast("bigint").alias("support"))
    summary = tot.select(F.inline(F.array(
        row("accuracy", acc, acc, acc),
        row("macro avg", F.col("mp"), F.col("mr"), F.col("mf")),
        row("weighted avg", F.col("wp"), F.col("wr"), F.col("wf")))))
    return classes.unionByName(summary)


def class_count(df: DataFrame, label: str = "label") -> DataFrame:
    """Number of distinct labels (decides binary vs multi-class)."""
    return df.agg(F.count_distinct(label).alias("n_classes"))


def distinct_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct non-null values per column with their sorted position."""
    vals = long_values(df, cols, "string").filter(F.col("value").isNotNull()).distinct()
    return dense_index(vals, ["value"], ["column_name"], name="position")


def axis_bounds(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Min / max of the actuals and the common range of actuals and predictions."""
    return df.agg(F.min(y).alias("y_min"), F.max(y).alias("y_max"),
                  F.least(F.min(y), F.min(p)).alias("lo"), F.greatest(F.max(y), F.max(p)).alias("hi"))


def cv_summary(folds: DataFrame, mse: str = "mse", group=None) -> DataFrame:
    """Mean and population std over folds of RMSE (= sqrt of each fold's MSE)."""
    r = F.sqrt(F.col(mse))
    by = [group] if isinstance(group, str) else list(group or [])
    return folds.groupBy(*by).agg(F.avg(r).alias("cv_rmse_mean"), F.stddev_pop(r).alias("cv_rmse_std"),
                                  F.count(F.lit(1)).alias("n_folds"))


def log_sum_exp(scores: Column) -> Column:
    m = F.array_max(scores)
    return m + F.log(F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))


def cross_entropy(scores: Column, label: Column) -> Column:
    """Per-row cross-entropy of the true class: logsumexp(scores) - scores[label]."""
    return log_sum_exp(scores) - F.element_at(scores, label.cast("int") + 1)


def log_loss(df: DataFrame, scores: str = "scores", label: str = "label") -> DataFrame:
    """Row mean of the cross-entropy (not the mean of batch means)."""
    return df.agg(F.avg(cross_entropy(F.col(scores), F.col(label))).alias("log_loss"),
                  F.count(F.lit(1)).alias("n"))


def epoch_metrics(df: DataFrame, loss: str = "loss", correct: str = "correct",
                  by=("epoch", "split")) -> DataFrame:
    """Mean loss and accuracy (%) per epoch and split of a scored log."""
    return df.groupBy(*by).agg(F.avg(loss).alias("loss"),
                               (F.lit(100.0) * F.avg(F.col(correct).cast("double"))).alias("accuracy"),
                               F.count(F.lit(1)).alias("n"))


# --- sorts and top-k (O1-O5) --------------------------------------------------------------

def sort_by_time(df: DataFrame, ts: str = "event_time", tie: str = "event_id") -> DataFrame:
    """O1: ascending time with a unique tie-break (a range-partitioned global sort)."""
    return df.orderBy(F.col(ts).asc(), F.col(tie).asc())


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """O2: the k largest by ``by`` (TakeOrderedAndProject: per-task top-k, then merge)."""
    return df.orderBy(F.col(by).desc(), F.col(tie).asc()).limit(k)


def head(df: DataFrame, order, n: int = 5) -> DataFrame:
    """O3: first n rows of an explicit order."""
    cols = [order] if isinstance(order, str) else list(order)
    return df.orderBy(*cols).limit(n)


def best_model(results: DataFrame, name: str = "model", score: str = "score", order: str = "position",
               group=None) -> DataFrame:
    """Argmin of ``score``; the first candidate (by ``order``) wins ties."""
    by = [group] if isinstance(group, str) else list(group or [])
    return results.groupBy(*by).agg(
        F.min_by(F.col(name), F.struct(F.col(score), F.col(order))).alias("best_model"),
        F.min(score).alias("best_score"))


def shuffle_key(key: str, seed: int = 42) -> Column:
    """Reproducible, layout-independent pseudo-random order key: md5(key|seed)."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42, name: str = "shuffle_position") -> DataFrame:
    """A seeded permutation, materialised as each row's 0-based position."""
    return dense_index(df.withColumn("_sk", shuffle_key(key, seed)), ["_sk", key], name=name).drop("_sk")
