"""Splits, folds, scalers and encoders.

Randomness is ``md5(key|seed)``: reproducible and independent of partitioning. Fitted
statistics are one aggregate row (bounded) turned into literal Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from verdant.operators.stats import class_list, shuffle_key
from verdant.operators.windows import dense_index

TEST_THRESHOLD = "33333333"  # first 8 hex digits of md5 below this ~ 20% of rows


def hash_fraction_key(key: str, seed: int = 42) -> Column:
    return F.substring(shuffle_key(key, seed), 1, 8)


def train_test_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42,
                     name: str = "split") -> DataFrame:
    """M1: 'test' iff the first 8 hex digits of md5(key|seed) fall below test_size * 16^8."""
    threshold = TEST_THRESHOLD if test_size == 0.2 else format(int(test_size * 16 ** 8), "08x")
    return df.withColumn(name, F.when(hash_fraction_key(key, seed) < F.lit(threshold), F.lit("test"))
                         .otherwise(F.lit("train")))


def fold_of(key: str, k: int = 5, seed: int = 42) -> Column:
    return (F.conv(hash_fraction_key(key, seed), 16, 10).cast("bigint") % F.lit(k)).cast("int")


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """M2: fold = (first 8 hex digits of md5(key|seed) as a number) mod k."""
    return df.withColumn(name, fold_of(key, k, seed))


def stratified_kfold(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42,
                     name: str = "fold") -> DataFrame:
    """M3: class-balanced folds: position within the class in md5 order, mod k.

    Positions come from ``dense_index`` (range partitioned), so a class holding a third of
    the rows is still spread over many tasks.
    """
    keyed = df.withColumn("_sk", shuffle_key(key, seed))
    out = dense_index(keyed, ["_sk", key], [label], name="_pos")
    return out.withColumn(name, (F.col("_pos") % F.lit(k)).cast("int")).drop("_sk", "_pos")


def fit_standard(train: DataFrame, cols: list[str]) -> dict:
    """M4 fit: mean and population std per column (nulls ignored)."""
    row = train.agg(*[x for c in cols for x in (F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std"))]
                    ).first().asDict()
    return {c: (row[f"{c}__mean"], row[f"{c}__std"]) for c in cols}


def apply_standard(df: DataFrame, stats: dict, suffix: str = "") -> DataFrame:
    """M4 apply: (x - mean) / std; a constant column (std 0) maps to 0."""
    out = {}
    for c, (m, s) in stats.items():
        if m is None:
            continue
        if not s:
            out[c + suffix] = F.when(F.col(c).isNull(), F.lit(None)).otherwise(F.lit(0.0))
        else:
            out[c + suffix] = (F.col(c) - F.lit(float(m))) / F.lit(float(s))
    return df.withColumns(out)


def fit_minmax(train: DataFrame, cols: list[str]) -> dict:
    """M5 fit: min and max per column."""
    row = train.agg(*[x for c in cols for x in (F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max"))]
                    ).first().asDict()
    return {c: (row[f"{c}__min"], row[f"{c}__max"]) for c in cols}


def apply_minmax(df: DataFrame, stats: dict, suffix: str = "") -> DataFrame:
    """M5 apply: (x - min) / (max - min); a constant column maps to 0."""
    out = {}
    for c, (lo, hi) in stats.items():
        if lo is None:
            continue
        rng = float(hi) - float(lo)
        out[c + suffix] = ((F.col(c) - F.lit(float(lo))) / F.lit(rng)) if rng else \
            F.when(F.col(c).isNull(), F.lit(None)).otherwise(F.lit(0.0))
    return df.withColumns(out)


def minmax_inverse(col: str, stats: dict) -> Column:
    """M5 inverse for one column: x * (max - min) + min."""
    lo, hi = stats[col]
    return F.col(col) * F.lit(float(hi) - float(lo)) + F.lit(float(lo))


def fit_categories(train: DataFrame, cols: list[str]) -> dict:
    """Sorted category list per column (category sets are small by nature)."""
    return {c: class_list(train, c) for c in cols}


def one_hot(df: DataFrame, categories: dict, drop_first: bool = False, keep_source: bool = False) -> DataFrame:
    """M6 / M7: one 0/1 column ``col_value`` per category; unknown or null -> all zeros.

    ``drop_first`` leaves out the alphabetically first category (pandas ``drop_first``).
    """
    out = {}
    for c, cats in categories.items():
        for v in (cats[1:] if drop_first else cats):
            out[f"{c}_{v}"] = F.when(F.col(c) == F.lit(v), F.lit(1)).otherwise(F.lit(0))
    res = df.withColumns(out)
    return res if keep_source else res.drop(*categories.keys())


def label_encode(df: DataFrame, col: str, classes: list | None = None, name: str | None = None) -> DataFrame:
    """M8: class -> rank in the sorted class list (unknown -> null)."""
    classes = classes if classes is not None else class_list(df, col)
    arr = F.array(*[F.lit(v) for v in classes])
    pos = F.array_position(arr, F.col(col).cast("string"))
    return df.withColumn(name or f"{col}_index", F.when(pos > 0, (pos - 1).cast("int")))
