"""Projections, column selection and cleaning and set ops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType

from verdant.functions.domain import yield_estimate
from verdant.functions.generic import lookup
from verdant.operators.stats import exact_quantiles, numeric_columns


class MissingColumnError(KeyError):
    """A required column (e.g. the target) is absent."""


def split_xy(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """features = every other column, target = ``target``; absent target raises."""
    if target not in df.columns:
        raise MissingColumnError(f"target column '{target}' not found")
    return df.drop(target), df.select(target)


def infer_task(df: DataFrame, target: str | None = None) -> tuple[str, str]:
    """(target, task): target defaults to the last column; string -> classification."""
    target = target or df.columns[-1]
    dtype = df.schema[target].dataType
    return target, ("classification" if isinstance(dtype, StringType) else "regression")


def features_by_exclusion(df: DataFrame, categorical: list[str], target: str) -> list[str]:
    """Numeric features = every column that is neither categorical nor the target."""
    num = set(numeric_columns(df))
    return [c for c in df.columns if c not in categorical and c != target and c in num]


def select_existing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keep the requested columns that exist (missing ones are skipped, not an error)."""
    return df.select(*[c for c in cols if c in df.columns])


def parse_timestamp(df: DataFrame, col: str = "timestamp", fmt: str | None = None) -> DataFrame:
    """Text -> timestamp when the column exists; unparsable text becomes null."""
    if col not in df.columns:
        return df
    parsed = F.try_to_timestamp(F.col(col), F.lit(fmt)) if fmt else F.try_to_timestamp(F.col(col))
    return df.withColumn(col, parsed)


def ensure_target(df: DataFrame, target: str = "yield") -> tuple[DataFrame, str]:
    """Keep ``target`` if present; else derive yield from temperature and soil moisture
    (short form); else use the first numeric column."""
    num = numeric_columns(df)
    if target in num:
        return df, target
    if "temperature" in num and "soil_moisture" in num:
        return df.withColumn(target, yield_estimate("temperature", "soil_moisture", None)), target
    if not num:
        raise MissingColumnError("no numeric column to use as target")
    return df, num[0]


def require_rows(df: DataFrame, n: int) -> bool:
    """True iff the table has more than ``n`` rows; reads at most n+1 rows."""
    return df.limit(n + 1).count() > n


def count_valid(df: DataFrame, group: str, corrupt_col: str = "_corrupt_record") -> DataFrame:
    """P15, counted in one pass: good and dead-letter rows of a permissive parse by ``group``."""
    bad = F.col(corrupt_col).isNotNull() if corrupt_col in df.columns else F.lit(False)
    return df.groupBy(group).agg(F.count_if(~bad).alias("n_good"), F.count_if(bad).alias("n_bad"))


def split_valid(df: DataFrame, corrupt_col: str = "_corrupt_record") -> tuple[DataFrame, DataFrame]:
    """(good rows, dead-letter rows) of a permissive parse."""
    if corrupt_col not in df.columns:
        return df, df.limit(0)
    bad = F.col(corrupt_col).isNotNull()
    return df.filter(~bad).drop(corrupt_col), df.filter(bad)


# --- P6 / P7: scoring-time defaults ---------------------------------------------------------

# Defaults the reference uses for absent scoring columns.
CARBON_SEQUESTRATION_DEFAULT = {"Regenerative": 2500.0, "Conservation": 1500.0, "Organic": 1000.0,
                                "Precision": 500.0}
WATER_EFFICIENCY_DEFAULT = {"Drip": 15.0, "Sprinkler": 25.0, "Subsurface": 20.0, "Flood": 40.0}
WATER_RECYCLING_DEFAULT = {"Drip": 60.0, "Sprinkler": 40.0, "Subsurface": 50.0, "Flood": 20.0}
IMPACT_DEFAULTS = {  # column: ({system: value}, else value, no-system value)
    "soil_health_impact_score": ({"Regenerative": 8.5, "Organic": 7.5, "Integrated": 6.5, "Conventional": 5.0}, 6.0, 6.0),
    "water_quality_impact_score": ({"Regenerative": 8.0, "Organic": 7.0, "Integrated": 6.0, "Conventional": 4.5}, 5.5, 5.5),
    "biodiversity_impact_score": ({"Regenerative": 8.5, "Organic": 7.5, "Integrated": 6.0, "Conventional": 4.0}, 5.5, 5.5),
    "air_quality_impact_score": ({"Regenerative": 7.5, "Organic": 7.0, "Integrated": 6.0, "Conventional": 5.0}, 6.0, 6.0),
}
FERTILIZER_DEFAULT = ({"Regenerative": 30.0, "Organic": 50.0, "Integrated": 100.0, "Conventional": 150.0}, 80.0, 80.0)


def _by(df: DataFrame, disc: str, mapping: dict, other: float, absent: float):
    if disc not in df.columns:
        return F.lit(absent)
    return lookup(disc, mapping, strict=False, default=other)


def with_missing_defaults(df: DataFrame, model_type: str) -> DataFrame:
    """Add each absent critical scoring column (null values of present columns are kept)."""
    cols = set(df.columns)
    add = {}
    if model_type == "carbon":
        if "carbon_sequestration_potential_kg_co2e" not in cols:
            add["carbon_sequestration_potential_kg_co2e"] = _by(
                df, "farming_method", CARBON_SEQUESTRATION_DEFAULT, 200.0, 1000.0)
        if "net_carbon_impact_kg_co2e" not in cols:
            seq = add.get("carbon_sequestration_potential_kg_co2e", F.col("carbon_sequestration_potential_kg_co2e"))
            add["net_carbon_impact_kg_co2e"] = (F.col("carbon_footprint_kg_co2e") - seq
                                                if "carbon_footprint_kg_co2e" in cols else F.lit(2000.0))
    elif model_type == "water":
        if "water_efficiency_cubic_meters_per_ton" not in cols:
            add["water_efficiency_cubic_meters_per_ton"] = _by(
                df, "irrigation_method", WATER_EFFICIENCY_DEFAULT, 30.0, 25.0)
        if "water_recycling_potential_percent" not in cols:
            add["water_recycling_potential_percent"] = _by(
                df, "irrigation_method", WATER_RECYCLING_DEFAULT, 30.0, 35.0)
    elif model_type == "environment":
        for col, (mapping, other, absent) in IMPACT_DEFAULTS.items():
            if col not in cols:
                add[col] = _by(df, "farming_system", mapping, other, absent)
        if "fertilizer_use_kg_per_hectare" not in cols:
            add["fertilizer_use_kg_per_hectare"] = (
                F.col("fertilizer_kg_per_hectare") if "fertilizer_kg_per_hectare" in cols
                else _by(df, "farming_system", *FERTILIZER_DEFAULT))
    else:
        raise ValueError(f"unknown model type {model_type!r}")
    return df.withColumns({k: v.cast("double") for k, v in add.items()}) if add else df


def align_to_features(df: DataFrame, numeric: list[str], categorical: list[str],
                      keep: list[str] | None = None) -> DataFrame:
    """Training feature order; absent numeric -> 0.0, absent categorical -> 'Unknown',
    extra columns dropped (``keep`` columns such as ids are carried in front)."""
    cols = set(df.columns)
    sel = [F.col(c) for c in (keep or []) if c in cols]
    sel += [F.col(c).cast("double").alias(c) if c in cols else F.lit(0.0).alias(c) for c in numeric]
    sel += [F.col(c).cast("string").alias(c) if c in cols else F.lit("Unknown").alias(c) for c in categorical]
    return df.select(*sel)


# --- P9 / P10: imputation ---------------------------------------------------------------------

def fit_impute(train: DataFrame, numeric: list[str], categorical: list[str]) -> dict:
    """P9 fit: exact median per numeric column, most frequent (smallest on ties) per string column.

    Returns ``{column: fill value}``: one scalar per column, computed by distributed aggregates.
    """
    fills: dict = {}
    if numeric:
        med = exact_quantiles(train, numeric, [0.5]).collect()
        fills.update({r.column_name: r.quantile for r in med})
    if categorical:
        counts = (train.select(*[F.col(c).cast("string").alias(c) for c in categorical])
                  .unpivot([], categorical, "column_name", "value").filter(F.col("value").isNotNull())
                  .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))
        mode = counts.groupBy("column_name").agg(
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode")).collect()
        fills.update({r.column_name: r.mode for r in mode})
    return fills


def apply_impute(df: DataFrame, fills: dict) -> DataFrame:
    """P9 apply: fill nulls (and NaN of doubles) with the fitted values."""
    out = {}
    for c, v in fills.items():
        if c not in df.columns or v is None:
            continue
        col = F.col(c)
        if isinstance(df.schema[c].dataType, DoubleType):
            col = F.nanvl(col, F.lit(None).cast("double"))
        out[c] = F.coalesce(col, F.lit(v).cast(df.schema[c].dataType))
    return df.withColumns(out) if out else df


FILL_WITH_MEAN_COLUMNS = ["carbon_footprint_kg_co2e", "water_usage_cubic_meters",
                          "soil_organic_matter_percent_current", "overall_environmental_impact_score"]


def fill_with_mean(df: DataFrame, cols: list[str] | None = None, materialize: bool = False) -> DataFrame:
    """P10: null -> column mean (over this table's rows) for the named columns that exist.

    The means are one aggregate row (bounded) turned into literals; all-null stays null.
    ``materialize`` writes ``df`` to the shared folder first, so an expensive input (a join chain)
    is computed once for both the means and the filled output.
    """
    cols = [c for c in (cols or FILL_WITH_MEAN_COLUMNS) if c in df.columns]
    if not cols:
        return df
    if materialize:
        from verdant.session import pin
        df = pin(df)
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
    out = {}
    for c in cols:
        m = means[c]
        if m is None:
            continue
        out[c] = F.coalesce(F.col(c), F.lit(float(m)))
    return df.withColumns(out) if out else df


# --- U1 ------------------------------------------------------------------------------------

def append(*dfs: DataFrame) -> DataFrame:
    """UNION ALL by column name; missing columns become null, types are widened."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
