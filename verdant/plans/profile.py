"""Profiling, cleaning, splitting and encoding queries: A1-A4, A14, P1, P6, P7, P9, P10, P14,
U1, M1-M7, O2, O5, W4, G2, G3, G11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verdant.functions import generic as G
from verdant.ml import features as M
from verdant.operators import clean as C
from verdant.operators import stats as S
from verdant.operators import windows as W
from verdant.plans.farm import carbon_table, farm_sql
from verdant.plans.registry import DIGITS, query, rnd, rounded
from verdant.sources.adapters import (CROPS, FARMING_METHODS, IRRIGATION_METHODS, SOIL_TYPES, base_table, view,
                                      with_views)

WATER_NUMERIC = ["water_id", "farm_size_hectares", "annual_rainfall_mm", "temperature_celsius", "growing_season_days"]
WATER_STRINGS = ["crop_type", "irrigation_method", "soil_type"]


def water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "farm_water")


def water_sql(sql: str, extra=None) -> str:
    return with_views(sql, "farm_water", extra=extra)


def _describe_sql() -> str:
    parts = []
    for c in WATER_NUMERIC:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, count({x}) AS count, {rnd(f'avg({x})')} AS mean,"
            f" {rnd(f'stddev_samp({x})')} AS std, {rnd(f'min({x})')} AS min,"
            f" {rnd(f'quantile_cont({x}, 0.25)')} AS p25, {rnd(f'quantile_cont({x}, 0.5)')} AS p50,"
            f" {rnd(f'quantile_cont({x}, 0.75)')} AS p75, {rnd(f'max({x})')} AS max FROM farm_water")
    return water_sql(" UNION ALL ".join(parts))


@query("describe_numeric", _describe_sql())
def q_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: count, mean, std, min, exact quartiles, max per numeric column."""
    return rounded(S.describe_numeric(water(spark, sf_dir)))


@query("value_counts", water_sql(
    "SELECT column_name, value, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY column_name"
    " ORDER BY count DESC, value ASC) AS rank FROM (SELECT column_name, value, count(*) AS count FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value FROM farm_water" for c in WATER_STRINGS)
    + ") WHERE value IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 5"))
def q_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 (+ W4): top-5 values per string column."""
    return S.value_counts(water(spark, sf_dir)).withColumn("rank", F.col("rank").cast("bigint"))


@query("null_counts", water_sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count FROM farm_water"
    for c in WATER_NUMERIC[:1] + WATER_STRINGS[:1] + ["irrigation_method", "soil_type"] + WATER_NUMERIC[1:])))
def q_null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: missing values per column."""
    return S.null_counts(water(spark, sf_dir))


@query("table_profile", water_sql("SELECT count(*) AS n_rows, 8 AS n_columns FROM farm_water"))
def q_table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: row and column counts."""
    return S.table_profile(water(spark, sf_dir)).withColumn("n_columns", F.col("n_columns").cast("int"))


@query("distinct_values", with_views(
    "SELECT column_name, value, dense_rank() OVER (PARTITION BY column_name ORDER BY value) - 1 AS position FROM ("
    "SELECT DISTINCT 'crop_type' AS column_name, crop_type AS value FROM farm_carbon"
    " UNION SELECT DISTINCT 'farming_method', farming_method FROM farm_carbon)", "farm_carbon"))
def q_distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted category list per column."""
    return S.distinct_values(view(spark, sf_dir, "farm_carbon"), ["crop_type", "farming_method"])


@query("append", with_views("SELECT * FROM farm_carbon UNION ALL BY NAME SELECT * FROM farm_water",
                            "farm_carbon", "farm_water"))
def q_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union by column name, missing columns null."""
    return C.append(view(spark, sf_dir, "farm_carbon"), view(spark, sf_dir, "farm_water"))


@query("split_xy", farm_sql("SELECT * EXCLUDE (carbon_footprint_kg_co2e) FROM carbon_m"))
def q_split_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature side of a target split (every column but the target)."""
    x, _y = C.split_xy(carbon_table(spark, sf_dir), "carbon_footprint_kg_co2e")
    return x


@query("select_existing", with_views("SELECT farm_id, crop_type FROM farm_carbon", "farm_carbon"))
def q_select_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested columns that exist (``irrigation_method`` is absent and skipped)."""
    return C.select_existing(view(spark, sf_dir, "farm_carbon"), ["farm_id", "crop_type", "irrigation_method"])


_SEQ_DEFAULT = ("(CASE farming_method WHEN 'Regenerative' THEN 2500e0 WHEN 'Conservation' THEN 1500e0"
                " WHEN 'Organic' THEN 1000e0 WHEN 'Precision' THEN 500e0 ELSE 200e0 END)")


@query("missing_defaults_carbon", farm_sql(
    f"SELECT farm_id, {_SEQ_DEFAULT} AS carbon_sequestration_potential_kg_co2e,"
    f" carbon_footprint_kg_co2e - {_SEQ_DEFAULT} AS net_carbon_impact_kg_co2e FROM carbon_m"))
def q_missing_carbon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 (carbon): sequestration and net impact filled from the farming method when absent."""
    df = carbon_table(spark, sf_dir).drop("carbon_sequestration_potential_kg_co2e", "net_carbon_impact_kg_co2e")
    return C.with_missing_defaults(df, "carbon").select(
        "farm_id", "carbon_sequestration_potential_kg_co2e", "net_carbon_impact_kg_co2e")


@query("missing_defaults_water", water_sql(
    "SELECT water_id, (CASE irrigation_method WHEN 'Drip' THEN 15e0 WHEN 'Sprinkler' THEN 25e0 WHEN 'Subsurface'"
    " THEN 20e0 WHEN 'Flood' THEN 40e0 ELSE 30e0 END) AS water_efficiency_cubic_meters_per_ton,"
    " (CASE irrigation_method WHEN 'Drip' THEN 60e0 WHEN 'Sprinkler' THEN 40e0 WHEN 'Subsurface' THEN 50e0"
    " WHEN 'Flood' THEN 20e0 ELSE 30e0 END) AS water_recycling_potential_percent FROM farm_water"))
def q_missing_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 (water): efficiency and recycling filled from the irrigation method when absent."""
    return C.with_missing_defaults(water(spark, sf_dir), "water").select(
        "water_id", "water_efficiency_cubic_meters_per_ton", "water_recycling_potential_percent")


def _impact_default_sql() -> str:
    cols = []
    for col, (mapping, other, _absent) in C.IMPACT_DEFAULTS.items():
        whens = " ".join(f"WHEN '{k}' THEN {v!r}e0" for k, v in mapping.items())
        cols.append(f"(CASE farming_system {whens} ELSE {other!r}e0 END) AS {col}")
    return with_views(f"SELECT env_id, {', '.join(cols)}, fertilizer_use_kg_per_hectare FROM farm_env", "farm_env")


@query("missing_defaults_env", _impact_default_sql())
def q_missing_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 (environment): absent impact sub-scores from the farming system; present fertilizer is kept."""
    out = C.with_missing_defaults(view(spark, sf_dir, "farm_env"), "environment")
    return out.select("env_id", *C.IMPACT_DEFAULTS.keys(), "fertilizer_use_kg_per_hectare")


@query("missing_defaults_absent", with_views(
    "SELECT 'carbon' AS kind, farm_id AS id, 1000e0 AS a, 2000e0 AS b FROM farm_carbon"
    " UNION ALL SELECT 'water', water_id, 25e0, 35e0 FROM farm_water"
    " UNION ALL SELECT 'environment', env_id, 6e0, 80e0 FROM farm_env", "farm_carbon", "farm_water", "farm_env"))
def q_missing_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6, the arms for tables without the column that tells methods apart: one constant for every row."""
    cases = [("carbon", "farm_carbon", "farm_id", "carbon_sequestration_potential_kg_co2e", "net_carbon_impact_kg_co2e"),
             ("water", "farm_water", "water_id", "water_efficiency_cubic_meters_per_ton", "water_recycling_potential_percent"),
             ("environment", "farm_env", "env_id", "soil_health_impact_score", "fertilizer_use_kg_per_hectare")]
    out = None
    for kind, name, key, a, b in cases:
        df = C.with_missing_defaults(view(spark, sf_dir, name).select(key), kind).select(
            F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(a).alias("a"), F.col(b).alias("b"))
        out = df if out is None else out.unionByName(df)
    return out


@query("missing_defaults_fertilizer", with_views(
    "SELECT env_id, CASE farming_system WHEN 'Regenerative' THEN 30e0 WHEN 'Organic' THEN 50e0 WHEN 'Integrated' THEN 100e0"
    " WHEN 'Conventional' THEN 150e0 ELSE 80e0 END AS fertilizer_use_kg_per_hectare FROM farm_env", "farm_env"))
def q_missing_fertilizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 (environment): an absent fertilizer column from the farming system."""
    df = view(spark, sf_dir, "farm_env").drop("fertilizer_use_kg_per_hectare")
    return C.with_missing_defaults(df, "environment").select("env_id", "fertilizer_use_kg_per_hectare")


@query("align_to_features", with_views(
    "SELECT farm_id, CAST(farm_size_hectares AS DOUBLE) AS farm_size_hectares,"
    " CAST(fertilizer_kg_per_hectare AS DOUBLE) AS fertilizer_kg_per_hectare, 0e0 AS annual_rainfall_mm,"
    " crop_type, 'Unknown' AS irrigation_method FROM farm_carbon", "farm_carbon"))
def q_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training feature order; absent numeric -> 0, absent categorical -> 'Unknown', extras dropped."""
    return C.align_to_features(view(spark, sf_dir, "farm_carbon"),
                               ["farm_size_hectares", "fertilizer_kg_per_hectare", "annual_rainfall_mm"],
                               ["crop_type", "irrigation_method"], keep=["farm_id"])


# --- splits and folds (M1-M3) ----------------------------------------------------------------

def _md5(key: str, seed: int = 42) -> str:
    return f"md5(CAST({key} AS VARCHAR) || '|{seed}')"


_SPLIT_SQL = f"CASE WHEN substr({_md5('farm_id')}, 1, 8) < '33333333' THEN 'test' ELSE 'train' END"


@query("train_test_split", with_views(f"SELECT farm_id, {_SPLIT_SQL} AS split FROM farm_carbon", "farm_carbon"))
def q_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: reproducible ~80/20 split on md5(key|seed)."""
    return M.train_test_split(view(spark, sf_dir, "farm_carbon"), "farm_id").select("farm_id", "split")


@query("kfold", with_views(
    f"SELECT farm_id, CAST(CAST(('0x' || substr({_md5('farm_id')}, 1, 8)) AS BIGINT) % 5 AS INTEGER) AS fold"
    " FROM farm_carbon", "farm_carbon"))
def q_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: five hash folds."""
    return M.kfold(view(spark, sf_dir, "farm_carbon"), "farm_id", 5).select("farm_id", "fold")


@query("stratified_kfold", with_views(
    "SELECT l_orderkey, l_linenumber, label, CAST((row_number() OVER (PARTITION BY label ORDER BY"
    " md5(concat_ws('-', l_orderkey, l_linenumber) || '|42'), concat_ws('-', l_orderkey, l_linenumber)) - 1) % 5"
    " AS INTEGER) AS fold FROM scored", "scored"))
def q_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: class-balanced folds (position within the class in md5 order, mod 5)."""
    df = view(spark, sf_dir, "scored").withColumn("row_key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return M.stratified_kfold(df, "row_key", "label", 5).select("l_orderkey", "l_linenumber", "label", "fold")


# --- scalers and encoders fitted on the train split (M4-M7), imputation (P9, P10) ----------------

_TRAIN_WATER = f"CASE WHEN substr({_md5('water_id')}, 1, 8) < '33333333' THEN 'test' ELSE 'train' END"
SCALE_COLS = ["annual_rainfall_mm", "temperature_celsius", "growing_season_days", "farm_size_hectares"]


@query("standard_scale", water_sql(
    "SELECT water_id, " + ", ".join(
        f"{rnd(f'CASE WHEN st.{c}_s = 0 THEN 0e0 ELSE (w.{c} - st.{c}_m) / st.{c}_s END')} AS {c}"
        for c in SCALE_COLS)
    + " FROM farm_water w, st",
    extra=[("st", "SELECT " + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in SCALE_COLS)
            + f" FROM farm_water WHERE {_TRAIN_WATER} = 'train'")]))
def q_standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: (x - mean) / population std fitted on the train split, applied to every row."""
    df = M.train_test_split(water(spark, sf_dir), "water_id")
    stats = M.fit_standard(df.filter(F.col("split") == "train"), SCALE_COLS)
    return rounded(M.apply_standard(df, stats).select("water_id", *SCALE_COLS))


MINMAX_COLS = ["temperature", "humidity", "rainfall", "soil_moisture", "solar_radiation", "wind_speed"]


@query("minmax_scale", with_views(
    "SELECT event_id, " + ", ".join(
        f"CASE WHEN b.{c}_hi = b.{c}_lo THEN 0e0 ELSE (r.{c} - b.{c}_lo) / (b.{c}_hi - b.{c}_lo) END AS {c}"
        for c in MINMAX_COLS)
    + ", (CASE WHEN b.temperature_hi = b.temperature_lo THEN 0e0 ELSE (r.temperature - b.temperature_lo)"
      " / (b.temperature_hi - b.temperature_lo) END) * (b.temperature_hi - b.temperature_lo) + b.temperature_lo"
      " AS temperature_restored FROM sensor_readings r, b", "sensor_readings",
    extra=[("b", "SELECT " + ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in MINMAX_COLS)
            + " FROM sensor_readings")]))
def q_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: min-max scaling of every sensor field and the inverse for one column."""
    df = view(spark, sf_dir, "sensor_readings")
    stats = M.fit_minmax(df, MINMAX_COLS)
    out = M.apply_minmax(df, stats)
    return out.select("event_id", *MINMAX_COLS, M.minmax_inverse("temperature", stats).alias("temperature_restored"))


_CATS = {"crop_type": sorted(CROPS), "irrigation_method": sorted(IRRIGATION_METHODS), "soil_type": sorted(SOIL_TYPES)}


def _one_hot_sql(drop_first: bool) -> str:
    cols = [f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS {c}_{v}"
            for c, vals in _CATS.items() for v in (vals[1:] if drop_first else vals)]
    return water_sql(f"SELECT water_id, {', '.join(cols)} FROM farm_water")


@query("one_hot", _one_hot_sql(False))
def q_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: one indicator per sorted category (fitted on the train split)."""
    df = M.train_test_split(water(spark, sf_dir), "water_id")
    cats = M.fit_categories(df.filter(F.col("split") == "train"), list(_CATS))
    return M.one_hot(df, cats).drop(*[c for c in df.columns if c != "water_id" and c not in _CATS]).drop("split")


@query("dummies_drop_first", _one_hot_sql(True))
def q_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: indicators without the alphabetically first category."""
    df = water(spark, sf_dir)
    cats = M.fit_categories(df, list(_CATS))
    return M.one_hot(df, cats, drop_first=True).drop(*[c for c in df.columns if c != "water_id" and c not in _CATS])


_TRAIN_CARBON = f"substr({_md5('farm_id')}, 1, 8) >= '33333333'"


_NULLABLE = "CASE WHEN farm_id % 7 = 0 THEN NULL WHEN farm_id % 5 < 2 THEN 'Wheat' ELSE crop_type END"


@query("impute", with_views(
    "SELECT farm_id, COALESCE(fertilizer_kg_per_hectare, (SELECT quantile_cont(fertilizer_kg_per_hectare, 0.5)"
    f" FROM farm_carbon WHERE {_TRAIN_CARBON})) AS fertilizer_kg_per_hectare,"
    f" COALESCE({_NULLABLE}, (SELECT v FROM (SELECT {_NULLABLE} AS v FROM farm_carbon WHERE {_TRAIN_CARBON}) WHERE v IS NOT NULL"
    " GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)) AS crop_type FROM farm_carbon", "farm_carbon"))
def q_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact median / most-frequent fill fitted on the train split."""
    farms = view(spark, sf_dir, "farm_carbon").withColumn("crop_type", F.expr(_NULLABLE))
    df = M.train_test_split(farms, "farm_id")
    fills = C.fit_impute(df.filter(F.col("split") == "train"), ["fertilizer_kg_per_hectare"], ["crop_type"])
    return C.apply_impute(df, fills).select("farm_id", "fertilizer_kg_per_hectare", "crop_type")


@query("fill_with_mean", with_views(
    "SELECT farm_id, round(COALESCE(fertilizer_kg_per_hectare, (SELECT avg(fertilizer_kg_per_hectare)"
    f" FROM farm_carbon)), {DIGITS}) AS fertilizer_kg_per_hectare FROM farm_carbon", "farm_carbon"))
def q_fill_with_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10 on one table: null -> column mean (reported to 1e-6)."""
    df = view(spark, sf_dir, "farm_carbon")
    return rounded(C.fill_with_mean(df, ["fertilizer_kg_per_hectare"]).select("farm_id", "fertilizer_kg_per_hectare"))


# --- order and top-k (O2, O5, W4) ------------------------------------------------------------------

@query("top_k", farm_sql(
    "SELECT farm_id, carbon_footprint_kg_co2e FROM carbon_m ORDER BY carbon_footprint_kg_co2e DESC, farm_id LIMIT 10"))
def q_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: the ten largest footprints."""
    return S.top_k(carbon_table(spark, sf_dir).select("farm_id", "carbon_footprint_kg_co2e"),
                   "carbon_footprint_kg_co2e", 10, "farm_id")


@query("top_per_group", farm_sql(
    "SELECT farming_method, farm_id, carbon_footprint_kg_co2e, rank FROM (SELECT farming_method, farm_id,"
    " carbon_footprint_kg_co2e, row_number() OVER (PARTITION BY farming_method ORDER BY carbon_footprint_kg_co2e DESC,"
    " farm_id) AS rank FROM carbon_m) WHERE rank <= 3"))
def q_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest footprints per farming method."""
    df = carbon_table(spark, sf_dir).select("farming_method", "farm_id", "carbon_footprint_kg_co2e")
    out = W.top_per_group(df, "farming_method", [F.desc("carbon_footprint_kg_co2e"), F.asc("farm_id")], 3)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query("seeded_shuffle", with_views(
    f"SELECT farm_id, row_number() OVER (ORDER BY {_md5('farm_id')}, farm_id) - 1 AS shuffle_position"
    " FROM farm_carbon", "farm_carbon"))
def q_seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded permutation as each row's position."""
    return S.seeded_shuffle(view(spark, sf_dir, "farm_carbon").select("farm_id"), "farm_id")


# --- generic strings (G2, G3, G11) ------------------------------------------------------------------

@query("snake_name", "SELECT p_partkey, replace(replace(lower(p_type), '-', '_'), ' ', '_') AS snake FROM part")
def q_snake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower case with '-' and ' ' turned into '_'."""
    return base_table(spark, sf_dir, "part").select("p_partkey", G.snake_name("p_type").alias("snake"))


@query("title_case", (
    "SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '),"
    " lambda w: array_to_string(list_transform(string_split(w, '_'), lambda v: upper(v[1]) || v[2:]), '_')), ' ') AS title"
    " FROM (SELECT p_partkey, replace(p_type, 'A', '_A') AS p_type FROM part)"))
def q_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words."""
    named = F.replace("p_type", F.lit("A"), F.lit("_A"))  # an underscore stays where it is
    return base_table(spark, sf_dir, "part").select("p_partkey", G.title_case(named).alias("title"))


@query("indicator", with_views(
    "SELECT farm_id, CASE WHEN farming_method = 'Organic' THEN 1 ELSE 0 END AS is_organic,"
    " CASE WHEN fertilizer_kg_per_hectare IS NOT NULL AND fertilizer_kg_per_hectare <> 0 THEN 1 ELSE 0 END"
    " AS uses_fertilizer FROM farm_carbon", "farm_carbon"))
def q_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(col = value) and numeric truth as 0/1."""
    df = view(spark, sf_dir, "farm_carbon")
    return df.select("farm_id", G.indicator("farming_method", "Organic").alias("is_organic"),
                     G.indicator("fertilizer_kg_per_hectare").alias("uses_fertilizer"))

