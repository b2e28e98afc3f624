"""Sustainability queries: formulas F1-F11, P5, P8, lookups, per-category means (A7),
merges (J1-J4, P10, A5) over the farm views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verdant.functions import domain as D
from verdant.operators import joins as J
from verdant.operators import stats as S
from verdant.operators.clean import fill_with_mean, FILL_WITH_MEAN_COLUMNS
from verdant.plans.registry import DIGITS, case_map, clip_sql, dlit, floor0, query, rnd, rounded
from verdant.sources.adapters import PRACTICE_COLUMNS, view, with_views

# --- Spark side: the four reference tables --------------------------------------------------


def carbon_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.with_carbon_metrics(view(spark, sf_dir, "farm_carbon"))


def water_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.with_water_metrics(view(spark, sf_dir, "farm_water"))


def regen_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.with_regen_metrics(view(spark, sf_dir, "farm_regen"))


def env_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.with_env_metrics(view(spark, sf_dir, "farm_env"))


# --- oracle side: the same tables as SQL ---------------------------------------------------

F1_SQL = floor0(
    f"{case_map('crop_type', D.CROP_CARBON)} * {case_map('farming_method', D.METHOD_FACTOR)}"
    " * (farm_size_hectares / 100e0) + fertilizer_kg_per_hectare * 3e0 + machinery_hours * 10e0"
    " + transport_distance_km * 2e-1 + energy_consumption_kwh * 5e-1")
F2_SQL = floor0(f"{case_map('farming_method', D.SEQUESTRATION_RATE, 0.0)} * farm_size_hectares / 100e0")
CARBON_SQL = ("SELECT *, carbon_footprint_kg_co2e - carbon_sequestration_potential_kg_co2e AS net_carbon_impact_kg_co2e"
              f" FROM (SELECT *, {F1_SQL} AS carbon_footprint_kg_co2e,"
              f" {F2_SQL} AS carbon_sequestration_potential_kg_co2e FROM farm_carbon)")

F4_SQL = floor0(
    f"{case_map('crop_type', D.CROP_WATER)} * {case_map('irrigation_method', D.IRRIGATION_FACTOR)}"
    f" * {case_map('soil_type', D.SOIL_FACTOR)} * (farm_size_hectares / 100e0)"
    " * (1e0 + (temperature_celsius - 20e0) / 50e0) * (1e0 - annual_rainfall_mm / 3000e0)")
WATER_SQL = (f"SELECT *, water_usage_cubic_meters / ({case_map('crop_type', D.CROP_WATER)} / 1000e0)"
             " AS water_efficiency_cubic_meters_per_ton,"
             f" {clip_sql(case_map('irrigation_method', D.RECYCLING_POTENTIAL, 0.0), 0, 100)}"
             " AS water_recycling_potential_percent"
             f" FROM (SELECT *, {F4_SQL} AS water_usage_cubic_meters FROM farm_water)")

_P5 = " + ".join(PRACTICE_COLUMNS)
_YRS = "(CASE WHEN years_practicing_regenerative > 10e0 THEN 10e0 ELSE years_practicing_regenerative END)"
_GROWN = f"(soil_organic_matter_percent_initial + total_practices_adopted * 2e-1 * {_YRS} / 10e0)"
REGEN_SQL = (
    "SELECT *,"
    f" CASE WHEN {_GROWN} < soil_organic_matter_percent_initial THEN soil_organic_matter_percent_initial"
    f" ELSE {_GROWN} END AS soil_organic_matter_percent_current,"
    " " + clip_sql("5e0 + total_practices_adopted * 8e-1"
                   " + (CASE WHEN uses_agroforestry <> 0 THEN 1 ELSE 0 END) * 2e0"
                   " + (CASE WHEN uses_crop_rotation <> 0 THEN 1 ELSE 0 END) * 1.5e0", 1, 10)
    + " AS biodiversity_score,"
    " " + clip_sql("4e0 + total_practices_adopted * 7e-1 + years_practicing_regenerative * 2e-1", 1, 10)
    + " AS economic_resilience_score"
    f" FROM (SELECT *, {_P5} AS total_practices_adopted FROM farm_regen)")

_PEST = case_map("farming_system", {k: v[0] for k, v in D.SYSTEM_ADJUST.items()}, 1.0)
_FERT = case_map("farming_system", {k: v[1] for k, v in D.SYSTEM_ADJUST.items()}, 1.0)
ENV_ADJ_SQL = (f"SELECT * REPLACE (pesticide_use_kg_per_hectare * {_PEST} AS pesticide_use_kg_per_hectare,"
               f" fertilizer_use_kg_per_hectare * {_FERT} AS fertilizer_use_kg_per_hectare) FROM farm_env")


def _impact(name: str, extra: list[str]) -> str:
    base, red = D.IMPACT_REDUCTION[name]
    expr = f"{dlit(base)} - {case_map('farming_system', red, 0.0)}" + "".join(f" + {e}" for e in extra)
    return clip_sql(expr, 1, 10) + f" AS {name}"


_p, _f, _e = ("(pesticide_use_kg_per_hectare / 10e0)", "(fertilizer_use_kg_per_hectare / 300e0)",
              "(energy_use_kwh_per_hectare / 2000e0)")
ENV_SQL = (
    "SELECT *, biodiversity_impact_score * 3e-1 + soil_health_impact_score * 3e-1"
    " + water_quality_impact_score * 2.5e-1 + air_quality_impact_score * 1.5e-1 AS overall_environmental_impact_score"
    " FROM (SELECT *, "
    + ", ".join([_impact("biodiversity_impact_score", [f"{_p} * 3e0"]),
                 _impact("soil_health_impact_score", [f"{_p} * 2e0", f"{_f} * 3e0"]),
                 _impact("water_quality_impact_score", [f"{_p} * 4e0", f"{_f} * 3e0"]),
                 _impact("air_quality_impact_score", [f"{_e} * 5e0"])])
    + " FROM env_adj)")

FARM_CTES = [("carbon_m", CARBON_SQL), ("water_m", WATER_SQL), ("regen_m", REGEN_SQL),
             ("env_adj", ENV_ADJ_SQL), ("env_m", ENV_SQL)]
FARM_VIEWS = ("farm_carbon", "farm_water", "farm_regen", "farm_env")


def farm_sql(sql: str) -> str:
    return with_views(sql, *FARM_VIEWS, extra=FARM_CTES)


# --- row-level formula queries ----------------------------------------------------------------

def _row_query(key: str, table_fn, id_col: str, cols: list[str], cte: str):
    sql = farm_sql(f"SELECT {id_col}, {', '.join(cols)} FROM {cte}")

    @query(key, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table_fn(spark, sf_dir).select(id_col, *cols)
    run.__name__ = key
    return run


_row_query("carbon_footprint", carbon_table, "farm_id",
           ["crop_type", "farming_method", "carbon_footprint_kg_co2e"], "carbon_m")
_row_query("sequestration", carbon_table, "farm_id",
           ["farming_method", "carbon_sequestration_potential_kg_co2e"], "carbon_m")
_row_query("net_carbon", carbon_table, "farm_id", ["net_carbon_impact_kg_co2e"], "carbon_m")
_row_query("water_usage", water_table, "water_id",
           ["crop_type", "irrigation_method", "soil_type", "water_usage_cubic_meters"], "water_m")
_row_query("water_efficiency", water_table, "water_id", ["water_efficiency_cubic_meters_per_ton"], "water_m")
_row_query("water_recycling", water_table, "water_id",
           ["irrigation_method", "water_recycling_potential_percent"], "water_m")
_row_query("practice_count", regen_table, "regen_id", ["total_practices_adopted"], "regen_m")
_row_query("soil_organic_matter", regen_table, "regen_id", ["soil_organic_matter_percent_current"], "regen_m")
_row_query("biodiversity", regen_table, "regen_id", ["biodiversity_score"], "regen_m")
_row_query("economic_resilience", regen_table, "regen_id", ["economic_resilience_score"], "regen_m")
_row_query("system_adjust", lambda s, d: D.system_adjust(view(s, d, "farm_env")), "env_id",
           ["farming_system", "pesticide_use_kg_per_hectare", "fertilizer_use_kg_per_hectare"], "env_adj")
_row_query("impact_scores", env_table, "env_id",
           ["biodiversity_impact_score", "soil_health_impact_score", "water_quality_impact_score",
            "air_quality_impact_score"], "env_m")
_row_query("overall_impact", env_table, "env_id", ["overall_environmental_impact_score"], "env_m")


@query("lookup", farm_sql(
    f"SELECT farm_id, {case_map('crop_type', D.CROP_CARBON)} AS crop_carbon,"
    f" {case_map('farming_method', D.METHOD_FACTOR)} AS method_factor FROM farm_carbon"))
def q_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension lookups (literal maps, no join)."""
    from verdant.functions.generic import lookup
    return view(spark, sf_dir, "farm_carbon").select(
        "farm_id", lookup("crop_type", D.CROP_CARBON).alias("crop_carbon"),
        lookup("farming_method", D.METHOD_FACTOR).alias("method_factor"))


# --- A7: per-category means (the flagship) -------------------------------------------------------

def _mean_by_sql(cte: str, dim: str, measure: str) -> str:
    half = f"1.96e0 * stddev_samp({measure}) / sqrt(count({measure}))"
    return farm_sql(
        f"SELECT {dim}, {rnd(f'avg({measure})')} AS mean, {rnd(f'stddev_samp({measure})')} AS std,"
        f" count({measure}) AS n, {rnd(f'avg({measure}) - {half}')} AS ci_low,"
        f" {rnd(f'avg({measure}) + {half}')} AS ci_high FROM {cte} GROUP BY {dim}")


def mean_carbon_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.mean_by(carbon_table(spark, sf_dir), "farming_method", "carbon_footprint_kg_co2e"))


query("mean_by_method", _mean_by_sql("carbon_m", "farming_method", "carbon_footprint_kg_co2e"))(
    mean_carbon_by_method)


@query("mean_by_irrigation", _mean_by_sql("water_m", "irrigation_method", "water_usage_cubic_meters"))
def q_mean_by_irrigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.mean_by(water_table(spark, sf_dir), "irrigation_method", "water_usage_cubic_meters"))


@query("mean_by_system", _mean_by_sql("env_m", "farming_system", "overall_environmental_impact_score"))
def q_mean_by_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.mean_by(env_table(spark, sf_dir), "farming_system", "overall_environmental_impact_score"))


# The 16-bit limits of a Poisson(1) draw, e^-1 (1 + 1 + 1/2 + ...) of 65536.
_POISSON = ["5e2d", "bc5b", "eb71", "fb24", "ff10", "ffd9", "fffb", "ffff"]


def _bootstrap_sql(cte: str, dim: str, measure: str, key: str) -> str:
    draw = "substr(h, 1 + 4 * j, 4)"
    weight = "CASE " + " ".join(f"WHEN {draw} < '{x}' THEN {k}" for k, x in enumerate(_POISSON)) + f" ELSE {len(_POISSON)} END"
    drawn = (f"SELECT {dim} AS d, {measure} AS x, b, md5('42:' || b || ':' || {key}) AS h FROM {cte}, range(125) AS t(b)"
             f" WHERE {measure} IS NOT NULL")
    weighed = f"SELECT d, x, b, j, {weight} AS w FROM ({drawn}) AS r, range(8) AS u(j)"
    means = f"SELECT d, b, j, sum(w * x) / sum(w) AS m FROM ({weighed}) AS v GROUP BY d, b, j HAVING sum(w) > 0"
    ends = f"SELECT d, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM ({means}) AS q GROUP BY d"
    base = f"SELECT {dim}, avg({measure}) AS mean, count({measure}) AS n FROM {cte} GROUP BY {dim}"
    return farm_sql(f"SELECT {dim}, {rnd('mean')} AS mean, n, {rnd('lo')} AS ci_low, {rnd('hi')} AS ci_high"
                    f" FROM ({base}) AS g LEFT JOIN ({ends}) AS e ON g.{dim} IS NOT DISTINCT FROM e.d")


@query("bootstrap_by_method", _bootstrap_sql("carbon_m", "farming_method", "carbon_footprint_kg_co2e", "farm_id"))
def q_bootstrap_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.bootstrap_mean(carbon_table(spark, sf_dir), "farming_method", "carbon_footprint_kg_co2e", "farm_id"))


@query("bootstrap_by_irrigation", _bootstrap_sql("water_m", "irrigation_method", "water_usage_cubic_meters", "water_id"))
def q_bootstrap_by_irrigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.bootstrap_mean(water_table(spark, sf_dir), "irrigation_method", "water_usage_cubic_meters", "water_id"))


@query("bootstrap_by_system", _bootstrap_sql("env_m", "farming_system", "overall_environmental_impact_score", "env_id"))
def q_bootstrap_by_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.bootstrap_mean(env_table(spark, sf_dir), "farming_system", "overall_environmental_impact_score", "env_id"))


# --- J1-J4, P10, A5: merges ---------------------------------------------------------------------

CARBON_COLS = ["farm_id", "crop_type", "farming_method", "farm_size_hectares", "fertilizer_kg_per_hectare",
               "machinery_hours", "transport_distance_km", "energy_consumption_kwh", "carbon_footprint_kg_co2e",
               "carbon_sequestration_potential_kg_co2e", "net_carbon_impact_kg_co2e"]
WATER_ONLY = ["water_id", "irrigation_method", "soil_type", "annual_rainfall_mm", "temperature_celsius",
              "growing_season_days", "water_usage_cubic_meters", "water_efficiency_cubic_meters_per_ton",
              "water_recycling_potential_percent"]
REGEN_ONLY = ["regen_id", "farm_type", "years_practicing_regenerative", "soil_organic_matter_percent_initial",
              *PRACTICE_COLUMNS, "total_practices_adopted", "soil_organic_matter_percent_current",
              "biodiversity_score", "economic_resilience_score"]
ENV_ONLY = ["env_id", "farming_system", "pesticide_use_kg_per_hectare", "fertilizer_use_kg_per_hectare",
            "energy_use_kwh_per_hectare", "water_use_cubic_meters_per_hectare", "biodiversity_impact_score",
            "soil_health_impact_score", "water_quality_impact_score", "air_quality_impact_score",
            "overall_environmental_impact_score"]


def _nsj(keys: list[str], a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys)


def _full_merge_sql(left: str, left_cols: list[str], right: str, right_cols: list[str], keys: list[str]) -> str:
    sel = [f"COALESCE(l.{c}, r.{c}) AS {c}" if c in keys else f"l.{c}" for c in left_cols]
    sel += [f"r.{c}" for c in right_cols if c not in keys]
    return f"SELECT {', '.join(sel)} FROM {left} l FULL OUTER JOIN {right} r ON {_nsj(keys, 'l', 'r')}"


_M1_COLS = CARBON_COLS + WATER_ONLY
_M2_COLS = _M1_COLS + REGEN_ONLY
J1_SQL = _full_merge_sql("carbon_m", CARBON_COLS, "water_m",
                         ["crop_type", "farm_size_hectares"] + WATER_ONLY, ["crop_type", "farm_size_hectares"])
J2_SQL = _full_merge_sql("m1", _M1_COLS, "regen_m", ["farm_size_hectares"] + REGEN_ONLY, ["farm_size_hectares"])
J3_SQL = _full_merge_sql("m2", _M2_COLS, "env_m", ["farm_type", "farm_size_hectares"] + ENV_ONLY,
                         ["farm_type", "farm_size_hectares"])
MERGE_CTES = FARM_CTES + [("m1", J1_SQL), ("m2", J2_SQL), ("m3", J3_SQL)]


def merged_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.merge_all(carbon_table(spark, sf_dir), water_table(spark, sf_dir),
                       regen_table(spark, sf_dir), env_table(spark, sf_dir))


@query("merge_common", farm_sql(J1_SQL))
def q_merge_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carbon and water full outer on (crop_type, farm_size_hectares), null keys matching."""
    return J.merge_common(carbon_table(spark, sf_dir), water_table(spark, sf_dir),
                          ["crop_type", "farm_size_hectares"])


_MEANS = ", ".join(f"avg({c}) AS {c}" for c in FILL_WITH_MEAN_COLUMNS)
_FILL_MEANS = ", ".join(f"{rnd(f'avg({c})', 4)} AS {c}" for c in FILL_WITH_MEAN_COLUMNS)
_M3_COLS = _M2_COLS + ENV_ONLY
_M3_CTES = MERGE_CTES + [("means", f"SELECT {_MEANS} FROM m3")]
MERGE_ALL_SQL = with_views(
    "SELECT " + ", ".join(
        f"COALESCE(m3.{c}, {rnd(f'means.{c}', 4)}) AS {c}" if c in FILL_WITH_MEAN_COLUMNS else f"m3.{c}" for c in _M3_COLS)
    + " FROM m3, means", *FARM_VIEWS, extra=_M3_CTES)


@query("merge_all", MERGE_ALL_SQL)
def q_merge_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 + P10: the four-table chain, then null -> mean (means over the joined rows, 1e-6).

    The merged rows are written once to the shared folder; the means and the output read them there."""
    merged = merged_chain(spark, sf_dir).withColumns({f"_{c}": F.col(c) for c in FILL_WITH_MEAN_COLUMNS})
    filled = fill_with_mean(merged, FILL_WITH_MEAN_COLUMNS, materialize=True)
    # only what was filled in is rounded for the report
    shown = {c: F.coalesce(f"_{c}", F.round(c, 4)) for c in FILL_WITH_MEAN_COLUMNS}
    return filled.withColumns(shown).drop(*[f"_{c}" for c in FILL_WITH_MEAN_COLUMNS])


@query("column_means", with_views(f"SELECT {_FILL_MEANS} FROM m3", *FARM_VIEWS, extra=MERGE_CTES))
def q_column_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: the fill means over the merged rows."""
    return rounded(S.column_means(merged_chain(spark, sf_dir), FILL_WITH_MEAN_COLUMNS), digits=4)


def _positional_sql(left: str, left_cols: list[str], left_key: str, right: str, right_cols: list[str],
                    right_key: str) -> str:
    return (f"WITH l AS (SELECT {', '.join(left_cols)}, row_number() OVER (ORDER BY {left_key}) - 1 AS _i FROM {left}),"
            f" r AS (SELECT {', '.join(right_cols)}, row_number() OVER (ORDER BY {right_key}) - 1 AS _j FROM {right})"
            f" SELECT {', '.join('l.' + c for c in left_cols)}, {', '.join('r.' + c for c in right_cols)}"
            " FROM l LEFT JOIN r ON l._i % (SELECT count(*) FROM r) = r._j")


SENSOR_COLS = ["event_id", "station_id", "event_time", "temperature", "humidity", "rainfall", "soil_moisture",
               "solar_radiation", "wind_speed"]


@query("merge_positional", farm_sql(
    "SELECT * FROM (" + _positional_sql("carbon_m", CARBON_COLS, "farm_id", "water_m", WATER_ONLY, "water_id") + ")"))
def q_merge_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carbon row i gets water row i mod n_water; the shared columns are dropped from water."""
    return J.merge_positional(carbon_table(spark, sf_dir), water_table(spark, sf_dir),
                              "farm_id", "water_id", drop_common=True)


@query("merge_positional_disjoint", with_views(
    "SELECT * FROM (" + _positional_sql("farm_carbon", CARBON_COLS[:8], "farm_id", "sensor_readings", SENSOR_COLS,
                                        "event_id") + ")", "farm_carbon", "sensor_readings"))
def q_merge_positional_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No shared columns: farm row i gets sensor row i mod n_sensor."""
    return J.merge_positional(view(spark, sf_dir, "farm_carbon"), view(spark, sf_dir, "sensor_readings"),
                              "farm_id", "event_id", drop_common=False)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean carbon footprint per farming method (S1 -> J5 -> F1 -> G1 -> A7)."""
    return mean_carbon_by_method(spark, sf_dir)
