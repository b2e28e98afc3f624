"""Reference-shaped views over the driver's test tables (FIXTURES §B).

The farm tables of the sustainability pipeline and the hourly sensor history are derived
from the TPC-H-like tables by integer arithmetic, so both Spark and DuckDB produce
bit-identical rows. Each view is a list of ``(name, SQL expression)`` over one base table:
Spark evaluates it with ``selectExpr`` (a plain projection, fused into the parquet scan's
codegen stage with column pruning), the oracle embeds the same text as a CTE.

Products ``key * k % m`` are written ``(key % m) * k % m``: equal for the non-negative keys,
but without bigint overflow (ANSI raises) at cluster-scale key ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _hmod(key: str, k: int, m: int) -> str:
    return f"((({key} % {m}) * {k}) % {m})"


def _size(key: str) -> str:
    """Hectares, practically continuous: equal sizes come from equal keys, so joins on them grow with the tables."""
    return f"5 + {_hmod(key, 7919, 1000000007)} / 2000000e0"


def _case(expr: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE CAST({expr} AS INT) {whens} ELSE '{values[-1]}' END"


# Fixed category domains of the reference tables, in the reference's order.
CROPS = ["Wheat", "Corn", "Rice", "Soybeans", "Cotton", "Potatoes"]
FARMING_METHODS = ["Conventional", "Organic", "Conservation", "Precision", "Regenerative"]
IRRIGATION_METHODS = ["Flood", "Drip", "Sprinkler", "Subsurface", "Rainfed"]
SOIL_TYPES = ["Sandy", "Loamy", "Clay", "Silt", "Peat"]
FARM_TYPES = ["Crop", "Mixed", "Livestock", "Orchard", "Vegetable"]
FARMING_SYSTEMS = ["Conventional", "Organic", "Integrated", "Regenerative", "Biodynamic"]
PRACTICE_COLUMNS = ["uses_cover_crops", "uses_no_till", "uses_crop_rotation", "uses_composting",
                    "uses_agroforestry", "uses_managed_grazing", "uses_reduced_synthetic_inputs"]

VIEWS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "farm_carbon": ("orders", [
        ("farm_id", "o_orderkey"),
        ("crop_type", _case("o_orderkey % 6", CROPS)),
        ("farming_method", _case("o_custkey % 5", FARMING_METHODS)),
        ("farm_size_hectares", _size('o_orderkey')),
        ("fertilizer_kg_per_hectare",
         f"CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE {_hmod('o_orderkey', 104729, 3001)} / 10e0 END"),
        ("machinery_hours", f"10 + {_hmod('o_orderkey', 1299709, 1901)} / 10e0"),
        ("transport_distance_km", f"5 + {_hmod('o_orderkey', 15485863, 4951)} / 10e0"),
        ("energy_consumption_kwh", f"500 + {_hmod('o_orderkey', 32452843, 9501)} / 1e0"),
    ]),
    "farm_water": ("part", [
        ("water_id", "p_partkey"),
        ("crop_type", _case("p_partkey % 6", CROPS)),
        ("irrigation_method", _case("p_size % 5", IRRIGATION_METHODS)),
        ("soil_type", _case("(p_partkey + p_size) % 5", SOIL_TYPES)),
        ("farm_size_hectares",
         f"CASE WHEN p_partkey % 101 = 0 THEN NULL ELSE {_size('p_partkey')} END"),
        ("annual_rainfall_mm", f"200 + {_hmod('p_partkey', 104729, 13001)} / 10e0"),
        ("temperature_celsius", f"10 + {_hmod('p_partkey', 1299709, 251)} / 10e0"),
        ("growing_season_days", f"60 + {_hmod('p_partkey', 15485863, 1201)} / 10e0"),
    ]),
    "farm_regen": ("customer", [
        ("regen_id", "c_custkey"),
        ("farm_type", _case("c_nationkey % 5", FARM_TYPES)),
        ("farm_size_hectares", _size('c_custkey')),
        ("years_practicing_regenerative", f"{_hmod('c_custkey', 104729, 151)} / 10e0"),
        ("soil_organic_matter_percent_initial", f"1 + {_hmod('c_custkey', 1299709, 201)} / 100e0"),
        ("uses_cover_crops", "CAST(c_custkey % 2 AS BIGINT)"),
        ("uses_no_till", "CAST(((c_custkey % 2) * 3 + c_nationkey) % 2 AS BIGINT)"),
        ("uses_crop_rotation", f"CAST({_hmod('c_custkey', 7919, 11)} % 2 AS BIGINT)"),
        ("uses_composting", f"CAST({_hmod('c_custkey', 7919, 13)} % 2 AS BIGINT)"),
        ("uses_agroforestry", f"CAST({_hmod('c_custkey', 7919, 17)} % 2 AS BIGINT)"),
        ("uses_managed_grazing", f"CAST({_hmod('c_custkey', 7919, 19)} % 2 AS BIGINT)"),
        ("uses_reduced_synthetic_inputs", f"CAST({_hmod('c_custkey', 7919, 23)} % 2 AS BIGINT)"),
    ]),
    "farm_env": ("supplier", [
        ("env_id", "s_suppkey"),
        ("farm_type", _case("s_nationkey % 5", FARM_TYPES)),
        ("farming_system", _case("s_suppkey % 5", FARMING_SYSTEMS)),
        ("farm_size_hectares", _size('s_suppkey')),
        ("pesticide_use_kg_per_hectare", f"{_hmod('s_suppkey', 104729, 101)} / 10e0"),
        ("fertilizer_use_kg_per_hectare", f"{_hmod('s_suppkey', 1299709, 3001)} / 10e0"),
        ("energy_use_kwh_per_hectare", f"100 + {_hmod('s_suppkey', 15485863, 1901)} / 1e0"),
        ("water_use_cubic_meters_per_hectare", f"1000 + {_hmod('s_suppkey', 32452843, 9001)} / 1e0"),
    ]),
    "sensor_readings": ("events", [
        ("event_id", "event_id"),
        ("station_id", "user_id"),
        ("event_time", "CAST(ts AS TIMESTAMP)"),
        ("temperature", f"5 + {_hmod('event_id', 7919, 401)} / 10e0"),
        ("humidity", f"20 + {_hmod('event_id', 104729, 801)} / 10e0"),
        ("rainfall", "value / 20e0"),
        ("soil_moisture", f"10 + {_hmod('event_id', 1299709, 601)} / 10e0"),
        ("solar_radiation", f"{_hmod('event_id', 15485863, 1501)} / 1e0"),
        ("wind_speed", f"{_hmod('event_id', 32452843, 201)} / 10e0"),
    ]),
    "scored": ("lineitem", [
        ("l_orderkey", "l_orderkey"),
        ("l_linenumber", "l_linenumber"),
        ("y_true", "l_extendedprice"),
        ("y_pred", "l_quantity * 1500e0 + l_discount * 1000e0"),
        ("label", "l_returnflag"),
        ("predicted", "CASE WHEN l_partkey % 4 = 0 THEN 'N' ELSE l_returnflag END"),
    ]),
}


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables (S1 on parquet)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A reference-shaped view (farm_carbon, farm_water, farm_regen, farm_env, sensor_readings, scored)."""
    base, cols = VIEWS[name]
    return base_table(spark, sf_dir, base).selectExpr(*[f"{expr} AS {alias}" for alias, expr in cols])


def view_sql(name: str) -> str:
    """The same view as SQL text for the DuckDB oracle (``timestamp`` cast is a no-op there)."""
    base, cols = VIEWS[name]
    select = ",\n  ".join(f"{expr} AS {alias}" for alias, expr in cols)
    return f"SELECT\n  {select}\nFROM {base}"


def with_views(sql: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``sql`` with CTEs for the named views and extra ``(name, body)`` CTEs."""
    ctes = [f"{n} AS (\n{view_sql(n)}\n)" for n in names]
    ctes += [f"{n} AS (\n{body}\n)" for n, body in (extra or [])]
    return ("WITH " + ",\n".join(ctes) + "\n" + sql) if ctes else sql


def documents_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a file listing: id and size only (the text column is pruned from the scan)."""
    return base_table(spark, sf_dir, "documents").select(
        F.col("doc_id"), F.col("n_chars").alias("length"))
