"""Sensor-history queries: F12-F14, P11, P12, W1, W2, W8, O1, O3, G6-G8, S5, S6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verdant.functions import domain as D
from verdant.functions import generic as G
from verdant.operators import clean as C
from verdant.operators import stats as S
from verdant.operators import windows as W
from verdant.plans.registry import TDIGITS, query, rnd, rounded
from verdant.sources import sensor_json as SJ
from verdant.sources.adapters import base_table, view, with_views

WINDOW_LENGTH = 30
TIME_ORDER = ["event_time", "event_id"]


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "sensor_readings")


def readings_with_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.with_yield(readings(spark, sf_dir))


_DT, _DM = "(temperature - 25e0)", "(soil_moisture - 35e0)"
_TE, _ME = f"(-0.5e0 * ({_DT} * {_DT}) / 100e0)", f"(-0.5e0 * ({_DM} * {_DM}) / 100e0)"
_RE = "(CASE WHEN rainfall < 10e0 THEN 1e-1 * rainfall ELSE 1e0 - 2e-2 * (rainfall - 10e0) END)"
YIELD_SQL = f"100e0 * (1e0 + {_TE} + {_ME} + {_RE}) / 3e0"
YIELD_SHORT_SQL = f"100e0 * (1e0 + {_TE} + {_ME}) / 2e0"
READINGS_Y = [("readings_y", f"SELECT *, {YIELD_SQL} AS yield FROM sensor_readings")]


def sensor_sql(sql: str, extra=None) -> str:
    return with_views(sql, "sensor_readings", extra=READINGS_Y + (extra or []))


@query("yield_estimate", sensor_sql("SELECT event_id, station_id, yield FROM readings_y"))
def q_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the yield estimate of each reading."""
    return readings_with_yield(spark, sf_dir).select("event_id", "station_id", "yield")


@query("ensure_target", sensor_sql(f"SELECT event_id, {YIELD_SHORT_SQL} AS yield FROM sensor_readings"))
def q_ensure_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No target column -> the short-form yield from temperature and soil moisture."""
    df, target = C.ensure_target(readings(spark, sf_dir).drop("rainfall"), "yield")
    return df.select("event_id", target)


@query("ensure_target_arms", sensor_sql(
    "SELECT event_id, 'yield' AS present, yield AS present_value, 'humidity' AS fallback, humidity AS fallback_value FROM readings_y"))
def q_ensure_target_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12, the other arms: a target that is there is kept; without the inputs of a yield the first numeric column is it."""
    df = readings_with_yield(spark, sf_dir)
    kept, present = C.ensure_target(df, "yield")
    rest, fallback = C.ensure_target(df.select("humidity", "rainfall", "event_id"), "yield")
    both = kept.select("event_id", F.lit(present).alias("present"), F.col(present).alias("present_value"))
    other = rest.select(F.col("event_id").alias("id"), F.lit(fallback).alias("fallback"), F.col(fallback).alias("fallback_value"))
    return both.join(other, F.col("event_id") == F.col("id")).drop("id")


_SEASON = "sin(2e0 * pi() * dayofyear(event_time) / 365e0)"
_DAILY = "sin(2e0 * pi() * hour(event_time) / 24e0)"


@query("season_factors", sensor_sql(
    f"SELECT event_id, {rnd(_SEASON, TDIGITS)} AS season_factor, {rnd(_DAILY, TDIGITS)} AS daily_factor"
    " FROM sensor_readings"))
def q_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seasonal and daily sine factors of each reading time."""
    return rounded(readings(spark, sf_dir).select("event_id", *[v.alias(k) for k, v in D.season_factors().items()]),
                   digits=TDIGITS)


_EXPECTED_SQL = {
    "expected_temperature": "25e0 + 10e0 * s + 5e0 * d",
    "expected_humidity": "60e0 + 20e0 * s - 10e0 * d",
    "expected_rainfall": "CASE WHEN 5e0 * s - 2e0 * d < 0e0 THEN 0e0 ELSE 5e0 * s - 2e0 * d END",
    "expected_soil_moisture": "30e0 + 15e0 * s",
    "expected_solar_radiation": "CASE WHEN 8e2 + 4e2 * s + 3e2 * d < 0e0 THEN 0e0 ELSE 8e2 + 4e2 * s + 3e2 * d END",
    "expected_wind_speed": "5e0 + 2e0 * s + 3e0 * d",
}


@query("expected_readings", sensor_sql(
    "SELECT event_id, " + ", ".join(f"{rnd(v, TDIGITS)} AS {k}" for k, v in _EXPECTED_SQL.items())
    + ", " + rnd("temperature - (25e0 + 10e0 * s + 5e0 * d)", TDIGITS) + " AS temperature_residual"
    + f" FROM (SELECT *, {_SEASON} AS s, {_DAILY} AS d FROM sensor_readings)"))
def q_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """expected (deterministic) readings for the time, and the temperature residual."""
    df = readings(spark, sf_dir).withColumns(D.season_factors()).withColumns(D.expected_readings())
    df = df.withColumn("temperature_residual", F.col("temperature") - F.col("expected_temperature"))
    cols = list(D.expected_readings().keys()) + ["temperature_residual"]
    return rounded(df.select("event_id", *cols), digits=TDIGITS)


@query("parse_timestamp", sensor_sql(
    "SELECT event_id, CAST(CAST(event_time AS VARCHAR) AS TIMESTAMP) AS event_time FROM sensor_readings"))
def q_parse_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps written as text parse back to the same instants."""
    txt = readings(spark, sf_dir).select("event_id", F.col("event_time").cast("string").alias("event_time"))
    return C.parse_timestamp(txt, "event_time")


@query("datetime_parts", sensor_sql(
    "SELECT event_id, CAST(dayofyear(event_time) AS INTEGER) AS day_of_year, CAST(hour(event_time) AS INTEGER) AS hour_of_day,"
    " strftime(event_time, '%Y-%m-%dT%H:%M:%S') AS iso_text, strftime(event_time, '%Y%m%d_%H%M%S') AS stamp"
    " FROM sensor_readings"))
def q_datetime_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day of year, hour, ISO text and file-name stamp."""
    return readings(spark, sf_dir).select("event_id", *[v.alias(k) for k, v in G.datetime_parts("event_time").items()])


# --- windows (W1, W2), order (O1, O3), sampling (W8) -------------------------------------------------

def _window_sql(lo: int, hi: int) -> str:
    frame = f"ROWS BETWEEN {lo} PRECEDING AND {'1 PRECEDING' if hi == -1 else 'CURRENT ROW'}"
    return sensor_sql(
        "SELECT station_id, event_id, yield, n_steps, first_event_id, last_event_id,"
        f" {rnd('temperature_sum')} AS window_temperature_sum FROM ("
        " SELECT station_id, event_id, yield, count(*) OVER w AS n_steps, first_value(event_id) OVER w AS first_event_id,"
        " last_value(event_id) OVER w AS last_event_id, sum(temperature) OVER w AS temperature_sum"
        " FROM readings_y WINDOW w AS (PARTITION BY station_id ORDER BY event_time, event_id"
        f" {frame})) WHERE n_steps = {WINDOW_LENGTH}")


def _window_summary(df: DataFrame) -> DataFrame:
    w = F.col("window")
    return rounded(df.select(
        "station_id", "event_id", "yield", F.size(w).cast("bigint").alias("n_steps"),
        F.element_at(w, 1)["event_id"].alias("first_event_id"),
        F.element_at(w, -1)["event_id"].alias("last_event_id"),
        F.aggregate(w, F.lit(0.0), lambda acc, x: acc + x["temperature"]).alias("window_temperature_sum")),
        ["window_temperature_sum"])


def training_windows(df: DataFrame, length: int = WINDOW_LENGTH, target: str = "yield", stored: bool = False) -> DataFrame:
    """W1 per station: the ``length`` previous readings (all columns but the target) per target row. ``stored``: for
    readers that go through them more than once."""
    feats = ["event_id"] + D.SENSOR_FIELDS
    return (W.stored_windows if stored else W.sliding_windows)(df, feats, TIME_ORDER, "station_id", length, include_current=False)


def scoring_windows(df: DataFrame, length: int = WINDOW_LENGTH) -> DataFrame:
    """W2 per station: the ``length`` readings ending at each row."""
    feats = ["event_id"] + D.SENSOR_FIELDS
    return W.sliding_windows(df, feats, TIME_ORDER, "station_id", length, include_current=True)


@query("training_windows", _window_sql(WINDOW_LENGTH, -1))
def q_training_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window_summary(training_windows(readings_with_yield(spark, sf_dir)))


@query("scoring_windows", _window_sql(WINDOW_LENGTH - 1, 0))
def q_scoring_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window_summary(scoring_windows(readings_with_yield(spark, sf_dir)))


@query("sort_by_time", sensor_sql("SELECT * FROM sensor_readings ORDER BY event_time, event_id"))
def q_sort_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: readings in ascending time."""
    return S.sort_by_time(readings(spark, sf_dir))


@query("head", sensor_sql("SELECT * FROM sensor_readings ORDER BY event_time, event_id LIMIT 5"))
def q_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: the first five readings of the explicit time order."""
    return S.head(readings(spark, sf_dir), TIME_ORDER, 5)


@query("every_nth", sensor_sql(
    "SELECT * FROM sensor_readings QUALIFY row_number() OVER (ORDER BY event_time, event_id) % 100 = 0"))
def q_every_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 100th reading of the global time order."""
    return W.every_nth(readings(spark, sf_dir), 100, TIME_ORDER)


@query("time_grid", sensor_sql(
    "SELECT g.station_id, g.hour, COALESCE(c.n, 0) AS n_readings FROM g LEFT JOIN c"
    " ON g.station_id = c.station_id AND g.hour = c.hour", extra=[
        ("b", "SELECT station_id, date_trunc('hour', min(event_time)) AS lo,"
              " date_trunc('hour', max(event_time)) AS hi FROM sensor_readings GROUP BY station_id"),
        ("g", "SELECT station_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM b"),
        ("c", "SELECT station_id, date_trunc('hour', event_time) AS hour, count(*) AS n"
              " FROM sensor_readings GROUP BY 1, 2")]))
def q_time_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly grid per station from its first to its last reading, readings per hour (gaps = 0)."""
    r = readings(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "event_time"))
    bounds = r.groupBy("station_id").agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    grid = bounds.select("station_id", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    counts = r.groupBy("station_id", "hour").agg(F.count(F.lit(1)).alias("n_readings"))
    return (grid.join(counts, ["station_id", "hour"], "left")
                .withColumn("n_readings", F.coalesce("n_readings", F.lit(0)).cast("bigint")))


# --- JSON (G6, S5, S6, P15) -------------------------------------------------------------------------------

@query("json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def q_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field out of the JSON text column ``events.props``."""
    return base_table(spark, sf_dir, "events").select("event_id", G.json_field("props", "k").cast("int").alias("k"))


@query("sensor_json_roundtrip", sensor_sql("SELECT * FROM sensor_readings"))
def q_sensor_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 then S5: readings -> JSON message value -> parsed readings (same rows)."""
    msgs = SJ.to_sensor_json(readings(spark, sf_dir))
    good, _bad = SJ.parse_sensor_stream(msgs)
    return good


# what the event messages become: as they are, with text after them, cut short, or not objects
MALFORMED = {
    "whole": "props",
    "trailing": "concat(props, ' junk')",
    "cut": "substr(props, 1, length(props) - 1)",
    "number": "CAST(event_id AS VARCHAR(20))",
    "list": "concat('[', props, ']')",
    "mixed": "CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN concat(props, props) ELSE 'null' END",
}


@query("split_valid", (
    "SELECT source, count(*) FILTER (WHERE ok) AS n_good, count(*) FILTER (WHERE NOT ok) AS n_bad FROM ("
    " SELECT source, json_valid(value) AND json_type(CASE WHEN json_valid(value) THEN value END) = 'OBJECT' AS ok FROM ("
    + " UNION ALL ".join(f"SELECT '{k}' AS source, {v} AS value FROM events" for k, v in MALFORMED.items())
    + " UNION ALL SELECT 'pages', url FROM pages)) GROUP BY source"))
def q_split_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON messages split into parsed rows and a dead-letter set (counted per source)."""
    events = base_table(spark, sf_dir, "events")
    made = F.explode(F.array(*[F.struct(F.lit(k).alias("source"), F.expr(v).alias("value")) for k, v in MALFORMED.items()]))
    msgs = events.select(made.alias("m")).select("m.*").unionByName(
        base_table(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), F.col("url").alias("value")))
    parsed = SJ.parse_json_column(msgs, "value", "k int")
    return C.count_valid(parsed, "source")
