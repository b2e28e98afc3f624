"""Small golden tables for the domain formulas (hand-computed values, clip edges, nulls)."""

import math

import pytest
from pyspark.sql import functions as F

from verdant.functions import domain as D
from verdant.functions import generic as G


def one(spark, rows, schema, col):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


CARBON = ("crop_type string, farming_method string, farm_size_hectares double, fertilizer_kg_per_hectare double, "
          "machinery_hours double, transport_distance_km double, energy_consumption_kwh double")


def test_carbon_footprint(spark):
    rows = [("Wheat", "Organic", 100.0, 10.0, 20.0, 50.0, 1000.0),
            ("Wheat", "Organic", 100.0, 10.0, 20.0, 50.0, -10000.0),
            ("Rice", "Conventional", 100.0, None, 20.0, 50.0, 1000.0)]
    got = one(spark, rows, CARBON, D.carbon_footprint())
    assert got[0] == pytest.approx(2500 * 0.7 + 30 + 200 + 10 + 500)
    assert got[1] == 0.0  # floor at zero
    assert got[2] is None  # null input stays null


def test_carbon_unknown_crop_raises(spark):
    df = spark.createDataFrame([("Kale", "Organic", 1.0, 1.0, 1.0, 1.0, 1.0)], CARBON)
    with pytest.raises(Exception, match="unknown lookup key"):
        df.select(D.carbon_footprint()).collect()


def test_sequestration_and_net(spark):
    df = spark.createDataFrame([("Regenerative", 200.0), ("Other", 200.0)], "farming_method string, farm_size_hectares double")
    assert [r[0] for r in df.select(D.sequestration()).collect()] == [1000.0, 0.0]


WATER = ("crop_type string, irrigation_method string, soil_type string, farm_size_hectares double, "
         "temperature_celsius double, annual_rainfall_mm double")


def test_water(spark):
    df = spark.createDataFrame([("Rice", "Drip", "Clay", 50.0, 20.0, 0.0), ("Rice", "Rainfed", "Clay", 50.0, 20.0, 0.0)],
                               WATER)
    out = D.with_water_metrics(df).collect()
    assert out[0].water_usage_cubic_meters == pytest.approx(2400.0)
    assert out[0].water_efficiency_cubic_meters_per_ton == pytest.approx(240.0)
    assert out[0].water_recycling_potential_percent == 60.0
    assert out[1].water_recycling_potential_percent == 0.0


def test_regen(spark):
    schema = ("soil_organic_matter_percent_initial double, years_practicing_regenerative double, "
              "uses_a bigint, uses_agroforestry bigint, uses_crop_rotation bigint")
    df = spark.createDataFrame([(2.0, 20.0, 1, 1, 1), (2.0, 0.0, 0, 0, 0)], schema)
    out = D.with_regen_metrics(df.withColumnRenamed("uses_a", "uses_cover_crops")).collect()
    assert out[0].total_practices_adopted == 3
    assert out[0].soil_organic_matter_percent_current == pytest.approx(2.0 + 3 * 0.2)
    assert out[0].biodiversity_score == 10.0  # 5 + 2.4 + 2 + 1.5 = 10.9, clipped
    assert out[0].economic_resilience_score == pytest.approx(min(10, 4 + 2.1 + 4.0))
    assert out[1].soil_organic_matter_percent_current == 2.0
    assert out[1].biodiversity_score == 5.0


def test_biodiversity_clip(spark):
    df = spark.createDataFrame([(7, 1, 1)], "total_practices_adopted bigint, uses_agroforestry bigint, uses_crop_rotation bigint")
    assert df.select(D.biodiversity()).first()[0] == 10.0


def test_env_scores(spark):
    schema = ("farming_system string, pesticide_use_kg_per_hectare double, fertilizer_use_kg_per_hectare double, "
              "energy_use_kwh_per_hectare double")
    df = spark.createDataFrame([("Organic", 10.0, 300.0, 2000.0), ("Conventional", 0.0, 0.0, 0.0)], schema)
    out = D.with_env_metrics(df).collect()
    assert out[0].pesticide_use_kg_per_hectare == pytest.approx(2.0)
    assert out[0].fertilizer_use_kg_per_hectare == pytest.approx(180.0)
    assert out[0].biodiversity_impact_score == pytest.approx(8 - 2.5 + 0.2 * 3)
    assert out[0].soil_health_impact_score == pytest.approx(7 - 3 + 0.2 * 2 + 0.6 * 3)
    assert out[0].air_quality_impact_score == pytest.approx(5 - 1.5 + 5)
    assert out[1].biodiversity_impact_score == 8.0
    w = out[1]
    assert w.overall_environmental_impact_score == pytest.approx(
        0.3 * w.biodiversity_impact_score + 0.3 * w.soil_health_impact_score
        + 0.25 * w.water_quality_impact_score + 0.15 * w.air_quality_impact_score)


def test_yield(spark):
    df = spark.createDataFrame([(25.0, 35.0, 10.0), (25.0, 35.0, 5.0), (35.0, 35.0, 30.0)],
                               "temperature double, soil_moisture double, rainfall double")
    got = [r[0] for r in df.select(D.yield_estimate()).collect()]
    assert got[0] == pytest.approx(100 * 2 / 3)  # rain = 10 takes the second branch
    assert got[1] == pytest.approx(50.0)
    assert got[2] == pytest.approx(100 * (1 - 0.5 + 1 - 0.4) / 3)
    short = [r[0] for r in df.select(D.yield_estimate(rainfall=None)).collect()]
    assert short[0] == pytest.approx(50.0)


def test_season_and_expected(spark):
    df = spark.createDataFrame([("2024-01-01 06:00:00",)], "t string").select(F.to_timestamp("t").alias("event_time"))
    r = df.withColumns(D.season_factors()).withColumns(D.expected_readings()).first()
    assert r.daily_factor == pytest.approx(1.0)
    assert r.season_factor == pytest.approx(math.sin(2 * math.pi / 365))
    assert r.expected_temperature == pytest.approx(25 + 10 * r.season_factor + 5)
    assert r.expected_rainfall == 0.0  # floor


def test_generic(spark):
    df = spark.createDataFrame([(-1.0, "Cover Crops-x"), (None, "a b")], "x double, s string")
    out = df.select(G.clip("x", 0.0, 1.0).alias("c"), G.snake_name("s").alias("n")).collect()
    assert out[0].c == 0.0 and out[1].c is None  # null stays null (greatest/least would give a value)
    assert out[0].n == "cover_crops_x"
    arr = spark.createDataFrame([([1.0, 3.0, 3.0],)], "a array<double>")
    assert arr.select(G.argmax_class("a")).first()[0] == 1
