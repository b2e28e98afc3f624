"""Schema-level helpers (P2-P4, P13, U2) and early stopping."""

import pytest
from pyspark.sql import functions as F

from verdant.ml import stages as P
from verdant.operators import clean as C
from verdant.operators import joins as J
from verdant.operators import stats as S


def test_columns_by_type_accepts_every_numeric_type(spark):
    df = spark.createDataFrame([(1, 2, 3.0, "a", None)], "a int, b bigint, c double, d string, t timestamp")
    kinds = {r.column_name: r.kind for r in S.columns_by_type(df).collect()}
    assert kinds == {"a": "numeric", "b": "numeric", "c": "numeric", "d": "string", "t": "other"}


def test_infer_task_and_split(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "id int, v double, label string")
    assert C.infer_task(df) == ("label", "classification")
    assert C.infer_task(df, "v") == ("v", "regression")
    with pytest.raises(C.MissingColumnError):
        C.split_xy(df, "nope")
    assert C.features_by_exclusion(df, ["label"], "v") == ["id"]


def test_require_rows_and_common_columns(spark):
    df = spark.range(31)
    assert C.require_rows(df, 30) and not C.require_rows(df, 31)
    a = spark.createDataFrame([(1, 2)], "x int, k int")
    b = spark.createDataFrame([(1, 2)], "k int, y int")
    assert J.common_columns(a, b) == ["k"]


def test_ensure_target_falls_back_to_first_numeric(spark):
    df = spark.createDataFrame([(1.0, "a")], "humidity double, s string")
    _, target = C.ensure_target(df)
    assert target == "humidity"


def test_boosting_stops_early_on_validation(spark):
    rows = [(float(i % 7), float(i % 7) * 2.0, i % 5 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "x double, y double, is_val boolean")
    from pyspark.ml.feature import VectorAssembler
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    model = P.boosted_tabular("y", "regression", rounds=50, validation_col="is_val").fit(data)
    assert model.getNumTrees < 50


def test_missing_defaults_without_discriminator(spark):
    df = spark.createDataFrame([(1, 100.0)], "env_id int, fertilizer_kg_per_hectare double")
    r = C.with_missing_defaults(df, "environment").first()
    assert (r.soil_health_impact_score, r.water_quality_impact_score, r.biodiversity_impact_score,
            r.air_quality_impact_score) == (6.0, 5.5, 5.5, 6.0)
    assert r.fertilizer_use_kg_per_hectare == 100.0  # copied from the carbon-side column
    c = C.with_missing_defaults(spark.createDataFrame([(1,)], "farm_id int"), "carbon").first()
    assert c.carbon_sequestration_potential_kg_co2e == 1000.0 and c.net_carbon_impact_kg_co2e == 2000.0
    w = C.with_missing_defaults(spark.createDataFrame([(1, "Rainfed")], "water_id int, irrigation_method string"),
                                "water").first()
    assert w.water_efficiency_cubic_meters_per_ton == 30.0 and w.water_recycling_potential_percent == 30.0
