"""Model pipeline properties (small tree counts, as the survey advises for tests)."""

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from verdant.ml import stages as P
from verdant.ml import train as T
from verdant.plans import farm as FARM

SF = "/root/testdata/sf0.001"


def test_unknown_category_encodes_to_zeros(spark):
    train = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "c")], "x double, c string")
    model = Pipeline(stages=P.preprocessor(["x"], ["c"])).fit(train)
    test = spark.createDataFrame([(1.0, "zzz"), (None, None), (2.0, "a")], "x double, c string")
    rows = [r.features.toArray().tolist() for r in model.transform(test).collect()]
    assert rows[0][1:] == [0.0, 0.0, 0.0]  # unknown -> all zeros
    assert rows[2][1:] == [1.0, 0.0, 0.0]
    assert rows[1][0] == pytest.approx(0.0)  # null imputed with the exact median 2.0, scaled to 0


def test_exact_imputer_median_and_mode(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, "a"), (10.0, "b"), (None, None)], "x double, c string")
    m = P.ExactImputer(numericCols=["x"], categoricalCols=["c"]).fit(df)
    out = m.transform(df).collect()[-1]
    assert out.x == 2.5 and out.c == "a"  # exact median; tie on the mode -> smallest


def test_train_predict_save_load(spark, tmp_path):
    df = FARM.carbon_table(spark, SF)
    res = T.train_sustainability(df, "carbon", num_trees=5, rounds=5)
    m = {r.model: r for r in res.metrics.collect()}
    assert set(m) == {"Random Forest", "Gradient Boosting"} and sum(r.selected for r in m.values()) == 1
    mean_rmse = df.agg(F.stddev_pop("carbon_footprint_kg_co2e")).first()[0]
    best = [r for r in m.values() if r.selected][0]
    assert best.test_rmse < mean_rmse  # better than predicting the mean
    imp = T.feature_importance(spark, res.model, res.numeric).collect()
    assert sum(r.Importance for r in imp) == pytest.approx(1.0)
    assert {"crop_type_Corn", "farming_method_Organic"} <= {r.Feature for r in imp}
    path = str(tmp_path / "carbon")
    T.save_model(res, path)
    loaded = T.load_model(spark, path)
    raw = FARM.view(spark, SF, "farm_carbon")
    a = T.predict(raw, "carbon", res.model, res.numeric, res.categorical, keep=["farm_id"]).orderBy("farm_id").collect()
    b = T.predict(raw, "carbon", loaded, res.numeric, res.categorical, keep=["farm_id"]).orderBy("farm_id").collect()
    assert [r.prediction for r in a] == pytest.approx([r.prediction for r in b])
    assert not any(r.is_default for r in a)


def test_training_fits_anew_and_scoring_checks_rows_and_settings(spark, tmp_path, monkeypatch):
    from verdant.plans import models
    df = FARM.water_table(spark, SF).persist()
    tables, fits, fit = {"now": df}, [], T.train_sustainability

    def small(table, kind, **settings):
        fits.append(table.count())
        return fit(table, kind, num_trees=2, rounds=2, **settings)

    monkeypatch.setattr(T, "train_sustainability", small)
    monkeypatch.setitem(models.TABLES, "water", lambda spark, sf_dir: tables["now"])
    n, source = df.count(), str(tmp_path)
    models.q_train_water(spark, source).collect()
    models._TRAINED.clear()  # as in a new session
    models.q_train_water(spark, source).collect()
    assert fits == [n, n]  # training trains, whatever is saved
    models._TRAINED.clear()
    tables["now"] = df.repartition(3)
    assert models.trained(spark, source, "water").numeric and fits == [n, n]  # the same rows: reloaded
    tables["now"] = df.limit(n - 10).persist()
    models.trained(spark, source, "water")
    assert fits == [n, n, n - 10]  # other rows, in the session that holds the old model
    models._TRAINED.clear()
    tables["now"] = tables["now"].withColumn("annual_rainfall_mm", F.col("annual_rainfall_mm") + 1)
    models.trained(spark, source, "water")
    assert fits == [n, n, n - 10, n - 10]  # as many rows with another value
    models._TRAINED.clear()
    forest = P.random_forest
    monkeypatch.setattr(P, "random_forest", lambda *a, **k: forest(*a, **{**k, "max_depth": 4}))
    models.trained(spark, source, "water")
    assert len(fits) == 5  # another setting
    path = T.model_path(spark, "water", source)
    mark = T.fingerprint(tables["now"], "water")
    assert T.load_result(spark, path, mark) is not None
    fit(tables["now"], "water", num_trees=2, rounds=2).model.write().overwrite().save(path)
    assert T.load_result(spark, path, mark) is None  # a model beside another one's metadata


def test_predict_without_model_uses_default(spark):
    df = spark.createDataFrame([(1,)], "farm_id int")
    r = T.predict(df, "water", None, keep=["farm_id"]).first()
    assert r.prediction == 3000.0 and r.is_default


def test_attach_predictions_keeps_rows_and_columns(spark):
    water = FARM.water_table(spark, SF)
    res = T.train_sustainability(water, "water", num_trees=3, rounds=3)
    out = T.attach_predictions(water, {"predicted_water": ("water", res.model, res.numeric, res.categorical)})
    assert out.count() == water.count()
    assert out.columns == water.columns + ["predicted_water"]
    ref = water.select("water_id", F.col("farm_size_hectares").alias("ref_size"))
    same = out.join(ref, "water_id").filter(F.col("farm_size_hectares").eqNullSafe(F.col("ref_size"))).count()
    assert same == water.count()  # original (unscaled) values kept


def test_tabular_classification_path(spark):
    df = FARM.view(spark, SF, "farm_water").select("water_id", "farm_size_hectares", "annual_rainfall_mm",
                                                   "temperature_celsius", "crop_type", "irrigation_method")
    res = T.train_tabular(df, key="water_id", rounds=3, folds=2)
    assert res.extra["task"] == "classification" and res.extra["n_classes"] == 5
    metrics = {r.metric: r.value for r in res.metrics.collect()}
    assert 0.0 <= metrics["accuracy"] <= 100.0 and "cv_mean" in metrics
    assert 0.0 <= metrics["macro_f1"] <= 1.0
    cm = res.extra["confusion_matrix"].collect()
    assert len(cm) == 25 and sum(r.n for r in cm) > 0  # 5 x 5 classes, zeros included
    assert {r["class"] for r in res.extra["classification_report"].collect()} >= {"accuracy", "macro avg"}


def test_drop_leaky_removes_target_determining_features(spark):
    df = FARM.carbon_table(spark, SF)
    res = T.train_sustainability(df, "carbon", drop_leaky=True, num_trees=3, rounds=3)
    assert not set(res.numeric) & set(T.LEAKY["carbon"])
    assert "farm_size_hectares" in res.numeric


def test_report_scores_once_and_returns_every_table(spark):
    df = spark.createDataFrame([("Organic", "Drip", 1.0, 2.0, 3.0), ("Organic", None, 3.0, 4.0, 5.0)],
                               "farming_method string, irrigation_method string, predicted_carbon double, predicted_water double, "
                               "predicted_impact double")
    rows = T.report_rows(T.sustainability_report(df)).collect()
    got = {(r.table, r.name): (r.n, r["mean"], r["min"]) for r in rows}
    assert got == {("summary", "Carbon Footprint"): (None, 2.0, 1.0), ("summary", "Water Usage"): (None, 3.0, 2.0),
                   ("summary", "Environmental Impact"): (None, 4.0, 3.0),
                   ("mean_predicted_carbon_by_farming_method", "Organic"): (2, 2.0, None),
                   ("mean_predicted_water_by_irrigation_method", "Drip"): (1, 2.0, None)}
