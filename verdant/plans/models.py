"""Model queries: M9, M13-M19, M21, S10/S11 (saved once per source and reused), J6, R1, A6.

Training queries use the reference's model sizes; they always fit, and save the model under the
shared checkpoint folder. The scoring, importance and report queries reload it, as the reference
loads its saved model lazily on first predict, if it was fitted on the same rows and settings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verdant.ml import features as M
from verdant.ml import stages as P
from verdant.ml import train as T
from verdant.operators import clean as C
from verdant.operators import stats as S
from verdant.plans import farm as FARM
from verdant.plans.registry import DIGITS, query, rnd, rounded
from verdant.plans.sensors import readings_with_yield, training_windows
from verdant.sources.adapters import base_table, view, with_views

TABLES = {"carbon": FARM.carbon_table, "water": FARM.water_table, "environment": FARM.env_table}
_TRAINED: dict = {}


def fitted(spark: SparkSession, sf_dir: str, kind: str, mark: str | None = None) -> T.TrainResult:
    """A model fitted on the table as it is now, and saved with the mark of that table and the settings."""
    table = TABLES[kind](spark, sf_dir)
    mark = mark or T.fingerprint(table, kind)
    res = T.train_sustainability(table, kind)
    T.save_model(res, T.model_path(spark, kind, sf_dir.rstrip("/")), mark)
    _TRAINED[(spark.sparkContext.applicationId, kind, sf_dir.rstrip("/"))] = (mark, res)
    return res


def trained(spark: SparkSession, sf_dir: str, kind: str) -> T.TrainResult:
    """The model of (kind, source) for scoring: kept in this session, else loaded from the shared folder (S10,
    S11). One of other rows or other settings is not used; then the model is fitted and saved."""
    key = (spark.sparkContext.applicationId, kind, sf_dir.rstrip("/"))
    mark = T.fingerprint(TABLES[kind](spark, sf_dir), kind)
    if _TRAINED.get(key, ("",))[0] == mark:
        return _TRAINED[key][1]
    res = T.load_result(spark, T.model_path(spark, kind, key[2]), mark)
    if res is None:
        return fitted(spark, sf_dir, kind, mark)
    _TRAINED[key] = (mark, res)
    return res


def _metrics(res: T.TrainResult) -> DataFrame:
    return res.metrics.select("model", "cv_rmse", "test_rmse", "test_mae", "test_r2", "selected")


@query("train_carbon", heavy=True)
def q_train_carbon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest vs boosting for the footprint, chosen on 5-fold CV RMSE; test RMSE/MAE/R^2."""
    return _metrics(fitted(spark, sf_dir, "carbon"))


@query("train_water", heavy=True)
def q_train_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M14 (water): dummies + scaling, forest vs boosting chosen on test RMSE."""
    return _metrics(fitted(spark, sf_dir, "water"))


@query("train_env", heavy=True)
def q_train_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M14 (environment): dummies + scaling, forest vs boosting chosen on test RMSE."""
    return _metrics(fitted(spark, sf_dir, "environment"))


_CHECKED = [("carbon", "carbon_m", "farm_id", "carbon_footprint_kg_co2e"),
            ("environment", "env_m", "env_id", "overall_environmental_impact_score"),
            ("water", "water_m", "water_id", "water_usage_cubic_meters")]


def _check_sql(kind: str, table: str, key: str, target: str) -> str:
    part = f"substr(md5(CAST({key} AS VARCHAR) || '|42'), 1, 8) < '33333333'"
    guess = f"(SELECT avg({target}) FROM {table} WHERE NOT ({part}))"
    return (f"SELECT '{kind}' AS kind, count({target}) FILTER (NOT ({part})) AS n_train, count({target}) FILTER ({part}) AS n_test, "
            + rnd(f"sqrt(avg(({target} - {guess}) * ({target} - {guess})) FILTER ({part}))") + f" AS mean_rmse, true AS beats_mean FROM {table}")


@query("train_checks", FARM.farm_sql(" UNION ALL ".join(_check_sql(*c) for c in _CHECKED)), heavy=True)
def q_train_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts each model was fitted and tested on, and whether the selected model's test error is
    below that of always predicting the train part's mean."""
    out = []
    for kind, _, key, target in _CHECKED:
        res = trained(spark, sf_dir, kind)
        best = res.metrics.where("selected").select("test_rmse")
        split = M.train_test_split(TABLES[kind](spark, sf_dir).select(key, target), key)
        train, test = F.col("split") == "train", F.col("split") == "test"
        y = F.col(target)
        # the error of one guess m: mean of (y - m)^2 = variance + (mean - m)^2
        parts = split.agg(F.count(F.when(train, y)).alias("n_train"), F.count(F.when(test, y)).alias("n_test"),
                          F.avg(F.when(train, y)).alias("guess"), F.avg(F.when(test, y)).alias("middle"), F.var_pop(F.when(test, y)).alias("spread"))
        rmse = F.sqrt(F.col("spread") + (F.col("middle") - F.col("guess")) * (F.col("middle") - F.col("guess")))
        # two tables of one row each
        out.append(parts.join(best, F.lit(True)).select(F.lit(kind).alias("kind"), "n_train", "n_test", F.round(rmse, DIGITS).alias("mean_rmse"),
                                                        (F.col("test_rmse") < rmse).alias("beats_mean")))
    return out[0].unionByName(out[1]).unionByName(out[2])


_PRE_NUM = ["farm_size_hectares", "fertilizer_kg_per_hectare", "machinery_hours", "transport_distance_km",
            "energy_consumption_kwh", "carbon_sequestration_potential_kg_co2e", "net_carbon_impact_kg_co2e"]
_PRE_TRAIN = "substr(md5(CAST(farm_id AS VARCHAR) || '|42'), 1, 8) >= '33333333'"
_PRE_CATS = {"crop_type": ["Corn", "Cotton", "Potatoes", "Rice", "Soybeans", "Wheat"],
             "farming_method": ["Conservation", "Conventional", "Organic", "Precision", "Regenerative"]}
_PRE_SQL = with_views(
    "SELECT farm_id, [" + ", ".join(
        [rnd(f"(COALESCE({c}, {c}_med) - {c}_avg) / {c}_sd") for c in _PRE_NUM]
        + [f"CASE WHEN {c} = '{v}' THEN 1e0 ELSE 0e0 END" for c, vs in _PRE_CATS.items() for v in vs])
    + "] AS features FROM carbon_m, med, st", *FARM.FARM_VIEWS, extra=FARM.FARM_CTES + [
        ("med", "SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}_med" for c in _PRE_NUM) + f" FROM carbon_m WHERE {_PRE_TRAIN}"),
        ("st", "SELECT " + ", ".join(f"avg(COALESCE({c}, {c}_med)) AS {c}_avg, stddev_pop(COALESCE({c}, {c}_med)) AS {c}_sd"
                                     for c in _PRE_NUM) + f" FROM carbon_m, med WHERE {_PRE_TRAIN}")])


@query("preprocessor", _PRE_SQL)
def q_preprocessor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: impute + scale + one-hot + assemble fitted on the train split, applied to every farm."""
    df = M.train_test_split(FARM.carbon_table(spark, sf_dir), "farm_id")
    cats = ["crop_type", "farming_method"]
    num = [c for c in C.features_by_exclusion(df, cats, "carbon_footprint_kg_co2e") if c != "farm_id"]
    from pyspark.ml import Pipeline
    model = Pipeline(stages=P.preprocessor(num, cats)).fit(df.filter(F.col("split") == "train"))
    out = model.transform(df).select("farm_id", T.vector_column_to_array("features").alias("features"))
    return out.select("farm_id", F.transform("features", lambda x: F.round(x, DIGITS)).alias("features"))


@query("feature_importance", heavy=True)
def q_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importances of the selected carbon model, named numeric + ``col_value``."""
    res = trained(spark, sf_dir, "carbon")
    return T.feature_importance(spark, res.model, res.numeric)


@query("predict_carbon", heavy=True)
def q_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 -> P7 -> saved model on every farm (absent model columns get their defaults)."""
    res = trained(spark, sf_dir, "carbon")
    model = T.load_model(spark, T.model_path(spark, "carbon", sf_dir.rstrip("/")))
    df = view(spark, sf_dir, "farm_carbon")  # raw farms: sequestration / net come from P6
    return T.predict(df, "carbon", model, res.numeric, res.categorical, keep=["farm_id"])


@query("predict_default", with_views("SELECT farm_id, 5000e0 AS prediction, true AS is_default FROM farm_carbon",
                                     "farm_carbon"))
def q_predict_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M16 default arm: no saved model -> the constant for every farm, flagged."""
    missing = T.load_model(spark, T.model_path(spark, "carbon", "no-such-model"))
    return T.predict(view(spark, sf_dir, "farm_carbon"), "carbon", missing, keep=["farm_id"])


@query("evaluate_model", heavy=True)
def q_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 + A9 of the stored water model over the whole water table."""
    res = trained(spark, sf_dir, "water")
    return T.evaluate(FARM.water_table(spark, sf_dir), res.target, res.model, res.numeric, res.categorical)


@query("evaluate_carbon", heavy=True)
def q_evaluate_carbon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M17 of the stored carbon model over the whole farm table."""
    res = trained(spark, sf_dir, "carbon")
    return T.evaluate(FARM.carbon_table(spark, sf_dir), res.target, res.model, res.numeric, res.categorical)


@query("evaluate_env", heavy=True)
def q_evaluate_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M17 of the stored impact model over the whole environment table."""
    res = trained(spark, sf_dir, "environment")
    return T.evaluate(FARM.env_table(spark, sf_dir), res.target, res.model, res.numeric, res.categorical)


@query("train_tabular_classes", heavy=True)
def q_train_tabular_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M15, classification arm: the farming system from the other environment columns."""
    df = FARM.env_table(spark, sf_dir).drop("overall_environmental_impact_score")
    cols = [c for c in df.columns if c != "farming_system"] + ["farming_system"]
    return T.train_tabular(df.select(*cols), key="env_id", rounds=20).metrics


@query("sustainability_report", heavy=True)
def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 (+ J6, A6, A7): the merged farms scored by the three models; the summary and the means by group."""
    scorers = {}
    for col, kind in [("predicted_carbon", "carbon"), ("predicted_water", "water"), ("predicted_impact", "environment")]:
        r = trained(spark, sf_dir, kind)
        scorers[col] = (kind, r.model, r.numeric, r.categorical)
    merged = FARM.merged_chain(spark, sf_dir)
    scored = T.attach_predictions(merged, scorers)
    return T.report_rows(T.sustainability_report(scored))


@query("train_tabular", heavy=True)
def q_train_tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M15 (+ M12): generic predictor on the regenerative-farm table, target = last column."""
    df = FARM.regen_table(spark, sf_dir)
    cols = [c for c in df.columns if c != "economic_resilience_score"] + ["economic_resilience_score"]
    return T.train_tabular(df.select(*cols), key="regen_id").metrics


@query("forecast_sequence", heavy=True)
def q_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-step yield forecast from the previous 30 readings per station (time-ordered split)."""
    from verdant.functions.domain import SENSOR_FIELDS
    windows = training_windows(readings_with_yield(spark, sf_dir), stored=True)
    return T.forecast_sequence(windows, SENSOR_FIELDS, "yield").metrics


@query("classify_vectors", heavy=True)
def q_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled vectors -> class; best candidate on validation kept (W5), test accuracy."""
    return T.classify_vectors(base_table(spark, sf_dir, "embeddings")).metrics


@query("summary_report", with_views(" UNION ALL ".join(
    f"SELECT '{m}' AS Metric, {rnd(f'avg({c})')} AS Mean, {rnd(f'quantile_cont({c}, 0.5)')} AS Median,"
    f" {rnd(f'min({c})')} AS Min, {rnd(f'max({c})')} AS Max FROM scored"
    for m, c in [("Actual", "y_true"), ("Predicted", "y_pred")]), "scored"))
def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, exact Median, Min, Max per prediction column (one row each)."""
    return rounded(S.summary_report(view(spark, sf_dir, "scored"), {"Actual": "y_true", "Predicted": "y_pred"}))


@query("early_stop", heavy=True)
def q_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosting (reference size) stopped on a held-out fifth of the train rows without gain."""
    from pyspark.ml import Pipeline
    df = P.spread(M.train_test_split(FARM.regen_table(spark, sf_dir), "regen_id", 0.2, name="_v"))
    df = df.withColumn("is_val", F.col("_v") == "test")
    target = "economic_resilience_score"
    num = [c for c in C.features_by_exclusion(df, ["farm_type"], target) if c != "regen_id"]
    model = Pipeline(stages=P.preprocessor(num, ["farm_type"]) + [
        P.boosted_tabular(target, "regression", validation_col="is_val")]).fit(df)
    return spark.createDataFrame([(100, int(model.stages[-1].getNumTrees))], "max_rounds int, rounds_used int")
