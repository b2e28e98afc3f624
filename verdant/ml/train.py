"""Training, selection, scoring and reporting flows.

Data never leaves the cluster: fits and evaluations are Spark jobs; the driver only sees models and metric
rows. The folds of all candidates are grown together from one binned table (``verdant.ml.trees``).
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from verdant.ml import features as M
from verdant.ml import stages as P
from verdant.ml import trees
from verdant.ml.ensemble import TreeEnsembleModel
from verdant.operators import clean as C
from verdant.operators import stats as S
from verdant.session import pin, shared_dir
from verdant.sources.tables import path_exists, save_metadata

CV_FOLDS = 5
# Constant predictions when no model exists (M16 default arm): carbon, water, environment.
DEFAULT_PREDICTION = {"carbon": 5000.0, "water": 3000.0, "environment": 5.0}


@dataclass
class TrainResult:
    model: PipelineModel
    metrics: DataFrame
    numeric: list[str]
    categorical: list[str]
    target: str
    extra: dict = field(default_factory=dict)


def rmse_of(pred: DataFrame, label: str, p: str = "prediction") -> float:
    e = F.col(label) - F.col(p)
    return pred.agg(F.sqrt(F.avg(e * e))).first()[0]


def _metric_row(name: str, pred: DataFrame, label: str, cv: list[float] | None, position: int):
    m = S.regression_metrics(pred, label, "prediction").first()
    cv_mean = sum(cv) / len(cv) if cv else None
    return (name, position, cv_mean, float(m.rmse), float(m.mae), float(m.r2))


METRICS_SCHEMA = "model string, position int, cv_rmse double, test_rmse double, test_mae double, test_r2 double"


def fit_all(train: DataFrame, label: str, key: str, stages: list, settings: list, fold: F.Column, folds) -> tuple:
    """Every model of ``settings`` on the whole train part and, for each of ``folds``, on the rest of it.

    The feature stages are fitted once and their output is binned once; all fits grow from that table.
    Returns the stages' model, one PipelineModel for each setting, and each one's errors on the held-out folds.
    """
    prepared = Pipeline(stages=stages).fit(train)
    rows = prepared.transform(train.withColumn("_fold", fold))
    tables: dict = {}
    models, errors = [None] * len(settings), [[] for _ in settings]
    for bins in sorted({s.bins for s in settings}):
        mine = [i for i, s in enumerate(settings) if s.bins == bins]
        table = tables.setdefault(bins, trees.bin_table(rows, label, F.col(key), F.col("_fold"), bins=bins))
        fits = [trees.Fit(settings[i], held) for i in mine for held in (None, *folds)]
        grown, held_out = trees.train(table, fits)
        for at, f in enumerate(fits):
            i = mine[at // (1 + len(folds))]
            if f.held is None:
                models[i] = PipelineModel(prepared.stages + [TreeEnsembleModel.of(grown[at], table.layout)])
            elif at in held_out:
                errors[i].append(held_out[at])
    return prepared, models, errors


def train_select(df: DataFrame, target: str, key: str, numeric: list[str], categorical: list[str],
                 candidates: dict, select_on: str = "cv", dummies: bool = False, seed: int = 42) -> TrainResult:
    """Split (M1), optional CV (M2/A16), fit every candidate, pick the best (O4) by CV or test RMSE."""
    spark = df.sparkSession
    data = P.ensure_parallelism(M.train_test_split(df.filter(F.col(target).isNotNull()), key, 0.2, seed))
    data = data.persist()
    train, test = data.filter(F.col("split") == "train"), data.filter(F.col("split") == "test")
    if dummies:
        cats = M.fit_categories(train, categorical)
        stages = P.dummies_preprocessor(numeric, categorical, cats)
    else:
        stages = P.preprocessor(numeric, categorical)
    folds = range(CV_FOLDS) if select_on == "cv" else ()
    prepared, fitted, cv = fit_all(train, target, key, stages, list(candidates.values()), M.fold_of(key, CV_FOLDS), folds)
    fitted = dict(zip(candidates, fitted))
    rows = []
    for pos, name in enumerate(candidates):
        scores = [e["rmse"] for e in cv[pos]] if folds else None
        rows.append(_metric_row(name, fitted[name].transform(test), target, scores, pos))
    metrics = spark.createDataFrame(rows, METRICS_SCHEMA)
    score = "cv_rmse" if select_on == "cv" else "test_rmse"
    best = S.best_model(metrics.withColumnRenamed(score, "score"), "model", "score", "position").first().best_model
    metrics = metrics.withColumn("selected", F.col("model") == F.lit(best))
    data.unpersist()
    return TrainResult(fitted[best], metrics, numeric, categorical, target, {"best": best})


# --- the three sustainability models (M13, M14) ---------------------------------------------------

LEAKY = {"carbon": ["carbon_sequestration_potential_kg_co2e", "net_carbon_impact_kg_co2e"],
         "water": ["water_efficiency_cubic_meters_per_ton"],
         "environment": ["biodiversity_impact_score", "soil_health_impact_score", "water_quality_impact_score",
                         "air_quality_impact_score"]}
MODEL_SPECS = {
    "carbon": dict(target="carbon_footprint_kg_co2e", key="farm_id", categorical=["crop_type", "farming_method"],
                   select_on="cv", dummies=False, rf_leaf=3),
    "water": dict(target="water_usage_cubic_meters", key="water_id",
                  categorical=["crop_type", "irrigation_method", "soil_type"], select_on="test", dummies=True, rf_leaf=1),
    "environment": dict(target="overall_environmental_impact_score", key="env_id",
                        categorical=["farm_type", "farming_system"], select_on="test", dummies=True, rf_leaf=1),
}


def sustainability_candidates(kind: str, num_trees: int = 100, rounds: int = 100) -> dict:
    return {"Random Forest": P.random_forest(MODEL_SPECS[kind]["rf_leaf"], num_trees),
            "Gradient Boosting": P.gradient_boosting(rounds)}


def fingerprint(df: DataFrame, kind: str, **settings) -> str:
    """What a sustainability model depends on: the rows of its table (their number and an order-free sum of
    hashes), its columns, and the settings of the fits. One aggregate over the table."""
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")).alias("h")).first()
    fits = {name: asdict(s) for name, s in sustainability_candidates(kind, **settings).items()}
    mark = [row.n, str(row.h), df.dtypes, sorted(MODEL_SPECS[kind].items()), CV_FOLDS, fits]
    return hashlib.md5(json.dumps(mark).encode()).hexdigest()


def train_sustainability(df: DataFrame, kind: str, drop_leaky: bool = False, num_trees: int = 100,
                         rounds: int = 100) -> TrainResult:
    """M13 (carbon: select on CV RMSE) and M14 (water, environment: select on test RMSE).

    Features are every numeric column but the key and target (P4) plus the categorical ones;
    ``drop_leaky`` removes the columns that determine the target (D5).
    """
    spec = MODEL_SPECS[kind]
    target, key, cats = spec["target"], spec["key"], spec["categorical"]
    numeric = [c for c in C.features_by_exclusion(df, cats, target) if c != key]
    if drop_leaky:
        numeric = [c for c in numeric if c not in LEAKY[kind]]
    cands = sustainability_candidates(kind, num_trees, rounds)
    return train_select(df.select(key, *numeric, *cats, target), target, key, numeric, cats, cands,
                        spec["select_on"], spec["dummies"])


# --- generic tabular predictor (M15) -----------------------------------------------------------------

def train_tabular(df: DataFrame, target: str | None = None, key: str | None = None, rounds: int = 100,
                  folds: int = CV_FOLDS) -> TrainResult:
    """P3 -> P9/M4/M6 (M9) -> M12 -> CV -> metrics (A8 or A10/A12).

    Every column but the target is a feature, as in the reference. ``key`` only seeds the
    split and folds; without one, a hash of the whole row does (reproducible, layout-free).
    """
    spark = df.sparkSession
    target, task = C.infer_task(df, target)
    feats = [c for c in df.columns if c != target]
    if key is None:
        key = "_row_key"
        df = df.withColumn(key, F.md5(F.to_json(F.struct(*[F.col(c) for c in df.columns]))))
    numeric = [c for c in S.numeric_columns(df) if c in feats]
    categorical = [c for c in S.string_columns(df) if c in feats]
    data = df.filter(F.col(target).isNotNull())
    n_classes = 0
    label = target
    if task == "classification":
        classes = S.class_list(data, target)
        n_classes = len(classes)
        data = M.label_encode(data, target, classes, name="_label")
        label = "_label"
    data = P.ensure_parallelism(M.train_test_split(data, key, 0.2)).persist()
    train, test = data.filter(F.col("split") == "train"), data.filter(F.col("split") == "test")
    extra_tables: dict = {}
    settings = P.second_order_boosting(task, n_classes, rounds)
    if task == "regression":
        fold = M.fold_of(key, folds)
    else:
        train = M.stratified_kfold(train, key, label, folds, name="_strat")
        fold = F.col("_strat")
    _, models, errors = fit_all(train, label, key, P.preprocessor(numeric, categorical), [settings], fold, range(folds))
    model = models[0]
    cv = [e["rmse" if task == "regression" else "accuracy"] for e in errors[0]]
    pred = model.transform(test)
    if task == "regression":
        m = S.regression_metrics(pred, label, "prediction").first()
        rows = [("mse", m.mse), ("rmse", m.rmse), ("mae", m.mae), ("r2", m.r2)]
    else:
        # A10-A12 on the test rows, with class names restored from the encoded labels
        names = F.array(*[F.lit(c) for c in classes])
        named = pred.select(F.element_at(names, F.col(label).cast("int") + 1).alias("label"),
                            F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"))
        acc = S.accuracy(named).first()
        report = S.classification_report(named)
        extra_tables["confusion_matrix"] = S.confusion_matrix(named)
        extra_tables["classification_report"] = report
        avg = {r["class"]: r.f1_score for r in report.filter(F.col("class").endswith("avg")).collect()}
        rows = [("accuracy", acc.accuracy), ("macro_f1", avg.get("macro avg")), ("weighted_f1", avg.get("weighted avg"))]
    cv_sd = (sum((x - sum(cv) / len(cv)) ** 2 for x in cv) / len(cv)) ** 0.5
    rows += [("cv_mean", sum(cv) / len(cv)), ("cv_std", cv_sd)]
    metrics = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in rows],
                                    "metric string, value double")
    if extra_tables:  # materialise the small report tables before the training data is released
        extra_tables = {k: spark.createDataFrame(v.collect(), v.schema) for k, v in extra_tables.items()}
    data.unpersist()
    return TrainResult(model, metrics, numeric, categorical, target,
                       {"task": task, "n_classes": n_classes, **extra_tables})


# --- sequence forecaster (M19, M20) --------------------------------------------------------------------

def window_vector(features: list[str], stats: dict, window: str = "window") -> F.Column:
    """Flattened, min-max scaled (train statistics) feature vector of a window of readings."""
    flat = F.flatten(F.transform(window, lambda s: F.array(*[s[c].cast("double") for c in features])))
    lo = F.array(*[F.lit(float(stats[c][0])) for c in features])
    rng = F.array(*[F.lit(float(stats[c][1] - stats[c][0]) or 1.0) for c in features])
    k = len(features)
    return array_to_vector(F.transform(flat, lambda x, i: (x - F.element_at(lo, (i % k) + 1))
                                       / F.element_at(rng, (i % k) + 1)))


def save_forecaster(res: "TrainResult", path: str) -> None:
    """The fitted model plus the min-max statistics it needs to score (JSON next to it)."""
    res.model.write().overwrite().save(os.path.join(path, "model"))
    meta = json.dumps({"features": res.numeric, "target": res.target, "stats": res.extra["stats"]})
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "meta"))


def load_forecaster(spark: SparkSession, path: str) -> "TrainResult":
    meta = json.loads(spark.read.text(os.path.join(path, "meta")).first().value)
    stats = {k: tuple(v) for k, v in meta["stats"].items()}
    return TrainResult(PipelineModel.load(os.path.join(path, "model")), None, meta["features"], [], meta["target"],
                       {"stats": stats})


def forecast_predict(windows: DataFrame, res: "TrainResult", window: str = "window") -> DataFrame:
    """Score windows with a forecaster: scaled vector -> model -> inverse-scaled ``prediction``."""
    stats, target = res.extra["stats"], res.target
    x = windows.withColumn("features", window_vector(res.numeric, stats, window))
    out = res.model.transform(x)
    return out.withColumn("prediction", M.minmax_inverse("prediction", {"prediction": stats[target]}))


def forecast_sequence(windows: DataFrame, features: list[str], target: str = "yield", test_fraction: float = 0.2,
                      learner: str = "linear", group: str = "station_id") -> TrainResult:
    """One-step-ahead target from the previous L readings (W1 output with ``_pos`` per group).

    Min-max scaling (M5) is fitted on the train part only (D6) and the prediction is mapped
    back (inverse) before MSE / R^2. The split is time-ordered: the last ``test_fraction`` of
    each group's windows is the test set. ``learner="boosting"`` uses boosted trees with early
    stopping on a held-out part of the train windows (M20). Windows of ``stored_windows`` are read several
    times and neither moved nor kept.
    """
    spark = windows.sparkSession
    stored = {"_first", "_last"} <= set(windows.columns)
    w, readings = windows, F.col("window")
    if stored:  # all windows of a group, one reading apart: each but the first adds its last reading
        w = windows.filter(F.col(group).isNotNull())
        readings = F.when(F.col("_pos") == F.col("_first"), F.col("window")).otherwise(F.slice("window", -1, 1))
    else:
        sizes = windows.groupBy(group).agg(F.max("_pos").alias("_last"), F.min("_pos").alias("_first"))
        # a window is many readings wide, which the planner's sizes do not know: windows are never broadcast
        w = windows.join(sizes.hint("merge"), group)
    cut = F.col("_first") + (F.col("_last") - F.col("_first") + 1) * F.lit(1 - test_fraction)
    w = w.withColumn("split", F.when(F.col("_pos") >= cut, "test").otherwise("train"))
    train_rows = w.filter(F.col("split") == "train")
    stats = M.fit_minmax(train_rows.select(F.explode(readings).alias("s"), F.col(target).alias("_target")).select("s.*", "_target"),
                         [*features, "_target"])
    stats[target] = stats.pop("_target")
    data = M.apply_minmax(w.withColumn("features", window_vector(features, stats)), {target: stats[target]},
                          suffix="_scaled")
    data = data.select(group, "event_id", "split", "features", target, f"{target}_scaled")
    if learner != "linear" or not stored:  # the linear fit is one pass
        data = P.ensure_parallelism(data).persist()
    model = (P.linear(f"{target}_scaled") if learner == "linear" else
             P.boosted_tabular(f"{target}_scaled", "regression", validation_col="_val"))
    train = data.filter(F.col("split") == "train")
    if learner != "linear":
        train = M.train_test_split(train, "event_id", 0.2, seed=11, name="_v").withColumn("_val", F.col("_v") == "test")
    fitted = PipelineModel([model.fit(train)])
    res = TrainResult(fitted, None, features, [], target, {"stats": stats})
    test = data.filter(F.col("split") == "test").drop("features")
    if stored and w.groupBy("event_id").count().where("count > 1 or event_id is null").isEmpty():
        test = w.filter(F.col("split") == "test")  # each has its window
    else:
        test = test.join(w.select("event_id", "window").hint("merge"), "event_id")
    pred = forecast_predict(test, res)
    m = S.regression_metrics(pred, target, "prediction").first()
    res.metrics = spark.createDataFrame([("mse", float(m.mse)), ("r2", float(m.r2)), ("rmse", float(m.rmse))],
                                        "metric string, value double")
    data.unpersist()
    return res


# --- labelled vectors (M21) ------------------------------------------------------------------------

def classify_vectors(df: DataFrame, vec: str = "embedding", label: str = "label", key: str = "vec_id",
                     regs=(0.0, 0.01, 0.1)) -> TrainResult:
    """Train one candidate per regularisation, keep the best on validation (W5 rule), report test accuracy."""
    spark = df.sparkSession
    data = M.train_test_split(df, key, 0.2, seed=42, name="_t")
    data = M.train_test_split(data, key, 0.2, seed=43, name="_v")
    data = data.withColumn("split", F.when(F.col("_t") == "test", "test").when(F.col("_v") == "test", "val")
                           .otherwise("train"))
    data = data.withColumn("features", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    data = P.ensure_parallelism(data.select(key, label, "split", "features")).persist()
    train = data.filter(F.col("split") == "train")
    rows, models = [], []
    for i, reg in enumerate(regs):
        mdl = P.classifier(label, reg=reg).fit(train)
        acc = {}
        for part in ("val", "test"):
            p = mdl.transform(data.filter(F.col("split") == part))
            acc[part] = p.agg(F.avg((F.col("prediction") == F.col(label).cast("double")).cast("double"))).first()[0]
        rows.append((i + 1, float(reg), 100.0 * (acc["val"] or 0.0), 100.0 * (acc["test"] or 0.0)))
        models.append(mdl)
    log = spark.createDataFrame(rows, "epoch int, reg double, val_accuracy double, test_accuracy double")
    from verdant.operators.windows import best_so_far
    log = best_so_far(log, "val_accuracy", "epoch", higher_is_better=True, name="is_best")
    best = max(range(len(rows)), key=lambda i: (rows[i][2], -i))
    data.unpersist()
    return TrainResult(PipelineModel([models[best]]), log, [], [], label, {"best_epoch": best + 1})


# --- persistence (S10, S11), scoring (M16, M17, J6), importances (M18) ---------------------------------

def model_path(spark: SparkSession, kind: str, source: str) -> str:
    """Where the model of a kind and a source is kept: the same in every session of one shared folder."""
    tag = hashlib.md5(source.encode()).hexdigest()[:10]
    return os.path.join(shared_dir(spark), "models", f"{kind}-{tag}")


def save_model(result: TrainResult, path: str, mark: str = "") -> str:
    """S10 + S11: PipelineModel, its feature lists and metrics, and the ``mark`` of what it was fitted on."""
    spark = result.metrics.sparkSession
    result.metrics.coalesce(1).write.mode("overwrite").parquet(path + "_metrics")
    save_metadata(spark, path + "_meta", result.target, result.extra.get("task", "regression"),
                  {**{k: v for k, v in result.extra.items() if isinstance(v, (str, int, float))},
                   "numeric": result.numeric, "categorical": result.categorical, "fingerprint": mark, "uid": result.model.uid})
    result.model.write().overwrite().save(path)  # last: a model that is there is complete
    return path


def load_model(spark: SparkSession, path: str) -> PipelineModel | None:
    """The saved model, or None when there is none."""
    return PipelineModel.load(path) if path_exists(spark, os.path.join(path, "metadata")) else None


def load_result(spark: SparkSession, path: str, mark: str = "") -> TrainResult | None:
    """S10 + S11: everything ``predict`` needs (model, feature lists, target, metrics), or None if there is no
    model with this ``mark``. The model's uid tells whether model and metadata were saved together."""
    model = load_model(spark, path)
    if model is None:
        return None
    meta = spark.read.schema("target_column string, task_type string, params map<string,string>").json(path + "_meta").first()
    params = {k: json.loads(v) for k, v in meta.params.items()}
    numeric, categorical = params.pop("numeric"), params.pop("categorical")
    if (params.pop("fingerprint", None), params.pop("uid", None)) != (mark, model.uid):
        return None
    return TrainResult(model, spark.read.parquet(path + "_metrics"), numeric, categorical, meta.target_column,
                       {**params, "task": meta.task_type})


def predict(df: DataFrame, kind: str, model: PipelineModel | None, numeric: list[str] | None = None,
            categorical: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """P6 defaults -> P7 alignment -> model. Without a model every row gets the constant
    default and ``is_default = true``; real scoring errors are raised, not hidden (D7)."""
    keep = keep or []
    if model is None:
        return df.select(*keep, F.lit(DEFAULT_PREDICTION[kind]).alias("prediction"), F.lit(True).alias("is_default"))
    filled = C.with_missing_defaults(df, kind)
    aligned = C.align_to_features(filled, numeric or [], categorical or [], keep=keep)
    return model.transform(aligned).select(*keep, "prediction", F.lit(False).alias("is_default"))


def evaluate(df: DataFrame, target: str, model: PipelineModel, numeric: list[str], categorical: list[str]) -> DataFrame:
    """A8 + A9 of a stored model on a table (full pipeline, D4 fixed)."""
    pred = model.transform(C.align_to_features(df, numeric, categorical, keep=[target]))
    e = F.col(target) - F.col("prediction")
    return pred.agg(F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
                    (F.lit(1.0) - F.sum(e * e) / (F.count(target) * F.var_pop(target))).alias("r2"),
                    F.avg(e).alias("residual_mean"), F.stddev_samp(e).alias("residual_std"))


def feature_names(model: PipelineModel, numeric: list[str]) -> list[str]:
    """Assembled feature names: numeric columns, then ``col_value`` per encoded category."""
    from pyspark.ml.feature import StringIndexerModel
    names = list(numeric)
    for st in model.stages:
        if isinstance(st, StringIndexerModel):
            for col, labels in zip(st.getInputCols(), st.labelsArray):
                names += [f"{col}_{v}" for v in labels]
        if isinstance(st, P.DummyModel):
            names += st.dummy_columns()
    return names


def feature_importance(spark: SparkSession, model: PipelineModel, numeric: list[str]) -> DataFrame:
    """(feature, importance) sorted descending; ``feature_i`` names when the counts differ."""
    last = model.stages[-1]
    imp = getattr(last, "featureImportances", None)
    if imp is None:
        coef = getattr(last, "coefficients", None)
        values = [abs(float(x)) for x in coef] if coef is not None else []
    else:
        values = [float(x) for x in imp.toArray()]
    names = feature_names(model, numeric)
    if len(names) != len(values):
        names = [f"feature_{i}" for i in range(len(values))]
    df = spark.createDataFrame(list(zip(names, values)), "Feature string, Importance double")
    return df.orderBy(F.desc("Importance"), F.asc("Feature"))


def attach_predictions(df: DataFrame, scorers: dict) -> DataFrame:
    """Add each model's prediction as a column on the same rows (chained transforms, no join).

    ``scorers`` maps output column -> (kind, model, numeric, categorical). The original row
    travels in a struct because the fitted scalers work in place.
    """
    out = df
    for name, (kind, model, numeric, categorical) in scorers.items():
        base = out.withColumn("_orig", F.struct(*[F.col(c) for c in out.columns]))
        filled = C.with_missing_defaults(base, kind)
        cols = set(filled.columns)
        feats = {c: (F.col(c).cast("double") if c in cols else F.lit(0.0)) for c in numeric}
        feats.update({c: (F.col(c).cast("string") if c in cols else F.lit("Unknown")) for c in categorical})
        ready = filled.withColumns(feats)
        scored = model.transform(ready) if model is not None else ready.withColumn(
            "prediction", F.lit(DEFAULT_PREDICTION[kind]))
        out = scored.select("_orig.*", F.col("prediction").alias(name))
    return out


def sustainability_report(scored: DataFrame, out_dir: str | None = None) -> dict[str, DataFrame]:
    """A6 summary of the three predictions and A7 means per method / irrigation / system.

    Returns the report tables (and writes them as parquet under ``out_dir`` when given). What they need of the
    scored rows is written once, so the models score each row one time.
    """
    dims = ["farming_method", "irrigation_method", "farming_system"]
    scored = pin(scored.select(*[c for c in dims if c in scored.columns], "predicted_carbon", "predicted_water", "predicted_impact"))
    tables = {"summary": S.summary_report(scored, {"Carbon Footprint": "predicted_carbon",
                                                   "Water Usage": "predicted_water",
                                                   "Environmental Impact": "predicted_impact"})}
    for dim, measure in [("farming_method", "predicted_carbon"), ("irrigation_method", "predicted_water"),
                         ("farming_system", "predicted_impact")]:
        if dim in scored.columns:  # P14: a missing discriminator skips that section
            tables[f"mean_{measure}_by_{dim}"] = S.mean_by(scored.filter(F.col(dim).isNotNull()), dim, measure)
    if out_dir:
        for name, t in tables.items():
            t.write.mode("overwrite").parquet(os.path.join(out_dir, name))
    return tables


def report_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """The report tables as one: (table, name, n, mean, median, std, min, max, ci_low, ci_high), name being the
    metric or the group; figures that a table does not have are null."""
    numbers = ["n", "mean", "median", "std", "min", "max", "ci_low", "ci_high"]

    def as_rows(name: str, t: DataFrame) -> DataFrame:
        t = t.withColumnsRenamed({c: c.lower() for c in t.columns})
        types = {"n": "long"}
        return t.select(F.lit(name).alias("table"), F.col(t.columns[0]).alias("name"), *[
            (F.col(c) if c in t.columns else F.lit(None)).cast(types.get(c, "double")).alias(c) for c in numbers])

    return reduce(DataFrame.unionByName, [as_rows(name, t) for name, t in tables.items()])


def vector_column_to_array(col: str) -> F.Column:
    return vector_to_array(F.col(col))
