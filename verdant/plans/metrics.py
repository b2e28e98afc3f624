"""Evaluation queries over truth/prediction pairs (``scored``) and class scores (``embeddings``):
A8-A13, A15-A18, O4, W5, W6, G9, G10, G1, R2, M8."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from verdant.functions import generic as G
from verdant.ml import features as M
from verdant.operators import stats as S
from verdant.operators import windows as W
from verdant.plans.farm import carbon_table, env_table, farm_sql, water_table
from verdant.plans.registry import TDIGITS, dlit, query, rnd, rounded
from verdant.sources.adapters import base_table, view, with_views

N_CLASSES = 10


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "scored")


def scored_sql(sql: str, extra=None) -> str:
    return with_views(sql, "scored", extra=extra)


_E = "(y_true - y_pred)"


@query("regression_metrics", scored_sql(
    f"SELECT {rnd(f'avg({_E} * {_E})')} AS mse, {rnd(f'sqrt(avg({_E} * {_E}))')} AS rmse,"
    f" {rnd(f'avg(abs({_E}))')} AS mae,"
    f" {rnd(f'1e0 - sum({_E} * {_E}) / (count(y_true) * var_pop(y_true))')} AS r2 FROM scored"))
def q_regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MSE, RMSE, MAE and R^2 of the scored pairs."""
    return rounded(S.regression_metrics(scored(spark, sf_dir)))


@query("residual_stats", scored_sql(
    f"SELECT {rnd(f'avg({_E})')} AS residual_mean, {rnd(f'stddev_samp({_E})')} AS residual_std FROM scored"))
def q_residual_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and sample std of the residuals."""
    return rounded(S.residual_stats(scored(spark, sf_dir)))


@query("accuracy", scored_sql(
    f"SELECT {rnd('100e0 * avg(CASE WHEN predicted = label THEN 1e0 ELSE 0e0 END)')} AS accuracy FROM scored"))
def q_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: percentage of correct class predictions."""
    return rounded(S.accuracy(scored(spark, sf_dir)))


_CLASSES = ("classes", "SELECT label AS c FROM scored UNION SELECT predicted FROM scored")
_CM_SQL = ("SELECT a.c AS label, b.c AS predicted, count(s.label) AS n FROM classes a CROSS JOIN classes b"
           " LEFT JOIN scored s ON s.label = a.c AND s.predicted = b.c GROUP BY a.c, b.c")


@query("confusion_matrix", scored_sql(_CM_SQL, extra=[_CLASSES]))
def q_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense label x predicted counts, zeros included."""
    return S.confusion_matrix(scored(spark, sf_dir))


_REPORT_SQL = (
    "SELECT class, " + ", ".join(f"{rnd(c)} AS {c}" for c in ["precision", "recall", "f1_score"]) + ", CAST(support AS BIGINT) AS support FROM ("
    " SELECT label AS class, precision, recall, f1_score, support FROM per"
    " UNION ALL SELECT 'accuracy', sum(tp) * 1e0 / sum(support), sum(tp) * 1e0 / sum(support),"
    "  sum(tp) * 1e0 / sum(support), sum(support) FROM per"
    " UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support) FROM per"
    " UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),"
    "  sum(f1_score * support) / sum(support), sum(support) FROM per)")
_PER = ("per", "SELECT label, tp, support, precision, recall,"
        " COALESCE(CASE WHEN precision + recall = 0 THEN NULL ELSE 2e0 * precision * recall / (precision + recall) END, 0e0)"
        " AS f1_score FROM (SELECT t.label, t.tp, t.support,"
        " COALESCE(CASE WHEN p.pred_n = 0 THEN NULL ELSE t.tp * 1e0 / p.pred_n END, 0e0) AS precision,"
        " COALESCE(CASE WHEN t.support = 0 THEN NULL ELSE t.tp * 1e0 / t.support END, 0e0) AS recall"
        " FROM (SELECT label, sum(CASE WHEN label = predicted THEN n ELSE 0 END) AS tp, sum(n) AS support FROM cm"
        " GROUP BY label) t JOIN (SELECT predicted AS label, sum(n) AS pred_n FROM cm GROUP BY predicted) p"
        " ON t.label = p.label)")


@query("classification_report", scored_sql(_REPORT_SQL, extra=[_CLASSES, ("cm", _CM_SQL), _PER]))
def q_classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-class precision/recall/F1/support plus accuracy, macro and weighted averages."""
    return rounded(S.classification_report(scored(spark, sf_dir)))


@query("class_count", scored_sql("SELECT count(DISTINCT label) AS n_classes FROM scored"))
def q_class_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of distinct labels."""
    return S.class_count(scored(spark, sf_dir))


@query("label_encode", scored_sql(
    "SELECT l_orderkey, l_linenumber, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_index"
    " FROM scored"))
def q_label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: class -> rank in the sorted class list."""
    df = scored(spark, sf_dir)
    return M.label_encode(df, "label", name="label_index").select("l_orderkey", "l_linenumber", "label", "label_index")


@query("axis_bounds", scored_sql(
    "SELECT min(y_true) AS y_min, max(y_true) AS y_max, least(min(y_true), min(y_pred)) AS lo,"
    " greatest(max(y_true), max(y_pred)) AS hi FROM scored"))
def q_axis_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges for the actual-vs-predicted reference line."""
    return S.axis_bounds(scored(spark, sf_dir))


@query("scatter_data", scored_sql(
    f"SELECT l_orderkey, l_linenumber, y_true, y_pred, {_E} AS residual FROM scored"))
def q_scatter_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: actual vs predicted and residual vs predicted point sets."""
    return scored(spark, sf_dir).select("l_orderkey", "l_linenumber", "y_true", "y_pred",
                                        (F.col("y_true") - F.col("y_pred")).alias("residual"))


_POINTS = [("carbon", "farm_id", "carbon_footprint_kg_co2e", "carbon_m"),
           ("water", "water_id", "water_usage_cubic_meters", "water_m"),
           ("impact", "env_id", "overall_environmental_impact_score", "env_m")]


@query("size_points", farm_sql(" UNION ALL ".join(
    f"SELECT '{name}' AS chart, CAST({key} AS BIGINT) AS id, farm_size_hectares AS x, {y} AS y FROM {cte}"
    for name, key, y, cte in _POINTS)))
def q_size_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: farm size vs footprint, water usage and impact score, one point set each."""
    tables = {"carbon": carbon_table, "water": water_table, "impact": env_table}
    sets = [tables[name](spark, sf_dir).select(F.lit(name).alias("chart"), F.col(key).cast("bigint").alias("id"),
                                               F.col("farm_size_hectares").alias("x"), F.col(y).alias("y"))
            for name, key, y, _ in _POINTS]
    return sets[0].unionByName(sets[1]).unionByName(sets[2])


@query("clip", scored_sql(
    "SELECT l_orderkey, l_linenumber, CASE WHEN y_pred < 5e3 THEN 5e3 WHEN y_pred > 5e4 THEN 5e4 ELSE y_pred END"
    " AS y_pred_clipped, CASE WHEN y_true - y_pred < 0e0 THEN 0e0 ELSE y_true - y_pred END AS under_forecast"
    " FROM scored"))
def q_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: clip to a range and floor at zero (null stays null)."""
    df = scored(spark, sf_dir)
    return df.select("l_orderkey", "l_linenumber", G.clip("y_pred", 5e3, 5e4).alias("y_pred_clipped"),
                     G.floor_at(F.col("y_true") - F.col("y_pred"), 0.0).alias("under_forecast"))


# --- cross-validation summary (M2 folds + A16) and model choice (O4) -----------------------------------

_ROW_KEY_SQL = "concat_ws('-', l_orderkey, l_linenumber)"
_FOLD_SQL = f"CAST(('0x' || substr(md5({_ROW_KEY_SQL} || '|42'), 1, 8)) AS BIGINT) % 5"


def scored_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).withColumn("row_key", F.concat_ws("-", "l_orderkey", "l_linenumber"))


@query("cv_summary", scored_sql(
    f"SELECT {rnd('avg(sqrt(mse))')} AS cv_rmse_mean, {rnd('stddev_pop(sqrt(mse))')} AS cv_rmse_std,"
    f" count(*) AS n_folds FROM (SELECT {_FOLD_SQL} AS fold, avg({_E} * {_E}) AS mse FROM scored GROUP BY fold)"))
def q_cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16 over hash folds (M2): mean and population std of the per-fold RMSE."""
    folds = M.kfold(scored_keyed(spark, sf_dir), "row_key", 5)
    e = F.col("y_true") - F.col("y_pred")
    per_fold = folds.groupBy("fold").agg(F.avg(e * e).alias("mse"))
    return rounded(S.cv_summary(per_fold))


@query("best_model", scored_sql(
    "SELECT arg_min(label, rmse) AS best_model, round(min(rmse), 6) AS best_score FROM ("
    f" SELECT label, sqrt(avg({_E} * {_E})) AS rmse FROM scored GROUP BY label)"))
def q_best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Argmin of RMSE across candidates (here: one candidate per label group), first wins ties."""
    df = scored(spark, sf_dir)
    e = F.col("y_true") - F.col("y_pred")
    results = df.groupBy(F.col("label").alias("model")).agg(F.sqrt(F.avg(e * e)).alias("score"))
    results = results.withColumn("position", F.col("model"))
    return rounded(S.best_model(results))


# --- class scores from embeddings (G9, G10, A17, A18, W5, W6) ------------------------------------------

def class_scores(emb: str = "embedding", k: int = N_CLASSES) -> Column:
    """Fold a vector into k class scores: score[c] = sum of the elements at positions = c (mod k)."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.aggregate(
        F.filter(F.col(emb), lambda x, i: i % k == c), F.lit(0.0), lambda acc, x: acc + x.cast("double")))


_SCORES_SQL = (f"list_transform(range({N_CLASSES}), lambda c: list_reduce(list_transform(list_filter(embedding,"
               f" lambda x, i: (i - 1) % {N_CLASSES} = c), lambda x: CAST(x AS DOUBLE)), lambda a, b: a + b))")
_LSE = "(list_max(scores) + ln(list_reduce(list_transform(scores, lambda x: exp(x - list_max(scores))), lambda a, b: a + b)))"
_CE = f"({_LSE} - scores[label + 1])"
_SCORED_EMB = ("emb", f"SELECT vec_id, label, {_SCORES_SQL} AS scores FROM embeddings")


def scored_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_table(spark, sf_dir, "embeddings").select("vec_id", "label", class_scores().alias("scores"))


@query("argmax_class", with_views(
    "SELECT vec_id, label, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS predicted FROM emb",
    extra=[_SCORED_EMB]))
def q_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted class = index of the largest score (first on ties)."""
    return scored_embeddings(spark, sf_dir).select("vec_id", "label", G.argmax_class("scores").alias("predicted"))


@query("log_loss", with_views(
    f"SELECT {rnd(f'avg({_CE})', TDIGITS)} AS log_loss, count(*) AS n FROM emb", extra=[_SCORED_EMB]))
def q_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row mean of the cross-entropy of the true class."""
    return rounded(S.log_loss(scored_embeddings(spark, sf_dir)), digits=TDIGITS)


_MEANS = "[" + ", ".join(dlit(v) for v in G.IMAGE_MEAN) + "]"
_STDS = "[" + ", ".join(dlit(v) for v in G.IMAGE_STD) + "]"


@query("normalise_array", with_views(
    f"SELECT vec_id, list_transform(embedding, lambda x, i: (CAST(x AS DOUBLE) - {_MEANS}[((i - 1) % 3) + 1])"
    f" / {_STDS}[((i - 1) % 3) + 1]) AS normalised FROM embeddings"))
def q_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-channel (x - mean) / std with the fixed image constants."""
    return base_table(spark, sf_dir, "embeddings").select(
        "vec_id", G.normalise_array("embedding", G.IMAGE_MEAN, G.IMAGE_STD).alias("normalised"))


# epoch log: each vector scored once per "epoch" = hash fold (M2) of vec_id, split by M1
_EPOCH_SQL = ("SELECT CAST(CAST(('0x' || substr(md5(CAST(vec_id AS VARCHAR) || '|42'), 1, 8)) AS BIGINT) % 5 + 1 AS INTEGER)"
              " AS epoch,"
              " CASE WHEN substr(md5(CAST(vec_id AS VARCHAR) || '|7'), 1, 8) < '33333333' THEN 'test' ELSE 'train' END"
              f" AS split, {_CE} AS loss, CASE WHEN list_position(scores, list_max(scores)) - 1 = label THEN 1 ELSE 0 END"
              " AS correct FROM emb")
_EPOCHS = ("epochs", "SELECT epoch, split, avg(loss) AS loss, 100e0 * avg(correct * 1e0) AS accuracy, count(*) AS n"
                     " FROM log GROUP BY epoch, split")


def epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored_embeddings(spark, sf_dir)
    df = M.kfold(df, "vec_id", 5, seed=42, name="epoch").withColumn("epoch", F.col("epoch") + 1)
    df = M.train_test_split(df, "vec_id", 0.2, seed=7)
    return df.select("epoch", "split", S.cross_entropy(F.col("scores"), F.col("label")).alias("loss"),
                     (G.argmax_class("scores") == F.col("label")).cast("int").alias("correct"))


@query("epoch_metrics", with_views(
    f"SELECT epoch, split, {rnd('loss', TDIGITS)} AS loss, {rnd('accuracy')} AS accuracy, n FROM epochs",
    extra=[_SCORED_EMB, ("log", _EPOCH_SQL), _EPOCHS]))
def q_epoch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss and accuracy per epoch and split."""
    m = S.epoch_metrics(epoch_log(spark, sf_dir))
    return rounded(rounded(m, ["loss"], TDIGITS), ["accuracy"])


@query("best_so_far", with_views(
    "SELECT epoch, split, round(accuracy, 6) AS accuracy, accuracy > COALESCE(max(accuracy) OVER (PARTITION BY split"
    " ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS is_best FROM epochs",
    extra=[_SCORED_EMB, ("log", _EPOCH_SQL), _EPOCHS]))
def q_best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs whose accuracy beats every earlier epoch of the split."""
    m = S.epoch_metrics(epoch_log(spark, sf_dir))
    out = W.best_so_far(m, "accuracy", "epoch", "split").select("epoch", "split", "accuracy", "is_best")
    return rounded(out, ["accuracy"])


# long runs: every vector is scored in one of 48 "epochs"; the loss falls in steps, drifts below the rate
# rule's least drop, and from epoch 31 on stays put
_RUN_EPOCHS = 48
_RUN_LOSS = ("1e0 - 1e-2 * least(floor((epoch - 1) / 8e0), 3e0) - 2e-5 * least(epoch, 30)"
             " + CASE WHEN split = 'test' AND epoch % 3 = 0 THEN 5e-3 ELSE 0e0 END")
_RUNS = ("runs", f"SELECT split, epoch, {_RUN_LOSS} AS loss, n FROM (SELECT CAST(vec_id % {_RUN_EPOCHS} + 1 AS INTEGER) AS epoch,"
                 " CASE WHEN label < 5 THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM embeddings GROUP BY 1, 2)")


@query("best_so_far_loss", with_views(
    f"SELECT epoch, split, {rnd('loss', TDIGITS)} AS loss, loss < COALESCE(min(loss) OVER (PARTITION BY split ORDER BY epoch"
    " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST('Infinity' AS DOUBLE)) AS is_best FROM epochs",
    extra=[_SCORED_EMB, ("log", _EPOCH_SQL), _EPOCHS]))
def q_best_so_far_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5, lower is better: epochs whose loss is below every earlier epoch's of the split."""
    m = S.epoch_metrics(epoch_log(spark, sf_dir))
    out = W.best_so_far(m, "loss", "epoch", "split", higher_is_better=False).select("epoch", "split", "loss", "is_best")
    return rounded(out, ["loss"], TDIGITS)


@query("plateau",
       "WITH RECURSIVE " + f"{_RUNS[0]} AS ({_RUNS[1]}), r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY epoch) AS i FROM runs),"
       " f AS (SELECT split, epoch, n, i, loss AS best, 0 AS wait, false AS stop, loss AS lr_best, 0 AS lr_wait, 0 AS cuts, 1e-3::DOUBLE AS lr"
       "  FROM r WHERE i = 1 UNION ALL"
       "  SELECT split, epoch, n, i, least(best, loss), w, stop OR w >= 10, CASE WHEN lw = 0 THEN loss ELSE lr_best END,"
       "   CASE WHEN lw >= 5 AND lr > 1e-4 THEN 0 ELSE lw END, cuts + CASE WHEN lw >= 5 AND lr > 1e-4 THEN 1 ELSE 0 END,"
       "   CASE WHEN lw >= 5 AND lr > 1e-4 THEN CASE WHEN lr * 2e-1 < 1e-4 THEN 1e-4 ELSE lr * 2e-1 END ELSE lr END"
       "  FROM (SELECT r.split, r.epoch, r.n, r.i, r.loss, f.best, f.stop, f.lr_best, f.cuts, f.lr,"
       "   CASE WHEN r.loss < f.best THEN 0 ELSE f.wait + 1 END AS w,"
       "   CASE WHEN r.loss < f.lr_best - 1e-4 THEN 0 ELSE f.lr_wait + 1 END AS lw"
       "   FROM f JOIN r ON r.split = f.split AND r.i = f.i + 1))"
       " SELECT epoch, split, n, wait AS epochs_since_gain, stop, cuts AS lr_cuts, round(lr, 9) AS learning_rate FROM f")
def q_plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs since the last loss gain, stop flag (patience 10) and learning-rate cuts (patience 5)."""
    rows = base_table(spark, sf_dir, "embeddings").selectExpr(
        f"CAST(vec_id % {_RUN_EPOCHS} + 1 AS INT) AS epoch", "CASE WHEN label < 5 THEN 'train' ELSE 'test' END AS split")
    runs = rows.groupBy("epoch", "split").agg(F.count(F.lit(1)).alias("n")).selectExpr("epoch", "split", "n", f"{_RUN_LOSS} AS loss")
    out = W.plateau(runs, "loss", "epoch", "split", patience=10, lr_patience=5).drop("loss")
    return rounded(out, ["learning_rate"], TDIGITS)
