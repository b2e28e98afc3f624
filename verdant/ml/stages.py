"""Feature pipeline stages and model factories.

The parity-sensitive statistics (exact median / mode imputation, population-sigma scaling,
constant-safe min-max) are small custom ``Estimator``/``Model`` pairs: their fit is one
distributed aggregate, their transform a projection of literal Columns, and they persist
with the standard ML writer inside a ``PipelineModel``.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from verdant.ml import features as M
from verdant.ml.trees import TreeSettings
from verdant.operators import clean as C
from verdant.session import TARGET_PARTITION_BYTES, input_bytes


class _Cols(Params):
    numericCols = Param(Params._dummy(), "numericCols", "numeric columns", TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "string columns", TypeConverters.toListString)
    fitted = Param(Params._dummy(), "fitted", "fitted values as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(numericCols=[], categoricalCols=[], fitted="{}")

    def _fitted(self) -> dict:
        return json.loads(self.getOrDefault(self.fitted))


class ExactImputerModel(Model, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    """P9 apply: nulls (and NaN) -> the fitted median / mode."""

    @keyword_only
    def __init__(self, numericCols=None, categoricalCols=None, fitted=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return C.apply_impute(df, self._fitted())


class ExactImputer(Estimator, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    """P9 fit: exact median of numeric columns, most frequent (smallest on ties) of strings."""

    @keyword_only
    def __init__(self, numericCols=None, categoricalCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ExactImputerModel:
        num, cat = self.getOrDefault(self.numericCols), self.getOrDefault(self.categoricalCols)
        return ExactImputerModel(numericCols=num, categoricalCols=cat, fitted=json.dumps(C.fit_impute(df, num, cat)))


class StandardScalerModel(Model, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, numericCols=None, categoricalCols=None, fitted=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return M.apply_standard(df, {k: tuple(v) for k, v in self._fitted().items()})


class ExactStandardScaler(Estimator, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    """M4: in-place (x - mean) / population sigma; a constant column maps to 0."""

    @keyword_only
    def __init__(self, numericCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> StandardScalerModel:
        cols = self.getOrDefault(self.numericCols)
        return StandardScalerModel(numericCols=cols, fitted=json.dumps(M.fit_standard(df, cols)))


class MinMaxModel(Model, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, numericCols=None, categoricalCols=None, fitted=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def stats(self) -> dict:
        return {k: tuple(v) for k, v in self._fitted().items()}

    def _transform(self, df: DataFrame) -> DataFrame:
        return M.apply_minmax(df, self.stats())


class ExactMinMaxScaler(Estimator, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    """M5: in-place (x - min) / (max - min); a constant column maps to 0 (MLlib's gives 0.5)."""

    @keyword_only
    def __init__(self, numericCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> MinMaxModel:
        cols = self.getOrDefault(self.numericCols)
        return MinMaxModel(numericCols=cols, fitted=json.dumps(M.fit_minmax(df, cols)))


class DummyModel(Model, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, numericCols=None, categoricalCols=None, fitted=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def dummy_columns(self) -> list[str]:
        return [f"{c}_{v}" for c, vals in self._fitted().items() for v in vals[1:]]

    def _transform(self, df: DataFrame) -> DataFrame:
        return M.one_hot(df, self._fitted(), drop_first=True)


class DummyEncoder(Estimator, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    """M7: ``col_value`` indicators without the alphabetically first category; the category
    lists are kept with the model, so scoring builds the same columns (fixes the reference's
    prefix parse, D2)."""

    @keyword_only
    def __init__(self, categoricalCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> DummyModel:
        cols = self.getOrDefault(self.categoricalCols)
        return DummyModel(categoricalCols=cols, fitted=json.dumps(M.fit_categories(df, cols)))


def dummy_names(categories: dict) -> list[str]:
    return [f"{c}_{v}" for c, vals in categories.items() for v in vals[1:]]


def preprocessor(numeric: list[str], categorical: list[str], impute: bool = True) -> list:
    """M9: impute -> scale numeric -> index + one-hot (unknown -> zeros) -> assemble ``features``."""
    stages: list = []
    if impute:
        stages.append(ExactImputer(numericCols=numeric, categoricalCols=categorical))
    if numeric:
        stages.append(ExactStandardScaler(numericCols=numeric))
    ohe = []
    if categorical:
        idx = [f"{c}__idx" for c in categorical]
        ohe = [f"{c}__ohe" for c in categorical]
        stages.append(StringIndexer(inputCols=categorical, outputCols=idx, stringOrderType="alphabetAsc",
                                    handleInvalid="keep"))
        # the indexer puts unknowns in an extra last slot, which dropLast removes: unknown -> all zeros
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True))
    stages.append(VectorAssembler(inputCols=numeric + ohe, outputCol="features", handleInvalid="keep"))
    return stages


def dummies_preprocessor(numeric: list[str], categorical: list[str], categories: dict) -> list:
    """M7 + M4 (water / environment models): dummies drop-first, then every column scaled."""
    cols = numeric + dummy_names(categories)
    return [DummyEncoder(categoricalCols=categorical), ExactStandardScaler(numericCols=cols),
            VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")]


# --- model factories (reference sizes as defaults) -------------------------------------------------

RF_MAX_DEPTH = 30   # the reference grows trees without a depth limit
TABULAR_BINS = 256  # bins of a feature for second-order boosting, as the reference's learner uses

PARALLELISM = "spark.verdant.ml.parallelism"       # model fits at once
NODE_MEMORY = "spark.verdant.ml.nodeMemoryMB"      # a task's budget for tree histograms
DEFAULTS = {PARALLELISM: 2, NODE_MEMORY: 64}


def setting(spark, name: str) -> int:
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    return int(spark.conf.get(name, str(DEFAULTS[name]))) if spark else DEFAULTS[name]


def fit_parallelism(spark, n_tasks: int) -> int:
    """How many of ``n_tasks`` model fits run at once (a setting; fitted forests live on the driver)."""
    return max(1, min(n_tasks, setting(spark, PARALLELISM)))


def node_memory_mb(spark=None) -> int:
    """MLlib's per-task histogram budget (``maxMemoryInMB``, a setting): a larger one splits more tree
    nodes in each pass over the data."""
    return setting(spark, NODE_MEMORY)


def random_forest(min_leaf: int = 1, num_trees: int = 100, max_depth: int = RF_MAX_DEPTH, seed: int = 42) -> TreeSettings:
    """Random forest regressor, all features considered at every split."""
    return TreeSettings(boosting=False, trees=num_trees, depth=max_depth, min_rows=min_leaf, seed=seed)


def gradient_boosting(rounds: int = 100, rate: float = 0.1, depth: int = 3, seed: int = 42) -> TreeSettings:
    """Squared-loss boosting of depth-3 trees."""
    return TreeSettings(boosting=True, trees=rounds, depth=depth, rate=rate, seed=seed)


def second_order_boosting(task: str, n_classes: int = 2, rounds: int = 100, rate: float = 0.1, depth: int = 5, sample: float = 0.8,
                          col_sample: float = 0.8, seed: int = 42) -> TreeSettings:
    """Boosting on gradients and Hessians, rows and columns drawn for each tree, ridge 1, least Hessian 1;
    squared loss, logistic for two classes, and one soft-max model for more."""
    loss = "squared" if task == "regression" else "logistic" if n_classes <= 2 else "softmax"
    return TreeSettings(boosting=True, trees=rounds, depth=depth, rate=rate, min_hessian=1.0, ridge=1.0, row_share=sample,
                        column_share=col_sample, loss=loss, classes=max(2, n_classes), bins=TABULAR_BINS, seed=seed)


def boosted_tabular(label: str, task: str, n_classes: int = 2, rounds: int = 100, rate: float = 0.1,
                    depth: int = 5, sample: float = 0.8, col_sample: float = 0.8, seed: int = 42,
                    validation_col: str | None = None):
    """MLlib's boosted trees of the M12 sizes, stopped early on the rows that ``validation_col`` flags."""
    common = dict(maxIter=rounds, stepSize=rate, maxDepth=depth, subsamplingRate=sample,
                  featureSubsetStrategy=str(col_sample), seed=seed, minInstancesPerNode=1,
                  maxMemoryInMB=node_memory_mb(), cacheNodeIds=True)
    if validation_col:
        common["validationIndicatorCol"] = validation_col
    if task == "regression":
        return GBTRegressor(labelCol=label, **common)
    clf = GBTClassifier(labelCol=label, **common)
    return clf if n_classes <= 2 else OneVsRest(classifier=clf, labelCol=label)


def classifier(label: str, kind: str = "logistic", seed: int = 42, reg: float = 0.0):
    """M21 learners for labelled vectors."""
    if kind == "forest":
        return RandomForestClassifier(labelCol=label, numTrees=100, seed=seed)
    return LogisticRegression(labelCol=label, family="multinomial", regParam=reg, maxIter=100)


def linear(label: str) -> LinearRegression:
    return LinearRegression(labelCol=label, solver="normal")


def assemble(stages: list, model) -> Pipeline:
    return Pipeline(stages=list(stages) + [model])


def ensure_parallelism(df: DataFrame) -> DataFrame:
    """Spread a training table evenly over the cluster's cores, or by its size if that is more.

    The shuffle partitions do not count here: every pass of a fit runs one task per partition."""
    size = input_bytes(df) or 0
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // TARGET_PARTITION_BYTES)))


SPREAD_BYTES = 4 * 1024 * 1024  # compressed bytes of a narrow table whose rows one task of a fit holds


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table of more than ``SPREAD_BYTES`` evenly, so many bytes to a task at most.

    How a file was written (one row group, say) may put all its rows in one task, which holds them unpacked in
    every round of a fit. A smaller table stays as it is."""
    size = input_bytes(df) or 0
    return df if size <= SPREAD_BYTES else df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // SPREAD_BYTES)))
