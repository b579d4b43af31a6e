"""Model families, their search spaces, scoring and importances.

Search spaces and their limits are fixed values of the toolkit's contract.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import IndexToString, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLWritable,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import as_double, doubles, per_column
from ..functions.ordered import number_by_hash
from ..functions.scratch import spread, written
from .hashing import NeighbourIndex, fit_index
from .pairs import nearest, vote

SEED = 42


@dataclass(frozen=True)
class Context:
    """What a factory needs to know about the data."""

    data: DataFrame
    features: Sequence[str]
    classes: int = 2
    id_col: str | None = None
    weight_col: str | None = None

    @cached_property
    def rows(self) -> int:
        """Counted only for the families whose penalty depends on it."""
        return self.data.count()


@dataclass(frozen=True)
class Family:
    """task, a factory (params, context) -> estimator, and the search space.

    A space entry is ("int", low, high), ("float", low, high) or ("choice", values).
    """

    task: str
    build: Callable[[dict, Context], Estimator]
    space: dict[str, tuple] = field(default_factory=dict)


def _weighted(estimator: Estimator, context: Context) -> Estimator:
    if context.weight_col and estimator.hasParam("weightCol"):
        estimator.set(estimator.getParam("weightCol"), context.weight_col)
    return estimator


def _plain(cls: type, **fixed) -> Callable[[dict, Context], Estimator]:
    return lambda params, context: _weighted(cls(**fixed, **params), context)


def _per_class(build: Callable[[dict, Context], Estimator]) -> Callable[[dict, Context], Estimator]:
    """Two-class estimators serve more classes one against the rest.

    One class at a time: boosting holds rows of its own for each class it is
    fitted for, and the tasks of one class fill a cluster.
    """

    def made(params: dict, context: Context) -> Estimator:
        base = build(params, context)
        return base if context.classes <= 2 else OneVsRest(classifier=base, parallelism=1)

    return made


def _logistic(params: dict, context: Context) -> Estimator:
    """C counts the summed loss, Spark's penalty the mean loss."""
    rest = {k: v for k, v in params.items() if k != "C"}
    penalty = 1.0 / (params.get("C", 1.0) * max(1, context.rows))
    return _weighted(LogisticRegression(regParam=penalty, standardization=False, **rest), context)


def _svc(params: dict, context: Context) -> Estimator:
    rest = {k: v for k, v in params.items() if k != "C"}
    penalty = 1.0 / (params.get("C", 1.0) * max(1, context.rows))
    return _weighted(LinearSVC(regParam=penalty, **rest), context)


def _ridge(params: dict, context: Context) -> Estimator:
    """The ridge penalty is against the summed loss, hence the division by rows."""
    rest = {k: v for k, v in params.items() if k != "alpha"}
    penalty = params.get("alpha", 1.0) / max(1, context.rows)
    return _weighted(LinearRegression(regParam=penalty, elasticNetParam=0.0, standardization=False, **rest), context)


def _elastic(params: dict, context: Context, ratio: float | None = None) -> Estimator:
    rest = {k: v for k, v in params.items() if k not in ("alpha", "l1Ratio")}
    mix = params.get("l1Ratio", 0.5) if ratio is None else ratio
    alpha = params.get("alpha", 1.0)
    return _weighted(LinearRegression(regParam=alpha, elasticNetParam=mix, standardization=False, **rest), context)


def _huber(params: dict, context: Context) -> Estimator:
    rest = {k: v for k, v in params.items() if k != "C"}
    penalty = 1.0 / (params.get("C", 1.0) * max(1, context.rows))
    return _weighted(LinearRegression(loss="huber", regParam=penalty, **rest), context)


def _perceptron(params: dict, context: Context) -> Estimator:
    rest = {k: v for k, v in params.items() if k != "hidden"}
    layers = [len(context.features), *params.get("hidden", [100]), max(2, context.classes)]
    return MultilayerPerceptronClassifier(layers=layers, seed=SEED, **rest)


def _neighbours(classify: bool) -> Callable[[dict, Context], Estimator]:
    def made(params: dict, context: Context) -> Estimator:
        if context.id_col is None:
            raise ValueError("nearest neighbours need a row id column")
        return NeighbourEstimator(idCol=context.id_col, classify=classify, **params)

    return made


_FOREST = {
    "numTrees": ("int", 50, 300),
    "maxDepth": ("int", 3, 20),
    "minInstancesPerNode": ("int", 1, 10),
    "featureSubsetStrategy": ("choice", ["sqrt", "log2", "all"]),
    "bootstrap": ("choice", [True, False]),
}
_BOOST = {
    "maxIter": ("int", 50, 300),
    "maxDepth": ("int", 3, 10),
    "stepSize": ("float", 0.01, 0.3),
    "minInstancesPerNode": ("int", 1, 10),
    "subsamplingRate": ("float", 0.6, 1.0),
}
_TREE = {"maxDepth": ("int", 3, 20), "minInstancesPerNode": ("int", 1, 10)}
_NEIGHBOURS = {
    "k": ("int", 3, 20),
    "weights": ("choice", ["uniform", "distance"]),
    "p": ("int", 1, 2),
}
_PENALTY = {"alpha": ("float", 0.1, 10.0), "fitIntercept": ("choice", [True, False]), "maxIter": ("int", 100, 1000)}

FAMILIES: dict[str, Family] = {
    "RandomForestClassifier": Family("classification", _plain(RandomForestClassifier, seed=SEED), _FOREST),
    "GradientBoostingClassifier": Family("classification", _per_class(_plain(GBTClassifier, seed=SEED)), _BOOST),
    "LogisticRegression": Family(
        "classification",
        _logistic,
        {"C": ("float", 0.1, 10.0), "elasticNetParam": ("choice", [0.0, 0.5, 1.0]), "maxIter": ("int", 100, 500)},
    ),
    "LinearSVC": Family("classification", _per_class(_svc), {"C": ("float", 0.1, 10.0)}),
    "KNeighborsClassifier": Family("classification", _neighbours(True), _NEIGHBOURS),
    "GaussianNB": Family("classification", _plain(NaiveBayes, modelType="gaussian")),
    "DecisionTreeClassifier": Family(
        "classification",
        _plain(DecisionTreeClassifier, seed=SEED),
        {**_TREE, "impurity": ("choice", ["gini", "entropy"])},
    ),
    "MLPClassifier": Family(
        "classification",
        _perceptron,
        {"hidden": ("choice", [[50], [100], [50, 50], [100, 50]]), "maxIter": ("int", 100, 500)},
    ),
    "RandomForestRegressor": Family("regression", _plain(RandomForestRegressor, seed=SEED), _FOREST),
    "GradientBoostingRegressor": Family("regression", _plain(GBTRegressor, seed=SEED), _BOOST),
    "LinearRegression": Family("regression", _plain(LinearRegression), {"fitIntercept": ("choice", [True, False])}),
    "Ridge": Family("regression", _ridge, _PENALTY),
    "Lasso": Family("regression", lambda p, c: _elastic(p, c, 1.0), _PENALTY),
    "ElasticNet": Family("regression", _elastic, {**_PENALTY, "l1Ratio": ("float", 0.0, 1.0)}),
    "LinearSVR": Family("regression", _huber, {"C": ("float", 0.1, 10.0)}),
    "KNeighborsRegressor": Family("regression", _neighbours(False), _NEIGHBOURS),
    "DecisionTreeRegressor": Family("regression", _plain(DecisionTreeRegressor, seed=SEED), _TREE),
    "KMeans": Family(
        "clustering",
        _plain(KMeans, seed=SEED),
        {"k": ("int", 2, 20), "initMode": ("choice", ["k-means||", "random"]), "maxIter": ("int", 100, 500)},
    ),
    "GaussianMixture": Family("clustering", _plain(GaussianMixture, seed=SEED), {"k": ("int", 2, 20)}),
    "BisectingKMeans": Family("clustering", _plain(BisectingKMeans, seed=SEED), {"k": ("int", 2, 20)}),
}

# Families tried when none are named; the others are opt-in.
DEFAULT_FAMILIES = {
    "classification": [
        "RandomForestClassifier", "GradientBoostingClassifier", "LogisticRegression", "LinearSVC", "GaussianNB",
    ],
    "regression": [
        "RandomForestRegressor", "GradientBoostingRegressor", "LinearRegression", "Ridge", "Lasso", "LinearSVR",
    ],
    "clustering": ["KMeans", "GaussianMixture", "BisectingKMeans"],
}


def register_family(name: str, family: Family) -> None:
    """Add a model family of the user's own."""
    FAMILIES[name] = family


# The families of this module read the features and the label; these the row id as well.
_OWN, _BY_ID = dict(FAMILIES), ("KNeighborsClassifier", "KNeighborsRegressor")


def columns_read(names: Sequence[str], features: Sequence[str], id_col: str) -> list[str] | None:
    """What fits of these families read besides the label; None where one is the caller's own, which may read any column."""
    if any(FAMILIES[n] is not _OWN.get(n) for n in names):
        return None
    return list(dict.fromkeys([*features, *([id_col] if any(n in _BY_ID for n in names) else [])]))


def families_for(task: str, names: Sequence[str] | None = None) -> list[str]:
    chosen = list(names) if names else DEFAULT_FAMILIES[task]
    unknown = [n for n in chosen if n not in FAMILIES or FAMILIES[n].task != task]
    if unknown or not chosen:
        raise ValueError(f"no such model for {task}: {', '.join(unknown)}")
    return chosen


def preparation(features: Sequence[str], stages: Sequence = ()) -> Pipeline:
    """Preparation stages and the feature vector."""
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=list(features), outputCol="features")])


def model_pipeline(name: str, params: dict, context: Context, stages: Sequence = ()) -> Pipeline:
    """Preparation stages, the feature vector, and the estimator, fitted as one."""
    return Pipeline(stages=[*preparation(context.features, stages).getStages(), FAMILIES[name].build(params, context)])


def fit_family(df: DataFrame, name: str, features: Sequence[str], label: str | None = None, params: dict | None = None,
               stages: Sequence = (), id_col: str | None = None, weight_col: str | None = None) -> PipelineModel:
    """Fit one family with given parameters; the label column is passed on as ``label``."""
    data = df if label in (None, "label") else df.withColumn("label", as_double(df, label))
    # The count of classes, every stage and most estimators read the rows, some several times.
    held = spread(data).persist()
    try:
        classes = 2
        if label is not None and FAMILIES[name].task == "classification":
            classes = held.select(label).distinct().count()
        context = Context(held, features, classes, id_col, weight_col)
        return model_pipeline(name, params or {}, context, stages).fit(held)
    finally:
        held.unpersist()


class NeighbourEstimator(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """k nearest neighbours: fitting keeps the training rows as a table.

    By ``method`` "hashed" they are found through an index of random
    projections whose share of true neighbours is measured at fit; "exact"
    compares all rows with all.
    """

    idCol = Param(Params._dummy(), "idCol", "unique row id", TypeConverters.toString)
    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform or distance", TypeConverters.toString)
    p = Param(Params._dummy(), "p", "1 manhattan, 2 euclidean", TypeConverters.toInt)
    classify = Param(Params._dummy(), "classify", "vote or mean", TypeConverters.toBoolean)
    method = Param(Params._dummy(), "method", "hashed or exact", TypeConverters.toString)
    recall = Param(Params._dummy(), "recall", "share of true neighbours the index should find", TypeConverters.toFloat)

    def __init__(self, idCol="id", k=5, weights="uniform", p=2, classify=True, method="hashed", recall=0.9):
        super().__init__()
        if method not in ("hashed", "exact"):
            raise ValueError(f"unknown method: {method}")
        self._set(idCol=idCol, k=k, weights=weights, p=p, classify=classify, method=method, recall=recall)

    def _fit(self, df: DataFrame) -> "NeighbourModel":
        options = {n.name: self.getOrDefault(n) for n in self.params}
        key = options["idCol"]
        # Written, as the rows given may be gone when the model is used.
        train = written(df.select(key, vector_to_array("features").alias("features"), F.col("label").cast("double").alias("label")), "neighbours")
        if options["method"] == "exact":
            return NeighbourModel(options, train)
        index = fit_index(train.select(key, "features"), key, options["k"], options["p"], options["recall"])
        return NeighbourModel(options | {"index": index.settings()}, train, index)


class NeighbourModel(Model, MLReadable, MLWritable):
    options = Param(Params._dummy(), "options", "settings of the estimator", TypeConverters.identity)

    def __init__(self, options: dict | None = None, train: DataFrame | None = None, index: NeighbourIndex | None = None):
        super().__init__()
        self._set(options=options or {})
        self.train, self.index = train, index

    @property
    def recall(self) -> float | None:
        """The measured share of true neighbours; 1 for the exact form."""
        return self.index.recall if self.index else 1.0

    def _transform(self, df: DataFrame) -> DataFrame:
        o = self.getOrDefault("options")
        key = o["idCol"]
        new = df.select(key, vector_to_array("features").alias("features"))
        if self.index is None:
            found = nearest(new, self.train.select(key, "features"), key, o["k"], o["p"], skip_self=False)
        else:
            found = self.index.nearest(new, o["k"], skip_self=False)
        return df.join(vote(found, self.train, key, "label", o["weights"], o["classify"]), key)

    def write(self) -> "_NeighbourWriter":
        return _NeighbourWriter(self)

    @classmethod
    def read(cls) -> "_NeighbourReader":
        return _NeighbourReader(cls)


class _NeighbourWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.train.write.mode("overwrite").parquet(f"{path}/train")
        if self.instance.index:
            self.instance.index.write(f"{path}/index")


class _NeighbourReader(DefaultParamsReader):
    def load(self, path: str) -> NeighbourModel:
        model = super().load(path)
        spark = SparkSession.active()
        model.train = spark.read.parquet(f"{path}/train")
        settings = model.getOrDefault("options").get("index")
        model.index = NeighbourIndex.read(spark, f"{path}/index", settings) if settings else None
        return model


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str], labels: Sequence[str] | None = None) -> DataFrame:
    """keep, predicted_value; or predicted_class and probability_class_i where the model gives probabilities.

    ``labels`` turns class numbers back into their texts.
    """
    out = model.transform(df)
    if "probability" not in out.columns and labels is None:
        return out.select(*keep, F.col("prediction").alias("predicted_value"))
    predicted = F.col("prediction")
    if labels is not None:
        out = IndexToString(inputCol="prediction", outputCol="_text", labels=list(labels)).transform(out)
        predicted = F.col("_text")
    columns = [*keep, predicted.alias("predicted_class")]
    if "probability" in out.columns:
        classes = model.stages[-1].numClasses if hasattr(model.stages[-1], "numClasses") else model.stages[-1].getK()
        p = vector_to_array("probability")
        columns += [p[i].alias(f"probability_class_{i}") for i in range(classes)]
    return out.select(*columns)


def feature_importance(model: PipelineModel, features: Sequence[str]) -> dict[str, float]:
    """Tree importances, else absolute coefficients (their mean over classes), else nothing."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        return dict(zip(features, (float(v) for v in last.featureImportances.toArray())))
    if hasattr(last, "coefficientMatrix"):
        rows = abs(last.coefficientMatrix.toArray())
        return dict(zip(features, (float(v) for v in rows.mean(axis=0))))
    if hasattr(last, "coefficients"):
        return dict(zip(features, (abs(float(v)) for v in last.coefficients.toArray())))
    return {}


def importance_table(spark: SparkSession, model: str, importance: dict[str, float]) -> DataFrame:
    """model, feature, importance."""
    return spark.createDataFrame([(model, k, v) for k, v in importance.items()], "model string, feature string, importance double")


def _givers(df: DataFrame, columns: Sequence[str], id_col: str, seed: int) -> tuple[DataFrame, dict[str, str]]:
    """The table with, for each of ``columns``, the value of row i of another hash order beside row i of one; and the names of these."""
    names = {c: f"_given_{i}" for i, c in enumerate(columns)}
    takers = number_by_hash(df, [], id_col, seed).drop("group_size")
    held = df.select(id_col, *[F.col(c).alias(n) for c, n in names.items()])
    givers = number_by_hash(held, [], id_col, seed + 1).select("position", *names.values())
    return takers.join(givers, "position").select(*df.columns, *names.values()), names


def permuted(df: DataFrame, column: str, id_col: str, seed: int = SEED) -> DataFrame:
    """The table with one column dealt anew: row i in one hash order gets the value of row i in another."""
    dealt, names = _givers(df, [column], id_col, seed)
    return dealt.select(*[F.col(names.get(c, c)).alias(c) for c in df.columns])


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], id_col: str,
                           metric: Callable[[DataFrame], float], seed: int = SEED) -> DataFrame:
    """feature, importance: the drop of a score when a feature loses its tie to the label.

    All features are dealt anew by the same two orders, so the table is ordered and joined once.
    """
    base = metric(model.transform(df))
    dealt, names = _givers(df, list(dict.fromkeys(features)), id_col, seed)
    dealt = written(dealt, "permuted")
    swapped = lambda f: dealt.select(*[F.col(names[f] if c == f else c).alias(c) for c in df.columns])
    rows = [(f, float(base - metric(model.transform(swapped(f))))) for f in features]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def form_bounds(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, low, high, start: bounds and mean for entering one row by hand."""
    return per_column(doubles(df, features), features, {"low": F.min, "high": F.max, "start": F.avg})


def decision_grid(model: PipelineModel, df: DataFrame, x: str, y: str, step: float = 0.1, margin: float = 1.0) -> DataFrame:
    """x, y, prediction over a grid around the data, for models of two features."""
    row = df.agg(*[f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))]).first()

    def axis(c: str) -> tuple[float, int]:
        low = float(row[f"lo_{c}"]) - margin
        return low, int((float(row[f"hi_{c}"]) + margin - low) / step + 1e-9) + 1

    (left, columns), (low, lines) = axis(x), axis(y)
    # One range over all cells, so that the grid is made in parallel.
    number = F.col("id")
    cells = df.sparkSession.range(columns * lines).select(
        (F.lit(left) + F.floor(number / lines) * step).alias(x), (F.lit(low) + number % lines * step).alias(y)
    )
    return model.transform(cells).select(x, y, "prediction")
