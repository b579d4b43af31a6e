"""Task typing, folds, model search and learning curves.

The loop over trials runs on the driver; every fit and every score is a Spark
job over the whole fold table.
"""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_double
from ..functions.ordered import hash_order, number_by_hash
from ..functions.scratch import written
from .clusters import calinski_harabasz, davies_bouldin
from .evaluate import classification_metrics, regression_metrics, roc_auc
from .estimators import FAMILIES, SEED, Context, columns_read, families_for, feature_importance, model_pipeline, preparation
from .samplers import MedianPruner, draw, sampler  # noqa: F401 - draw is part of this module's face

# True where a larger value is better.
METRICS = {
    "accuracy": True,
    "f1": True,
    "precision": True,
    "recall": True,
    "auc": True,
    "r2": True,
    "mse": False,
    "rmse": False,
    "mae": False,
    "mape": False,
}
DEFAULT_METRIC = {"classification": "accuracy", "regression": "mse"}

# Fits run at a time.
PARALLEL_FITS = 4

# Rows of one task of a search. An iteration of a fit is a round of tasks, so a small table is held in few.
FIT_ROWS = 25_000

# A search holds the prepared rows of every fold up to so many rows. Of a larger table there is one copy,
# with the columns that are read, and rows are prepared each time they are read.
HELD_ROWS = 2_000_000

TRIAL_SCHEMA = """trial int, model string, params map<string,string>, metric string, score double, score_std double,
train_seconds double, status string, error string"""


def _few_values(df: DataFrame, column: str, limit: int) -> int:
    """Distinct values including null, counted up to ``limit``."""
    return df.select(column).distinct().limit(limit).count()


def detect_task(df: DataFrame, target: str = "target", few: int = 10) -> str:
    """clustering without a target; classification for text or few values; else regression."""
    if target not in df.columns:
        return "clustering"
    if isinstance(df.schema[target].dataType, T.StringType) or _few_values(df, target, few) < few:
        return "classification"
    return "regression"


def label_task(df: DataFrame, label: str, few: int = 10, some: int = 100) -> str:
    """By the label's values: few, text or boolean, or under a hundred whole numbers make classes."""
    kind = df.schema[label].dataType
    if isinstance(kind, (T.StringType, T.BooleanType)) or _few_values(df, label, few) < few:
        return "classification"
    if _few_values(df, label, some) < some:
        whole = df.agg(F.bool_and(as_double(df, label) % 1 == 0)).first()[0]
        return "classification" if whole else "regression"
    return "regression"


def optimal_settings(df: DataFrame, features: int) -> DataFrame:
    """rows, training seconds, folds, feature selection, by the size of the table."""
    rows = F.count("*")
    seconds = F.when(rows < 1000, 300).when(rows < 10000, 1800).otherwise(3600)
    return df.agg(
        rows.alias("rows"),
        seconds.alias("max_training_time"),
        F.when(rows < 5000, 3).otherwise(5).alias("cv_folds"),
        F.lit(features > 100).alias("enable_feature_selection"),
    )


def with_folds(df: DataFrame, id_col: str, folds: int = 5, stratify: str | None = None, seed: int = SEED,
               exact: bool = True) -> DataFrame:
    """Add ``fold``: rows dealt out in hash order of the id, per class when stratified.

    Exact folds differ by one row at most and cost one shuffle of the table.
    Otherwise the hash alone decides: no shuffle, and on large tables folds and
    classes are even up to chance.
    """
    if not exact:
        prefix = F.conv(F.substring(hash_order(id_col, seed=seed), 1, 8), 16, 10).cast("long")
        return df.withColumn("fold", F.pmod(prefix, F.lit(folds)).cast("int"))
    numbered = number_by_hash(df, [stratify] if stratify else [], id_col, seed)
    return numbered.select(*df.columns, F.pmod(F.col("position") - 1, F.lit(folds)).cast("int").alias("fold"))


def metric_value(scored: DataFrame, metric: str) -> float:
    """A metric of a table with ``label`` and ``prediction`` (and a score column for auc)."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    if metric == "auc":
        column = "probability" if "probability" in scored.columns else "rawPrediction"
        return _auc(scored.select("label", vector_to_array(column).alias("p")))
    if metric in ("r2", "mse", "rmse", "mae", "mape"):
        return regression_metrics(scored).first()[metric]
    return classification_metrics(scored).first()[metric]


def _auc(scored: DataFrame) -> float | None:
    """Area under the curve; with more than two classes the mean of one class against the rest, over classes that occur."""
    row = scored.first()
    width = len(row["p"]) if row else 0
    curves = [1] if width == 2 else range(width)
    areas = []
    for c in curves:
        one = scored.select((F.col("label") == c).cast("int").alias("label"), F.col("p")[c].alias("score"))
        areas.append(roc_auc(one, "label", "score").first()["auc"])
    known = [a for a in areas if a is not None]
    return sum(known) / len(known) if known else None


@dataclass
class SearchResult:
    """The best fitted pipeline, and one row per trial."""

    task_type: str
    model_type: str
    params: dict
    metric: str
    score: float
    metrics: dict[str, float]
    importance: dict[str, float]
    model: PipelineModel
    trials: DataFrame


def _each_fold(data: DataFrame, work: Callable[[int], object], folds: int, parallelism: int) -> list:
    """Run the folds side by side: their jobs share the cluster."""
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return list(pool.map(inheritable_thread_target(data.sparkSession)(work), range(folds)))


def _dealt(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """The table in as many tasks as its counted rows ask for, in an order of its own, so that reruns add up alike."""
    return df.repartition(-(-rows // FIT_ROWS) or 1, id_col).sortWithinPartitions(id_col)


def _folds_written(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """The table with its folds, written once: with these columns, or all if none are named or some are not plain columns."""
    known = columns is not None and set(columns) <= set(df.columns)
    return written(df.select(*dict.fromkeys([*columns, "label", "fold"])) if known else df, "folds")


class _PreparedFolds:
    """Training and validation rows of every fold. No stage hangs on the parameters of a trial, so each is fitted once a fold."""

    def __init__(self, data: DataFrame, features: Sequence[str], stages: Sequence, id_col: str, rows: int):
        self.data, self.id_col, self.rows = data, id_col, rows
        self.steps = preparation(features, stages)
        self.held: dict[int, tuple[DataFrame, DataFrame]] = {}

    def of(self, i: int) -> tuple[DataFrame, DataFrame]:
        if i not in self.held:
            train, valid = (self.data.where(side).drop("fold") for side in (F.col("fold") != i, F.col("fold") == i))
            ready = self.steps.fit(train)
            sides = [ready.transform(side) for side in (train, valid)]
            if self.rows <= HELD_ROWS:
                sides = [_dealt(side, self.id_col, self.rows).persist() for side in sides]
            self.held[i] = tuple(sides)
        return self.held[i]

    def release(self) -> None:
        for pair in self.held.values():
            for side in pair:
                side.unpersist()


def _fold_scores(prepared: _PreparedFolds, name: str, params: dict, context: Context, metric: str,
                 folds: int, parallelism: int, pruner: MedianPruner | None = None) -> tuple[list[float], bool]:
    """The score of every fold, and whether the trial was given up before the last.

    While no trial can be given up the folds run side by side. Afterwards they
    run one after the other, as a fold not begun is what a hopeless trial saves.
    """

    def one(i: int) -> float:
        train, valid = prepared.of(i)
        return metric_value(FAMILIES[name].build(params, context).fit(train).transform(valid), metric)

    sign = -1.0 if METRICS[metric] else 1.0
    if pruner is None or not pruner.ready:
        scores = _each_fold(prepared.data, one, folds, parallelism)
        if pruner is not None:
            pruner.keep([sign * s for s in scores])
        return scores, False
    scores = []
    for i in range(folds):
        scores.append(one(i))
        losses = [sign * s for s in scores]
        if i + 1 < folds and pruner.hopeless(losses):
            pruner.keep(losses)
            return scores, True
    pruner.keep(losses)
    return scores, False


def _better(a: float | None, b: float | None, metric: str) -> bool:
    if a is None or math.isnan(a):
        return False
    return b is None or (a > b if METRICS[metric] else a < b)


def search(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    id_col: str,
    task: str | None = None,
    models: Sequence[str] | None = None,
    metric: str | None = None,
    trials: int = 30,
    time_limit: float = 1800.0,
    patience: int = 10,
    folds: int = 5,
    stages: Sequence = (),
    seed: int = SEED,
    parallelism: int = PARALLEL_FITS,
    fixed: dict[str, dict] | None = None,
    exact_folds: bool = True,
    callback: Callable[[int, float | None], None] | None = None,
    draws: str = "parzen",
    prune: bool = True,
    startup: int = 10,
) -> SearchResult:
    """Try families with various parameters by cross-validation, and refit the best on all rows.

    ``draws`` says how parameters are chosen: "parzen" near what went well,
    after ``startup`` random trials, or "random". With ``prune`` a trial that
    falls behind the median of its family is given up between folds; it is
    recorded as pruned, with its mean so far. ``trials`` and ``time_limit`` hold
    per family; a family stops early after ``patience`` trials without gain.
    ``fixed`` sets parameters of a family beforehand. A failing trial is
    recorded and does not stop the search.
    """
    task = task or label_task(df, label)
    metric = metric or DEFAULT_METRIC[task]
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    names = families_for(task, models)
    data = df.withColumn("label", as_double(df, label)) if label != "label" else df
    strata = "label" if task == "classification" else None
    rows = data.count()
    data = with_folds(data, id_col, folds, strata, seed, exact_folds)
    if rows <= HELD_ROWS:
        data = _dealt(data, id_col, rows).persist()
    else:
        data = _folds_written(data, None if stages else columns_read(names, features, id_col))
    prepared = None
    try:
        classes = data.select("label").distinct().count() if task == "classification" else 2
        context = Context(data, list(features), classes, id_col)
        prepared = _PreparedFolds(data, features, stages, id_col, rows)
        log: list[tuple] = []
        best: tuple[float | None, str, dict] = (None, "", {})
        for name in names:
            rng = random.Random(f"{seed}-{name}")
            family_best, stale, seen, start = None, 0, set(), time.time()
            chooser, pruner = sampler(draws, startup), MedianPruner() if prune else None
            for _ in range(trials):
                space = {k: v for k, v in FAMILIES[name].space.items() if k not in (fixed or {}).get(name, {})}
                params = {**chooser.suggest(space, rng), **(fixed or {}).get(name, {})}
                mark = repr(sorted(params.items()))
                if mark in seen:
                    # A small space runs out; a repeat would give the same score.
                    stale += 1
                    if stale >= patience or not space:
                        break
                    continue
                seen.add(mark)
                began, score, spread, error, pruned = time.time(), None, None, None, False
                try:
                    got, pruned = _fold_scores(prepared, name, params, context, metric, folds, parallelism, pruner)
                    score = sum(got) / len(got)
                    spread = math.sqrt(sum((g - score) ** 2 for g in got) / len(got))
                except Exception as failure:  # noqa: BLE001 - a trial may fail for any reason of its model
                    error = f"{type(failure).__name__}: {failure}"[:500]
                chooser.learn(params, None if score is None else (-score if METRICS[metric] else score))
                texts = {k: str(v) for k, v in params.items()}
                status = "failed" if error is not None else "pruned" if pruned else "completed"
                log.append((len(log), name, texts, metric, score, spread, time.time() - began, status, error))
                if callback:
                    callback(len(log) - 1, score)
                # A trial that was given up is never the best, whatever its folds gave.
                stale = 0 if not pruned and _better(score, family_best, metric) else stale + 1
                if stale == 0:
                    family_best = score
                if not pruned and _better(score, best[0], metric):
                    best = (score, name, params)
                if stale >= patience or time.time() - start > time_limit:
                    break
        table = df.sparkSession.createDataFrame(log, TRIAL_SCHEMA)
        if best[0] is None:
            raise ValueError("every trial failed: " + "; ".join(sorted({str(r[8]) for r in log})))
        whole = data.drop("fold")
        model = model_pipeline(best[1], best[2], context, stages).fit(whole)
        scored = model.transform(whole)
        final = (classification_metrics if task == "classification" else regression_metrics)(scored).first().asDict()
        metrics = {f"cv_{metric}": best[0], **{f"train_{k}": v for k, v in final.items() if v is not None}}
        return SearchResult(task, best[1], best[2], metric, best[0], metrics, feature_importance(model, features), model, table)
    finally:
        if prepared is not None:
            prepared.release()
        data.unpersist()


# Measures of a clustering; True where a larger value is better.
CLUSTER_METRICS = {"silhouette": True, "calinski_harabasz": True, "davies_bouldin": False}


def cluster_score(clustered: DataFrame, features: Sequence[str], metric: str) -> float:
    """One measure of a table with ``features`` and ``prediction``.

    The silhouette here is by squared distance, which needs one pass; the
    euclidean one compares all rows (``clusters.silhouette``).
    """
    if metric == "silhouette":
        return ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(clustered)
    if metric == "calinski_harabasz":
        return calinski_harabasz(clustered, features, "prediction").first()[metric]
    if metric == "davies_bouldin":
        return davies_bouldin(clustered, features, "prediction").first()[metric]
    raise ValueError(f"unknown metric: {metric}")


def search_clusters(df: DataFrame, features: Sequence[str], models: Sequence[str] | None = None, metric: str = "silhouette",
                    trials: int = 30, stages: Sequence = (), seed: int = SEED, fixed: dict[str, dict] | None = None,
                    callback: Callable[[int, float | None], None] | None = None, draws: str = "parzen") -> SearchResult:
    """Try clustering families with various parameters (``draws`` as in ``search``) and keep the best model by one measure."""
    if metric not in CLUSTER_METRICS:
        raise ValueError(f"unknown metric: {metric}")
    data = df.persist()
    try:
        context = Context(data, list(features))
        log: list[tuple] = []
        best: tuple = (None, "", {}, None)
        for name in families_for("clustering", models):
            rng, chooser = random.Random(f"{seed}-{name}"), sampler(draws)
            for _ in range(trials):
                params = {**chooser.suggest(FAMILIES[name].space, rng), **(fixed or {}).get(name, {})}
                began, score, error, model = time.time(), None, None, None
                try:
                    model = model_pipeline(name, params, context, stages).fit(data)
                    score = cluster_score(model.transform(data), features, metric)
                except Exception as failure:  # noqa: BLE001 - a trial may fail for any reason of its model
                    error = f"{type(failure).__name__}: {failure}"[:500]
                chooser.learn(params, None if score is None else (-score if CLUSTER_METRICS[metric] else score))
                texts = {k: str(v) for k, v in params.items()}
                status = "completed" if error is None else "failed"
                log.append((len(log), name, texts, metric, score, None, time.time() - began, status, error))
                if callback:
                    callback(len(log) - 1, score)
                if score is not None and (best[0] is None or (score > best[0]) == CLUSTER_METRICS[metric] and score != best[0]):
                    best = (score, name, params, model)
        if best[0] is None:
            raise ValueError("every trial failed: " + "; ".join(sorted({str(r[8]) for r in log})))
        table = df.sparkSession.createDataFrame(log, TRIAL_SCHEMA)
        return SearchResult("clustering", best[1], best[2], metric, best[0], {metric: best[0]}, {}, best[3], table)
    finally:
        data.unpersist()


def best_trials(trials: DataFrame, smaller_is_better: bool) -> DataFrame:
    """model, trial, score of the best trial of every model."""
    done = trials.where("status = 'completed'")
    pick = F.min_by if smaller_is_better else F.max_by
    order = F.struct("score", (F.col("trial") if smaller_is_better else -F.col("trial")).alias("t"))
    return done.groupBy("model").agg(pick("trial", order).alias("trial"), pick("score", order).alias("score"))


def stopping_report(trials: DataFrame, smaller_is_better: bool = False) -> DataFrame:
    """trial, model, score, best_so_far, since_gain: trials since the last improvement of the model."""
    from pyspark.sql import Window as W

    # One model has at most as many trials as its budget.
    w = W.partitionBy("model").orderBy("trial").rowsBetween(W.unboundedPreceding, W.currentRow)
    best = (F.min if smaller_is_better else F.max)("score").over(w)
    before = (F.min if smaller_is_better else F.max)("score").over(w.rowsBetween(W.unboundedPreceding, -1))
    gain = before.isNull() | ((F.col("score") < before) if smaller_is_better else (F.col("score") > before))
    marked = trials.where("score IS NOT NULL").select("trial", "model", "score", best.alias("best_so_far"), gain.alias("_gain"))
    place = F.row_number().over(W.partitionBy("model").orderBy("trial"))
    placed = marked.withColumn("_p", place)
    last = F.max(F.when(F.col("_gain"), F.col("_p"))).over(w)
    return placed.select("trial", "model", "score", "best_so_far", (F.col("_p") - last).alias("since_gain"))


def _curve_rows(data: DataFrame, name: str, params: dict, features: Sequence[str], id_col: str, metric: str,
                folds: int, stages: Sequence, share: float = 1.0) -> tuple[list[float], list[float]]:

    def one(i: int) -> tuple[float, float]:
        train = data.where(F.col("fold") != i)
        if share < 1.0:
            train = train.where(F.col("share") < share)
        context = Context(train, list(features), train.select("label").distinct().count(), id_col)
        model = model_pipeline(name, params, context, stages).fit(train)
        valid = data.where(F.col("fold") == i)
        return metric_value(model.transform(train), metric), metric_value(model.transform(valid), metric)

    scores = _each_fold(data, one, folds, PARALLEL_FITS)
    return [s[0] for s in scores], [s[1] for s in scores]


def _curve_data(df: DataFrame, label: str, id_col: str, task: str, folds: int) -> DataFrame:
    data = df.withColumn("label", as_double(df, label)) if label != "label" else df
    # A share of the rows is those whose hash falls below it, so larger shares hold the smaller.
    prefix = F.conv(F.substring(hash_order(id_col, seed=7), 1, 8), 16, 10).cast("double") / float(16**8)
    return with_folds(data, id_col, folds, "label" if task == "classification" else None).withColumn("share", prefix)


def _mean_std(values: Sequence[float]) -> tuple[float, float]:
    mean = sum(values) / len(values)
    return mean, math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))


CURVE_SCHEMA = "at double, train_mean double, train_std double, valid_mean double, valid_std double, overfit boolean"


def learning_curve(df: DataFrame, name: str, features: Sequence[str], label: str, id_col: str, params: dict | None = None,
                   metric: str | None = None, shares: Sequence[float] = tuple(i / 10 for i in range(1, 11)),
                   folds: int = 5, stages: Sequence = (), gap: float = 0.1) -> DataFrame:
    """at (share of the training rows), mean and std of both scores, overfit when they part by more than ``gap``."""
    task = FAMILIES[name].task
    metric = metric or ("accuracy" if task == "classification" else "r2")
    data = _curve_data(df, label, id_col, task, folds).persist()
    try:
        rows = []
        for share in shares:
            train, valid = _curve_rows(data, name, params or {}, features, id_col, metric, folds, stages, share)
            (tm, ts), (vm, vs) = _mean_std(train), _mean_std(valid)
            rows.append((float(share), tm, ts, vm, vs, abs(tm - vm) > gap))
        return df.sparkSession.createDataFrame(rows, CURVE_SCHEMA)
    finally:
        data.unpersist()


def validation_curve(df: DataFrame, name: str, features: Sequence[str], label: str, id_col: str, param: str,
                     values: Sequence[float], params: dict | None = None, metric: str | None = None,
                     folds: int = 5, stages: Sequence = (), gap: float = 0.1) -> DataFrame:
    """The same along one parameter."""
    task = FAMILIES[name].task
    metric = metric or ("accuracy" if task == "classification" else "r2")
    data = _curve_data(df, label, id_col, task, folds).persist()
    try:
        rows = []
        for value in values:
            train, valid = _curve_rows(data, name, {**(params or {}), param: value}, features, id_col, metric, folds, stages)
            (tm, ts), (vm, vs) = _mean_std(train), _mean_std(valid)
            rows.append((float(value), tm, ts, vm, vs, abs(tm - vm) > gap))
        return df.sparkSession.createDataFrame(rows, CURVE_SCHEMA)
    finally:
        data.unpersist()
