"""Evaluation of scored tables: classification, regression, curves, confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import safe_divide, union_all
from ..functions.ordered import running_by_value


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """label, prediction, n: the only shuffle of the scored rows, combined on the map side."""
    pair = df.select(F.col(label).alias("label"), F.col(prediction).alias("prediction"))
    return pair.where("label IS NOT NULL").groupBy("label", "prediction").agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction", classes: Sequence | None = None) -> DataFrame:
    """label, prediction, n of every pair that occurs; with ``classes``, of all their pairs, zero cells included."""
    counts = confusion_counts(df, label, prediction)
    if classes is None:
        return counts
    # The caller holds the classes, so their pairs are made from literals.
    each = lambda name: F.explode(F.array(*[F.lit(c).cast(df.schema[name].dataType) for c in classes]))
    grid = df.sparkSession.range(1).select(each(label).alias("label")).select("label", each(prediction).alias("prediction"))
    return grid.join(counts, ["label", "prediction"], "left").select("label", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """class, precision, recall, f1, support; 0 where undefined."""
    counts = confusion_counts(df, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = counts.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.alias("tp")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
            )
        )
    )
    sums = sides.where("class IS NOT NULL").groupBy("class").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "tp")]
    )
    ratio = lambda a, b: F.coalesce(safe_divide(a, b), F.lit(0.0))
    tp = F.col("tp")
    return sums.select(
        "class",
        ratio(tp, F.col("predicted")).alias("precision"),
        ratio(tp, F.col("support")).alias("recall"),
        ratio(2 * tp, F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "tp",
    )


def _weighted(c: str) -> Column:
    return safe_divide(F.sum(F.col(c) * F.col("support")), F.sum("support"))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy, and precision, recall and f1 weighted by support; AUC of hard labels for two classes."""
    per_class = class_metrics(df, label, prediction)
    balanced = F.when(F.count_if(F.col("support") > 0) == 2, F.sum(F.when(F.col("support") > 0, F.col("recall"))) / 2)
    return per_class.agg(
        safe_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
        *[_weighted(c).alias(c) for c in ("precision", "recall", "f1")],
        balanced.alias("roc_auc"),
    )


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """class, precision, recall, f1, support, with macro and weighted average rows."""
    per_class = class_metrics(df, label, prediction)
    names = ("precision", "recall", "f1")
    rows = per_class.select(F.col("class").cast("string").alias("class"), *names, "support")
    macro = per_class.agg(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = per_class.agg(F.lit("weighted avg").alias("class"), *[_weighted(c).alias(c) for c in names], F.sum("support").alias("support"))
    return union_all([rows, macro, weighted])


def _score_counts(df: DataFrame, label: str, score: str, positive) -> DataFrame:
    """One row per distinct score with its positives and negatives, keyed by falling score."""
    is_positive = (F.col(label) == positive).cast("long")
    return (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy((-F.col(score).cast("double")).alias("fall"))
        .agg(F.sum(is_positive).alias("pos"), F.sum(1 - is_positive).alias("neg"))
    )


def _curve(df: DataFrame, label: str, score: str, positive, buckets: int | None) -> DataFrame:
    return running_by_value(_score_counts(df, label, score, positive), [], "fall", ["pos", "neg"], buckets)


def roc_curve(df: DataFrame, label: str, score: str, positive=1, buckets: int | None = None) -> DataFrame:
    """threshold, fpr, tpr: one point per distinct score."""
    curve = _curve(df, label, score, positive, buckets)
    return curve.select(
        (-F.col("fall")).alias("threshold"),
        safe_divide(F.col("upto_neg"), F.col("total_neg")).alias("fpr"),
        safe_divide(F.col("upto_pos"), F.col("total_pos")).alias("tpr"),
    )


def roc_auc(df: DataFrame, label: str, score: str, positive=1, buckets: int | None = None) -> DataFrame:
    """auc, positives, negatives. Each step of the curve is a trapezoid, so no neighbour row is needed."""
    curve = _curve(df, label, score, positive, buckets)
    height = F.col("upto_pos") - F.col("pos") / 2
    area = F.sum(F.col("neg") * height)
    return curve.agg(
        safe_divide(area, F.max(F.col("total_pos").cast("double") * F.col("total_neg"))).alias("auc"),
        F.max("total_pos").alias("positives"),
        F.max("total_neg").alias("negatives"),
    )


def precision_recall_curve(df: DataFrame, label: str, score: str, positive=1, buckets: int | None = None) -> DataFrame:
    """threshold, precision, recall: one point per distinct score."""
    curve = _curve(df, label, score, positive, buckets)
    return curve.select(
        (-F.col("fall")).alias("threshold"),
        safe_divide(F.col("upto_pos"), F.col("upto_pos") + F.col("upto_neg")).alias("precision"),
        safe_divide(F.col("upto_pos"), F.col("total_pos")).alias("recall"),
    )


def regression_columns(label: str, prediction: str) -> dict[str, Column]:
    """Aggregates for r2, mse, rmse, mae, and mape (null when a label is 0).

    r2 of a constant label is 1 for exact predictions and 0 otherwise.
    """
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = F.when(y.isNotNull() & p.isNotNull(), y - p)
    y = F.when(p.isNotNull(), y)
    sse, sst = F.sum(e * e), F.var_pop(y) * F.count(y)
    flat = F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return {
        "r2": F.when(F.count(e) < 2, F.lit(None)).when(sst == 0, flat).otherwise(1 - safe_divide(sse, sst)),
        "mse": F.avg(e * e),
        "rmse": F.sqrt(F.avg(e * e)),
        "mae": F.avg(F.abs(e)),
        "mape": F.when(F.count_if(y == 0) == 0, F.avg(F.abs(F.try_divide(e, y)))),
    }


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(*[c.alias(n) for n, c in regression_columns(label, prediction).items()])


def regression_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    return df.agg(
        *[c.alias(n) for n, c in regression_columns(label, prediction).items()],
        F.avg(y).alias("label_mean"),
        F.stddev_pop(y).alias("label_std"),
        F.avg(p).alias("prediction_mean"),
        F.stddev_pop(p).alias("prediction_std"),
    )


def residuals(df: DataFrame, label: str = "label", prediction: str = "prediction", keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, label, prediction, (F.col(label) - F.col(prediction)).alias("residual"))


def common_range(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """low, high over label and prediction together."""
    return df.agg(
        F.least(F.min(label), F.min(prediction)).alias("low"), F.greatest(F.max(label), F.max(prediction)).alias("high")
    )


def _confidence(df: DataFrame, probability: str) -> Column:
    """The largest class probability of a vector or an array column."""
    is_array = isinstance(df.schema[probability].dataType, T.ArrayType)
    return F.array_max(F.col(probability) if is_array else vector_to_array(F.col(probability)))


def confidence_summary(df: DataFrame, probability: str = "probability") -> DataFrame:
    """rows, mean, share above 0.9, share below 0.5."""
    c = _confidence(df, probability)
    return df.select(c.alias("c")).agg(
        F.count("*").alias("rows"),
        F.avg("c").alias("mean_confidence"),
        F.avg((F.col("c") > 0.9).cast("int")).alias("high_share"),
        F.avg((F.col("c") < 0.5).cast("int")).alias("low_share"),
    )


def confidence_histogram(df: DataFrame, label: str, prediction: str, probability: str = "probability", bins: int = 30) -> DataFrame:
    """bin (of 0..1), correct, n."""
    c = _confidence(df, probability)
    place = F.least(F.lit(bins - 1), F.floor(c * bins)).cast("int")
    return df.groupBy(place.alias("bin"), (F.col(label) == F.col(prediction)).alias("correct")).agg(F.count("*").alias("n"))


def metrics_long(models: DataFrame, name: str = "model") -> DataFrame:
    """model, metric, value from a map column ``metrics``."""
    return models.select(F.col(name).alias("model"), F.explode("metrics").alias("metric", "value"))


def metric_texts(long: DataFrame, digits: int = 4) -> DataFrame:
    """model, label, text: metric names as words in title case, values with thousands set apart."""
    label = F.initcap(F.replace(F.col("metric"), F.lit("_"), F.lit(" ")))
    return long.select("model", label.alias("label"), F.format_number("value", digits).alias("text"))


def compare_models(long: DataFrame, metrics: Sequence[str], digits: int = 4, seconds: DataFrame | None = None) -> DataFrame:
    """One row per model, one rounded column per metric; with ``seconds`` (model, train_seconds) the training time too."""
    if seconds is not None:
        timed = seconds.select("model", F.lit("train_seconds").alias("metric"), F.col("train_seconds").cast("double").alias("value"))
        long, metrics = long.select("model", "metric", "value").unionByName(timed), [*metrics, "train_seconds"]
    wide = long.where(F.col("metric").isin(*metrics)).groupBy("model").pivot("metric", list(metrics)).agg(F.first("value"))
    return wide.select("model", *[F.round(m, digits).alias(m) for m in metrics])


def main_metric(long: DataFrame, metric: str, smaller_is_better: bool = False) -> DataFrame:
    """Models by one metric, the best first."""
    order = F.asc_nulls_last("value") if smaller_is_better else F.desc_nulls_last("value")
    return long.where(F.col("metric") == metric).select("model", "value").orderBy(order, "model")


def best_model(long: DataFrame, metric: str, smaller_is_better: bool = False) -> DataFrame:
    """One row: the best model by a metric, the first name on a tie."""
    sign = 1 if smaller_is_better else -1
    best = F.min(F.struct((sign * F.col("value")).alias("v"), "model"))
    rows = long.where((F.col("metric") == metric) & F.col("value").isNotNull())
    return rows.agg(best.alias("b")).select(F.col("b.model").alias("model"), (sign * F.col("b.v")).alias("value"))


def top_importances(importances: DataFrame, n: int = 10, by: Sequence[str] = ("model",)) -> DataFrame:
    """The n most important features per model with rank, share and running share."""
    w = W.partitionBy(*by)
    ranked = importances.select(
        "*",
        F.row_number().over(w.orderBy(F.desc("importance"), "feature")).alias("place"),
        safe_divide(F.col("importance"), F.sum("importance").over(w)).alias("share"),
    )
    upto = w.orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    return ranked.withColumn("running_share", F.sum("share").over(upto)).where(F.col("place") <= n)


def importance_summary(importances: DataFrame, n: int = 10, least: float = 0.01) -> DataFrame:
    """model, top_share (percent of the n largest), important: features above ``least``."""
    place = F.row_number().over(W.partitionBy("model").orderBy(F.desc("importance"), "feature"))
    top = F.sum(F.when(F.col("place") <= n, F.col("importance")))
    return importances.withColumn("place", place).groupBy("model").agg(
        F.round(safe_divide(top * 100, F.sum("importance")), 1).alias("top_share"),
        F.count_if(F.col("importance") > least).alias("important"),
    )


def importance_percent(importances: DataFrame) -> DataFrame:
    """model, feature, pct: percent of the model's total, rounded to 1, ascending."""
    share = safe_divide(F.col("importance") * 100, F.sum("importance").over(W.partitionBy("model")))
    return importances.select("model", "feature", F.round(share, 1).alias("pct")).orderBy("model", "pct", "feature")


def evaluate(df: DataFrame, task: str, label: str = "label", prediction: str = "prediction",
             probability: str | None = None, features: Sequence[str] = (), **reduction) -> dict[str, DataFrame]:
    """Named result tables for a task type: classification, regression, clustering or reduction."""
    if task == "classification":
        out = {
            "metrics": classification_metrics(df, label, prediction),
            "report": classification_report(df, label, prediction),
            "confusion": confusion_matrix(df, label, prediction),
        }
        if probability:
            out["confidence"] = confidence_summary(df, probability)
        return out
    if task == "regression":
        return {
            "metrics": regression_metrics(df, label, prediction),
            "report": regression_report(df, label, prediction),
            "residuals": residuals(df, label, prediction),
            "range": common_range(df, label, prediction),
        }
    if task == "clustering":
        from .clusters import cluster_metrics, cluster_sizes

        return {"metrics": cluster_metrics(df, features, prediction), "sizes": cluster_sizes(df, prediction)}
    if task == "reduction":
        from .clusters import reduction_metrics

        return {"metrics": reduction_metrics(df, **reduction)}
    raise ValueError(f"unknown task type: {task}")
