"""Evaluation queries over a rule-based prediction, so that every figure is exact."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from .base import query, rounded, table
from .monitoring import SCORED_SQL, _F1_SQL, scored


def three_way(spark, sf):
    """Return flag predicted from line number: three classes."""
    df = table(spark, sf, "lineitem")
    guess = F.element_at(F.array(*map(F.lit, "ANR")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return df.select(F.col("l_returnflag").alias("label"), guess.alias("prediction"))


THREE_SQL = """three AS (SELECT l_returnflag AS label, CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS prediction FROM lineitem)"""
_CLASSES_SQL = f"""WITH {THREE_SQL}, c AS (SELECT k AS class, count(*) FILTER (WHERE label = k) AS s, count(*) FILTER (WHERE prediction = k) AS p,
  CAST(count(*) FILTER (WHERE label = k AND prediction = k) AS DOUBLE) AS t FROM three, (SELECT unnest(['A', 'N', 'R']) AS k) GROUP BY k),
m AS (SELECT class, t / p AS precision, t / s AS recall, 2 * t / (s + p) AS f1, s AS support FROM c)"""


@query(
    "confusion_matrix",
    f"""WITH {THREE_SQL} SELECT a AS label, b AS prediction, count(label) AS n
FROM (SELECT unnest(['A', 'N', 'R']) AS a) CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS b)
LEFT JOIN three ON label = a AND prediction = b GROUP BY 1, 2""",
)
def confusion_matrix(spark, sf):
    return E.confusion_matrix(three_way(spark, sf), classes=["A", "N", "R"])


@query(
    "classification_metrics",
    _CLASSES_SQL
    + """ SELECT (SELECT round(avg(CAST(label = prediction AS INTEGER)), 6) FROM three) AS accuracy,
  round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall,
  round(sum(f1 * support) / sum(support), 6) AS f1, CAST(NULL AS DOUBLE) AS roc_auc FROM m""",
)
def classification_metrics(spark, sf):
    return rounded(E.classification_metrics(three_way(spark, sf)), 6, "accuracy", "precision", "recall", "f1")


@query(
    "classification_report",
    _CLASSES_SQL
    + """ SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m""",
)
def classification_report(spark, sf):
    return rounded(E.classification_report(three_way(spark, sf)), 6, "precision", "recall", "f1")


@query(
    "hard_label_auc",
    _F1_SQL + " SELECT round(avg(CAST(t AS DOUBLE) / s), 6) AS roc_auc FROM c",
)
def hard_label_auc(spark, sf):
    return rounded(E.classification_metrics(scored(spark, sf)).select("roc_auc"), 6, "roc_auc")


_CURVE_SQL = f"""WITH {SCORED_SQL}, g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY 1),
c AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn,
  CAST(sum(pos) OVER () AS DOUBLE) AS tp, CAST(sum(neg) OVER () AS DOUBLE) AS tn FROM g)"""
_ROC_SQL = _CURVE_SQL + " SELECT score AS threshold, round(cn / tn, 6) AS fpr, round(cp / tp, 6) AS tpr FROM c"


@query("roc_curve", _ROC_SQL)
def roc_curve(spark, sf):
    return rounded(E.roc_curve(scored(spark, sf), "label", "score"), 6, "fpr", "tpr")


@query("roc_curve_by_range", _ROC_SQL)
def roc_curve_by_range(spark, sf):
    return rounded(E.roc_curve(scored(spark, sf), "label", "score", buckets=8), 6, "fpr", "tpr")


@query(
    "roc_auc",
    _CURVE_SQL
    + """ SELECT round(sum(neg * (cp - pos / 2.0)) / (any_value(tp) * any_value(tn)), 6) AS auc,
  CAST(any_value(tp) AS BIGINT) AS positives, CAST(any_value(tn) AS BIGINT) AS negatives FROM c""",
)
def roc_auc(spark, sf):
    return rounded(E.roc_auc(scored(spark, sf), "label", "score"), 6, "auc")


@query(
    "precision_recall_curve",
    _CURVE_SQL + " SELECT score AS threshold, round(cp / (CAST(cp AS DOUBLE) + cn), 6) AS precision, round(cp / tp, 6) AS recall FROM c",
)
def precision_recall_curve(spark, sf):
    return rounded(E.precision_recall_curve(scored(spark, sf), "label", "score"), 6, "precision", "recall")


def priced(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction")
    )


PRICED_SQL = "priced AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS label, l_quantity * 1500 AS prediction FROM lineitem)"
_REG = """round(1 - sum((label - prediction) ** 2) / (var_pop(label) * count(*)), 6) AS r2,
  round(avg((label - prediction) ** 2), 2) AS mse, round(sqrt(avg((label - prediction) ** 2)), 4) AS rmse,
  round(avg(abs(label - prediction)), 4) AS mae, round(avg(abs((label - prediction) / label)), 6) AS mape"""


def _round_regression(df):
    return rounded(rounded(rounded(df, 6, "r2", "mape"), 2, "mse"), 4, "rmse", "mae")


@query("regression_metrics", f"WITH {PRICED_SQL} SELECT {_REG} FROM priced")
def regression_metrics(spark, sf):
    return _round_regression(E.regression_metrics(priced(spark, sf)))


@query(
    "regression_report",
    f"""WITH {PRICED_SQL} SELECT {_REG}, round(avg(label), 4) AS label_mean, round(stddev_pop(label), 4) AS label_std,
  round(avg(prediction), 4) AS prediction_mean, round(stddev_pop(prediction), 4) AS prediction_std FROM priced""",
)
def regression_report(spark, sf):
    out = _round_regression(E.regression_report(priced(spark, sf)))
    return rounded(out, 4, "label_mean", "label_std", "prediction_mean", "prediction_std")


@query("residuals", f"WITH {PRICED_SQL} SELECT *, round(label - prediction, 4) AS residual FROM priced")
def residuals(spark, sf):
    return rounded(E.residuals(priced(spark, sf), keep=["l_orderkey", "l_linenumber"]), 4, "residual")


@query("common_range", f"WITH {PRICED_SQL} SELECT least(min(label), min(prediction)) AS low, greatest(max(label), max(prediction)) AS high FROM priced")
def common_range(spark, sf):
    return E.common_range(priced(spark, sf))


def with_probability(spark, sf):
    return scored(spark, sf).withColumn("probability", F.array(1 - F.col("score"), F.col("score")))


@query(
    "confidence_summary",
    f"""WITH {SCORED_SQL}, c AS (SELECT greatest(1 - score, score) AS c FROM scored)
SELECT count(*) AS "rows", round(avg(c), 6) AS mean_confidence, round(avg(CAST(c > 0.9 AS INTEGER)), 6) AS high_share,
  round(avg(CAST(c < 0.5 AS INTEGER)), 6) AS low_share FROM c""",
)
def confidence_summary(spark, sf):
    return rounded(E.confidence_summary(with_probability(spark, sf)), 6, "mean_confidence", "high_share", "low_share")


@query(
    "confidence_histogram",
    f"""WITH {SCORED_SQL} SELECT CAST(least(29, floor(greatest(1 - score, score) * 30)) AS INTEGER) AS bin,
  label = prediction AS correct, count(*) AS n FROM scored GROUP BY 1, 2""",
)
def confidence_histogram(spark, sf):
    return E.confidence_histogram(with_probability(spark, sf), "label", "prediction")


# Metrics per ship mode of the data: one "model" per line number.
_MODEL_SQL = """long AS (SELECT 'model ' || l_linenumber AS model, unnest(['mean_price', 'mean_discount']) AS metric,
  unnest([avg(l_extendedprice), avg(l_discount)]) AS value FROM lineitem GROUP BY l_linenumber)"""


def model_metrics(spark, sf):
    models = table(spark, sf, "lineitem").groupBy("l_linenumber").agg(
        F.create_map(F.lit("mean_price"), F.avg("l_extendedprice"), F.lit("mean_discount"), F.avg("l_discount")).alias("metrics")
    )
    return E.metrics_long(models.select(F.concat(F.lit("model "), "l_linenumber").alias("model"), "metrics"))


@query("metrics_long", f"WITH {_MODEL_SQL} SELECT model, metric, round(value, 4) AS value FROM long")
def metrics_long(spark, sf):
    return rounded(model_metrics(spark, sf), 4, "value")


@query(
    "metric_texts",
    f"""WITH {_MODEL_SQL} SELECT model, array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(replace(metric, '_', ' '), ' ')], ' ') AS label,
  format('{{:,.4f}}', value) AS text FROM long""",
)
def metric_texts(spark, sf):
    return E.metric_texts(rounded(model_metrics(spark, sf), 9, "value"))


@query(
    "compare_models_timed",
    f"""WITH {_MODEL_SQL} SELECT model, round(max(CASE WHEN metric = 'mean_price' THEN value END), 4) AS mean_price,
  round(max(seconds), 4) AS train_seconds FROM long
JOIN (SELECT 'model ' || l_linenumber AS model, sum(l_quantity) / 1000 AS seconds FROM lineitem GROUP BY 1) USING (model) GROUP BY 1""",
)
def compare_models_timed(spark, sf):
    """Quantities stand in for the seconds of a training run."""
    name = F.concat(F.lit("model "), "l_linenumber").alias("model")
    seconds = table(spark, sf, "lineitem").groupBy(name).agg((F.sum("l_quantity") / 1000).alias("train_seconds"))
    return E.compare_models(model_metrics(spark, sf), ["mean_price"], seconds=seconds)


@query(
    "compare_models",
    f"""WITH {_MODEL_SQL} SELECT model, round(max(CASE WHEN metric = 'mean_price' THEN value END), 4) AS mean_price,
  round(max(CASE WHEN metric = 'mean_discount' THEN value END), 4) AS mean_discount FROM long GROUP BY 1""",
)
def compare_models(spark, sf):
    return E.compare_models(model_metrics(spark, sf), ["mean_price", "mean_discount"])


@query("main_metric", f"WITH {_MODEL_SQL} SELECT model, round(value, 4) AS value FROM long WHERE metric = 'mean_price'")
def main_metric(spark, sf):
    return rounded(E.main_metric(model_metrics(spark, sf), "mean_price"), 4, "value")


@query(
    "best_model",
    f"WITH {_MODEL_SQL} SELECT model, round(value, 4) AS value FROM long WHERE metric = 'mean_price' ORDER BY value, model LIMIT 1",
)
def best_model(spark, sf):
    return rounded(E.best_model(model_metrics(spark, sf), "mean_price", smaller_is_better=True), 4, "value")


# Revenue of each brand per size class stands in for feature importances.
def importances(spark, sf):
    return (
        table(spark, sf, "part")
        .groupBy((F.col("p_size") % 4).cast("string").alias("model"), F.col("p_brand").alias("feature"))
        .agg((F.sum("p_retailprice") / 1e6).alias("importance"))
    )


_IMP_SQL = """imp AS (SELECT CAST(p_size % 4 AS VARCHAR) AS model, p_brand AS feature, sum(p_retailprice) / 1e6 AS importance FROM part GROUP BY 1, 2),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS INTEGER) AS place,
  importance / sum(importance) OVER (PARTITION BY model) AS share FROM imp)"""


@query(
    "top_importances",
    f"""WITH {_IMP_SQL} SELECT model, feature, round(importance, 6) AS importance, place, round(share, 6) AS share, round(running_share, 6) AS running_share
FROM (SELECT *, sum(share) OVER (PARTITION BY model ORDER BY place) AS running_share FROM ranked) WHERE place <= 5""",
)
def top_importances(spark, sf):
    return rounded(E.top_importances(importances(spark, sf), 5), 6, "importance", "share", "running_share")


@query(
    "importance_summary",
    f"""WITH {_IMP_SQL} SELECT model, round(100 * sum(importance) FILTER (WHERE place <= 10) / sum(importance), 1) AS top_share,
  count(*) FILTER (WHERE importance > 0.01) AS important FROM ranked GROUP BY 1""",
)
def importance_summary(spark, sf):
    return E.importance_summary(importances(spark, sf), 10)


@query("importance_percent", f"WITH {_IMP_SQL} SELECT model, feature, round(100 * share, 1) AS pct FROM ranked")
def importance_percent(spark, sf):
    return E.importance_percent(importances(spark, sf))
