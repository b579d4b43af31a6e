"""Drift and monitoring queries. The events serve as a prediction log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.columns import safe_divide
from ..operators import drift as D
from ..operators import monitor as M
from .base import query, rounded, table, union_sql
from .selection import NOW, NOW_SQL, PREDICTIONS_SQL, predictions

CUT = "1998-01-01"
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]


def _lineitem_halves(spark, sf):
    df = table(spark, sf, "lineitem")
    early = F.col("l_shipdate") < F.lit(CUT).cast("timestamp_ntz")
    return df.where(early), df.where(~early)


# Cumulative shares of both sides at every value; KS is their largest gap.
_KS_SQL = union_sql(
    [
        f"""SELECT '{c}' AS feature, CAST(max(tr) AS BIGINT) AS ref_rows, CAST(max(tn) AS BIGINT) AS new_rows, max(abs(cr / tr - cn / tn)) AS d FROM (
  SELECT sum(r) OVER (ORDER BY v) AS cr, sum(n) OVER (ORDER BY v) AS cn,
    CAST(sum(r) OVER () AS DOUBLE) AS tr, CAST(sum(n) OVER () AS DOUBLE) AS tn FROM (
    SELECT {c} AS v, sum(CAST(l_shipdate < TIMESTAMP '{CUT}' AS INTEGER)) AS r,
      sum(CAST(l_shipdate >= TIMESTAMP '{CUT}' AS INTEGER)) AS n FROM lineitem GROUP BY 1))"""
        for c in NUMBERS
    ]
)
_KS_P = " + ".join(f"({2.0 if k % 2 else -2.0}) * exp(-2.0 * {k * k} * x * x)" for k in range(1, 13))
KS_FULL_SQL = f"""WITH k AS ({_KS_SQL}), e AS (SELECT *, sqrt(CAST(ref_rows AS DOUBLE) * new_rows / (ref_rows + new_rows)) AS s FROM k),
p AS (SELECT *, (s + 0.12 + 0.11 / s) * d AS x FROM e)
SELECT feature, ref_rows, new_rows, round(d, 9) AS statistic,
  round(CASE WHEN x < 0.3 THEN 1.0 ELSE least(1.0, greatest(0.0, {_KS_P})) END, 6) AS p_value,
  CASE WHEN x < 0.3 THEN 1.0 ELSE {_KS_P} END < 0.05 AS has_drift FROM p"""


def _ks(spark, sf, buckets):
    ref, new = _lineitem_halves(spark, sf)
    return rounded(rounded(D.ks_drift(ref, new, NUMBERS, buckets=buckets), 9, "statistic"), 6, "p_value")


@query("ks_drift", KS_FULL_SQL)
def ks_drift(spark, sf):
    return _ks(spark, sf, None)


@query("ks_drift_by_range", KS_FULL_SQL)
def ks_drift_by_range(spark, sf):
    """The bucketed form used on large tables."""
    return _ks(spark, sf, 16)


@query(
    "drift_detected",
    f"""SELECT count(*) AS features, count(*) FILTER (WHERE has_drift) AS drifted, bool_or(has_drift) AS drift_detected
FROM ({KS_FULL_SQL})""",
)
def drift_detected(spark, sf):
    ref, new = _lineitem_halves(spark, sf)
    return D.drift_detected(D.ks_drift(ref, new, NUMBERS))


def _kl_sql(shared: bool) -> str:
    side = {"r": f"l_shipdate < TIMESTAMP '{CUT}'", "n": f"l_shipdate >= TIMESTAMP '{CUT}'"}
    parts = []
    for c in NUMBERS:
        ctes = []
        for s, cond in side.items():
            edge_cond = "TRUE" if shared else cond
            scale = "" if shared else " / any_value((hi - lo) / 50)"
            ctes.append(
                f"""{s}e AS (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem WHERE {edge_cond}),
{s}h AS (SELECT CAST(least(49, floor(({c} - lo) / ((hi - lo) / 50))) AS INTEGER) AS bin,
  count(*) / CAST((SELECT count(*) FROM lineitem WHERE {cond}) AS DOUBLE){scale} AS h FROM lineitem, {s}e WHERE {cond} GROUP BY 1)"""
            )
        parts.append(
            f"""SELECT '{c}' AS feature, round(sum(p * ln(p / q)), 6) AS score FROM (WITH {', '.join(ctes)}
SELECT greatest(coalesce(rh.h, 0.0), 1e-10) AS p, greatest(coalesce(nh.h, 0.0), 1e-10) AS q
FROM (SELECT unnest(range(50)) AS bin) g LEFT JOIN rh ON g.bin = rh.bin LEFT JOIN nh ON g.bin = nh.bin)"""
        )
    return union_sql(parts)


@query("kl_drift", _kl_sql(True))
def kl_drift(spark, sf):
    return rounded(D.kl_drift(*_lineitem_halves(spark, sf), NUMBERS), 6, "score")


@query("kl_drift_own_bins", _kl_sql(False))
def kl_drift_own_bins(spark, sf):
    return rounded(D.kl_drift(*_lineitem_halves(spark, sf), NUMBERS, mode="own"), 6, "score")


TEXTS = ["l_returnflag", "l_linestatus"]
_SHARES_SQL = union_sql(
    [
        f"""SELECT '{c}' AS feature, {c} AS value,
  sum(CAST(l_shipdate < TIMESTAMP '{CUT}' AS INTEGER)) / (SELECT CAST(count(*) AS DOUBLE) FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUT}') AS p,
  sum(CAST(l_shipdate >= TIMESTAMP '{CUT}' AS INTEGER)) / (SELECT CAST(count(*) AS DOUBLE) FROM lineitem WHERE l_shipdate >= TIMESTAMP '{CUT}') AS q
FROM lineitem GROUP BY 2"""
        for c in TEXTS
    ]
)


@query("category_shares", f"SELECT feature, value, round(p, 6) AS p, round(q, 6) AS q FROM ({_SHARES_SQL})")
def category_shares(spark, sf):
    return rounded(D.category_shares(*_lineitem_halves(spark, sf), TEXTS), 6, "p", "q")


@query("category_drift", f"SELECT feature, round(avg(abs(p - q)), 9) AS score FROM ({_SHARES_SQL}) GROUP BY 1")
def category_drift(spark, sf):
    return rounded(D.category_drift(*_lineitem_halves(spark, sf), TEXTS), 9, "score")


@query(
    "chi_square_drift",
    union_sql(
        [
            f"""SELECT '{c}' AS feature, round(sum((r - s * tr / (tr + tn)) ** 2 / (s * tr / (tr + tn))
    + (n - s * tn / (tr + tn)) ** 2 / (s * tn / (tr + tn))), 6) AS statistic, CAST(count(*) - 1 AS INTEGER) AS freedom FROM (
  SELECT *, r + n AS s, CAST(sum(r) OVER () AS DOUBLE) AS tr, CAST(sum(n) OVER () AS DOUBLE) AS tn FROM (
    SELECT {c}, sum(CAST(l_shipdate < TIMESTAMP '{CUT}' AS INTEGER)) AS r,
      sum(CAST(l_shipdate >= TIMESTAMP '{CUT}' AS INTEGER)) AS n FROM lineitem GROUP BY 1))"""
            for c in ["l_returnflag", "l_linestatus", "l_linenumber"]
        ]
    ),
)
def chi_square_drift(spark, sf):
    ref, new = _lineitem_halves(spark, sf)
    out = D.chi_square_drift(ref, new, ["l_returnflag", "l_linestatus", "l_linenumber"])
    return rounded(out.select("feature", "statistic", "freedom"), 6, "statistic")


@query("table_drift_flags")
def table_drift_flags(spark, sf):
    """The chi-square test with p-values and flags."""
    ref, new = _lineitem_halves(spark, sf)
    return D.chi_square_drift(ref, new, ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"])


_PERIOD_SQL = """halves AS (SELECT *, epoch_us(ts) < (SELECT avg(epoch_us(ts)) FROM events) AS early FROM events),
num AS (SELECT 'value' AS feature, sum(p * ln(p / q)) AS score FROM (
  SELECT greatest(coalesce(a, 0) / (SELECT CAST(count(*) AS DOUBLE) FROM halves WHERE early), 1e-10) AS p,
    greatest(coalesce(b, 0) / (SELECT CAST(count(*) AS DOUBLE) FROM halves WHERE NOT early), 1e-10) AS q
  FROM (SELECT unnest(range(50)) AS bin) g LEFT JOIN (
    SELECT CAST(least(49, floor((value - lo) / ((hi - lo) / 50))) AS INTEGER) AS bin,
      sum(CAST(early AS INTEGER)) AS a, sum(CAST(NOT early AS INTEGER)) AS b
    FROM halves, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1) h ON g.bin = h.bin)),
cat AS (SELECT 'event_type' AS feature, avg(abs(p - q)) AS score FROM (
  SELECT event_type, sum(CAST(early AS INTEGER)) / (SELECT CAST(count(*) AS DOUBLE) FROM halves WHERE early) AS p,
    sum(CAST(NOT early AS INTEGER)) / (SELECT CAST(count(*) AS DOUBLE) FROM halves WHERE NOT early) AS q FROM halves GROUP BY 1)),
scores AS (SELECT * FROM num UNION ALL SELECT * FROM cat)"""


@query("period_drift", f"WITH {_PERIOD_SQL} SELECT feature, round(score, 6) AS score FROM scores")
def period_drift(spark, sf):
    return rounded(D.period_drift(table(spark, sf, "events"), "ts", ["value", "event_type"]), 6, "score")


@query(
    "drifting_features",
    f"""WITH {_PERIOD_SQL} SELECT feature, round(score, 6) AS score FROM scores WHERE score > (SELECT avg(score) FROM scores)""",
)
def drifting_features(spark, sf):
    scores = D.period_drift(table(spark, sf, "events"), "ts", ["value", "event_type"])
    return rounded(D.drifting_features(scores), 6, "score")


@query(
    "period_statistics",
    """SELECT CASE WHEN early THEN 1 ELSE 2 END AS period, 'value' AS feature, count(*) AS "count", round(avg(value), 4) AS mean,
  round(stddev_samp(value), 4) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 4) AS q25,
  round(median(value), 4) AS q50, round(quantile_cont(value, 0.75), 4) AS q75, max(value) AS max
FROM (SELECT *, epoch_us(ts) < (SELECT avg(epoch_us(ts)) FROM events) AS early FROM events) GROUP BY early""",
)
def period_statistics(spark, sf):
    out = D.period_statistics(table(spark, sf, "events"), "ts", ["value"])
    return rounded(out, 4, "mean", "std", "q25", "q50", "q75")


@query(
    "drift_by_role",
    f"""SELECT CASE feature WHEN 'l_returnflag' THEN 'target' ELSE 'feature' END AS role, feature, round(avg(abs(p - q)), 9) AS score
FROM ({_SHARES_SQL}) GROUP BY 1, 2""",
)
def drift_by_role(spark, sf):
    ref, new = _lineitem_halves(spark, sf)
    return rounded(D.drift_by_role(ref, new, ["l_linestatus"], target="l_returnflag"), 9, "score")


@query(
    "own_monitors",
    f"""SELECT 'mean shift' AS monitor, 'l_quantity' AS feature,
  round(abs(avg(l_quantity) FILTER (WHERE l_shipdate < TIMESTAMP '{CUT}') - avg(l_quantity) FILTER (WHERE l_shipdate >= TIMESTAMP '{CUT}')), 6) AS score
FROM lineitem UNION ALL SELECT 'shares', feature, round(avg(abs(p - q)), 6) FROM ({_SHARES_SQL}) GROUP BY feature""",
)
def own_monitors(spark, sf):
    def mean_shift(ref, new):
        before = ref.agg(F.avg("l_quantity").alias("a")).scalar()
        return new.agg(F.abs(F.avg("l_quantity") - before).alias("score")).select(F.lit("l_quantity").alias("feature"), "score")

    monitors = {"mean shift": mean_shift, "shares": lambda a, b: D.category_drift(a, b, TEXTS)}
    return rounded(D.run_monitors(*_lineitem_halves(spark, sf), monitors), 6, "score")


# A rule-based prediction, so that every score is exact: returned items are
# those with more than 25 pieces.
def scored(spark, sf):
    return table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_quantity") > 25).cast("int").alias("prediction"),
        (F.col("l_quantity") / 50).alias("score"),
    )


SCORED_SQL = """scored AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label,
  CAST(l_quantity > 25 AS INTEGER) AS prediction, l_quantity / 50 AS score FROM lineitem)"""


@query(
    "performance_check",
    f"""WITH {SCORED_SQL}, a AS (SELECT avg(CAST(label = prediction AS INTEGER)) AS s FROM scored)
SELECT round(s, 6) AS current_score, round(0.9 - s, 6) AS performance_drop, 0.9 - s > 0.1 AS requires_retraining FROM a""",
)
def performance_check(spark, sf):
    out = M.performance_check(scored(spark, sf), "label", "prediction", 0.9)
    return rounded(out, 6, "current_score", "performance_drop")


@query(
    "performance_own_metric",
    f"""WITH {SCORED_SQL}, a AS (SELECT CAST(count(*) FILTER (WHERE label = 1 AND prediction = 1) AS DOUBLE) / count(*) FILTER (WHERE label = 1) AS s FROM scored)
SELECT round(s, 6) AS current_score, round(0.55 - s, 6) AS performance_drop, 0.55 - s > 0.1 AS requires_retraining FROM a""",
)
def performance_own_metric(spark, sf):
    def recall(y, p):
        return safe_divide(F.count_if((y == 1) & (p == 1)), F.count_if(y == 1))

    out = M.performance_check(scored(spark, sf), "label", "prediction", 0.55, metric=recall)
    return rounded(out, 6, "current_score", "performance_drop")


@query(
    "prediction_statistics",
    """SELECT round(avg(p), 4) AS mean, round(stddev_pop(p), 4) AS std, round(min(p), 4) AS min, round(max(p), 4) AS max, round(avg((y - p) ** 2), 2) AS mse,
  round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2
FROM (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)""",
)
def prediction_statistics(spark, sf):
    df = table(spark, sf, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1500).alias("p"))
    out = M.prediction_statistics(df, "p", "l_extendedprice")
    return rounded(rounded(rounded(out, 4, "mean", "std", "min", "max"), 2, "mse"), 6, "r2")


_F1_SQL = f"""WITH {SCORED_SQL}, c AS (SELECT k, count(*) FILTER (WHERE label = k) AS s, count(*) FILTER (WHERE prediction = k) AS p,
  count(*) FILTER (WHERE label = k AND prediction = k) AS t FROM scored, (SELECT unnest([0, 1]) AS k) GROUP BY k)"""


@query(
    "prediction_statistics_classes",
    _F1_SQL
    + """ SELECT round(avg(prediction), 6) AS mean, round(stddev_pop(prediction), 6) AS std, CAST(min(prediction) AS DOUBLE) AS min,
  CAST(max(prediction) AS DOUBLE) AS max, round(avg(CAST(label = prediction AS INTEGER)), 6) AS accuracy,
  (SELECT round(sum(s * 2.0 * t / (s + p)) / sum(s), 6) FROM c) AS f1_score FROM scored""",
)
def prediction_statistics_classes(spark, sf):
    out = M.prediction_statistics(scored(spark, sf), "prediction", "label")
    return rounded(out, 6, "mean", "std", "accuracy", "f1_score")


@query(
    "monitoring_decision",
    f"""WITH k AS ({KS_FULL_SQL}), r AS (SELECT bool_or(has_drift) AS drift_detected, count(*) FILTER (WHERE has_drift) AS drifted,
  (SELECT count(*) FROM lineitem WHERE l_shipdate >= TIMESTAMP '{CUT}') AS data_size FROM k),
w AS (WITH {SCORED_SQL} SELECT round(0.9 - avg(CAST(label = prediction AS INTEGER)), 6) AS performance_drop FROM scored)
SELECT r.*, performance_drop, CASE WHEN data_size < 1000 THEN 'too few rows' WHEN drift_detected THEN 'drift'
  WHEN performance_drop > 0.1 THEN 'performance' ELSE 'none' END AS reason,
  data_size >= 1000 AND (drift_detected OR performance_drop > 0.1) AS "update" FROM r, w""",
)
def monitoring_decision(spark, sf):
    ref, new = _lineitem_halves(spark, sf)
    performance = M.performance_check(scored(spark, sf), "label", "prediction", 0.9)
    report = M.monitoring_report(ref, new, NUMBERS, rounded(performance, 6, "performance_drop"))
    return M.should_update(report, NOW, NOW - dt.timedelta(days=3))


# Daily figures of the events as a metric log: model = user group.
METRICS_SQL = """metrics AS (SELECT user_id % 20 AS model_id, event_type AS metric, avg(value) AS value FROM events GROUP BY 1, 2)"""
RULES_SQL = """rules AS (SELECT c_custkey AS alert_id, c_custkey % 20 AS model_id, 'quality' AS type,
  CASE c_custkey % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'view' WHEN 2 THEN 'click' ELSE 'latency' END AS metric,
  CASE c_custkey % 3 WHEN 0 THEN 'greater_than' WHEN 1 THEN 'less_than' ELSE 'near' END AS operator,
  50.0::DOUBLE AS threshold, c_custkey % 5 <> 0 AS is_active FROM customer
UNION ALL SELECT c_custkey, c_custkey % 20, 'quality', 'purchase', 'greater_than', 40.0::DOUBLE, c_custkey % 5 <> 0 FROM customer)"""


def daily_metrics(spark, sf):
    return table(spark, sf, "events").groupBy((F.col("user_id") % 20).alias("model_id"), F.col("event_type").alias("metric")).agg(
        F.avg("value").alias("value")
    )


def alert_rules(spark, sf):
    """Two conditions per alert, from the customers."""
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    pick = lambda m, names: F.element_at(F.array(*map(F.lit, names)), (key % m + 1).cast("int"))
    base = [key.alias("alert_id"), (key % 20).alias("model_id"), F.lit("quality").alias("type")]
    active = (key % 5 != 0).alias("is_active")
    first = c.select(
        *base,
        pick(4, ["error", "view", "click", "latency"]).alias("metric"),
        pick(3, ["greater_than", "less_than", "near"]).alias("operator"),
        F.lit(50.0).alias("threshold"),
        active,
    )
    second = c.select(
        *base, F.lit("purchase").alias("metric"), F.lit("greater_than").alias("operator"), F.lit(40.0).alias("threshold"), active
    )
    return first.unionByName(second)


_FIRES_SQL = f"""{METRICS_SQL}, {RULES_SQL}, fired AS (SELECT alert_id, model_id, count(*) AS conditions, bool_and(coalesce(CASE operator
  WHEN 'greater_than' THEN value > threshold WHEN 'less_than' THEN value < threshold ELSE TRUE END, TRUE)) AS fires
FROM rules LEFT JOIN metrics USING (model_id, metric) WHERE is_active GROUP BY 1, 2)"""


@query("check_alerts", f"WITH {_FIRES_SQL} SELECT * FROM fired")
def check_alerts(spark, sf):
    return M.check_alerts(alert_rules(spark, sf), daily_metrics(spark, sf))


@query(
    "notifications",
    f"""WITH {_FIRES_SQL} SELECT alert_id, model_id, n_name AS name FROM fired JOIN nation ON n_nationkey = model_id WHERE fires""",
)
def notifications(spark, sf):
    rules, metrics = alert_rules(spark, sf), daily_metrics(spark, sf)
    models = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("model_id"), F.col("n_name").alias("name"))
    sent = M.notifications(M.check_alerts(rules, metrics), rules, models, metrics)
    return sent.select("alert_id", "model_id", F.regexp_extract("message", "model: (.*)", 1).alias("name"))


@query("unread_notifications", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def unread_notifications(spark, sf):
    sent = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    reads = table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("id"))
    return M.unread(sent, reads)


_CHANGE_SQL = """SELECT event_id, event_type, value, lag(value) OVER w AS previous, round(value - lag(value) OVER w, 6) AS change
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)"""


def _changes(spark, sf, buckets):
    df = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    out = M.series_changes(df, ["event_type"], "ts", "value", "event_id", buckets)
    return rounded(out.drop("ts"), 6, "change")


@query("series_changes", _CHANGE_SQL)
def series_changes(spark, sf):
    return _changes(spark, sf, None)


@query("series_changes_by_range", _CHANGE_SQL)
def series_changes_by_range(spark, sf):
    return _changes(spark, sf, 16)


@query(
    "latest_and_change",
    """SELECT event_type, arg_max(value, ts) AS latest, round(arg_max(value, ts) - arg_min(value, ts), 6) AS change FROM events GROUP BY 1""",
)
def latest_and_change(spark, sf):
    return rounded(M.latest_and_change(table(spark, sf, "events"), ["event_type"], "ts", "value", "event_id"), 6, "change")


@query(
    "metric_summary",
    """SELECT event_type AS metric, max(value) AS best, min(value) AS worst, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std
FROM events GROUP BY 1""",
)
def metric_summary(spark, sf):
    long = table(spark, sf, "events").select(F.col("event_type").alias("metric"), "value")
    return rounded(M.metric_summary(long), 6, "mean", "std")


@query(
    "resource_summary",
    """SELECT 'value' AS measure, arg_max(value, ts) AS current, round(avg(value), 6) AS mean, max(value) AS peak, count(*) AS n FROM events
UNION ALL SELECT 'load', arg_max(CAST(user_id AS DOUBLE), ts), round(avg(user_id), 6), CAST(max(user_id) AS DOUBLE), count(*) FROM events""",
)
def resource_summary(spark, sf):
    df = table(spark, sf, "events").select("ts", "event_id", "value", F.col("user_id").cast("double").alias("load"))
    return rounded(M.resource_summary(df, "ts", ["value", "load"], "event_id"), 6, "mean")


@query(
    "prediction_log_summary",
    f"""WITH {PREDICTIONS_SQL} SELECT count(*) AS "rows", round(avg(CAST(status = 'ok' AS INTEGER)), 6) AS success_rate,
  round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (WHERE confidence < 0.5) AS uncertain FROM predictions""",
)
def prediction_log_summary(spark, sf):
    return rounded(M.prediction_log_summary(predictions(spark, sf)), 6, "success_rate", "mean_confidence")


def _last_sql(n: int) -> str:
    return f"""SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r
FROM events) WHERE r <= {n}"""


@query("last_thousand", _last_sql(1000))
def last_thousand(spark, sf):
    return M.last_rows(table(spark, sf, "events"), ["event_type"], "ts", "event_id", 1000).select("event_id", "event_type")


@query("last_many", _last_sql(1500))
def last_many(spark, sf):
    return M.last_rows(table(spark, sf, "events"), ["event_type"], "ts", "event_id", 1500).select("event_id", "event_type")


@query(
    "late_labels",
    "SELECT doc_id, source, quality FROM documents LEFT JOIN labels USING (doc_id)",
)
def late_labels(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return M.attach_labels(docs, table(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"])


@query(
    "label_share",
    """SELECT count(*) AS "rows", count(quality) AS labelled, round(count(quality) / CAST(count(*) AS DOUBLE), 6) AS share
FROM documents LEFT JOIN labels USING (doc_id)""",
)
def label_share(spark, sf):
    return rounded(M.label_share(late_labels(spark, sf), "quality"), 6, "share")


@query("retained_log", f"SELECT event_id, ts FROM events WHERE ts >= {NOW_SQL} - INTERVAL 10 DAY")
def retained_log(spark, sf):
    return M.keep_since(table(spark, sf, "events").select("event_id", "ts"), "ts", NOW, 10)
