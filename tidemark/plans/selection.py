"""Projection, filter and validation queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import select as S
from ..operators import validate as V
from ..operators.profile import null_counts
from .base import GAPS_SQL, gappy_lineitem, query, rounded, table, union_sql

NOW = dt.datetime(2024, 1, 20, 12)
NOW_SQL = "TIMESTAMP '2024-01-20 12:00:00'"


@query(
    "columns_by_type",
    """SELECT * FROM (SELECT 'numerical' AS kind, unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber',
  'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, (SELECT count(*) FROM lineitem) AS n
UNION ALL SELECT 'categorical', 'l_linestatus', (SELECT count(*) FROM lineitem)
UNION ALL SELECT 'datetime', 'l_shipdate', (SELECT count(*) FROM lineitem))""",
)
def columns_by_type(spark, sf):
    return S.type_overview(table(spark, sf, "lineitem"), target="l_returnflag")


@query("default_features", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem")
def default_features(spark, sf):
    df = table(spark, sf, "lineitem")
    return df.select(*S.default_features(df, "l_quantity"))


@query("split_target_features", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def split_target_features(spark, sf):
    return S.split_target(table(spark, sf, "orders"), "o_orderstatus")[0]


@query(
    "drop_sparse_columns",
    f"""WITH {GAPS_SQL} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  l_discount, l_returnflag, l_linestatus, l_shipdate FROM gaps""",
)
def drop_sparse_columns(spark, sf):
    return S.drop_sparse_columns(gappy_lineitem(spark, sf))


@query(
    "last_week",
    f"""SELECT event_id, ts, value FROM events WHERE ts BETWEEN {NOW_SQL} - INTERVAL 7 DAY AND {NOW_SQL}""",
)
def last_week(spark, sf):
    return S.last_days(table(spark, sf, "events").select("event_id", "ts", "value"), "ts", NOW, "week")


@query(
    "recent_counts",
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE ts > {NOW_SQL} - INTERVAL 24 HOUR) AS recent FROM events""",
)
def recent_counts(spark, sf):
    return S.recent_counts(table(spark, sf, "events"), "ts", NOW)


PREDICTIONS_SQL = """predictions AS (SELECT event_id, ts, user_id, event_type, props AS input, value AS prediction,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS confidence,
  CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'uncertain' ELSE 'ok' END AS status
  FROM events)"""


def predictions(spark, sf):
    """The events as a prediction log."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "uncertain")
    return table(spark, sf, "events").select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        F.col("props").alias("input"),
        F.col("value").alias("prediction"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("confidence"),
        status.otherwise("ok").alias("status"),
    )


@query(
    "filter_predictions",
    f"""WITH {PREDICTIONS_SQL} SELECT ts, input, prediction, confidence, status FROM predictions
WHERE confidence >= 0.4 AND status IN ('ok', 'uncertain')""",
)
def filter_predictions(spark, sf):
    return S.filter_predictions(predictions(spark, sf), 0.4, ["ok", "uncertain"])


@query(
    "metric_anomalies",
    """SELECT event_id, event_type, value FROM events JOIN
  (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1) USING (event_type)
WHERE abs(value - m) > 2 * s""",
)
def metric_anomalies(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type", "value")
    return S.metric_anomalies(df, "value", ["event_type"])


@query(
    "split_at_mean_time",
    """WITH m AS (SELECT avg(epoch_us(ts)) AS m FROM events)
SELECT CASE WHEN epoch_us(ts) < m THEN 1 ELSE 2 END AS period, count(*) AS n FROM events, m GROUP BY 1""",
)
def split_at_mean_time(spark, sf):
    return S.split_at_mean_time(table(spark, sf, "events"), "ts").groupBy("period").agg(F.count("*").alias("n"))


@query("metric_rows", "SELECT event_id, event_type AS metric, value FROM events WHERE event_type <> 'view'")
def metric_rows(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.col("event_type").alias("metric"), "value")
    return S.metric_rows(df, "view", others=True)


@query("scoring_columns", "SELECT l_tax, l_discount, l_quantity FROM lineitem")
def scoring_columns(spark, sf):
    return S.scoring_columns(table(spark, sf, "lineitem"), ["l_tax", "l_discount", "l_quantity"])


@query(
    "storage_safe",
    f"""WITH {GAPS_SQL} SELECT l_orderkey, coalesce(l_returnflag, 'NA') AS l_returnflag,
  coalesce(l_quantity, -999) AS l_quantity, coalesce(strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'), 'NA') AS l_shipdate FROM gaps""",
)
def storage_safe(spark, sf):
    return S.storage_safe(gappy_lineitem(spark, sf).select("l_orderkey", "l_returnflag", "l_quantity", "l_shipdate"))


@query("to_float32", "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS FLOAT) AS l_extendedprice FROM lineitem")
def to_float32(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return S.to_float32(df, ["l_extendedprice"])


MIXED = "CASE WHEN l_partkey % 3 = 0 THEN CAST(l_partkey AS VARCHAR) ELSE l_returnflag END"


@query(
    "mixed_types",
    f"""WITH {GAPS_SQL}, m AS (SELECT {MIXED} AS mixed, l_linestatus FROM gaps)
SELECT 'mixed' AS feature, count(*) - count(mixed) AS nulls, count(TRY_CAST(mixed AS DOUBLE)) AS numbers,
  count(mixed) - count(TRY_CAST(mixed AS DOUBLE)) AS texts FROM m
UNION ALL SELECT 'l_linestatus', 0, 0, count(*) FROM m""",
)
def mixed_types(spark, sf):
    df = gappy_lineitem(spark, sf).select(
        F.expr(MIXED.replace("VARCHAR", "STRING")).alias("mixed"), "l_linestatus"
    )
    return V.mixed_types(df)


_CHECKED = ["l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag"]
_FACTS = union_sql(
    [
        f"SELECT '{c}' AS feature, count(*) AS n, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS d FROM gaps"
        for c in _CHECKED
    ]
)
_OUT = union_sql(
    [
        f"""SELECT '{c}' AS feature, count(*) FILTER (WHERE x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a)) / CAST(count(*) AS DOUBLE) AS ratio
FROM (SELECT {c} AS x FROM gaps), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS a, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS b FROM gaps)"""
        for c in _CHECKED[:4]
    ]
)


@query(
    "validation_issues",
    f"""WITH {GAPS_SQL}, facts AS ({_FACTS}), outs AS ({_OUT}), r AS (
SELECT feature, missing / CAST(n AS DOUBLE) AS miss, d / CAST(n AS DOUBLE) AS uniq FROM facts)
SELECT 'error' AS severity, 'missing' AS rule, feature, round(miss, 6) AS ratio FROM r WHERE miss > 0.2
UNION ALL SELECT 'warning', 'few unique', feature, round(uniq, 6) FROM r WHERE uniq < 0.01
UNION ALL SELECT 'warning', 'many unique', feature, round(uniq, 6) FROM r WHERE uniq > 0.99
UNION ALL SELECT 'warning', 'mixed types', 'l_returnflag', round(count(l_returnflag) / CAST(count(*) AS DOUBLE), 6) FROM gaps
UNION ALL SELECT 'warning', 'outliers', feature, round(ratio, 6) FROM outs WHERE ratio > 0""",
)
def validation_issues(spark, sf):
    return rounded(V.issues(gappy_lineitem(spark, sf).select(*_CHECKED)), 6, "ratio")


_ORDER_FACTS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(DISTINCT {c}) / count(*) AS ratio, count(*) AS n FROM orders"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
)
_ORDER_OUTLIERS = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) / count(*) AS ratio
    FROM orders, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM orders)"""
    for c in ("o_orderkey", "o_custkey", "o_totalprice")
)
_ORDER_ISSUES = f"""
  SELECT 'warning' AS severity, 'few unique' AS rule, feature, ratio, 0.01 AS lim FROM ({_ORDER_FACTS}) WHERE ratio < 0.01
  UNION ALL SELECT 'warning', 'many unique', feature, ratio, 0.99 FROM ({_ORDER_FACTS}) WHERE ratio > 0.99
  UNION ALL SELECT 'warning', 'outliers', feature, ratio, NULL FROM ({_ORDER_OUTLIERS}) WHERE ratio > 0"""


def _report_issues(report):
    """One row per issue of a report, with the fields of the report itself."""
    return report.select(
        "dataset", "total_rows", "total_columns", F.col("unique_values")["o_custkey"].alias("customers"),
        F.round(F.col("numeric_stats")["o_totalprice"]["mean"], 4).alias("mean_price"), F.explode("issues").alias("i"),
    ).select("dataset", "total_rows", "total_columns", "customers", "mean_price", "i.severity", "i.rule", "i.feature",
             F.round("i.ratio", 8).alias("ratio"), F.col("i.limit").alias("lim"))


@query(
    "training_report",
    f"""SELECT 'training_data' AS dataset, (SELECT count(*) FROM orders) AS total_rows, 6 AS total_columns,
  (SELECT count(DISTINCT o_custkey) FROM orders) AS customers, (SELECT round(avg(o_totalprice), 4) FROM orders) AS mean_price,
  severity, rule, feature, round(ratio, 8) AS ratio, CAST(lim AS DOUBLE) AS lim FROM ({_ORDER_ISSUES})""",
)
def training_report(spark, sf):
    return _report_issues(V.validate_training(table(spark, sf, "orders"), "o_orderstatus"))


@query(
    "scoring_report",
    f"""SELECT 'prediction_data' AS dataset, (SELECT count(*) FROM orders) AS total_rows, 2 AS total_columns,
  (SELECT count(DISTINCT o_custkey) FROM orders) AS customers, (SELECT round(avg(o_totalprice), 4) FROM orders) AS mean_price,
  severity, rule, feature, round(ratio, 8) AS ratio, CAST(lim AS DOUBLE) AS lim
FROM (SELECT * FROM ({_ORDER_ISSUES}) WHERE feature IN ('o_custkey', 'o_totalprice')
  UNION ALL VALUES ('error', 'absent column', 'o_channel', NULL, NULL), ('warning', 'column not used', 'o_custkey', NULL, NULL))""",
)
def scoring_report(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_totalprice")
    return _report_issues(V.validate_scoring(orders, ["o_totalprice", "o_channel"]))


@query(
    "suitability",
    "SELECT count(*) AS \"rows\", 3 AS features, CAST(CASE WHEN count(*) >= 50 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score FROM orders",
)
def suitability(spark, sf):
    return V.suitability(table(spark, sf, "orders"), ["o_custkey", "o_totalprice", "o_orderdate"])


@query(
    "above_mean_missing",
    f"""WITH {GAPS_SQL}, f AS ({_FACTS}) SELECT feature, missing FROM f WHERE missing > (SELECT avg(missing) FROM f)""",
)
def above_mean_missing(spark, sf):
    return S.above_mean(null_counts(gappy_lineitem(spark, sf), _CHECKED).select("feature", "missing"), "missing")
