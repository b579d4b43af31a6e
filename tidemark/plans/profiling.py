"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..functions.scratch import scratch_path
from ..operators import profile as P
from ..operators import sketches as K
from .base import GAPS_SQL, gappy_lineitem, query, rounded, table, union_sql

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
GAP_NUMBERS = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]


def _describe_sql(columns: list[str], source: str) -> str:
    return union_sql(
        [
            f"""SELECT '{c}' AS feature, count({c}) AS "count", round(avg({c}), 4) AS mean,
  round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q25,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS q50,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q75,
  CAST(max({c}) AS DOUBLE) AS max FROM {source}"""
            for c in columns
        ]
    )


@query("describe_numbers", _describe_sql(NUMBERS, "lineitem"))
def describe_numbers(spark, sf):
    out = P.describe(table(spark, sf, "lineitem"), NUMBERS)
    return rounded(out, 4, "mean", "std", "q25", "q50", "q75")


@query("describe_with_gaps", f"WITH {GAPS_SQL}\n" + _describe_sql(GAP_NUMBERS, "gaps"))
def describe_with_gaps(spark, sf):
    out = P.describe(gappy_lineitem(spark, sf), GAP_NUMBERS)
    return rounded(out, 4, "mean", "std", "q25", "q50", "q75")


@query(
    "quantiles_by_rank",
    union_sql(
        [
            f"""SELECT '{c}' AS feature, count({c}) AS n, round(quantile_cont({c}, 0.01), 4) AS p01,
  round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.99), 4) AS p99 FROM lineitem"""
            for c in NUMBERS
        ]
    ),
)
def quantiles_by_rank(spark, sf):
    """The form used on tables too large for one task."""
    found = quantiles(table(spark, sf, "lineitem"), NUMBERS, [0.01, 0.5, 0.99], buckets=16)
    return found.select(
        "feature", "n", *[F.round(F.col("q")[i], 4).alias(c) for i, c in enumerate(["p01", "p50", "p99"])]
    )


@query(
    "numeric_profile",
    union_sql(
        [
            f"""SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median,
  round(stddev_samp({c}), 4) AS std, min({c}) AS min, max({c}) AS max,
  round(skewness({c}), 6) AS skew, round(kurtosis({c}), 6) AS kurtosis FROM lineitem"""
            for c in NUMBERS
        ]
    ),
)
def numeric_profile(spark, sf):
    out = P.numeric_profile(table(spark, sf, "lineitem"), NUMBERS)
    return rounded(rounded(out, 4, "mean", "median", "std"), 6, "skew", "kurtosis")


@query(
    "dataset_info",
    """SELECT 'rows' AS kind, count(*) AS n FROM lineitem
UNION ALL SELECT 'columns', count(*) FROM (DESCRIBE SELECT * FROM lineitem)
UNION ALL SELECT 'type ' || CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
  WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END, count(*)
FROM (DESCRIBE SELECT * FROM lineitem) GROUP BY 1""",
)
def dataset_info(spark, sf):
    return P.dataset_info(table(spark, sf, "lineitem"))


_GAP_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
_NULLS_SQL = union_sql(
    [
        f"""SELECT '{c}' AS feature, count(*) AS "rows", count(*) - count({c}) AS missing,
  round(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_pct, count(DISTINCT {c}) AS "distinct" FROM gaps"""
        for c in _GAP_COLUMNS
    ]
)


@query(
    "missing_report",
    f"""WITH {GAPS_SQL}, per AS ({_NULLS_SQL})
SELECT feature, "rows", missing, missing_pct FROM per WHERE missing > 0""",
)
def missing_report(spark, sf):
    return P.missing_report(gappy_lineitem(spark, sf))


@query(
    "missing_total",
    f"""WITH {GAPS_SQL}, per AS ({_NULLS_SQL})
SELECT CAST(sum(missing) AS BIGINT) AS total_missing,
  count(*) FILTER (WHERE missing > 0) AS columns_with_missing FROM per""",
)
def missing_total(spark, sf):
    return P.missing_total(gappy_lineitem(spark, sf))


@query(
    "distinct_counts",
    f"""WITH {GAPS_SQL}, per AS ({_NULLS_SQL}) SELECT feature, "distinct" FROM per""",
)
def distinct_counts(spark, sf):
    return P.distinct_counts(gappy_lineitem(spark, sf))


@query(
    "distinct_by_day",
    """WITH w AS (SELECT * FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20')
SELECT 'event_type' AS feature, count(*) AS "rows", count(DISTINCT event_type) AS "distinct", TRUE AS close FROM w
UNION ALL SELECT 'user_id', count(*), count(DISTINCT user_id), TRUE FROM w
UNION ALL SELECT 'value', count(*), count(DISTINCT value), TRUE FROM w""",
)
def distinct_by_day(spark, sf):
    """Sketches of all days are stored; those of sixteen days are merged and held against the exact counts."""
    df = table(spark, sf, "events").select("ts", "event_type", "user_id", "value")
    root = scratch_path(spark, "sketches")
    K.record_days(df, root, "ts")
    days = F.to_date("ts").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date"))
    exact = P.distinct_counts(df.where(days), ["event_type", "user_id", "value"])
    merged = K.profile_of_days(spark, root, "2024-01-05", "2024-01-20").select("feature", "rows", F.col("distinct").alias("estimate"))
    close = F.abs(F.col("estimate") - F.col("distinct")) <= 0.04 * F.col("distinct")
    return exact.join(merged, "feature").select("feature", "rows", "distinct", close.alias("close"))


@query(
    "column_overview",
    f"""WITH {GAPS_SQL}, per AS ({_NULLS_SQL})
SELECT feature, CASE WHEN feature IN ('l_orderkey', 'l_partkey', 'l_suppkey') THEN 'bigint'
  WHEN feature = 'l_linenumber' THEN 'int' WHEN feature IN ('l_returnflag', 'l_linestatus') THEN 'string'
  WHEN feature = 'l_shipdate' THEN 'timestamp_ntz' ELSE 'double' END AS type, "distinct", missing_pct FROM per""",
)
def column_overview(spark, sf):
    return P.column_overview(gappy_lineitem(spark, sf))


@query(
    "value_counts",
    f"""WITH {GAPS_SQL} SELECT l_returnflag AS value, count(*) AS n FROM gaps
WHERE l_returnflag IS NOT NULL GROUP BY 1""",
)
def value_counts(spark, sf):
    return P.value_counts(gappy_lineitem(spark, sf), "l_returnflag")


_SHARE_SQL = """WITH {gaps}, c AS (SELECT l_returnflag AS value, count(*) AS n FROM gaps GROUP BY 1)
SELECT value, n, round(n / (SELECT CAST(sum(n) AS DOUBLE) FROM c {where}), 6) AS share
FROM c WHERE value IS NOT NULL"""


@query("value_shares", _SHARE_SQL.format(gaps=GAPS_SQL, where="WHERE value IS NOT NULL"))
def value_shares(spark, sf):
    return rounded(P.value_shares(gappy_lineitem(spark, sf), "l_returnflag"), 6, "share")


@query("class_balance", _SHARE_SQL.format(gaps=GAPS_SQL, where=""))
def class_balance(spark, sf):
    return rounded(P.value_shares(gappy_lineitem(spark, sf), "l_returnflag", of_all_rows=True), 6, "share")


@query(
    "top_values",
    """WITH c AS (
  SELECT 'c_mktsegment' AS feature, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2
  UNION ALL SELECT 'c_name', c_name, count(*) FROM customer GROUP BY 2)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS INTEGER) AS place FROM c)
WHERE place <= 5""",
)
def top_values(spark, sf):
    return P.top_values(table(spark, sf, "customer"))


@query(
    "duplicate_rows",
    """SELECT CAST(sum(n) AS BIGINT) AS "rows", CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (
  SELECT l_quantity, l_discount, l_tax, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4)""",
)
def duplicate_rows(spark, sf):
    return P.duplicate_rows(table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag"))


# A heavy-tailed column, so that some rows lie outside the fences.
TAIL = "value * value"


def _fence_sql(source: str, columns: list[str]) -> str:
    return union_sql(
        [
            f"""SELECT '{c}' AS feature, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
  SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {source})"""
            for c in columns
        ]
    )


@query(
    "numeric_stats",
    "WITH d AS ("
    + _describe_sql(["value"], "events")
    + f"), f AS ({_fence_sql('events', ['value'])})"
    + """
SELECT d.*, (SELECT count(*) FROM events, f WHERE value < lo OR value > hi) AS outliers,
  round(lo, 4) AS lower_bound, round(hi, 4) AS upper_bound FROM d JOIN f USING (feature)""",
)
def numeric_stats(spark, sf):
    out = P.numeric_stats(table(spark, sf, "events"), ["value"])
    return rounded(out, 4, "mean", "std", "q25", "q50", "q75", "lower_bound", "upper_bound")


@query(
    "outlier_rows",
    f"""WITH f AS ({_fence_sql('events', ['value'])})
SELECT event_id, value FROM events, f WHERE value < lo OR value > hi""",
)
def outlier_rows(spark, sf):
    return P.outlier_rows(table(spark, sf, "events").select("event_id", "value"), "value")


@query(
    "target_profile_number",
    """SELECT 'mean' AS fact, round(avg(o_totalprice), 4) AS value FROM orders
UNION ALL SELECT 'median', round(median(o_totalprice), 4) FROM orders
UNION ALL SELECT 'std', round(stddev_samp(o_totalprice), 4) FROM orders
UNION ALL SELECT 'min', min(o_totalprice) FROM orders UNION ALL SELECT 'max', max(o_totalprice) FROM orders""",
)
def target_profile_number(spark, sf):
    return rounded(P.target_profile(table(spark, sf, "orders"), "o_totalprice"), 4, "value")


@query(
    "target_profile_text",
    """WITH c AS (SELECT o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 1)
SELECT 'distinct' AS fact, CAST(count(*) AS DOUBLE) AS value FROM c
UNION ALL SELECT 'count ' || v, CAST(n AS DOUBLE) FROM c
UNION ALL SELECT 'share ' || v, round(n / (SELECT CAST(sum(n) AS DOUBLE) FROM c), 6) FROM c""",
)
def target_profile_text(spark, sf):
    return rounded(P.target_profile(table(spark, sf, "orders"), "o_orderstatus"), 6, "value")


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]
_CORR_PAIRS = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]]
_CORR_SQL = union_sql(
    [f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM gaps" for a, b in _CORR_PAIRS]
)


@query("correlations", f"WITH {GAPS_SQL} {_CORR_SQL}")
def correlations(spark, sf):
    return rounded(P.strongest_correlations(gappy_lineitem(spark, sf), _CORR), 6, "r")


@query(
    "correlation_matrix",
    f"""WITH {GAPS_SQL}, half AS ({_CORR_SQL})
SELECT a, b, r FROM half UNION ALL SELECT b, a, r FROM half
UNION ALL SELECT DISTINCT c, c, CAST(1.0 AS DOUBLE) FROM (SELECT a AS c FROM half UNION ALL SELECT b FROM half)""",
)
def correlation_matrix(spark, sf):
    return rounded(P.correlation_matrix(gappy_lineitem(spark, sf), _CORR), 6, "r")


@query(
    "wide_correlations",
    """WITH cells AS (SELECT vec_id, d, CASE WHEN (vec_id + d) % 7 > 0 THEN x END AS x
  FROM (SELECT vec_id, unnest(range(64)) AS d, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings))
SELECT 'e' || a.d AS a, 'e' || b.d AS b, round(corr(a.x, b.x), 6) AS r FROM cells a JOIN cells b ON a.vec_id = b.vec_id AND a.d < b.d
WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2""",
)
def wide_correlations(spark, sf):
    """All pairs of the 64 axes in one read, with gaps in every column."""
    cells = [F.when((F.col("vec_id") + d) % 7 > 0, F.col("embedding")[d].cast("double")).alias(f"e{d}") for d in range(64)]
    return rounded(P.correlations(table(spark, sf, "embeddings").select(cells)), 6, "r")


@query(
    "high_correlations",
    """SELECT 'event_id' AS a, 'doubled' AS b, round(abs(corr(event_id, 5 - 2 * event_id)), 6) AS r FROM events""",
)
def high_correlations(spark, sf):
    df = table(spark, sf, "events").select("event_id", (5 - 2 * F.col("event_id")).alias("doubled"), "value")
    return rounded(P.high_correlations(df), 6, "r")


@query(
    "histogram",
    """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, (max(o_totalprice) - min(o_totalprice)) / 30 AS w FROM orders)
SELECT 'o_totalprice' AS feature, bin, round(any_value(lo) + bin * any_value(w), 4) AS low,
  round(any_value(lo) + (bin + 1) * any_value(w), 4) AS high, count(*) AS n
FROM (SELECT lo, w, CAST(least(29, floor((o_totalprice - lo) / w)) AS INTEGER) AS bin FROM orders, e) GROUP BY bin""",
)
def histogram(spark, sf):
    return rounded(P.histogram(table(spark, sf, "orders"), ["o_totalprice"], 30), 4, "low", "high")


@query(
    "box_summary",
    f"""WITH f AS ({_fence_sql('events', ['value'])})
SELECT 'value' AS feature, min(value) FILTER (WHERE value BETWEEN lo AND hi) AS low_whisker,
  round(quantile_cont(value, 0.25), 4) AS q25, round(median(value), 4) AS median,
  round(quantile_cont(value, 0.75), 4) AS q75,
  max(value) FILTER (WHERE value BETWEEN lo AND hi) AS high_whisker FROM events, f""",
)
def box_summary(spark, sf):
    return rounded(P.box_summary(table(spark, sf, "events"), ["value"]), 4, "q25", "median", "q75")


@query(
    "missing_pattern_sample",
    f"""WITH {GAPS_SQL}, ids AS (SELECT *, l_orderkey || '-' || l_partkey || '-' || l_linenumber AS row_id FROM gaps)
SELECT row_id, CAST(l_quantity IS NULL AS INTEGER) AS l_quantity, CAST(l_discount IS NULL AS INTEGER) AS l_discount,
  CAST(l_tax IS NULL AS INTEGER) AS l_tax, CAST(l_returnflag IS NULL AS INTEGER) AS l_returnflag
FROM ids ORDER BY md5(CAST(row_id AS VARCHAR) || '|42'), row_id LIMIT 100""",
)
def missing_pattern_sample(spark, sf):
    row_id = F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber")
    df = gappy_lineitem(spark, sf).select(
        row_id.alias("row_id"), "l_quantity", "l_discount", "l_tax", "l_returnflag"
    )
    return P.missing_pattern_sample(df, "row_id", 100)


@query(
    "row_sample",
    """SELECT o_orderkey, o_totalprice, o_custkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42'), o_orderkey LIMIT 100""",
)
def row_sample(spark, sf):
    return P.row_sample(table(spark, sf, "orders"), "o_orderkey", ["o_totalprice", "o_custkey"], 100)


@query(
    "simple_stats",
    union_sql(
        [
            f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std, min({c}) AS min, max({c}) AS max FROM lineitem"
            for c in NUMBERS
        ]
    ),
)
def simple_stats(spark, sf):
    return rounded(P.simple_stats(table(spark, sf, "lineitem"), NUMBERS), 4, "mean", "std")


@query(
    "feature_insight",
    f"""WITH {GAPS_SQL}, f AS ({_fence_sql('gaps', ['l_discount'])})
SELECT 'l_discount' AS feature, count(*) - count(l_discount) AS missing,
  round(100.0 * (count(*) - count(l_discount)) / count(*), 2) AS missing_pct,
  count(DISTINCT l_discount) AS "distinct", count(*) FILTER (WHERE l_discount < lo OR l_discount > hi) AS outliers
FROM gaps, f""",
)
def feature_insight(spark, sf):
    return P.feature_insight(gappy_lineitem(spark, sf), "l_discount")


@query(
    "group_shares",
    """SELECT label AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM embeddings), 1) AS pct
FROM embeddings GROUP BY 1""",
)
def group_shares(spark, sf):
    return P.group_shares(table(spark, sf, "embeddings"), "label")


@query(
    "importance_matrix",
    """SELECT o_orderpriority AS feature, sum(CASE WHEN o_orderstatus = 'F' THEN 1 END) / CAST(count(*) AS DOUBLE) AS "F",
  sum(CASE WHEN o_orderstatus = 'O' THEN 1 END) / CAST(count(*) AS DOUBLE) AS "O",
  sum(CASE WHEN o_orderstatus = 'P' THEN 1 END) / CAST(count(*) AS DOUBLE) AS "P" FROM orders GROUP BY 1""",
)
def importance_matrix(spark, sf):
    """The status share of each priority stands in for a feature's importance per model."""
    orders = table(spark, sf, "orders")
    counts = orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    totals = counts.groupBy("o_orderpriority").agg(F.sum("n").alias("t"))
    long = counts.join(totals, "o_orderpriority").select(
        F.col("o_orderpriority").alias("feature"),
        F.col("o_orderstatus").alias("model"),
        (F.col("n") / F.col("t")).alias("importance"),
    )
    return P.importance_matrix(long, ["F", "O", "P"])
