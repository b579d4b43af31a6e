"""Feature preparation queries: statistics from one table, applied to it or another."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import prepare as R
from ..operators import rebalance as B
from .base import GAPS_SQL, gappy_lineitem, query, rounded, table

KEY = ["l_orderkey", "l_partkey", "l_linenumber"]
KEY_SQL = "l_orderkey, l_partkey, l_linenumber"


def _gaps(spark, sf):
    return gappy_lineitem(spark, sf).select(*KEY, "l_quantity", "l_discount", "l_returnflag")


def _fill_sql(number: str) -> str:
    return f"""WITH {GAPS_SQL}, m AS (SELECT l_returnflag AS v FROM gaps WHERE l_returnflag IS NOT NULL
  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT {KEY_SQL}, round(coalesce(l_quantity, (SELECT {number.format(c='l_quantity')} FROM gaps)), 6) AS l_quantity,
  round(coalesce(l_discount, (SELECT {number.format(c='l_discount')} FROM gaps)), 6) AS l_discount,
  coalesce(l_returnflag, (SELECT v FROM m)) AS l_returnflag FROM gaps"""


def _filled(spark, sf, strategy):
    df = _gaps(spark, sf)
    filler = R.MissingFiller(strategy, columns=["l_quantity", "l_discount", "l_returnflag"])
    return rounded(filler.fit(df).transform(df), 6, "l_quantity", "l_discount")


@query("fill_mean", _fill_sql("avg({c})"))
def fill_mean(spark, sf):
    return _filled(spark, sf, "mean")


@query("fill_median", _fill_sql("median({c})"))
def fill_median(spark, sf):
    return _filled(spark, sf, "median")


@query(
    "fill_most_frequent",
    f"""WITH {GAPS_SQL}, c AS (
  SELECT 'q' AS f, l_quantity AS v, count(*) AS n FROM gaps WHERE l_quantity IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'd', l_discount, count(*) FROM gaps WHERE l_discount IS NOT NULL GROUP BY 2),
m AS (SELECT f, v FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY n DESC, v) AS r FROM c) WHERE r = 1),
t AS (SELECT l_returnflag AS v FROM gaps WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT {KEY_SQL}, coalesce(l_quantity, (SELECT v FROM m WHERE f = 'q')) AS l_quantity,
  coalesce(l_discount, (SELECT v FROM m WHERE f = 'd')) AS l_discount,
  coalesce(l_returnflag, (SELECT v FROM t)) AS l_returnflag FROM gaps""",
)
def fill_most_frequent(spark, sf):
    df = _gaps(spark, sf)
    return R.MissingFiller("most_frequent").fit(df).transform(df)


@query(
    "fill_constant_chosen",
    f"""WITH {GAPS_SQL} SELECT {KEY_SQL}, coalesce(l_quantity, -1) AS l_quantity, l_discount, l_returnflag FROM gaps""",
)
def fill_constant_chosen(spark, sf):
    df = _gaps(spark, sf)
    return R.MissingFiller("constant", columns=["l_quantity"], fillValue=-1).fit(df).transform(df)


@query(
    "default_cleaning",
    f"""WITH {GAPS_SQL}, m AS (SELECT l_returnflag AS v FROM gaps WHERE l_returnflag IS NOT NULL
  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber,
  round(coalesce(l_quantity, (SELECT median(l_quantity) FROM gaps)), 6) AS l_quantity,
  coalesce(l_returnflag, (SELECT v FROM m)) AS l_returnflag FROM gaps""",
)
def default_cleaning(spark, sf):
    df = gappy_lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag")
    return rounded(R.default_cleaning(df), 6, "l_quantity")


_BOUNDS_SQL = """b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
  SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events))"""


def _values(spark, sf):
    return table(spark, sf, "events").select("event_id", "value")


@query(
    "outliers_clipped",
    f"WITH {_BOUNDS_SQL} SELECT event_id, round(least(greatest(value, lo), hi), 6) AS value FROM events, b",
)
def outliers_clipped(spark, sf):
    df = _values(spark, sf)
    return rounded(R.OutlierHandler("iqr", ["value"]).fit(df).transform(df), 6, "value")


@query(
    "outliers_to_mean",
    """WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS d FROM events)
SELECT event_id, round(CASE WHEN abs((value - m) / d) > 1.5 THEN m ELSE value END, 6) AS value FROM events, s""",
)
def outliers_to_mean(spark, sf):
    df = _values(spark, sf)
    return rounded(R.OutlierHandler("zscore", ["value"]).fit(df).transform(df), 6, "value")


@query("outliers_removed", f"WITH {_BOUNDS_SQL} SELECT event_id, value FROM events, b WHERE value BETWEEN lo AND hi")
def outliers_removed(spark, sf):
    df = _values(spark, sf)
    return R.OutlierHandler("remove", ["value"]).fit(df).transform(df)


@query(
    "label_encoded",
    f"""WITH {GAPS_SQL}, v AS (SELECT DISTINCT coalesce(l_returnflag, 'MISSING') AS v FROM gaps),
codes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM v)
SELECT {KEY_SQL}, code AS l_returnflag FROM gaps JOIN codes ON coalesce(l_returnflag, 'MISSING') = v""",
)
def label_encoded(spark, sf):
    df = gappy_lineitem(spark, sf).select(*KEY, "l_returnflag")
    return R.LabelEncoder(["l_returnflag"]).fit(df).transform(df)


@query(
    "label_codes_of_many",
    """WITH v AS (SELECT DISTINCT c_name AS v FROM customer), codes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM v)
SELECT c_custkey, code AS c_name FROM customer JOIN codes ON c_name = v""",
)
def label_codes_of_many(spark, sf):
    """The form for columns with too many values to hold in one place."""
    df = table(spark, sf, "customer").select("c_custkey", "c_name")
    return R.encode_by_table(df, "c_name", R.code_table(df, "c_name"))


@query(
    "label_encoded_many",
    """WITH v AS (SELECT DISTINCT c_name AS v FROM customer), codes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM v)
SELECT c_custkey, code AS c_name FROM customer JOIN codes ON c_name = v""",
)
def label_encoded_many(spark, sf):
    """The encoder itself on a column where every row has its own value."""
    df = table(spark, sf, "customer").select("c_custkey", "c_name")
    return R.LabelEncoder(["c_name"]).fit(df).transform(df)


@query(
    "indicator_vector",
    f"""WITH {GAPS_SQL}, v AS (SELECT DISTINCT coalesce(l_returnflag, 'MISSING') AS v FROM gaps),
codes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM v)
SELECT {KEY_SQL}, code AS place, 1.0::DOUBLE AS total FROM gaps JOIN codes ON coalesce(l_returnflag, 'MISSING') = v""",
)
def indicator_vector(spark, sf):
    df = gappy_lineitem(spark, sf).select(*KEY, "l_returnflag")
    out = R.indicator_vector("l_returnflag", "v").fit(df).transform(df).withColumn("a", vector_to_array("v"))
    total = F.aggregate("a", F.lit(0.0), lambda acc, x: acc + x)
    return out.select(*KEY, (F.array_position("a", F.lit(1.0)) - 1).alias("place"), total.alias("total"))


@query(
    "indicator_columns",
    f"""WITH {GAPS_SQL} SELECT {KEY_SQL}, CAST(coalesce(l_returnflag, 'MISSING') = 'A' AS INTEGER) AS "l_returnflag_A",
  CAST(coalesce(l_returnflag, 'MISSING') = 'MISSING' AS INTEGER) AS "l_returnflag_MISSING",
  CAST(coalesce(l_returnflag, 'MISSING') = 'N' AS INTEGER) AS "l_returnflag_N",
  CAST(coalesce(l_returnflag, 'MISSING') = 'R' AS INTEGER) AS "l_returnflag_R" FROM gaps""",
)
def indicator_columns(spark, sf):
    df = gappy_lineitem(spark, sf).select(*KEY, "l_returnflag")
    return R.IndicatorEncoder(["l_returnflag"]).fit(df).transform(df)


@query(
    "ordinal_encoded",
    """SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS BIGINT) AS o_orderstatus FROM orders""",
)
def ordinal_encoded(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return R.OrdinalEncoder({"o_orderstatus": ["P", "O", "F"]}).fit(df).transform(df)


def _scale(spark, sf, method):
    """Statistics from the orders before 1998 half, applied to all: no leak from the rest."""
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    train = df.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    model = R.Scaler(method, ["o_totalprice"]).fit(train)
    return rounded(model.transform(df).drop("o_orderdate"), 6, "o_totalprice")


def _scale_sql(center: str, spread: str) -> str:
    return f"""WITH s AS (SELECT {center} AS a, {spread} AS b FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')
SELECT o_orderkey, round((o_totalprice - a) / b, 6) AS o_totalprice FROM orders, s"""


@query("scaled_standard", _scale_sql("avg(o_totalprice)", "stddev_pop(o_totalprice)"))
def scaled_standard(spark, sf):
    return _scale(spark, sf, "standard")


@query("scaled_minmax", _scale_sql("min(o_totalprice)", "max(o_totalprice) - min(o_totalprice)"))
def scaled_minmax(spark, sf):
    return _scale(spark, sf, "minmax")


@query(
    "scaled_robust",
    _scale_sql("median(o_totalprice)", "quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)"),
)
def scaled_robust(spark, sf):
    return _scale(spark, sf, "robust")


@query(
    "full_preparation",
    f"""WITH {GAPS_SQL}, m AS (SELECT l_returnflag AS v FROM gaps WHERE l_returnflag IS NOT NULL
  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
filled AS (SELECT l_orderkey, coalesce(l_quantity, (SELECT avg(l_quantity) FROM gaps)) AS q,
  coalesce(l_returnflag, (SELECT v FROM m)) AS f FROM gaps),
b AS (SELECT a - 1.5 * (z - a) AS lo, z + 1.5 * (z - a) AS hi FROM (
  SELECT quantile_cont(q, 0.25) AS a, quantile_cont(q, 0.75) AS z FROM filled)),
clipped AS (SELECT l_orderkey, least(greatest(q, lo), hi) AS q,
  CASE f WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS f FROM filled, b),
s AS (SELECT avg(q) AS mq, stddev_pop(q) AS dq, avg(f) AS mf, stddev_pop(f) AS df FROM clipped)
SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, round((q - mq) / dq, 6) AS l_quantity, round((f - mf) / df, 6) AS l_returnflag
FROM clipped, s""",
)
def full_preparation(spark, sf):
    df = gappy_lineitem(spark, sf).select("l_orderkey", "l_quantity", "l_returnflag")
    out = R.full_preparation(df, target="l_orderkey").fit_transform(df)
    return rounded(out.withColumn("l_orderkey", F.col("l_orderkey").cast("double")), 6, "l_quantity", "l_returnflag")


_TARGET_CODE = "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"


@query(
    "basic_preparation",
    f"""SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_totalprice, o_orderpriority,
  CAST({_TARGET_CODE} AS BIGINT) AS o_orderstatus FROM orders""",
)
def basic_preparation(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return R.basic_preparation(df, "o_orderstatus").fit_transform(df)


@query(
    "training_preparation",
    f"""SELECT CAST(o_orderkey AS FLOAT) AS o_orderkey, CAST(o_totalprice AS FLOAT) AS o_totalprice,
  CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS FLOAT) AS o_orderpriority,
  CAST({_TARGET_CODE} AS BIGINT) AS o_orderstatus FROM orders""",
)
def training_preparation(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return R.training_preparation(df, "o_orderstatus").fit_transform(df)


@query(
    "trainer_preparation",
    f"""SELECT round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS o_totalprice,
  dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority,
  CAST({_TARGET_CODE} AS BIGINT) AS o_orderstatus FROM orders""",
)
def trainer_preparation(spark, sf):
    df = table(spark, sf, "orders").select("o_totalprice", "o_orderpriority", "o_orderstatus")
    return rounded(R.trainer_preparation(df, "o_orderstatus").fit_transform(df), 6, "o_totalprice")


@query(
    "class_weights",
    """SELECT l_returnflag, count(*) AS n, round((SELECT count(*) FROM lineitem)
  / (CAST((SELECT count(DISTINCT l_returnflag) FROM lineitem) AS DOUBLE) * count(*)), 6) AS weight FROM lineitem GROUP BY 1""",
)
def class_weights(spark, sf):
    return rounded(B.class_weights(table(spark, sf, "lineitem"), "l_returnflag"), 6, "weight")


@query(
    "weighted_rows",
    """WITH w AS (SELECT o_orderstatus, (SELECT count(*) FROM orders)
  / (CAST((SELECT count(DISTINCT o_orderstatus) FROM orders) AS DOUBLE) * count(*)) AS weight FROM orders GROUP BY 1)
SELECT o_orderkey, o_orderstatus, round(weight, 6) AS weight FROM orders JOIN w USING (o_orderstatus)""",
)
def weighted_rows(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return rounded(B.with_class_weights(df, "o_orderstatus"), 6, "weight")


@query(
    "undersampled",
    """SELECT event_id, event_type FROM (SELECT event_id, event_type,
  row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR) || '|42'), event_id) AS r FROM events)
WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM events GROUP BY event_type))""",
)
def undersampled(spark, sf):
    return B.undersample(table(spark, sf, "events").select("event_id", "event_type"), "event_type", "event_id")


@query(
    "drop_constant_and_correlated",
    "SELECT o_orderkey, o_totalprice FROM orders",
)
def drop_constant_and_correlated(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.lit(7).alias("seven"), (F.col("o_orderkey") * -2 + 1).alias("mirrored"), "o_totalprice"
    )
    return Pipeline(stages=[R.ConstantColumnDropper(), R.CorrelatedColumnDropper()]).fit(df).transform(df)


@query(
    "mutual_information",
    """WITH e AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a1, quantile_cont(l_extendedprice, 0.5) AS a2,
  quantile_cont(l_extendedprice, 0.75) AS a3, quantile_cont(l_quantity, 0.25) AS b1, quantile_cont(l_quantity, 0.5) AS b2,
  quantile_cont(l_quantity, 0.75) AS b3 FROM lineitem),
cells AS (SELECT 'l_extendedprice' AS feature, l_returnflag AS y, CAST(l_extendedprice > a1 AS INTEGER)
    + CAST(l_extendedprice > a2 AS INTEGER) + CAST(l_extendedprice > a3 AS INTEGER) AS bin FROM lineitem, e
  UNION ALL SELECT 'l_quantity', l_returnflag, CAST(l_quantity > b1 AS INTEGER) + CAST(l_quantity > b2 AS INTEGER)
    + CAST(l_quantity > b3 AS INTEGER) FROM lineitem, e),
j AS (SELECT feature, bin, y, CAST(count(*) AS DOUBLE) AS n FROM cells GROUP BY 1, 2, 3)
SELECT feature, round(sum(t), 6) AS mi FROM (SELECT feature, n / sum(n) OVER (PARTITION BY feature)
  * ln(n * sum(n) OVER (PARTITION BY feature) / (sum(n) OVER (PARTITION BY feature, bin) * sum(n) OVER (PARTITION BY feature, y))) AS t
FROM j) GROUP BY 1""",
)
def mutual_information(spark, sf):
    df = table(spark, sf, "lineitem")
    return rounded(B.mutual_information(df, ["l_extendedprice", "l_quantity"], "l_returnflag", bins=4), 6, "mi")


@query(
    "target_encoded",
    """WITH m AS (SELECT c_mktsegment, avg(c_acctbal) AS e FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1)
SELECT c_custkey, c_mktsegment, round(coalesce(e, (SELECT avg(c_acctbal) FROM customer WHERE c_custkey % 2 = 0)), 4) AS encoded
FROM customer LEFT JOIN m USING (c_mktsegment)""",
)
def target_encoded(spark, sf):
    """Means from the even customers, applied to all."""
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    train = df.where(F.col("c_custkey") % 2 == 0)
    out = B.target_encode(train, df, "c_mktsegment", "c_acctbal", "encoded")
    return rounded(out.select("c_custkey", "c_mktsegment", "encoded"), 4, "encoded")


@query(
    "evidence_weights",
    """WITH t AS (SELECT CAST(sum(CAST(l_returnflag = 'R' AS INTEGER)) AS DOUBLE) AS p, count(*) AS n FROM lineitem)
SELECT l_linenumber AS value, count(*) AS n, round(ln(((sum(CAST(l_returnflag = 'R' AS INTEGER)) + 1) / (any_value(p) + 2))
  / ((count(*) - sum(CAST(l_returnflag = 'R' AS INTEGER)) + 1) / (any_value(t.n) - any_value(p) + 2))), 6) AS woe
FROM lineitem, t GROUP BY 1""",
)
def evidence_weights(spark, sf):
    df = table(spark, sf, "lineitem").select("l_linenumber", (F.col("l_returnflag") == "R").alias("returned"))
    return rounded(B.evidence_weights(df, "l_linenumber", "returned"), 6, "woe")
