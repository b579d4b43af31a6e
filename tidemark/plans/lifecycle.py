"""Sources, log tables, registry, text search and streaming queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.scratch import scratch_path
from ..operators import monitor as M
from ..operators import text as X
from ..operators import validate as V
from ..sources import alerts as A
from ..sources import logs as L
from ..sources import readers as R
from ..sources import registry as G
from ..sources import reports as J
from ..streaming import monitoring as S
from .base import query, rounded, table
from .evaluation import _MODEL_SQL, model_metrics
from .monitoring import METRICS_SQL, RULES_SQL, alert_rules
from .selection import PREDICTIONS_SQL, predictions


@query("csv_round_trip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_round_trip(spark, sf):
    """Written with a header, read back with the types given."""
    path = scratch_path(spark, "orders") + ".csv"
    df = table(spark, sf, "orders").drop("o_orderdate")
    R.write_predictions(df, path, "csv")
    return R.read_csv(spark, path, schema=df.schema)


@query(
    "csv_inferred_clean",
    "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_totalprice, o_orderstatus FROM orders",
)
def csv_inferred_clean(spark, sf):
    """Types inferred from the file, then the default cleaning."""
    path = scratch_path(spark, "orders") + ".csv"
    R.write_predictions(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, "csv")
    return R.load_clean(spark, path)


@query("json_round_trip", "SELECT event_id, event_type, value FROM events")
def json_round_trip(spark, sf):
    path = scratch_path(spark, "events") + ".json"
    df = table(spark, sf, "events").select("event_id", "event_type", "value")
    R.write_predictions(df, path, "json")
    return R.read_table(spark, path, schema=df.schema)


@query("preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def preview(spark, sf):
    return R.preview(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


def prediction_log(spark, sf):
    """The events written as a prediction log, partitioned by day."""
    root = scratch_path(spark, "logs")
    rows = predictions(spark, sf).select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 5).alias("model_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "prediction",
        F.create_map(F.lit("value"), F.col("prediction"), F.lit("user"), F.col("user_id").cast("double")).alias("features"),
        "confidence",
        "status",
    )
    L.append_log(rows, root, "prediction_logs")
    return root


@query(
    "scan_log",
    f"""WITH {PREDICTIONS_SQL} SELECT event_id AS id, user_id % 5 AS model_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, prediction,
  CAST(NULL AS DOUBLE) AS actual, confidence, status, CAST(user_id AS DOUBLE) AS user, prediction AS value
FROM predictions WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12 12:00:00'""",
)
def scan_log(spark, sf):
    """Written once, then a time range with its map spread to columns."""
    rows = L.scan_log(spark, prediction_log(spark, sf), "prediction_logs", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 12, 12))
    wide = L.spread_map(rows, "features")
    return wide.withColumn("at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).drop("ts")


@query(
    "scan_log_of_model",
    """SELECT event_id AS id, metric, CAST(CASE metric WHEN 'user' THEN user_id ELSE value END AS DOUBLE) AS value
FROM events, (SELECT unnest(['user', 'value']) AS metric)
WHERE user_id % 5 = 3 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12 12:00:00'""",
)
def scan_log_of_model(spark, sf):
    root = prediction_log(spark, sf)
    rows = L.scan_log(spark, root, "prediction_logs", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 12, 12), model_id=3)
    return L.map_long(rows, "features", ["id"])


@query("kept_log_days", "SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def kept_log_days(spark, sf):
    rows = L.read_log(spark, prediction_log(spark, sf), "prediction_logs")
    return L.drop_old_days(rows, dt.datetime(2024, 1, 20, 12), 10).select("id")


# Orders as model versions: one name per customer group.
def registry_rows(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("model "), (F.col("o_custkey") % 50).cast("string")).alias("name"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
        F.col("o_orderstatus").alias("model_type"),
        F.create_map(F.lit("price"), "o_totalprice", F.lit("thousands"), F.col("o_totalprice") / 1000).alias("metrics"),
    )
    return G.number_versions(rows)


_REG_SQL = """rows AS (SELECT o_orderkey AS id, 'model ' || o_custkey % 50 AS name, o_orderdate AS created_at, o_orderstatus AS model_type, o_totalprice,
  row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate, o_orderkey) AS v FROM orders),
models AS (SELECT *, 'v' || v AS version FROM rows)"""


@query("number_versions", f"WITH {_REG_SQL} SELECT id, name, version FROM models")
def number_versions(spark, sf):
    return registry_rows(spark, sf).select("id", "name", "version")


@query("latest_versions", f"WITH {_REG_SQL} SELECT name, arg_max(id, v) AS id, arg_max(version, v) AS version FROM models GROUP BY 1")
def latest_versions(spark, sf):
    return G.latest_versions(registry_rows(spark, sf))


@query("model_names", "SELECT DISTINCT 'model ' || o_custkey % 50 AS name FROM orders")
def model_names(spark, sf):
    return G.model_names(registry_rows(spark, sf))


@query("newest_models", f"WITH {_REG_SQL} SELECT id, version FROM models WHERE name = 'model 7'")
def newest_models(spark, sf):
    return G.newest_first(registry_rows(spark, sf), "model 7").select("id", "version")


@query(
    "history_view",
    f"""WITH {_REG_SQL} SELECT name, version, model_type, strftime(created_at, '%Y-%m-%d %H:%M') AS created,
  strftime(created_at, '%Y-%m-%d %H:%M') AS updated FROM models""",
)
def history_view(spark, sf):
    from ..operators.select import history_view as view

    return view(registry_rows(spark, sf))


@query("version_metrics", f"WITH {_REG_SQL} SELECT name, version, o_totalprice AS price, o_totalprice / 1000 AS thousands FROM models")
def version_metrics(spark, sf):
    return G.version_metrics(registry_rows(spark, sf), ["price", "thousands"])


@query("live_models", f"WITH {_REG_SQL} SELECT id, name FROM models WHERE id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def live_models(spark, sf):
    stones = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("model_id"))
    return G.live_models(registry_rows(spark, sf), stones).select("id", "name")


@query(
    "update_status",
    f"""WITH {_REG_SQL} SELECT name, count(*) AS versions, arg_max(version, v) AS current_version,
  strftime(max(created_at), '%Y-%m-%d') AS last_update FROM models GROUP BY 1""",
)
def update_status(spark, sf):
    return G.update_status(registry_rows(spark, sf)).withColumn("last_update", F.date_format("last_update", "yyyy-MM-dd"))


@query("saved_comparison", f"WITH {_MODEL_SQL} SELECT model, metric, round(value, 4) AS value FROM long")
def saved_comparison(spark, sf):
    path = J.save_comparison(model_metrics(spark, sf), scratch_path(spark, "comparison"))
    return rounded(J.load_comparison(spark, path), 4, "value")


@query(
    "saved_report",
    """SELECT 'training_data' AS dataset, (SELECT count(*) FROM customer) AS total_rows, (SELECT count(DISTINCT c_name) FROM customer) AS names,
  (SELECT max(c_acctbal) FROM customer) AS most""",
)
def saved_report(spark, sf):
    """A validation report as JSON and back."""
    path = J.save_report(V.validate_training(table(spark, sf, "customer"), "c_mktsegment"), scratch_path(spark, "report"))
    report = J.load_report(spark, path, V.REPORT_SCHEMA)
    return report.select(
        "dataset", "total_rows", F.col("unique_values")["c_name"].alias("names"), F.col("numeric_stats")["c_acctbal"]["max"].alias("most")
    )


@query(
    "recorded_statistics",
    """SELECT 7 AS model_id, metric, round(value, 6) AS value FROM (SELECT unnest(['mean', 'std', 'min', 'max']) AS metric,
  unnest([avg(value), stddev_pop(value), min(value), max(value)]) AS value FROM events)""",
)
def recorded_statistics(spark, sf):
    """The statistics of the predictions, appended to the performance log and read back."""
    root = scratch_path(spark, "logs")
    A.record_metrics(M.prediction_statistics(table(spark, sf, "events"), "value"), root, 7, dt.datetime(2024, 2, 1))
    rows = L.scan_log(spark, root, "performance_logs", dt.datetime(2024, 2, 1), dt.datetime(2024, 2, 1))
    return rounded(L.map_long(rows, "metrics", [F.col("model_id").cast("int").alias("model_id")]), 6, "value")


_WORDS_SQL = r"SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS word FROM documents"


@query("word_index", _WORDS_SQL)
def word_index(spark, sf):
    return X.word_index(table(spark, sf, "documents"), "doc_id", F.col("text"))


@query("word_frequencies", f"SELECT word, count(*) AS texts FROM ({_WORDS_SQL}) GROUP BY 1")
def word_frequencies(spark, sf):
    return X.word_frequencies(table(spark, sf, "documents"), "doc_id", F.col("text"))


@query(
    "search_texts",
    f"SELECT doc_id, count(*) AS matches FROM ({_WORDS_SQL}) WHERE word IN ('license', 'copyright', 'the') GROUP BY 1",
)
def search_texts(spark, sf):
    return X.search(table(spark, sf, "documents"), "doc_id", F.col("text"), "The LICENSE, copyright")


@query(
    "related_texts",
    f"""WITH w AS ({_WORDS_SQL}) SELECT doc_id, count(*) AS common FROM w
WHERE doc_id <> 1 AND word IN (SELECT word FROM w WHERE doc_id = 1) GROUP BY 1 ORDER BY common DESC, doc_id LIMIT 3""",
)
def related_texts(spark, sf):
    return X.related(table(spark, sf, "documents"), "doc_id", F.col("text"), 1)


def _window_sql(width: str, closed: str = "") -> str:
    return f"""SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, strftime(w + INTERVAL {width}, '%Y-%m-%d %H:%M') AS window_end, event_type,
  count(*) AS n, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std, min(value) AS min, max(value) AS max
FROM (SELECT *, time_bucket(INTERVAL {width}, ts) AS w FROM events) {closed} GROUP BY w, event_type"""


def _readable(df):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return rounded(df.withColumns({"window_start": text("window_start"), "window_end": text("window_end")}), 9, "mean", "std")


@query("tumbling_metrics", _window_sql("1 HOUR"))
def tumbling_metrics(spark, sf):
    return _readable(S.window_metrics(table(spark, sf, "events"), "ts", ["event_type"], "value"))


@query(
    "sliding_metrics",
    """SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, strftime(w + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M') AS window_end, event_type,
  count(*) AS n, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std, min(value) AS min, max(value) AS max
FROM (SELECT event_type, value, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(CAST(h AS INTEGER)) AS w FROM events, (SELECT unnest(range(24)) AS h))
GROUP BY w, event_type""",
)
def sliding_metrics(spark, sf):
    return _readable(S.window_metrics(table(spark, sf, "events"), "ts", ["event_type"], "value", "24 hours", "1 hour"))


def _event_stream(spark, sf):
    """The events file as a stream source."""
    schema = table(spark, sf, "events").schema
    return S.read_stream(spark, f"{sf}/events*.parquet", schema)


def _finish(spark, query, path):
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.parquet(path)


@query(
    "streamed_tumbling_metrics",
    _window_sql("1 HOUR", "WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"),
)
def streamed_tumbling_metrics(spark, sf):
    """Closed windows only: a stream appends a window once the watermark has passed it."""
    out = S.window_metrics(_event_stream(spark, sf), "ts", ["event_type"], "value")
    path = scratch_path(spark, "windows")
    return _readable(_finish(spark, S.append_stream(out, path, scratch_path(spark, "state")), path))


@query(
    "streamed_drift",
    """WITH r AS (SELECT event_type, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM events WHERE event_id % 2 = 0) AS p FROM events WHERE event_id % 2 = 0 GROUP BY 1),
n AS (SELECT event_type, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM events) AS q FROM events GROUP BY 1)
SELECT CAST(0 AS INTEGER) AS batch_id, 'event_type' AS feature, round(avg(abs(coalesce(p, 0) - coalesce(q, 0))), 6) AS score
FROM r FULL JOIN n USING (event_type)""",
)
def streamed_drift(spark, sf):
    """The even half of the events is the reference, all of them the stream."""
    reference = table(spark, sf, "events").where("event_id % 2 = 0").select("event_type")
    path = scratch_path(spark, "drift")
    stream = _event_stream(spark, sf).select("event_type")
    run = S.drift_stream(stream, reference, ["event_type"], path, scratch_path(spark, "state"))
    return rounded(_finish(spark, run, path), 6, "score")


@query(
    "streamed_alerts",
    f"""WITH {METRICS_SQL}, {RULES_SQL}
SELECT CAST(0 AS INTEGER) AS batch_id, alert_id, model_id, conditions FROM (
SELECT alert_id, model_id, count(*) AS conditions, bool_and(coalesce(CASE operator
  WHEN 'greater_than' THEN value > threshold WHEN 'less_than' THEN value < threshold ELSE TRUE END, TRUE)) AS fires
FROM rules LEFT JOIN metrics USING (model_id, metric) WHERE is_active GROUP BY 1, 2) WHERE fires""",
)
def streamed_alerts(spark, sf):
    stream = _event_stream(spark, sf).select((F.col("user_id") % 20).alias("model"), "event_type", "value")
    path = scratch_path(spark, "alerts")
    run = S.alert_stream(stream, alert_rules(spark, sf), "model", "event_type", "value", path, scratch_path(spark, "state"))
    return _finish(spark, run, path)


_LATE_SQL = """SELECT p.event_id, p.value AS prediction, l.value AS label FROM events p LEFT JOIN events l
  ON l.event_type = 'purchase' AND l.user_id = p.user_id AND l.ts >= p.ts AND l.ts <= p.ts + INTERVAL 1 DAY
WHERE p.event_type = 'click'"""


def _late(frame):
    """Clicks are predictions, and later purchases of the user bring the labels."""
    p = frame.where("event_type = 'click'").select("event_id", F.col("user_id").alias("k"), "ts", F.col("value").alias("prediction"))
    l = frame.where("event_type = 'purchase'").select(F.col("user_id").alias("k"), F.col("ts").alias("label_ts"), F.col("value").alias("label"))
    return S.join_late_labels(p, l, "k", "ts", "label_ts", "label").select("event_id", "ts", "prediction", "label")


@query("late_label_join", _LATE_SQL)
def late_label_join(spark, sf):
    return _late(table(spark, sf, "events")).drop("ts")


@query("streamed_label_join", _LATE_SQL)
def streamed_label_join(spark, sf):
    """As the batch: an unlabelled row is sent once the watermark is past its bound, which two closing rows bring about."""
    events = table(spark, sf, "events")
    source, path = scratch_path(spark, "source"), scratch_path(spark, "labelled")
    events.write.parquet(source)
    last = events.agg(F.max("ts").alias("t"))
    closing = last.select(
        F.lit(-1).cast("long").alias("event_id"), (F.col("t") + F.expr("INTERVAL 3 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("user_id"),
        F.explode(F.array(F.lit("click"), F.lit("purchase"))).alias("event_type"), F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("props"),
    )
    state = scratch_path(spark, "state")
    for part in (None, closing):
        # One stream, gone on with from its state when the closing rows are there.
        if part is not None:
            part.write.mode("append").parquet(source)
        run = S.append_stream(_late(S.read_stream(spark, source, events.schema)), path, state)
        out = _finish(spark, run, path)
    return out.where("event_id >= 0").drop("ts")


@query(
    "streamed_sliding_metrics",
    """SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, strftime(w + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M') AS window_end, event_type,
  count(*) AS n, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std, min(value) AS min, max(value) AS max
FROM (SELECT event_type, value, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(CAST(h AS INTEGER)) AS w FROM events, (SELECT unnest(range(6)) AS h))
WHERE w + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY w, event_type""",
)
def streamed_sliding_metrics(spark, sf):
    """Closed windows of six hours that begin every hour."""
    out = S.window_metrics(_event_stream(spark, sf), "ts", ["event_type"], "value", "6 hours", "1 hour")
    path = scratch_path(spark, "windows")
    return _readable(_finish(spark, S.append_stream(out, path, scratch_path(spark, "state")), path))


@query(
    "streamed_late_rows",
    """WITH m AS (SELECT max(ts) AS t FROM events WHERE event_id % 2 = 0)
SELECT count(*) FILTER (WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= t - INTERVAL 10 MINUTE) AS dropped FROM events, m WHERE event_id % 2 = 1""",
)
def streamed_late_rows(spark, sf):
    """The odd events come after the even ones: those of windows that are closed by then are dropped, and a listener counts them."""
    events = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    source, path, state, counts = (scratch_path(spark, n) for n in ("source", "windows", "state", "late"))
    listener = S.LateRows(spark, counts)
    spark.streams.addListener(listener)
    try:
        for half in (0, 1):
            # One row per event: rows of a window would be put together before they meet the state.
            events.where(F.col("event_id") % 2 == half).write.mode("append").parquet(source)
            stream = S.read_stream(spark, source, events.schema)
            run = S.append_stream(S.window_metrics(stream, "ts", ["event_id"], "value"), path, state)
            _finish(spark, run, path)
        _wait_for_listeners(spark)
    finally:
        spark.streams.removeListener(listener)
        listener.flush()
    return S.late_rows(spark, counts).agg(F.sum("dropped").alias("dropped"))


def _wait_for_listeners(spark):
    """Events reach listeners a little after a query has ended."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
