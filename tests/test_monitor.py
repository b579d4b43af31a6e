import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift as D
from tidemark.operators import evaluate as E
from tidemark.operators import monitor as M
from tidemark.operators import select as S
from tidemark.sources import alerts as A
from tidemark.sources import logs as L
from tidemark.sources import readers as R
from tidemark.sources import registry as G
from tidemark.sources import reports as J
from tidemark.streaming import monitoring as W

NOW = dt.datetime(2024, 5, 1, 12)


def test_no_drift_against_itself(spark):
    df = spark.range(500).select(F.sin("id").alias("x"), (F.col("id") % 7).cast("string").alias("c"))
    r = D.ks_drift(df, df, ["x"]).first()
    assert r["statistic"] == 0 and r["p_value"] == 1 and not r["has_drift"]
    scores = {r["feature"]: r["score"] for r in D.drift_scores(df, df).collect()}
    assert scores["x"] == pytest.approx(0, abs=1e-12) and scores["c"] == 0
    assert {r["p_value"] for r in D.chi_square_drift(df, df, ["c"]).collect()} == {1.0}


def test_shifted_data_drifts(spark):
    a = spark.range(400).select(F.col("id").cast("double").alias("x"))
    b = a.select((F.col("x") + 200).alias("x"))
    r = D.ks_drift(a, b, ["x"], buckets=5).first()
    assert r["statistic"] == 0.5 and r["has_drift"]
    assert D.drift_detected(D.ks_drift(a, b)).first()["drift_detected"]


def test_one_side_without_values(spark):
    a = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    r = D.ks_drift(a, a.select(F.lit(None).cast("double").alias("x"))).first()
    assert r["statistic"] is None and not r["has_drift"]


def test_chi_square_tail(spark):
    """Known upper tails: 3.841 at 1, 18.307 at 10, 124.342 at 100 degrees."""
    df = spark.createDataFrame([(3.841459, 1), (18.307038, 10), (124.342113, 100), (0.0, 0)], "s double, k int")
    got = [r["p"] for r in df.select(D.chi_square_tail("s", "k").alias("p")).collect()]
    assert got[:3] == pytest.approx([0.05] * 3, abs=1e-6) and got[3] is None


def test_alerts(spark):
    rules = spark.createDataFrame(
        [
            (1, 1, "t", "acc", "less_than", 0.8, True), (1, 1, "t", "gone", "greater_than", 9.0, True),
            (2, 1, "t", "acc", "less_than", 0.7, True), (3, 1, "t", "acc", "equal", 0.75, True),
            (4, 1, "t", "acc", "near", 0.0, True), (5, 1, "t", "acc", "less_than", 0.9, False),
        ],
        "alert_id long, model_id long, type string, metric string, operator string, threshold double, is_active boolean",
    )
    metrics = spark.createDataFrame([(1, "acc", 0.75), (2, "acc", 0.1)], "model_id long, metric string, value double")
    fires = {r["alert_id"]: r["fires"] for r in M.check_alerts(rules, metrics).collect()}
    assert fires == {1: True, 2: False, 3: True, 4: True}
    models = spark.createDataFrame([(1, "churn")], "model_id long, name string")
    sent = M.notifications(M.check_alerts(rules, metrics), rules, models, metrics).collect()
    assert {r["alert_id"] for r in sent} == {1, 3, 4} and all("churn" in r["message"] and "acc: 0.75" in r["message"] for r in sent)


def test_alert_store(spark, tmp_path):
    root = str(tmp_path)
    assert A.unread_notifications(spark, root).count() == 0
    alert = A.create_alert(spark, root, 1, "quality", {"acc": {"operator": "less_than", "threshold": 0.8}, "mse": {"operator": "greater_than", "threshold": 2}})
    A.create_alert(spark, root, 2, "quality", {"acc": {"operator": "less_than", "threshold": 0.1}})
    rules = A.active_alerts(spark, root, 1)
    assert rules.count() == 2
    metrics = spark.createDataFrame([(1, "acc", 0.75)], "model_id long, metric string, value double")
    models = spark.createDataFrame([(1, "churn")], "model_id long, name string")
    sent = M.notifications(M.check_alerts(rules, metrics), rules, models, metrics)
    A.store_notifications(sent, root, NOW)
    waiting = A.unread_notifications(spark, root).collect()
    assert [r["alert_id"] for r in waiting] == [alert]
    A.mark_as_read(spark, root, [waiting[0]["id"]])
    assert A.unread_notifications(spark, root).count() == 0


def test_front_door(spark):
    df = spark.range(40).select((F.col("id") % 2).alias("label"), (F.col("id") % 3 % 2).alias("prediction"), F.col("id").cast("double").alias("x"))
    assert {k: v.count() for k, v in E.evaluate(df, "classification").items()} == {"metrics": 1, "report": 4, "confusion": 4}
    assert E.evaluate(df, "regression")["report"].first()["label_mean"] == 0.5
    found = E.evaluate(df, "clustering", features=["x"])
    assert found["metrics"].first()["status"] == "success" and found["sizes"].count() == 2
    with pytest.raises(ValueError):
        E.evaluate(df, "other")


def test_update_decision(spark):
    rows = [(True, 0.0, 5000), (False, 0.2, 5000), (False, 0.05, 5000), (True, 0.5, 10), (False, None, 5000)]
    report = spark.createDataFrame(rows, "drift_detected boolean, performance_drop double, data_size long")
    reasons = [r["reason"] for r in M.should_update(report, NOW).collect()]
    assert reasons == ["drift", "performance", "none", "too few rows", "none"]
    soon = M.should_update(report, NOW, NOW - dt.timedelta(hours=3))
    assert {r["reason"] for r in soon.collect()} == {"too soon"} and soon.where("update").count() == 0


def test_curve_area_and_metrics(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.6), (1, 1, 0.6), (1, 1, 0.9), (1, 0, 0.2)], "label int, prediction int, score double")
    assert E.roc_auc(df, "label", "score").first()["auc"] == pytest.approx((3 + 1.5) / 6)
    assert E.roc_auc(df, "label", "score", buckets=3).first()["auc"] == pytest.approx((3 + 1.5) / 6)
    m = E.classification_metrics(df).first()
    assert m["accuracy"] == pytest.approx(0.6) and m["roc_auc"] == pytest.approx((0.5 + 2 / 3) / 2)
    assert E.confusion_matrix(df, classes=[0, 1]).count() == 4 and E.confusion_matrix(df).count() == 4
    one = df.where("label = 1")
    assert E.roc_auc(one, "label", "score").first()["auc"] is None


def test_regression_edges(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 2.0)], "label double, prediction double")
    assert E.regression_metrics(df).first()["mape"] is None
    flat = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "label double, prediction double")
    assert E.regression_metrics(flat).first()["r2"] == 1.0


def test_versions_are_numbers(spark):
    rows = [(i, "m", NOW + dt.timedelta(hours=i)) for i in range(1, 13)]
    models = G.number_versions(spark.createDataFrame(rows, "id long, name string, created_at timestamp"))
    assert G.latest_versions(models).first()["version"] == "v12"


def test_logs(spark, tmp_path):
    root = str(tmp_path)
    assert L.scan_log(spark, root, "performance_logs", NOW, NOW).count() == 0
    rows = [(i, 1, NOW + dt.timedelta(days=i), {"acc": i / 10}) for i in range(5)]
    L.append_log(spark.createDataFrame(rows, L.log_schema("performance_logs")), root, "performance_logs")
    got = L.scan_log(spark, root, "performance_logs", NOW + dt.timedelta(days=1), NOW + dt.timedelta(days=3))
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    wide = L.spread_map(got, "metrics")
    assert [r["acc"] for r in wide.collect()] == [0.1, 0.2, 0.3]


def test_readers(spark, tmp_path):
    path = str(tmp_path / "people.csv")
    people = spark.createDataFrame([(1, 25, "PhD", "yes"), (2, None, "Master", "no"), (3, 35, None, "no")], "id int, age int, education string, has_car string")
    R.write_predictions(people, path, "csv")
    assert dict(R.read_csv(spark, path).dtypes)["age"] == "int"
    clean = R.load_clean(spark, path)
    assert clean.where("age IS NULL OR education IS NULL").count() == 0
    with pytest.raises(ValueError, match="unsupported"):
        R.read_table(spark, str(tmp_path / "x.xls"))
    empty = str(tmp_path / "empty.parquet")
    R.write_predictions(people.limit(0), empty)
    with pytest.raises(ValueError, match="no rows"):
        R.load_clean(spark, empty)
    assert R.from_records(spark, [{"feature1": 1.0, "feature2": "A"}, {"feature1": 2.0, "feature2": "B"}]).count() == 2


def test_reports(spark, tmp_path):
    long = spark.createDataFrame([("a", "acc", 0.5), ("b", "acc", 0.75)], J.COMPARISON_SCHEMA)
    path = J.save_comparison(long, str(tmp_path / "c"))
    assert sorted(map(tuple, J.load_comparison(spark, path).collect())) == sorted(map(tuple, long.collect()))


def test_column_contracts(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert S.column_match(df, ["a", "c"]) == (["c"], ["b"])
    with pytest.raises(ValueError, match="c"):
        S.scoring_columns(df, ["a", "c"])
    assert S.scoring_columns(df, ["b", "a"]).columns == ["b", "a"]


def settled(spark, listener):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    listener.flush()


def test_late_rows_of_many_triggers(spark, tmp_path):
    """More triggers than a query remembers, a late row in every fourth."""
    source, counts = str(tmp_path / "in"), str(tmp_path / "late")
    schema = "k long, ts timestamp, value double"
    start = dt.datetime(2024, 1, 1)
    for i in range(112):
        rows = [(i, start + dt.timedelta(hours=2 * i), 1.0)]
        if i % 4 == 3:
            rows.append((1000 + i, start, 1.0))
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/batch={i:03d}")
    listener = W.LateRows(spark, counts, flush_every=30)
    spark.streams.addListener(listener)
    try:
        stream = W.read_stream(spark, f"{source}/*", spark.createDataFrame([], schema).schema, files_per_batch=1)
        q = W.append_stream(W.window_metrics(stream, "ts", ["k"], "value", late="0 seconds"), str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination()
        settled(spark, listener)
    finally:
        spark.streams.removeListener(listener)
    row = W.late_rows(spark, counts).first()
    assert len(q.recentProgress) <= 100 < row["batches"] and row["dropped"] == 28


def test_streams_drop_late_rows_and_replay_once(spark, tmp_path):
    """Three files: the second moves the watermark, the third is late."""
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "event_id long, ts timestamp, k string, value double"
    hour = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        frame = W.read_stream(spark, source, spark.createDataFrame([], schema).schema)
        q = W.append_stream(W.window_metrics(frame, "ts", ["k"], "value"), out, state)
        q.awaitTermination()

    counts = str(tmp_path / "late")
    assert W.late_rows(spark, counts).count() == 0
    listener = W.LateRows(spark, counts)
    spark.streams.addListener(listener)
    try:
        feed([(1, hour(0), "a", 1.0), (2, hour(0.5), "a", 3.0)])
        run()
        feed([(3, hour(5), "a", 10.0)])
        run()
        feed([(4, hour(0.2), "a", 99.0), (5, hour(9), "a", 1.0)])
        run()
        settled(spark, listener)
    finally:
        spark.streams.removeListener(listener)
    assert [r["dropped"] for r in W.late_rows(spark, counts).collect()] == [1]
    got = {r["window_start"]: (r["n"], r["mean"]) for r in spark.read.parquet(out).collect()}
    assert got[hour(0)] == (2, 2.0) and got[hour(5)] == (1, 10.0)


def test_batches_are_written_once_per_id(spark, tmp_path):
    path = str(tmp_path / "d")
    ref = spark.createDataFrame([("a",), ("b",)], "c string")
    for _ in range(2):
        W._write_batch(W.batch_drift(ref, ref, ["c"], 7), path, 7)
    rows = spark.read.parquet(path).collect()
    assert [(r["batch_id"], r["feature"], r["score"]) for r in rows] == [(7, "c", 0.0)]


def test_checkpoint_folder(spark):
    from tidemark.functions.scratch import ensure_checkpoint_dir, spread

    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)
    assert spread(spark.createDataFrame([(1,)], "a int")).rdd.getNumPartitions() == 64
