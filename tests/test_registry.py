from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from tidemark.operators import estimators as E
from tidemark.operators.retrain import update_model
from tidemark.sources.logs import append_log, read_log
from tidemark.sources.registry import ModelStore, put_if_absent


@pytest.fixture(scope="module")
def rows(spark):
    x = F.col("id")
    return spark.range(90).select("id", F.sin(x * 1.7).alias("f"), (F.sin(x * 1.7) > 0).cast("double").alias("label")).persist()


def test_one_of_many_puts_a_file(spark, tmp_path):
    path = str(tmp_path / "a" / "v1.json")
    put = inheritable_thread_target(spark)(lambda i: put_if_absent(spark, path, f"writer {i}"))
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(put, range(8)))
    assert sum(won) == 1 and open(path).read() == f"writer {won.index(True)}"
    assert [p.name for p in (tmp_path / "a").iterdir() if not p.name.endswith(".crc")] == ["v1.json"]


def test_writers_at_once_get_versions_of_their_own(spark, rows, tmp_path):
    store = ModelStore(spark, str(tmp_path / "store"))
    models = [E.fit_family(rows, "DecisionTreeClassifier", ["f"], "label", {"maxDepth": d}) for d in (1, 2, 3)]
    save = inheritable_thread_target(spark)(lambda i: store.save(models[i], "a/b name", "DecisionTreeClassifier", {"depth": i}))
    with ThreadPoolExecutor(3) as pool:
        ids = list(pool.map(save, range(3)))
    saved = {r["id"]: r["version"] for r in store.models().collect()}
    assert sorted(saved.values()) == ["v1", "v2", "v3"] and set(saved) == set(ids)
    for i, model_id in enumerate(ids):
        assert store.load(model_id).stages[-1].depth == models[i].stages[-1].depth
    assert read_log(spark, store.root, "training_logs").count() == 3
    store.delete(ids[0])
    assert store.models().count() == 2 and store.versions().count() == 3


def test_logs_take_writers_at_once(spark, tmp_path):
    make = lambda i: spark.range(i * 10, i * 10 + 10).select("id", F.lit(i).alias("model_id"), F.timestamp_seconds(F.col("id") * 40_000).alias("ts"))
    work = inheritable_thread_target(spark)(lambda i: append_log(make(i), str(tmp_path), "training_logs"))
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(work, range(6)))
    assert sorted(r["id"] for r in read_log(spark, str(tmp_path), "training_logs").collect()) == list(range(60))
    append_log(make(0).limit(0), str(tmp_path), "prediction_logs")
    assert read_log(spark, str(tmp_path), "prediction_logs").count() == 0


def test_retraining_joins_old_and_new_rows(spark, rows, tmp_path):
    store = ModelStore(spark, str(tmp_path / "store"))
    kept = dict(models=["DecisionTreeClassifier"], trials=1, folds=2)
    flipped = rows.where("id >= 40").withColumn("label", 1 - F.col("label"))
    update_model(store, "m", rows.where("id < 50"), ["f"], "label", "id", **kept)
    update_model(store, "m", flipped, ["f"], "label", "id", **kept)
    assert store.latest("m")["parent"] == "v1" and len(store.latest("m")["batches"]) == 2
    first, second = (store.training_rows("m", v, "id") for v in ("v1", "v2"))
    assert first.count() == 50 and second.count() == 90
    # Of rows with one id the newer counts.
    labels = {r["id"]: r["label"] for r in second.collect()}
    want = {r["id"]: r["label"] if r["id"] < 40 else 1 - r["label"] for r in rows.collect()}
    assert labels == want
    with pytest.raises(KeyError):
        store.version("m", "v9")
    store.delete("m")
    assert store.latest("m")["version"] == "v1"
