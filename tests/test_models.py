import itertools
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import estimators as E
from tidemark.operators import pairs as N
from tidemark.operators import tuning as T
from tidemark.operators.clusters import cluster_metrics
from tidemark.operators.dbscan import connected, dbscan
from tidemark.operators.prepare import Scaler
from tidemark.operators.reduce import principal_components, singular_vectors
from tidemark.sources.registry import ModelStore

FEATURES = [f"f{i}" for i in range(5)]


def made(spark, label):
    """100 rows, three informative features and two mixes of them."""
    f = [F.sin(F.col("id") * k).alias(f"f{i}") for i, k in enumerate((1.7, 2.3, 3.1))]
    df = spark.range(100).select("id", *f)
    df = df.withColumn("f3", F.col("f0") + F.col("f1")).withColumn("f4", F.col("f1") - F.col("f2"))
    return df.withColumn("label", label).persist()


@pytest.fixture(scope="module")
def classes(spark):
    noise = (F.col("id") * 7 % 10 - 5) / 50
    return made(spark, (F.col("f0") - F.col("f1") * 0.5 + noise > 0).cast("double"))


@pytest.fixture(scope="module")
def numbers(spark):
    return made(spark, 3 * F.col("f0") + F.col("f2") + (F.col("id") * 7 % 10) / 50)


def test_task_types(spark, classes, numbers):
    assert T.label_task(classes, "label") == "classification"
    assert T.label_task(numbers, "label") == "regression"
    assert T.detect_task(classes, "target") == "clustering"
    nulls = spark.createDataFrame([(float(i),) for i in range(9)] + [(None,)], "target double")
    assert T.detect_task(nulls) == "regression"


def test_folds_are_even_per_class(classes):
    sizes = T.with_folds(classes, "id", 5, "label").groupBy("label", "fold").agg(F.count("*").alias("n")).collect()
    for label in (0.0, 1.0):
        n = [r["n"] for r in sizes if r["label"] == label]
        assert len(n) == 5 and max(n) - min(n) <= 1


def test_search_predict_save_load(spark, classes, tmp_path):
    seen = []
    result = T.search(
        classes, FEATURES, "label", "id", models=["LogisticRegression", "LinearSVC"], trials=1, folds=2,
        stages=[Scaler("standard", FEATURES)], fixed={"LogisticRegression": {"maxIter": 10}, "LinearSVC": {"maxIter": 5}}, callback=lambda t, s: seen.append(t),
    )
    assert result.task_type == "classification" and result.score > 0.5 and seen == [0, 1]
    assert result.model_type in ("LogisticRegression", "LinearSVC") and set(result.importance) == set(FEATURES)
    assert result.trials.where("status = 'completed'").count() == 2
    store = ModelStore(spark, str(tmp_path / "models"))
    first = store.save(result.model, "m", result.model_type, result.metrics)
    store.save(result.model, "m", result.model_type)
    assert store.find("m")["version"] == "v2" and store.find(first)["version"] == "v1"
    for which in ("m", first, store.find("m")["path"]):
        out = store.load(which).transform(classes)
        assert out.count() == 100 and out.where("prediction IS NULL").count() == 0
    store.delete("m")
    assert store.find("m")["version"] == "v1"
    store.save(result.model, "m", result.model_type)
    assert store.find("m")["version"] == "v3"
    with pytest.raises(KeyError):
        store.find("other")


def test_regression_keeps_the_lowest_error(numbers):
    result = T.search(numbers, FEATURES[:3], "label", "id", models=["LinearRegression", "Lasso"], trials=1, folds=2, fixed={"Lasso": {"alpha": 10.0}, "LinearRegression": {"fitIntercept": True}})
    assert result.model_type == "LinearRegression" and result.metrics["train_r2"] > 0.9
    worst = result.trials.agg(F.max("score")).first()[0]
    assert result.score < worst


def test_failures_are_recorded(classes):
    E.register_family("Broken", E.Family("classification", lambda p, c: 1 / 0))
    try:
        with pytest.raises(ValueError, match="ZeroDivisionError"):
            T.search(classes, FEATURES, "label", "id", models=["Broken"], trials=1, folds=2)
        with pytest.raises(ValueError):
            E.families_for("regression", ["Broken"])
    finally:
        del E.FAMILIES["Broken"]


def test_neighbour_model_is_saved(classes, tmp_path):
    model = E.fit_family(classes, "KNeighborsClassifier", FEATURES, "label", {"k": 3}, id_col="id")
    model.save(str(tmp_path / "knn"))
    again = type(model).load(str(tmp_path / "knn"))
    a = {r["id"]: r["prediction"] for r in model.transform(classes).collect()}
    assert a == {r["id"]: r["prediction"] for r in again.transform(classes).collect()}
    assert sum(a[r["id"]] == r["label"] for r in classes.collect()) > 80


def test_nearest_is_brute_force(classes):
    rows = [(r["id"], [r[f] for f in FEATURES]) for r in classes.collect()]
    v = N.vectors(classes, "id", FEATURES)
    for p in (1, 2):
        want = {}
        for i, x in rows:
            d = sorted((sum(abs(a - b) ** p for a, b in zip(x, y)) ** (1 / p), j) for j, y in rows if j != i)
            want[i] = [j for _, j in d[:4]]
        got = {}
        for r in N.nearest(v, v, "id", 4, p, block_rows=17).orderBy("key", "place").collect():
            got.setdefault(r["key"], []).append(r["neighbour"])
        assert got == want


def brute_dbscan(points, eps, least, p):
    dist = lambda a, b: sum(abs(x - y) ** p for x, y in zip(a, b)) ** (1 / p)
    ids = sorted(points)
    near = {i: [j for j in ids if dist(points[i], points[j]) <= eps] for i in ids}
    core = {i for i in ids if len(near[i]) >= least}
    label, n = {}, 0
    for i in ids:
        if i in core and i not in label:
            stack = [i]
            while stack:
                k = stack.pop()
                if k not in label:
                    label[k] = n
                    stack += [j for j in near[k] if j in core]
            n += 1
    for i in ids:
        if i not in core:
            reach = [(dist(points[i], points[j]), label[j]) for j in near[i] if j in core]
            label[i] = min(reach)[1] if reach else -1
    return label, core


@pytest.mark.parametrize("p", [1, 2])
def test_dbscan_is_brute_force(spark, p):
    """A dense ball, a chain, loose points, and many copies of one point."""
    import random

    rng = random.Random(5)
    pts = [(rng.gauss(0, 0.3), rng.gauss(0, 0.3)) for _ in range(120)]
    pts += [(3 + i * 0.23, 0.02 * (i % 3)) for i in range(30)]
    pts += [(rng.uniform(-2, 11), rng.uniform(-4, 4)) for _ in range(60)] + [(5.0, 3.0)] * 25
    points = dict(enumerate(pts))
    df = spark.createDataFrame([(i, *xy) for i, xy in points.items()], "id long, x double, y double")
    want, core = brute_dbscan(points, 0.35, 4, p)
    got = dbscan(df, "id", ["x", "y"], 0.35, 4, "euclidean" if p == 2 else "manhattan").collect()
    assert {r["id"] for r in got if r["core"]} == core
    assert {r["id"]: r["cluster"] for r in got} == want


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (102, 101)] + [(200, 200 + i) for i in range(1, 40)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 1 for i in range(2, 61)) and got[101] == got[102] == 100
    assert all(got[200 + i] == 200 for i in range(1, 40))


def test_reductions(spark, classes):
    import numpy as np

    v = N.vectors(classes, "id", FEATURES)
    x = np.array([r["features"] for r in v.orderBy("id").collect()])
    axes, shares = principal_components(v, "features", 5, 0.99)
    values = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    assert shares == pytest.approx((values / values.sum())[: len(shares)]) and len(shares) <= 3
    _, singular = singular_vectors(v, "features", 5, 2)
    assert singular == pytest.approx(np.linalg.svd(x, compute_uv=False)[:2])


def test_one_cluster_has_no_metrics(classes):
    one = classes.withColumn("c", F.lit(0))
    r = cluster_metrics(one, FEATURES, "c").first()
    assert r["n_clusters"] == 1 and r["status"] == "insufficient_clusters"


def test_cluster_search_finds_the_blobs(spark):
    """Three blobs far apart: the trial with three clusters wins by every measure."""
    blob = spark.range(90).select("id", (F.col("id") % 3 * 50 + F.sin("id")).alias("x"), F.cos(F.col("id") * 2).alias("y"))
    for metric in T.CLUSTER_METRICS:
        scores = {}
        for k in (2, 3):
            fixed = {"KMeans": {"k": k, "maxIter": 10, "initMode": "k-means||"}}
            scores[k] = T.search_clusters(blob, ["x", "y"], ["KMeans"], metric, trials=1, fixed=fixed).score
        assert (scores[3] > scores[2]) == T.CLUSTER_METRICS[metric]
    found = T.search_clusters(blob, ["x", "y"], ["KMeans"], "silhouette", trials=1, fixed={"KMeans": {"k": 3, "maxIter": 10}})
    assert found.model.transform(blob).select("prediction").distinct().count() == 3
    with pytest.raises(ValueError):
        T.search_clusters(blob, ["x", "y"], metric="other")


def test_permuted_keeps_the_values(classes):
    out = E.permuted(classes, "f0", "id")
    pick = lambda df: sorted(r["f0"] for r in df.select("f0").collect())
    assert pick(out) == pick(classes)
    moved = out.alias("a").join(classes.alias("b"), "id").where("a.f0 <> b.f0").count()
    assert moved > 80


def test_draw_stays_inside_the_space():
    import random

    for name, family in E.FAMILIES.items():
        for seed, (k, v) in itertools.product(range(5), family.space.items()):
            got = T.draw({k: v}, random.Random(seed))[k]
            assert got in v[1] if v[0] == "choice" else v[1] <= got <= v[2], name
            assert not (isinstance(got, float) and math.isnan(got))


def test_permutations_share_one_join(spark, monkeypatch):
    """All features are dealt anew by the same two orders, numbered once; values as of one feature at a time."""
    df = spark.createDataFrame([(i, float(i % 5), float(i % 7), i * 0.5) for i in range(60)], "id long, a double, b double, label double")
    model = E.fit_family(df, "LinearRegression", ["a", "b"], "label")
    metric = lambda s: s.selectExpr("sum(prediction * label)").first()[0]
    base = metric(model.transform(df))
    want = [(f, pytest.approx(base - metric(model.transform(E.permuted(df, f, "id"))))) for f in ("a", "b")]
    calls, plain = [], E.number_by_hash
    monkeypatch.setattr(E, "number_by_hash", lambda *a: calls.append(1) or plain(*a))
    assert [tuple(r) for r in E.permutation_importance(model, df, ["a", "b"], "id", metric).collect()] == want
    assert len(calls) == 2


def test_classes_are_fitted_one_by_one_from_rows_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(i):
        read.add(1)
        return float(i % 3)

    rows = spark.range(90).select(counted("id").alias("label"), (F.col("id") % 3 * 10 + F.col("id") % 7).cast("double").alias("x"))
    model = E.fit_family(rows, "GradientBoostingClassifier", ["x"], "label", {"maxIter": 2, "maxDepth": 2})
    assert read.value == 90
    assert len(model.stages[-1].models) == 3
    out = E.score(model, spark.range(90).select("id", (F.col("id") % 3 * 10 + F.col("id") % 7).cast("double").alias("x")), ["id"]).collect()
    assert len(out) == 90 and all(r["predicted_value"] == r["id"] % 3 for r in out)
    for family in ("GradientBoostingClassifier", "LinearSVC"):
        assert E.FAMILIES[family].build({}, E.Context(rows, ["x"], 3)).getParallelism() == 1
