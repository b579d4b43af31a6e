import random

import pytest

from tidemark.operators import estimators as E
from tidemark.operators import pairs as N
from tidemark.operators.hashing import NeighbourIndex, fit_index, found_share


@pytest.fixture(scope="module")
def points(spark):
    """Blobs, and one point that a third of all rows share."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        centre = i % 12 * 4.0
        x = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0] if i % 3 == 0 else [rng.gauss(centre if j == i % 6 else 0.0, 1.0) for j in range(6)]
        rows.append((i, x))
    return spark.createDataFrame(rows, "id long, features array<double>").persist()


def as_sets(found):
    out = {}
    for r in found.collect():
        out.setdefault(r["key"], []).append((r["place"], r["neighbour"], round(r["distance"], 9)))
    return {k: sorted(v) for k, v in out.items()}


def test_one_bucket_is_exact(points):
    """Copies beyond the bucket size are one row of the index, so they need no division."""
    few = points.where("id < 900")
    index = fit_index(few, "id", most=7, bucket_rows=1000)
    assert index.recall == 1.0 and index.depth == 0
    assert as_sets(index.nearest(few, 7)) == as_sets(N.nearest(few, few, "id", 7))
    assert as_sets(index.nearest(few, 3, skip_self=False)) == as_sets(N.nearest(few, few, "id", 3, skip_self=False))
    with pytest.raises(ValueError):
        index.nearest(few, 8)


@pytest.mark.parametrize("p", [1, 2])
def test_recall_is_as_measured(spark, points, tmp_path, p):
    index = fit_index(points, "id", most=10, p=p, bucket_rows=128, tables=2)
    assert index.depth and index.recall >= 0.9
    assert index.placed.groupBy("node").count().agg({"count": "max"}).first()[0] <= 128
    truth = N.nearest(points, points, "id", 10, p)
    found = index.nearest(points, 10)
    assert found_share(found, truth) >= 0.9
    index.write(str(tmp_path / "index"))
    again = NeighbourIndex.read(spark, str(tmp_path / "index"), index.settings())
    assert as_sets(again.nearest(points, 10)) == as_sets(found) and again.recall == index.recall


def test_blocks_within_a_bucket(points):
    """No digit may divide: the bucket is compared in blocks, and nothing is lost."""
    few = points.where("id < 700")
    index = fit_index(few, "id", most=4, bucket_rows=64, digits=1, tables=1, most_tables=1)
    whole = fit_index(few, "id", most=4, bucket_rows=10_000)
    in_bucket = as_sets(index.nearest(few, 4))
    exact = as_sets(whole.nearest(few, 4))
    assert set(in_bucket) == set(exact) and sum(in_bucket[k] == exact[k] for k in exact) > 0.3 * len(exact)


def test_small_tables(spark):
    schema = "id long, features array<double>"
    nothing = spark.createDataFrame([], schema)
    index = fit_index(nothing, "id", most=3)
    one = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], schema)
    assert index.recall is None and index.nearest(one, 3).count() == 0
    same = spark.createDataFrame([(i, [1.0, -0.0]) for i in range(9)] + [(20, None)], schema)
    found = as_sets(fit_index(same, "id", most=3).nearest(same, 3))
    assert found[0] == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0)] and found[8] == [(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0)] and 20 not in found


def test_model_by_both_methods(spark, points, tmp_path):
    from pyspark.sql import functions as F

    df = points.select("id", *[F.col("features")[j].alias(f"f{j}") for j in range(6)], (F.col("id") % 2).cast("double").alias("label"))
    names = [f"f{j}" for j in range(6)]
    fitted = {m: E.fit_family(df, "KNeighborsClassifier", names, "label", {"k": 5, "method": m}, id_col="id") for m in ("hashed", "exact")}
    assert fitted["exact"].stages[-1].recall == 1.0 and fitted["hashed"].stages[-1].recall >= 0.9
    got = {m: {r["id"]: r["prediction"] for r in f.transform(df).collect()} for m, f in fitted.items()}
    assert sum(got["hashed"][i] == got["exact"][i] for i in range(3000)) > 0.95 * 3000
    fitted["hashed"].save(str(tmp_path / "m"))
    again = type(fitted["hashed"]).load(str(tmp_path / "m"))
    assert again.stages[-1].recall == fitted["hashed"].stages[-1].recall
    assert {r["id"]: r["prediction"] for r in again.transform(df).collect()} == got["hashed"]
    with pytest.raises(ValueError):
        E.NeighbourEstimator(method="other")


def test_recall_is_reached_without_structure(spark, tmp_path):
    """The tables allowed cannot find nine of ten: all rows are compared."""
    rng = random.Random(8)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(24)]) for i in range(600)], "id long, features array<double>").persist()
    index = fit_index(df, "id", most=5, bucket_rows=32, tables=1, most_tables=2)
    assert index.recall >= 0.9
    assert as_sets(index.nearest(df, 5)) == as_sets(N.nearest(df, df, "id", 5))
    index.write(str(tmp_path / "index"))
    assert NeighbourIndex.read(spark, str(tmp_path / "index"), index.settings()).recall == index.recall
