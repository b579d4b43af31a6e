import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clusters as C
from tidemark.operators import profile as P
from tidemark.operators import sketches as K


def as_map(df):
    return {(r["a"], r["b"]): r["r"] for r in df.collect()}


def test_wide_correlations_equal_narrow_ones(spark):
    """Gaps, a large mean, constants, a column with one value, NaN and an empty table."""
    x = F.col("id")
    df = spark.range(500).select(
        F.sin(x * 1.3).alias("a"), (F.sin(x * 1.3) * 2 + F.cos(x * 0.7)).alias("b"), (F.lit(1e9) + x % 17).alias("c"),
        F.when(x % 3 > 0, x % 11).alias("d"), F.lit(4.25).alias("e"), F.when(x == 7, 1.0).alias("f"),
        F.when(x % 5 == 0, F.lit(float("nan"))).otherwise(F.cos(x)).alias("g"), F.lit(None).cast("double").alias("h"), (x * x).cast("int").alias("i.j"),
    ).withColumnRenamed("i.j", "i_j")
    narrow, wide = as_map(P.correlations(df, wide=False)), as_map(P.correlations(df, wide=True))
    assert set(narrow) == set(wide)
    for pair, r in narrow.items():
        assert wide[pair] == pytest.approx(r, abs=1e-6) if r is not None else wide[pair] is None, pair
    assert all(v is None for v in as_map(P.correlations(df.limit(0), wide=True)).values())


def test_a_thousand_columns(spark):
    k, n = 1000, 300
    rng = np.random.default_rng(1)
    axes = [F.sin(F.col("id") * float(a)).alias(f"c{i}") for i, a in enumerate(rng.uniform(0.1, 9.0, k))]
    df = spark.range(n).select(axes).persist()
    got = P.correlations(df)
    x = np.array([list(r) for r in df.collect()])
    want = np.corrcoef(x.T)
    rows = got.collect()
    assert len(rows) == k * (k - 1) // 2
    assert max(abs(r["r"] - want[int(r["a"][1:]), int(r["b"][1:])]) for r in rows) < 1e-9


def test_distinct_counts_do_not_copy_rows(spark):
    df = spark.createDataFrame([(1, "a", 0.0, None), (1, None, -0.0, None), (2, "a", float("nan"), None)], "i int, s string, x double, v string")
    facts = {r["feature"]: (r["rows"], r["missing"], r["distinct"]) for r in P.column_facts(df).collect()}
    assert facts == {"i": (3, 0, 2), "s": (3, 1, 1), "x": (3, 1, 1), "v": (3, 3, 0)}
    assert {r["feature"]: (r["rows"], r["distinct"]) for r in P.column_facts(df.limit(0)).collect()} == {c: (0, 0) for c in df.columns}
    plan = P.distinct_counts(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_sketches_merge(spark, tmp_path):
    x = F.col("id")
    df = spark.range(60_000).select(
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((x % 10).cast("int"))).alias("ts"),
        (x % 20_000).alias("many"), (x % 7).cast("string").alias("few"), F.when(x % 2 == 0, x / 3).alias("half"), F.lit(None).cast("date").alias("none"),
    )
    root = str(tmp_path / "days")
    K.record_days(df, root, "ts")
    # Recorded again, a day is put in its place, and other days stay.
    K.record_days(df.where(F.to_date("ts") == F.lit("2024-01-03")), root, "ts")
    for first, last, part in ((None, None, df), ("2024-01-03", "2024-01-05", df.where(F.to_date("ts").between(F.lit("2024-01-03"), F.lit("2024-01-05"))))):
        got = {r["feature"]: r for r in K.profile_of_days(spark, root, first, last).collect()}
        exact = {r["feature"]: r for r in P.column_facts(part, ["many", "few", "half", "none"]).collect()}
        for c, r in exact.items():
            assert got[c]["rows"] == r["rows"] and got[c]["missing"] == r["missing"]
            assert abs(got[c]["distinct"] - r["distinct"]) <= 0.03 * r["distinct"]
    whole = {r["feature"]: r["distinct"] for r in K.merged_distinct(K.distinct_sketches(df, ["many", "few"])).collect()}
    merged = {r["feature"]: r["distinct"] for r in K.profile_of_days(spark, root).collect()}
    assert merged["few"] == whole["few"] == 7 and abs(merged["many"] - whole["many"]) <= 0.01 * whole["many"]


def test_squared_silhouette(spark, monkeypatch):
    rng = np.random.default_rng(2)
    points = [(int(c), *(rng.normal(c * 3.0, 1.0, 2))) for c in (0, 1, 2) for _ in range(40)] + [(9, 50.0, 50.0)]
    df = spark.createDataFrame([(c, float(a), float(b)) for c, a, b in points], "c int, a double, b double")
    x, own = np.array([p[1:] for p in points]), np.array([p[0] for p in points])
    square = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    scores = []
    for i, c in enumerate(own):
        mean = {g: square[i, own == g].sum() / (max(1, (own == g).sum() - 1) if g == c else (own == g).sum()) for g in set(own)}
        a, b = mean.pop(c), min(mean.values())
        scores.append(0.0 if (own == c).sum() == 1 else (b - a) / max(a, b))
    # By one row of all clusters, and by blocks of clusters.
    assert C.squared_silhouette(df, ["a", "b"], "c").first()[0] == pytest.approx(np.mean(scores))
    monkeypatch.setattr(C, "HELD_NUMBERS", 1)
    assert C.squared_silhouette(df, ["a", "b"], "c").first()[0] == pytest.approx(np.mean(scores))
    assert C.squared_silhouette(df.where("c = 1"), ["a", "b"], "c").first()[0] is None
    report = C.cluster_metrics(df, ["a", "b"], "c").first()
    assert report["status"] == "success" and report["silhouette"] == pytest.approx(np.mean(scores))
