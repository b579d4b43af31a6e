import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tidemark.operators import prepare as R
from tidemark.operators import rebalance as B
from tidemark.operators.select import column_types


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame(
        [(1.0, "A", 0), (2.0, "B", 1), (None, "A", 1), (4.0, None, 0), (5.0, "C", 1)], "numeric double, categorical string, target long"
    )


@pytest.fixture(scope="module")
def fresh(spark):
    return spark.createDataFrame([(3.0, "B"), (None, "A")], "numeric double, categorical string")


def nulls(df):
    return sum(df.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first())


def test_column_types(sample):
    assert column_types(sample, "target") == {"numerical": ["numeric"], "categorical": ["categorical"], "datetime": []}


def test_fit_transform_leaves_no_nulls(sample, fresh):
    prep = R.full_preparation(sample, "target")
    out = prep.fit_transform(sample)
    assert out.count() == 5 and nulls(out) == 0
    assert prep.feature_names == ["numeric", "categorical"]
    new = prep.transform(fresh)
    assert new.count() == 2 and nulls(new) == 0
    x, y = prep.split(out)
    assert x.columns == ["numeric", "categorical"] and y.columns == ["target"]


def test_fill_values(sample):
    for strategy, want in (("mean", 3.0), ("median", 3.0), ("most_frequent", 1.0), ("constant", 0.0)):
        out = R.MissingFiller(strategy).fit(sample).transform(sample)
        assert sorted(r["numeric"] for r in out.collect()) == sorted([1.0, 2.0, want, 4.0, 5.0])
        assert [r["categorical"] for r in out.where("numeric = 4").collect()] == ["A"]


def test_all_null_columns(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "x double, c string")
    out = R.MissingFiller("mean").fit(df).transform(df).collect()
    assert [(r["x"], r["c"]) for r in out] == [(None, "MISSING")] * 2


def test_unseen_categories(spark):
    train = spark.createDataFrame([("A",), ("B",)], "c string")
    new = spark.createDataFrame([("A",), ("Z",)], "c string")
    code = lambda how: [r["c"] for r in R.LabelEncoder(["c"], how).fit(train).transform(new).orderBy("c").collect()]
    assert code("keep") == [0, 2]
    assert code("null") == [None, 0]
    with pytest.raises(Exception, match="not seen"):
        code("error")
    flags = R.IndicatorEncoder(["c"]).fit(train).transform(new)
    assert flags.columns == ["c_A", "c_B"]
    assert sorted(map(tuple, flags.collect())) == [(0, 0), (1, 0)]


def test_vector_indicators(spark):
    train = spark.createDataFrame([("A",), ("B",), ("C",)], "c string")
    out = R.indicator_vector("c", "v").fit(train).transform(train)
    assert sorted(r["v"].indices[0] for r in out.collect()) == [0, 1, 2]


def test_scaling(spark):
    df = spark.createDataFrame([(float(i), 7.0) for i in range(10)], "x double, flat double")
    out = R.Scaler("standard").fit(df).transform(df)
    r = out.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.max(F.abs("flat")).alias("f")).first()
    assert r["m"] == pytest.approx(0) and r["s"] == pytest.approx(1) and r["f"] == 0
    out = R.Scaler("minmax").fit(df).transform(df)
    assert tuple(out.agg(F.min("x"), F.max("x"), F.max("flat")).first()) == (0.0, 1.0, 0.0)
    out = R.Scaler("robust").fit(df).transform(df)
    assert out.where("x = 0").count() == 0 and out.agg(F.max("flat")).first()[0] == 0


def test_statistics_do_not_leak(spark):
    train = spark.createDataFrame([(0.0,), (10.0,)], "x double")
    new = spark.createDataFrame([(20.0,)], "x double")
    assert R.Scaler("minmax").fit(train).transform(new).first()["x"] == 2.0


def test_outliers(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(1000.0,), (None,)], "x double")
    model = R.OutlierHandler("iqr").fit(df)
    low, high = model.values["limits"]["x"]
    out = model.transform(df)
    assert out.where((F.col("x") < low) | (F.col("x") > high)).count() == 0
    assert out.count() == 22 and out.where("x IS NULL").count() == 1
    assert R.OutlierHandler("remove").fit(df).transform(df).count() == 21
    z = R.OutlierHandler("zscore").fit(df).transform(df)
    assert z.agg(F.max("x")).first()[0] < 1000
    with pytest.raises(ValueError):
        R.OutlierHandler("isolation_forest")


def test_too_many_values_are_refused(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError, match="indicator_vector"):
        R.IndicatorEncoder(["c"]).fit(df)


def test_many_values_are_encoded(spark, tmp_path):
    df = spark.range(100_500).select("id", F.format_string("v%07d", "id").alias("c"))
    model = R.LabelEncoder(["c"]).fit(df)
    assert model.transform(df).where("c <> id").count() == 0
    model.save(str(tmp_path / "codes"))
    new = spark.createDataFrame([(1, "v0000003"), (2, "other")], "id long, c string")
    assert [r["c"] for r in R.LabelEncoderModel.load(str(tmp_path / "codes")).transform(new).orderBy("id").collect()] == [3, 100_500]


def test_settings_are_saved(tmp_path):
    R.OrdinalEncoder({"c": ["a"]}, unknown="null").save(str(tmp_path / "o"))
    assert R.OrdinalEncoder.load(str(tmp_path / "o")).getOrDefault("unknown") == "null"


def test_pipelines_are_saved(sample, fresh, tmp_path):
    stages = [R.MissingFiller("median"), R.OutlierHandler(), R.LabelEncoder(), R.Scaler("robust", exclude=["target"]), R.FloatCaster()]
    model = Pipeline(stages=stages).fit(sample)
    model.save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(model.transform(fresh)) == key(again.transform(fresh))


def test_dropping_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, None), (2.0, 4.0, 5.0, None), (4.0, 8.0, 5.0, 1.0)], "a double, b double, k double, s double")
    assert R.SparseColumnDropper().fit(df).transform(df).columns == ["a", "b", "k"]
    assert R.ConstantColumnDropper().fit(df).transform(df).columns == ["a", "b"]
    assert R.CorrelatedColumnDropper(exclude=["s"]).fit(df).transform(df).columns == ["a", "k", "s"]


def test_first_by_hash(spark):
    from tidemark.functions.ordered import first_by_hash, number_by_hash

    df = spark.range(9000).select("id", F.when(F.col("id") % 9 < 8, True).alias("k"))
    for n in (1, 300, 1000, 5000):
        want = number_by_hash(df, ["k"], "id").where(F.col("position") <= n).select("id")
        got = first_by_hash(df, ["k"], "id", n).select("id")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_class_weights_and_undersampling(spark):
    df = spark.range(90).select("id", F.when(F.col("id") < 60, "a").when(F.col("id") < 80, "b").otherwise("c").alias("y"))
    weights = {r["y"]: r["weight"] for r in B.class_weights(df, "y").collect()}
    assert weights == {"a": 0.5, "b": 1.5, "c": 3.0}
    assert B.with_class_weights(df, "y").agg(F.sum("weight")).first()[0] == pytest.approx(90)
    assert {r["n"] for r in B.undersample(df, "y", "id").groupBy("y").agg(F.count("*").alias("n")).collect()} == {10}


def test_information_prefers_the_label_itself(spark):
    df = spark.range(400).select((F.col("id") % 2).alias("y"), (F.col("id") % 2).cast("double").alias("same"), F.rand(1).alias("noise"))
    mi = {r["feature"]: r["mi"] for r in B.mutual_information(df, ["same", "noise"], "y", 4).collect()}
    assert mi["same"] == pytest.approx(0.693147, abs=1e-5) and mi["noise"] < 0.1
    assert B.select_by_information(df, ["same", "noise"], "y", 1, only_above=1) == ["same"]
