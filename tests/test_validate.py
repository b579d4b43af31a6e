import pytest
from pyspark.sql import functions as F

from tidemark.operators.profile import distinct_counts, null_counts
from tidemark.operators.validate import Limits, NothingToValidate, issues, suitability, validate_scoring, validate_training


@pytest.fixture(scope="module")
def sample(spark):
    pattern = [
        (1.0, "A", 1.0, 0), (2.0, "B", None, 1), (None, "A", None, 1), (4.0, None, None, 0), (5.0, "C", 2.0, 1),
    ]
    rows = [(*pattern[i % 5][:3], i, pattern[i % 5][3]) for i in range(100)]
    return spark.createDataFrame(rows, "numeric double, categorical string, many_missing double, unique long, target long")


def test_missing_counts(sample):
    counts = {r["feature"]: r["missing"] for r in null_counts(sample).collect()}
    assert counts == {"numeric": 20, "categorical": 20, "many_missing": 60, "unique": 0, "target": 0}
    errors = issues(sample).where("severity = 'error'").collect()
    assert [r["feature"] for r in errors] == ["many_missing"]


def test_types_and_unique(sample):
    report = validate_training(sample, "target").first()
    assert len(report["data_types"]) == 5
    assert report["unique_values"]["categorical"] == 3 and report["unique_values"]["unique"] == 100
    assert {r["feature"]: r["distinct"] for r in distinct_counts(sample).collect()}["unique"] == 100


def test_training_report(sample):
    report = validate_training(sample, "target").first()
    assert report["total_rows"] == 100 and report["total_columns"] == 5
    assert report["validation_errors"] and any("unique" in w for w in report["warnings"])
    assert report["numeric_stats"]["numeric"]["q50"] == 3.0


def test_report_holds_the_issues(sample):
    listed = {(r["severity"], r["rule"], r["feature"], r["ratio"]) for r in issues(sample).collect()}
    report = validate_training(sample, "target").first()
    assert {(i["severity"], i["rule"], i["feature"], i["ratio"]) for i in report["issues"]} == listed
    assert len(report["validation_errors"]) + len(report["warnings"]) == len(listed)


def test_null_target_is_an_error(sample):
    report = validate_training(sample, "numeric").first()
    assert report["issues"][0]["rule"] == "missing target" and report["issues"][0]["ratio"] == 0.2
    assert report["validation_errors"][0].startswith("numeric: missing target")


def test_scoring_report(spark):
    df = spark.createDataFrame([(1, "A", 1), (2, "B", 2), (3, "C", 3)], "numeric long, categorical string, extra_col long")
    report = validate_scoring(df, ["numeric", "categorical"]).first()
    assert any("extra_col" in w for w in report["warnings"])
    assert not [i for i in report["issues"] if i["rule"] == "absent column"]


def test_errors(spark, sample):
    with pytest.raises(NothingToValidate):
        validate_training(sample.limit(0), "target")
    with pytest.raises(NothingToValidate):
        validate_training(spark.createDataFrame([(1,), (2,), (3,)], "feature long"), "target")


def test_limits_are_settings(sample):
    assert issues(sample, Limits(most_missing=0.7)).where("severity = 'error'").count() == 0


def test_suitability(sample):
    assert suitability(sample, ["numeric"]).first()["score"] == 1.0
    assert suitability(sample, ["numeric"], gives_probability=False).first()["score"] == 0.5
    assert suitability(sample.where(F.col("unique") < 49), ["numeric"]).first()["score"] == 0.0
