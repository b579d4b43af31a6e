"""Checks of training and scoring tables against thresholds."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns, per_column, safe_divide, text_columns, union_all
from .profile import column_facts, numeric_stats, outlier_counts
from .select import column_match

STAT_NAMES = ("count", "mean", "std", "min", "q25", "q50", "q75", "max", "outliers", "lower_bound", "upper_bound")

REPORT_SCHEMA = """created_at timestamp, dataset string, total_rows bigint, total_columns int,
missing_values map<string,bigint>, data_types map<string,string>, unique_values map<string,bigint>,
numeric_stats map<string,map<string,double>>, validation_errors array<string>, warnings array<string>,
issues array<struct<severity:string,rule:string,feature:string,ratio:double,limit:double>>"""


class NothingToValidate(ValueError):
    """The table has no rows, or not the column that is to be checked."""


@dataclass(frozen=True)
class Issue:
    """One broken rule. ``ratio`` is the share of rows that break it, or of distinct values; ``limit`` what is allowed."""

    severity: str
    rule: str
    feature: str
    ratio: float | None = None
    limit: float | None = None

    def __str__(self) -> str:
        parts = [f"{self.feature}: {self.rule}"]
        if self.ratio is not None:
            parts.append(f"{self.ratio:.4f}" + (f", limit {self.limit:g}" if self.limit is not None else ""))
        return " = ".join(parts)


@dataclass(frozen=True)
class Limits:
    most_missing: float = 0.2
    least_unique: float = 0.01
    most_unique: float = 0.99


def mixed_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """feature, nulls, numbers, texts: what the cells of each text column hold."""
    columns = text_columns(df) if columns is None else columns
    number = lambda c: F.col(c).try_cast("double").isNotNull()
    return per_column(
        df,
        columns,
        {
            "nulls": lambda c: F.count_if(F.col(c).isNull()),
            "numbers": lambda c: F.count_if(number(c)),
            "texts": lambda c: F.count_if(F.col(c).isNotNull() & ~number(c)),
        },
    )


def issues(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """severity, rule, feature, ratio: every broken rule, from aggregates only."""
    facts = column_facts(df)
    missing = safe_divide(F.col("missing"), F.col("rows"))
    unique = safe_divide(F.col("distinct"), F.col("rows"))

    def rule(source: DataFrame, severity: str, name: str, ratio, broken) -> DataFrame:
        return source.where(broken).select(
            F.lit(severity).alias("severity"), F.lit(name).alias("rule"), "feature", ratio.alias("ratio")
        )

    parts = [
        rule(facts, "error", "missing", missing, missing > limits.most_missing),
        rule(facts, "warning", "few unique", unique, unique < limits.least_unique),
        rule(facts, "warning", "many unique", unique, unique > limits.most_unique),
    ]
    texts = text_columns(df)
    if texts:
        kinds = sum((F.col(c) > 0).cast("int") for c in ("nulls", "numbers", "texts"))
        share = safe_divide(F.col("texts"), F.col("nulls") + F.col("numbers") + F.col("texts"))
        parts.append(rule(mixed_types(df, texts), "warning", "mixed types", share, (F.col("texts") > 0) & (kinds > 1)))
    numbers = numeric_columns(df)
    if numbers:
        share = safe_divide(F.col("outliers"), F.col("rows"))
        parts.append(rule(outlier_counts(df, numbers), "warning", "outliers", share, F.col("outliers") > 0))
    return union_all(parts)


def _broken_rules(facts: dict, outliers: dict, mixed: dict, limits: Limits) -> list[Issue]:
    """The records of ``issues()``, from facts per column that are on the driver already."""
    out = []
    for feature, (rows, missing, distinct) in facts.items():
        gaps, unique = missing / rows, distinct / rows
        if gaps > limits.most_missing:
            out.append(Issue("error", "missing", feature, gaps, limits.most_missing))
        if unique < limits.least_unique:
            out.append(Issue("warning", "few unique", feature, unique, limits.least_unique))
        if unique > limits.most_unique:
            out.append(Issue("warning", "many unique", feature, unique, limits.most_unique))
        if feature in mixed:
            out.append(Issue("warning", "mixed types", feature, mixed[feature]))
        if outliers.get(feature):
            out.append(Issue("warning", "outliers", feature, outliers[feature] / rows))
    return out


def _report(df: DataFrame, dataset: str, limits: Limits, given: list[Issue], filled: str | None = None) -> DataFrame:
    """One report row. Only per-column aggregates reach the driver; ``filled`` must hold no missing value."""
    facts = {r["feature"]: (r["rows"], r["missing"], r["distinct"]) for r in column_facts(df).collect()}
    facts = {c: facts[c] for c in df.columns}
    if not next(iter(facts.values()))[0]:
        raise NothingToValidate(f"no rows in {dataset}")
    numbers, texts = numeric_columns(df), text_columns(df)
    stats = {}
    if numbers:
        found = {r["feature"]: r for r in numeric_stats(df, numbers).collect()}
        stats = {c: {s: None if found[c][s] is None else float(found[c][s]) for s in STAT_NAMES} for c in numbers}
    mixed = {}
    for r in mixed_types(df, texts).collect() if texts else []:
        kinds = [r[k] for k in ("nulls", "numbers", "texts")]
        if r["texts"] > 0 and sum(k > 0 for k in kinds) > 1:
            mixed[r["feature"]] = r["texts"] / sum(kinds)
    found_issues = given + _broken_rules(facts, {c: s["outliers"] for c, s in stats.items()}, mixed, limits)
    if filled and facts[filled][1]:
        found_issues.insert(0, Issue("error", "missing target", filled, facts[filled][1] / facts[filled][0], 0.0))
    of = lambda severity: [str(i) for i in found_issues if i.severity == severity]
    row = (
        dt.datetime.now(),
        dataset,
        next(iter(facts.values()))[0],
        len(df.columns),
        {c: f[1] for c, f in facts.items()},
        {f.name: f.dataType.simpleString() for f in df.schema.fields},
        {c: f[2] for c, f in facts.items()},
        stats,
        of("error"),
        of("warning"),
        [(i.severity, i.rule, i.feature, i.ratio, i.limit) for i in found_issues],
    )
    return df.sparkSession.createDataFrame([row], REPORT_SCHEMA)


def validate_training(df: DataFrame, target: str, limits: Limits = Limits()) -> DataFrame:
    """The report row of a training table, whose target must be there in every row."""
    if target not in df.columns:
        raise NothingToValidate(f"no column {target}")
    return _report(df, "training_data", limits, [], filled=target)


def validate_scoring(df: DataFrame, training_columns: Sequence[str], limits: Limits = Limits()) -> DataFrame:
    """The report row of a table to score: columns of training that are absent, columns that training had not."""
    absent, extra = column_match(df, training_columns)
    given = [Issue("error", "absent column", c) for c in absent] + [Issue("warning", "column not used", c) for c in extra]
    return _report(df, "prediction_data", limits, given)


def suitability(df: DataFrame, features: Sequence[str], gives_probability: bool = True,
                least_rows: int = 50, most_features: int = 1000) -> DataFrame:
    """rows, features, score: 0 too few rows or too many features, 0.5 without probabilities, else 1."""
    fits = (F.count("*") >= least_rows) & F.lit(len(features) <= most_features)
    score = F.when(~fits, 0.0).otherwise(1.0 if gives_probability else 0.5)
    return df.agg(F.count("*").alias("rows"), F.lit(len(features)).alias("features"), score.alias("score"))
