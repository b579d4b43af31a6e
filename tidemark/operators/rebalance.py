"""Class weights, under-sampling, and features scored or coded against a label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import as_double, safe_divide
from ..functions.ordered import first_by_hash
from ..functions.quantiles import quantiles
from ..functions.scratch import join_lookup


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n, weight with weight = rows / (classes * n)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg((F.sum("n") / F.count("*")).alias("even")).scalar()
    return counts.select(label, "n", safe_divide(totals, F.col("n")).alias("weight"))


def with_class_weights(df: DataFrame, label: str, output: str = "weight") -> DataFrame:
    weights = class_weights(df, label).select(label, F.col("weight").alias(output))
    return join_lookup(df, weights, [label])


def undersample(df: DataFrame, label: str, id_col: str, seed: int = 42) -> DataFrame:
    """As many rows of every class as the smallest has, picked in hash order of the id."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    smallest = counts.agg(F.min("n")).first()[0] or 0
    return first_by_hash(df.where(F.col(label).isNotNull()), [label], id_col, smallest, seed)


def target_means(df: DataFrame, column: str, label: str) -> DataFrame:
    """value, n, mean of the label."""
    y = as_double(df, label)
    return df.groupBy(F.col(column).alias("value")).agg(F.count(y).alias("n"), F.avg(y).alias("encoded"))


def target_encode(train: DataFrame, df: DataFrame, column: str, label: str, output: str) -> DataFrame:
    """Replace a category by the training mean of the label; new ones get the overall mean."""
    overall = train.agg(F.avg(as_double(train, label))).first()[0]
    means = target_means(train, column, label).select(F.col("value").alias(column), F.col("encoded").alias(output))
    return join_lookup(df, means, [column], "left").withColumn(output, F.coalesce(output, F.lit(overall)))


def evidence_weights(df: DataFrame, column: str, label: str, regularization: float = 1.0) -> DataFrame:
    """value, n, woe: log ratio of the category's share of positives to its share of negatives."""
    y = as_double(df, label)
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(y).alias("n"), F.sum(y).alias("pos"))
    # Totals from a plain aggregate: the categories may be many.
    totals = df.agg(F.sum(y).alias("p"), F.count(y).alias("n")).first()
    positives, rows = totals["p"] or 0.0, totals["n"]
    up = (F.col("pos") + regularization) / F.lit(positives + 2 * regularization)
    down = (F.col("n") - F.col("pos") + regularization) / F.lit(rows - positives + 2 * regularization)
    return counts.select("value", "n", F.ln(up / down).alias("woe"))


def mutual_information(df: DataFrame, columns: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """feature, mi: information shared by the label and each quantile-binned number, in nats."""
    probs = [i / bins for i in range(1, bins)]
    edges = {r["feature"]: sorted({q for q in r["q"] if q is not None}) for r in quantiles(df, columns, probs).collect()}
    parts = []
    for c in columns:
        x = as_double(df, c)
        place = F.lit(0)
        for edge in edges[c]:
            place = place + (x > edge).cast("int")
        parts.append(F.struct(F.lit(c).alias("feature"), F.when(x.isNotNull(), place).alias("bin")))
    cells = df.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), F.inline(F.array(*parts)))
    joint = cells.where(F.col("bin").isNotNull()).groupBy("feature", "bin", "y").agg(F.count("*").alias("n"))
    # From here on the rows are features x bins x classes.
    over = lambda *keys: F.sum("n").over(W.partitionBy(*keys))
    rows = over("feature")
    term = F.col("n") / rows * F.ln(F.col("n") * rows / (over("feature", "bin") * over("feature", "y")))
    return joint.select("feature", term.alias("t")).groupBy("feature").agg(F.sum("t").alias("mi"))


def select_by_information(df: DataFrame, columns: Sequence[str], label: str, keep: int, only_above: int = 100) -> list[str]:
    """The columns with most information, when there are more than ``only_above``."""
    if len(columns) <= only_above:
        return list(columns)
    best = mutual_information(df, columns, label).orderBy(F.desc("mi"), "feature").limit(keep)
    return [r["feature"] for r in best.collect()]

