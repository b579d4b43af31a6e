"""Exact quantiles and modes that do not depend on one task's memory."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import PASS_WIDTH, doubles, long_numbers, long_text, named, per_column, union_all
from .ordered import running, running_by_value
from .scratch import BUCKET_ROWS


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    buckets: int | None = None,
    accuracy: int = 10_000,
) -> DataFrame:
    """feature, n, q array<double>: exact linear-interpolated quantiles per column.

    Spark's ``percentile`` keeps every distinct value of a column in one task,
    so it serves only columns counted to hold few (under ``3 * accuracy``).
    In others a sketch brackets each quantile between two values. Where they are
    equal that is the answer; elsewhere the rows below the bracket are counted
    and only the few rows inside it are shuffled and ranked.
    """
    parts = []
    for start in range(0, len(columns), PASS_WIDTH):
        chunk = columns[start : start + PASS_WIDTH]
        slim = doubles(df, chunk)
        parts.append(_bracketed(slim, chunk, probs, buckets, accuracy))
    return union_all(parts)


def _bracketed(df: DataFrame, columns: Sequence[str], probs: Sequence[float], buckets: int | None, accuracy: int) -> DataFrame:
    # The sketch is off by at most n / accuracy ranks; twice that is left on both sides.
    slack = 2.0 / accuracy
    points = [min(1.0, max(0.0, p + s)) for p in probs for s in (-slack, slack)]
    sketch = per_column(
        df,
        columns,
        {"n": F.count, "q": lambda c: F.percentile_approx(c, [float(p) for p in points], accuracy)},
    )
    rows = {r["feature"]: (r["n"], r["q"]) for r in sketch.collect()}
    known: dict[tuple[str, int], float] = {}
    open_: list[tuple[str, int, float, float]] = []
    # Below this count the slack is less than the rank of error and the two ranks that interpolation needs.
    few = [c for c in columns if 0 < rows[c][0] < 3 * accuracy]
    if few:
        exact = per_column(df, few, {"q": lambda c: F.percentile(c, [float(p) for p in probs])})
        known.update({(r["feature"], i): v for r in exact.collect() for i, v in enumerate(r["q"])})
    for c in columns:
        n, q = rows[c]
        for i in range(len(probs) if n and c not in few else 0):
            low, high = q[2 * i], q[2 * i + 1]
            if low == high:
                known[c, i] = low
            else:
                open_.append((c, i, low, high))
    if open_:
        known.update(_ranked_inside(df, open_, {c: rows[c][0] for c in columns}, probs, buckets))
    found = [(c, rows[c][0], [known.get((c, i)) for i in range(len(probs))]) for c in columns]
    return df.sparkSession.createDataFrame(found, "feature string, n long, q array<double>")


def _ranked_inside(df: DataFrame, brackets: list[tuple[str, int, float, float]], sizes: dict[str, int],
                   probs: Sequence[float], buckets: int | None) -> dict[tuple[str, int], float]:
    """The quantiles of the open brackets: one pass counts the rows below, one ranks those inside."""
    inside = [F.col(c).between(low, high) for c, _, low, high in brackets]
    below = df.agg(
        *[F.count_if(F.col(c) < low).alias(f"b_{j}") for j, (c, _, low, _) in enumerate(brackets)],
        *[F.count_if(i).alias(f"i_{j}") for j, i in enumerate(inside)],
    ).first()
    cells = [
        F.when(inside[j], F.struct(F.lit(j).alias("j"), F.col(c).alias("value"))) for j, (c, *_) in enumerate(brackets)
    ]
    any_inside = inside[0]
    for condition in inside[1:]:
        any_inside = any_inside | condition
    counts = (
        df.where(any_inside)
        .select(F.explode(F.array_compact(F.array(*cells))).alias("s"))
        .groupBy("s.j", "s.value")
        .agg(F.count("*").alias("n"))
    )
    if buckets is None and sum(below[len(brackets) :]) <= BUCKET_ROWS:
        # Counted to fit one bucket, so the rows need not be written to be counted.
        ranked = running(counts, ["j"], [F.col("value")], ["n"])
    else:
        ranked = running_by_value(counts, ["j"], "value", ["n"], buckets)
    # Ranks of the two rows around each quantile, within its bracket.
    targets = [probs[i] * (sizes[c] - 1) for c, i, *_ in brackets]
    ranks = [(math.floor(t) - below[j], math.ceil(t) - below[j]) for j, t in enumerate(targets)]
    firsts = F.array(*[F.lit(r[0]) for r in ranks])[F.col("j")]
    lasts = F.array(*[F.lit(r[1]) for r in ranks])[F.col("j")]
    start = F.col("upto_n") - F.col("n")
    holds = lambda rank: (start <= rank) & (rank < F.col("upto_n"))
    picked = ranked.groupBy("j").agg(
        F.max(F.when(holds(firsts), F.col("value"))).alias("a"), F.max(F.when(holds(lasts), F.col("value"))).alias("b")
    )
    out = {}
    for r in picked.collect():
        c, i, *_ = brackets[r["j"]]
        if r["a"] is None or r["b"] is None:
            raise RuntimeError(f"the sketch missed a quantile of {c}")
        share = targets[r["j"]] - math.floor(targets[r["j"]])
        out[c, i] = r["a"] + share * (r["b"] - r["a"])
    return out


def modes(df: DataFrame, columns: Sequence[str], text: bool) -> DataFrame:
    """feature, value, n: the most frequent value, the smallest on a tie.

    Counting by value combines on the map side, so a hot value costs one row
    per task; the final pick is an aggregate, not a sort.
    """
    cells = long_text(df, columns) if text else long_numbers(df, columns)
    counts = cells.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count("*").alias("n"))
    best = counts.groupBy("feature").agg(F.min(F.struct((-F.col("n")).alias("neg"), "value")).alias("best"))
    return named(best, columns).select("feature", F.col("best.value").alias("value"), (-F.col("best.neg")).alias("n"))
