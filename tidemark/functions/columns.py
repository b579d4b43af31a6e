"""Column choice by type, null handling, and wide-to-long reshaping."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns aggregated together in one pass. Wider tables are split, and as each
# pass reads other columns of the files, splitting does not read more bytes.
PASS_WIDTH = 60


def _is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = (), with_bool: bool = False) -> list[str]:
    skip = set(exclude)
    kinds = (T.NumericType, T.BooleanType) if with_bool else (T.NumericType,)
    return [f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, kinds)]


def text_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, T.StringType)]


def time_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if f.name not in skip and _is_time(f.dataType)]


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null, so both count as missing."""
    kind = df.schema[name].dataType
    column = F.col(f"`{name}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column), column)
    return column


def as_double(df: DataFrame, name: str) -> Column:
    """Numbers, booleans and times as doubles (times as epoch seconds)."""
    kind = df.schema[name].dataType
    if _is_time(kind):
        return F.col(f"`{name}`").cast("timestamp").cast("double")
    if isinstance(kind, T.BooleanType):
        return F.col(f"`{name}`").cast("int").cast("double")
    return present(df, name).cast("double")


def doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only these columns, as doubles with NaN as null: computed once per row, however many aggregates follow."""
    return df.select(*[as_double(df, c).alias(c) for c in columns])


def normalise(df: DataFrame) -> DataFrame:
    """NaN to null in every floating column."""
    return df.select(*[present(df, c).alias(c) for c in df.columns])


def long_numbers(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, feature, value: one row per numeric cell, missing ones too.

    ``feature`` is the place of the column in ``columns``: a number is cheaper
    to hash and to shuffle than a name. ``named`` puts the names back.
    """
    wide = df.select(*keep, *[as_double(df, c).alias(f"v_{i}") for i, c in enumerate(columns)])
    return _melt(wide, columns, keep)


def long_text(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, feature (as in ``long_numbers``), value: one row per cell, values as text."""
    wide = df.select(*keep, *[present(df, c).cast("string").alias(f"v_{i}") for i, c in enumerate(columns)])
    return _melt(wide, columns, keep)


def _melt(wide: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    cells = F.array(
        *[F.struct(F.lit(i).alias("feature"), F.col(f"v_{i}").alias("value")) for i in range(len(columns))]
    )
    return wide.select(*keep, F.inline(cells))


def named(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Feature numbers back to column names."""
    return df.withColumn("feature", F.array(*map(F.lit, columns))[F.col("feature")])


def numbered(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column names to feature numbers."""
    place = F.array_position(F.array(*map(F.lit, columns)), F.col("feature")) - 1
    return df.withColumn("feature", place.cast("int"))


def per_column(
    df: DataFrame,
    columns: Sequence[str],
    measures: dict[str, Callable[[str], Column]],
) -> DataFrame:
    """One row per column with the given aggregates, computed in one pass.

    ``measures`` maps a result name to a function from column name to an
    aggregate expression; the results must have one type for all columns.
    """
    parts = []
    for start in range(0, len(columns), PASS_WIDTH):
        chunk = columns[start : start + PASS_WIDTH]
        row = df.agg(
            *[
                F.struct(F.lit(c).alias("feature"), *[fn(c).alias(m) for m, fn in measures.items()]).alias(f"s_{i}")
                for i, c in enumerate(chunk)
            ]
        )
        parts.append(row.select(F.inline(F.array(*[F.col(f"s_{i}") for i in range(len(chunk))]))))
    return union_all(parts)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other)
    return out


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))
