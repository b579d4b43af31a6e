"""What several operators of this subpackage share: text rules, joins behind a size check, queries."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import cut, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Fixed values of the contracts: what separates words for sizes and shingles.
SPACE = r"\x20\x09-\x0D"

#: Rows of fixed width that may be broadcast: under 10 MB at 64 bytes each.
BROADCAST_ROWS = 150_000


#: CRC-32 in SQL: a table ``tab`` of one list ``t``, and the checksum of an expression of digits by it.
CRC_TABLE = """
    tab AS (
      SELECT list(v ORDER BY i) AS t
      FROM (SELECT i, list_reduce(range(8), lambda a, x: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i::BIGINT) AS v
            FROM range(256) r(i)))"""


def crc32_sql(digits: str) -> str:
    step = "lambda a, c: xor(a >> 8, t[(xor(a, ascii(c)::BIGINT) & 255) + 1])"
    return f"xor(list_reduce(string_split({digits}, ''), {step}, 4294967295::BIGINT), 4294967295)"


def query(name: str, sql: str | None = None):
    """Register a query of this subpackage, with its SQL twin where one exists."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from it.

    For loops: unlike a checkpoint, what is read back carries no constraints
    of the plan before, whose number would grow from round to round.
    """
    path = scratch_path(df.sparkSession, "rounds")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case and every other character as it is; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def fits_broadcast(narrow: DataFrame, most_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a written table of a few fixed-width columns is small enough for every executor."""
    return narrow.limit(most_rows + 1).count() <= most_rows


def join_narrow(df: DataFrame, narrow: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join with a written table of a few fixed-width columns.

    It is broadcast if its counted rows are few. Otherwise both sides are
    shuffled, and adaptive execution splits hot keys of ``df``.
    """
    return df.join(F.broadcast(narrow) if fits_broadcast(narrow) else narrow, on, how)


__all__ = ["CRC_TABLE", "QUERIES", "SQL", "SPACE", "crc32_sql", "cut", "fits_broadcast", "join_narrow", "lowered", "query", "stored", "table"]
