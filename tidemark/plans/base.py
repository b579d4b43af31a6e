"""Registry of the named queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL twin where one exists."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round the named columns so that two engines' last float digits agree."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# The test tables hold no nulls, so both sides of a pair inject them by rule.
GAPS_SQL = """gaps AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
         l_extendedprice,
         CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_discount END AS l_discount,
         CASE WHEN l_linenumber <> 2 THEN NULL ELSE l_tax END AS l_tax,
         CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
         l_linestatus, l_shipdate
  FROM lineitem)"""


def gappy_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    hide = lambda cond, c: F.when(~cond, F.col(c)).alias(c)
    return df.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        hide(F.col("l_linenumber") % 4 == 0, "l_quantity"),
        "l_extendedprice",
        hide(F.col("l_suppkey") % 5 == 0, "l_discount"),
        hide(F.col("l_linenumber") != 2, "l_tax"),
        hide(F.col("l_partkey") % 7 == 0, "l_returnflag"),
        "l_linestatus",
        "l_shipdate",
    )
