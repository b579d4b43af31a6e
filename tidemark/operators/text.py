"""Word search over texts: distinct words per text, matches and related texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A word is a run of letters, digits and underscores of any script.
WORD = r"([\p{L}\p{N}_]+)"


def words(text: str | Column) -> Column:
    """Distinct lower-case words of the whole text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1)))


def word_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """word, key: one row per word and text.

    The index stays in rows: a common word occurs in most texts, and a list of
    them would not fit one row.
    """
    return df.select(F.explode(words(text)).alias("word"), key)


def word_frequencies(df: DataFrame, key: str, text: str) -> DataFrame:
    """word, texts: in how many texts each word occurs."""
    return word_index(df, key, text).groupBy("word").agg(F.count("*").alias("texts"))


def search(df: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """key, matches: texts that hold any word of the query. No join: the query words are literals."""
    wanted = F.array_distinct(F.regexp_extract_all(F.lower(F.lit(query)), F.lit(WORD), F.lit(1)))
    common = F.size(F.array_intersect(words(text), wanted))
    return df.select(key, common.cast("long").alias("matches")).where("matches > 0")


def related(df: DataFrame, key: str, text: str, current, k: int = 3) -> DataFrame:
    """key, common: the k other texts that share most words with one text."""
    row = df.where(F.col(key) == current).select(words(text).alias("w")).first()
    if row is None:
        raise KeyError(f"no text {current}")
    wanted = F.from_json(F.lit(_json(row["w"])), "array<string>")
    common = F.size(F.array_intersect(words(text), wanted)).cast("long")
    return (
        df.where(F.col(key) != current)
        .select(key, common.alias("common"))
        .where("common > 0")
        .orderBy(F.desc("common"), key)
        .limit(k)
    )


def _json(values: list[str]) -> str:
    import json

    return json.dumps(values, ensure_ascii=False)


def first_line(text: str | Column) -> Column:
    """The title of a text: its first line."""
    return F.substring_index(text, "\n", 1)
