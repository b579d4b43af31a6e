"""Exact duplicates by a 128-bit content hash, with the bytes compared inside groups.

Built-in functions only. The texts themselves are moved only for documents that
share their hash with another one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, join_narrow, lowered, query, table


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row of ``docs``: the id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is an
    empty one, and all empty texts are one group. ``keep`` names which stable id
    stays, the smallest or the largest; a missing id stays only where the group
    has no other. Of repeated rows with one id, one is kept. Other columns of
    ``docs`` are ignored, whatever their names.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    norm = lowered(F.col(text_col))
    hashed = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm"), F.unhex(F.md5(norm)).alias("_hash"))
    rows = cut(hashed.select("_id", "_hash", F.sha2("_norm", 256).alias("_sha")).withColumn("_row", F.monotonically_increasing_id()))
    copies = cut(_groups(rows, "_hash", keep).where("_n > 1"))
    odd = cut(_collisions(hashed, copies, keep))
    key = F.col("_hash")
    if not odd.isEmpty():
        # A true collision: its rows are told apart by the second hash as well.
        rows = rows.join(odd.distinct().withColumn("_odd", F.lit(True)), ["_hash", "_sha"], "left")
        key = F.when("_odd", F.concat("_hash", F.unhex("_sha"))).otherwise(F.col("_hash"))
        rows = cut(rows.select("_id", key.alias("_hash"), "_sha", "_row"))
        copies = cut(_groups(rows, "_hash", keep).where("_n > 1"))
    return rows.join(copies, "_hash", "left").select(
        F.col("_id").alias(id_col),
        F.coalesce("_keep", "_id").alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_row") == F.col("_keep_row"), F.lit(True)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def _groups(rows: DataFrame, key: str, keep: str) -> DataFrame:
    """One row per hash; counted before the shuffle, so a hot hash is as cheap as any other."""
    if keep == "smallest":
        best = F.min(F.struct(F.col("_id").isNull(), "_id", "_row"))
    else:
        best = F.max(F.struct(F.col("_id").isNotNull(), "_id", "_row"))
    found = rows.groupBy(key).agg(F.count("*").alias("_n"), best.alias("_best"))
    return found.select(key, "_n", F.col("_best._id").alias("_keep"), F.col("_best._row").alias("_keep_row"))


def _collisions(hashed: DataFrame, copies: DataFrame, keep: str) -> DataFrame:
    """Hash and SHA-256 of the texts that differ from the kept text of their hash."""
    members = join_narrow(hashed, copies.select("_hash", "_keep"), ["_hash"], "inner")
    # One text per hash, however many rows repeat the kept id; should they differ, all others are told apart from it.
    # Written, so that the join below shuffles both sides itself and its hot hashes can be split.
    kept = cut(members.where(F.col("_id").eqNullSafe(F.col("_keep"))).groupBy("_hash").agg(F.min("_norm").alias("_first")))
    different = members.join(kept, "_hash").where(F.col("_norm") != F.col("_first"))
    return different.select("_hash", F.sha2("_norm", 256).alias("_sha"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are."""
    found = cut(exact_duplicates(docs, id_col, text_col, keep).select(id_col, "kept", F.unhex("text_sha256").alias("_sha")))
    gone = cut(found.where(~F.col("kept")).select(id_col).distinct())
    stay = found.where("kept").select(id_col, "_sha")
    # Ids on both sides belong to repeated rows, or to rows without an id.
    both = cut(gone.join(stay, gone[id_col].eqNullSafe(stay[id_col]), "left_semi"))
    if both.isEmpty():
        return join_narrow(docs, gone, [id_col], "left_anti").select(*docs.columns)
    # Whole rows in one column, so that none of their names can clash.
    sha = F.unhex(F.sha2(lowered(F.col(text_col)), 256))
    rows = docs.select(F.struct(*docs.columns).alias("_all"), F.col(id_col).alias("_id"), sha.alias("_sha"))
    same = lambda other: F.col("d._id").eqNullSafe(F.col(f"o.{other}"))
    rest = rows.alias("d").join(gone.alias("o"), same(id_col), "left_anti").select("_all.*")
    again = rows.alias("d").join(both.alias("o"), same(id_col), "left_semi")
    place = F.row_number().over(W.partitionBy("_id", "_sha").orderBy(F.lit(0)))
    again = again.withColumn("_place", place).where("_place = 1")
    again = again.alias("d").join(stay.alias("o"), same(id_col) & (F.col("d._sha") == F.col("o._sha")), "left_semi")
    return rest.unionByName(again.select("_all.*"))


@query(
    "op1_exact_dedup",
    """
    WITH d AS (
      SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY t)
    """,
)
def op1_exact_dedup(spark, sf):
    return exact_duplicates(table(spark, sf, "documents"), keep="largest")
