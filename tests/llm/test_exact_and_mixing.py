import math

import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

from tidemark.llm.common import QUERIES, SQL
from tidemark.llm.components import connected_components
from tidemark.llm.exact_dedup import _collisions, drop_copies, exact_duplicates
from tidemark.llm.mixing import mix, mixed_documents, source_targets


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op2_url_filters"])
def test_agrees_with_sql(spark, sf, name):
    assert compare(spark, duck(sf), QUERIES[name], SQL[name], sf) == ""


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_exact_cases(messy, empty):
    rows = exact_duplicates(messy, keep="smallest").collect()
    assert len(rows) == messy.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["keep_id"] == 1 and by[1]["group_size"] == 2 and not by[2]["kept"]
    assert by[4]["keep_id"] == 4 and by[5]["keep_id"] == 4
    assert sorted(r["kept"] for r in rows if r["doc_id"] == 8) == [False, True]
    assert [r for r in rows if r["doc_id"] is None][0]["kept"]
    assert exact_duplicates(empty).count() == 0
    kept = drop_copies(messy)
    assert kept.columns == messy.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 4, 6, 7, 8, 9, 10, 11, 12]


def test_bytes_are_compared_within_a_hash(spark):
    hashed = spark.createDataFrame([(1, "x", b"h"), (2, "x", b"h"), (3, "y", b"h")], "_id long, _norm string, _hash binary")
    copies = spark.createDataFrame([(b"h", 1)], "_hash binary, _keep long")
    odd = _collisions(hashed, copies, "smallest").collect()
    assert [r["_sha"] for r in odd] == [hashed.where("_id = 3").select(F.sha2("_norm", 256)).first()[0]]


def test_rows_repeated_many_times(spark):
    """Rows that repeat the kept id are not compared with each other: time grows with their number, not its square."""
    n = 100_000
    df = spark.range(n).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    row = exact_duplicates(df).agg(F.count("*"), F.min("group_size"), F.count_if("kept"), F.max("keep_id")).first()
    assert tuple(row) == (n, n, 1, 5)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {len({v for k, v in got.items() if k in span}) for span in (range(1, 41), range(100, 160), range(200, 202))} == {1}
    assert len(set(got.values())) == 3 and len(got) == 40 + 60 + 2
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_targets_stop_and_are_shared_again(spark):
    sizes = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 100, 1), (None, 50, 1)], "source string, source_size long, n long")
    got = {r["source"]: r["target"] for r in source_targets(sizes).collect()}
    assert got["a"] == 20.0 and got["c"] == 200.0 and got[None] == 100.0
    assert math.isclose(sum(got.values()), 1.5 * 1160)


def test_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    once, again = (sorted(tuple(r) for r in mix(d).select("doc_id", "taken", "target", "source", "size").collect()) for d in (docs, docs.repartition(5)))
    assert once == again
    taken, target = {}, {}
    for _, t, goal, source, size in once:
        assert t in (0, size, 2 * size)
        taken[source], target[source] = taken.get(source, 0) + t, goal
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] for s in target)


def test_mix_fills_from_later_blocks(spark):
    """Long texts at the edge of a source leave no gap that shorter ones of later blocks can fill."""
    rows = [(i, "w " * (3000 if i % 40 == 0 else 1 + i % 7), "a" if i % 3 else "b") for i in range(1200)] + [(5000 + i, "w " * 50, None) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in range(3):
        got = mix(docs, block_docs=16, seed=seed).collect()
        for source in ("a", "b", None):
            of = [r for r in got if r["source"] == source]
            gap = of[0]["target"] - sum(r["taken"] for r in of)
            spare = [r["size"] for r in of if r["size"] and r["taken"] < 2 * r["size"] and r["copies"] == min(x["copies"] for x in of)]
            # Every word not yet met is less than the smallest text that is left.
            assert abs(gap) <= (min(spare) if spare else 1), (seed, source, gap)
        assert all(len(r["shards"]) == r["copies"] for r in got)


def test_mixed_documents_follow_the_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(r["doc_id"] for r in mix(docs).collect() for _ in range(r["copies"]))
    once = mixed_documents(docs, part_words=200)
    assert once.rdd.getNumPartitions() > 16
    parts = once.rdd.glom().map(lambda rows: [r["doc_id"] for r in rows]).collect()
    assert sorted(i for part in parts for i in part) == want and max(map(len, parts)) < len(want) / 16


def test_mix_cases(messy, empty):
    rows = mix(messy).collect()
    assert len(rows) == messy.count() and mix(empty).count() == 0
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (4, 5, 6)} == {0}
    assert mixed_documents(messy).columns == messy.columns and mixed_documents(empty).count() == 0
    drawn = sum(r["copies"] for r in rows if r["doc_id"] == 8)
    assert mixed_documents(messy).where("doc_id = 8").count() == drawn
