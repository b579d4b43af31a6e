"""Nearest neighbours by largest inner product, from shifted Hilbert orderings.

Vectors are projected to a few dimensions, shifted and put in the order of a
Hilbert curve, several times over; Spark sorts each ordering by range. What
lies near a query in an ordering is compared with it, and the best of all
orderings give a limit that a vector must beat. Windows then widen: blocks of
neighbouring vectors are visited as long as their centre and radius allow a
vector beyond the limit, so the result is exact. On data without structure that
is nearly every block, and each is met by the queries in tiles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordered import BUCKET, add_value_buckets
from .common import cut, join_narrow, query, table

_SLACK = 1e-9

#: What one task is given at least of tables that were counted: vectors, results, numbers of rows by bucket.
_TASK_VECTORS, _TASK_HITS, _TASK_COUNTS = 4096, 200_000, 1000

#: Numbers of tile centres that are broadcast at once: 8 MB.
_BROADCAST_NUMBERS = 1_000_000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of integer cells (rows) of ``bits`` bits a dimension.

    From the highest bit down, a bit set in a dimension inverts the lower bits
    of the first, one not set swaps them; the Gray code of the result, read
    across dimensions, is the place.
    """
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for d in range(dims):
            up = (x[d] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(up, low, swap)
            x[d] ^= swap
        q >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            place = place << 1 | (x[d] >> b & 1)
    return place


def curve_keys(vectors: np.ndarray, curve: int, longest: float, as_query: bool, dims: int = 6, bits: int = 8, seed: int = 5) -> np.ndarray:
    """Hilbert places of vectors in ordering number ``curve``.

    One more component makes all candidates equally long, so that the largest
    inner product is the nearest vector; queries are brought to length one.
    """
    rng = np.random.default_rng([seed, curve])
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    if as_query:
        full = np.hstack([vectors / length, np.zeros_like(length)])
    else:
        scaled = vectors / longest
        full = np.hstack([scaled, np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(1, keepdims=True)))])
    axes = rng.standard_normal((full.shape[1], dims))
    spread = full @ axes * (1 << (bits - 2)) / 2.0 + rng.uniform(0, 1 << (bits - 2), dims)
    cells = np.clip(spread + (1 << (bits - 1)), 0, (1 << bits) - 1).astype(np.int64)
    return hilbert_index(cells, bits)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(np.float64)


def usable(vector: Column) -> Column:
    """Neither null, empty nor all zero, and no component null, infinite or not a number."""
    value = lambda v: v.cast("double")
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(value(v)) & (F.abs(value(v)) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda v: value(v) != 0)


def nearest(vectors: DataFrame, queries_every: int = 20, k: int = 20, curves: int = 4, window: int = 512, tile: int = 4096, seed: int = 5, widen: bool = True, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of largest inner product with each query but itself.

    Queries are the rows whose id is divisible by ``queries_every``. Nearest
    first, ties to the smaller id; all candidates, if fewer than k. Scores are
    sums in double precision, in the order of the components. ``widen=False``
    stops after the windows of the orderings; then the result is approximate.

    Vectors that are null, empty, zero or hold a null or non-finite component
    take no part, nor do rows without an id; all others must be of one length.
    Of rows that repeat an id, each is a candidate, but an id is returned once,
    with its best score. Other columns are ignored.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    rows = cut(rows.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda v: v.cast("float")).alias("v") if _is_float(vectors, vector_col) else F.transform(vector_col, lambda v: v.cast("double")).alias("v")))
    # Rows that repeat an id and its vector are one candidate. Only rows of repeated ids are moved for that.
    repeated = rows.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select("id")
    if not repeated.isEmpty():
        repeated = cut(repeated)
        rows = cut(join_narrow(rows, repeated, ["id"], "left_anti").unionByName(join_narrow(rows, repeated, ["id"], "left_semi").dropDuplicates(["id", "v"])))
    square = F.aggregate("v", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    asking = F.col("id") % queries_every == 0
    n, asked, longest = rows.agg(F.count("*"), F.count_if(asking), F.max(F.sqrt(square))).first()
    kind = rows.schema["v"].dataType.elementType.simpleString()
    # Of a vector that is there many times, only the smallest ids can be among the k nearest. The limit is
    # applied before the shuffle, so such a vector is as cheap as any other.
    place = F.row_number().over(W.partitionBy("v").orderBy("id"))
    first_ids = cut(_in_few(rows.withColumn("_p", place).where(F.col("_p") <= k + 1).drop("_p"), n, _TASK_VECTORS))
    schema = f"curve int, key long, id long, q boolean, v array<{kind}>"

    def keys(df: DataFrame, count: int, as_query: bool) -> DataFrame:
        return df.mapInArrow(_key_rows(count, longest or 1.0, as_query, seed), schema)

    queries = rows.where(asking)
    keyed = keys(first_ids, curves, False).unionByName(keys(queries, curves, True))
    parts = max(1, -(-(n or 0) * curves // (64 * window)))
    ordered = keyed.repartitionByRange(parts, "curve", "key", "id").sortWithinPartitions("curve", "key", "id")
    found = cut(_in_few(_best(ordered.mapInArrow(_window_rows(window, k), "qid long, id long, score double"), k), asked * k, _TASK_HITS))
    if widen:
        limit = found.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).alias("limit"))
        more = _widened(keys(first_ids, 1, False), keys(queries, 1, True), limit, n, asked, k, tile)
        found = cut(_in_few(_best(found.unionByName(more), k), asked * k, _TASK_HITS))
    exact = found.join(rows.withColumnRenamed("v", "_c"), "id").join(rows.select(F.col("id").alias("qid"), F.col("v").alias("_q")), "qid")
    product = F.aggregate(F.zip_with("_q", "_c", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    scored = exact.groupBy("qid", "id").agg(F.max(product).alias("score"))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return scored.select(F.col("qid").alias("query_id"), rank.alias("rank"), F.col("id").alias("vec_id"), "score").where(F.col("rank") <= k)


def _is_float(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.simpleString() == "array<float>"


def _in_few(df: DataFrame, rows: int, each: int) -> DataFrame:
    """A table of about ``rows`` rows in as many tasks as they ask for, if that is fewer than a shuffle dealt it out to."""
    return df.coalesce(max(1, -(-rows // each)))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, and others that rounding cannot tell from the last of them."""
    # One shuffle serves the groups and the window.
    once = found.repartition("qid").groupBy("qid", "id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("_r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id")))
    last = F.min(F.when(F.col("_r") <= k, F.col("score"))).over(W.partitionBy("qid"))
    return ranked.withColumn("_last", last).where(F.col("score") >= F.col("_last") - _SLACK).select("qid", "id", "score")


def _key_rows(curves: int, longest: float, as_query: bool, seed: int):
    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            v = _matrix(batch.column(1)) if n else None
            for curve in range(curves if n else 0):
                key = curve_keys(v, curve, longest, as_query, seed=seed)
                columns = [pa.array(np.full(n, curve, np.int32)), pa.array(key), batch.column(0), pa.array(np.full(n, as_query)), batch.column(1)]
                yield pa.RecordBatch.from_arrays(columns, ["curve", "key", "id", "q", "v"])

    return keys


def _window_rows(window: int, k: int):
    """Queries of a sorted partition meet the candidates at most about ``window`` places before and after."""

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hits(ids, q, v, begin, end):
            ask = begin + np.flatnonzero(q[begin:end])
            low, high = max(0, begin - window), min(len(ids), end + window)
            have = low + np.flatnonzero(~q[low:high])
            if not len(ask) or not len(have):
                return None
            score = v[ask] @ v[have].T
            score[ids[ask][:, None] == ids[have][None, :]] = -np.inf
            n = min(k, len(have))
            top = np.argpartition(-score, n - 1, axis=1)[:, :n]
            value = np.take_along_axis(score, top, 1)
            keep = value > -np.inf
            return np.repeat(ids[ask], n).reshape(-1, n)[keep], ids[have][top][keep], value[keep]

        def emit(found):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["qid", "id", "score"])

        held: list[pa.RecordBatch] = []

        def work(held, last):
            if not held:
                return
            t = pa.Table.from_batches(held)
            curve, ids, q = (t.column(c).to_numpy() for c in ("curve", "id", "q"))
            v = _matrix(t.column("v").combine_chunks())
            for c in np.unique(curve):
                on = np.flatnonzero(curve == c)
                for begin in range(0, len(on), window):
                    found = hits(ids[on], q[on], v[on], begin, min(len(on), begin + window))
                    if found is not None and len(found[0]):
                        yield emit(found)

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= 64 * window:
                yield from work(held, False)
                # The end of this stretch is met again by what follows.
                held, size = [pa.Table.from_batches(held).slice(max(0, size - window)).combine_chunks().to_batches()[0]], window
        yield from work(held, True)

    return meet


def _by_id(ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their best scores, a column each, so that an id takes one place."""
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
    if len(first) == len(ids):
        return ids, score
    return ids[order][first], np.maximum.reduceat(score[:, order], first, axis=1)


def _tiles(rows: DataFrame, n: int, size: int) -> DataFrame:
    """One row per about ``size`` neighbours on the curve: ids, limits, flat vectors, centre, radius, longest, least.

    Tiles are ranges of the curve, by a sketch of the keys. Where one key holds
    more rows than a tile, as of a vector that is there many times, they are
    dealt to several by id. So a tile is bounded whatever the data.
    """
    buckets = -(-max(n, 1) // size)
    ranged = add_value_buckets(rows.withColumn("_k", F.col("key").cast("double")), "_k", buckets)
    counts = _in_few(ranged.groupBy(BUCKET).agg(F.ceil(F.count("*") / size).alias("_parts")), buckets, _TASK_COUNTS)
    # One narrow row per tile.
    dealt = ranged.join(F.broadcast(counts), BUCKET).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")))
    lists = dealt.groupBy(BUCKET, "_part").agg(F.collect_list(F.struct("id", "limit", "v")).alias("m")).select("m")
    lists = _in_few(lists, n, size)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.float64()]
        names = ["ids", "limits", "flat", "centre", "radius", "longest", "least"]
        for batch in batches:
            for row in range(batch.num_rows):
                members = batch.column(0)[row].values
                ids, limits = np.asarray(members.field(0)), np.asarray(members.field(1))
                v = _matrix(members.field(2))
                centre = v.mean(0)
                radius = float(np.sqrt(((v - centre) ** 2).sum(1)).max())
                out = [ids, limits, v.reshape(-1), centre, radius, float(np.linalg.norm(v, axis=1).max()), float(limits.min())]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out, kinds)], names)

    return lists.mapInArrow(pack, "ids array<long>, limits array<double>, flat array<double>, centre array<double>, radius double, longest double, least double")


def _widened(blocks: DataFrame, asks: DataFrame, limit: DataFrame, n: int, asked: int, k: int, tile: int) -> DataFrame:
    """Vectors that beat the limit of a query, from all tiles whose centre and radius allow one.

    Candidates (``blocks``) are tiles of neighbours on the first curve, queries
    (``asks``) likewise. A pair of tiles is one row, so work is dealt evenly
    whatever the data.
    """
    blocks = blocks.select("key", "id", "v", F.lit(0.0).alias("limit"))
    asks = asks.join(limit, F.col("id") == F.col("qid"), "left").select("key", "id", "v", F.coalesce("limit", F.lit(float("-inf"))).alias("limit"))
    blocks = cut(_tiles(cut(blocks), n, tile).withColumn("b", F.monotonically_increasing_id()))
    asks = cut(_tiles(cut(_in_few(asks, asked, _TASK_VECTORS)), asked, tile // 4).withColumn("a", F.monotonically_increasing_id()))
    # Which tiles can hold something: one narrow row per tile on either side.
    dot = F.aggregate(F.zip_with("ac", "bc", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    left = asks.select("a", F.col("centre").alias("ac"), F.col("radius").alias("ar"), F.col("longest").alias("al"), "least")
    right = blocks.select("b", F.col("centre").alias("bc"), F.col("radius").alias("br"))
    norm_b = F.sqrt(F.aggregate("bc", F.lit(0.0), lambda acc, x: acc + x * x))
    # q.v = ac.bc + (q - ac).bc + q.(v - bc)
    bound = dot + F.col("ar") * norm_b + F.col("al") * F.col("br")
    # The narrow rows of the queries go to all tasks, so many numbers at once. Tasks for each pair of partitions
    # on either side would be more than there are pairs of tiles.
    numbers = left.agg(F.sum(F.size("ac") + 4)).first()[0] or 0
    turns = -(-numbers // _BROADCAST_NUMBERS) or 1
    met = [right.join(F.broadcast(left.where(F.pmod(F.xxhash64("a"), F.lit(turns)) == turn)), bound >= F.col("least") - _SLACK) for turn in range(turns)]
    pairs = cut(reduce(DataFrame.unionByName, met).select("a", "b"))

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                qi, ql, qv, bi, bv = (np.asarray(batch.column(c)[r].values) for c in range(5))
                q, b = qv.reshape(len(qi), -1), bv.reshape(len(bi), -1)
                bi, score = _by_id(bi, q @ b.T)
                hit = (score >= ql[:, None] - _SLACK) & (qi[:, None] != bi[None, :])
                # Where there is no limit yet, or many beat it, the best of this tile are enough.
                many = np.flatnonzero(hit.sum(1) > 2 * k)
                if len(many) and len(bi) >= k:
                    least = -np.partition(-np.where(hit[many], score[many], -np.inf), k - 1, axis=1)[:, k - 1]
                    hit[many] &= score[many] >= least[:, None] - _SLACK
                at, to = np.nonzero(hit)
                yield pa.RecordBatch.from_arrays([pa.array(qi[at]), pa.array(bi[to]), pa.array(score[at, to])], ["qid", "id", "score"])

    both = pairs.join(asks.select("a", F.col("ids").alias("qi"), F.col("limits").alias("ql"), F.col("flat").alias("qv")), "a")
    both = both.join(blocks.select("b", F.col("ids").alias("bi"), F.col("flat").alias("bv")), "b")
    return both.select("qi", "ql", "qv", "bi", "bv").mapInArrow(meet, "qid long, id long, score double")


@query("op10_nearest_neighbours")
def op10_nearest_neighbours(spark, sf):
    return nearest(table(spark, sf, "embeddings"))
