"""Mixing sources to target weights: exact block quotas, split over output shards by a tree.

Built-in functions only. Only (id, source, size) and a hash of every document
are moved; all further work is on one row per block or per source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordered import running
from .common import SPACE, cut, query, table

#: Fixed values of the contract.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST_TIMES = 1.5, 2.0


def words_in(text: Column) -> Column:
    """How many runs of non-space characters a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most_times: float = MOST_TIMES) -> DataFrame:
    """source, source_size, n, target from source, source_size, n: words each source should give.

    Weights repeat along the sources in code-point order, null last. A target
    above ``most_times`` its source's size stops there, and what is left over is
    shared again by weight among the others.
    """
    # Numbered by range: a bucket is the first bytes of the name, so no task holds all sources.
    head = F.when(F.col("source").isNull(), F.lit("\U0010ffff\U0010ffff")).otherwise(F.substring("source", 1, 4))
    named = sizes.withColumns({"_head": head, "_one": F.lit(1).cast("long"), "_all": F.lit(0)})
    ranked = running(named, ["_all"], [F.asc_nulls_last("source")], ["_one"], bucket="_head")
    place = (F.col("upto__one") - 1) % len(weights)
    ranked = cut(ranked.select("source", "source_size", "n", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).alias("_w")))
    total, weight = ranked.agg(F.sum("source_size"), F.sum("_w")).first()
    wanted = share * (total or 0)
    level, before, most = wanted / weight if weight else 0.0, -1, most_times * F.col("source_size")
    while True:
        full = F.col("_w") * F.lit(level) >= most
        n, held, free = ranked.agg(F.count_if(full), F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("_w")))).first()
        if n == before or not free:
            break
        # The level never falls, so a source that is full stays full.
        before, level = n, (wanted - (held or 0.0)) / free
    return ranked.select("source", "source_size", "n", F.least(F.col("_w") * F.lit(level), most).cast("double").alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most_times: float = MOST_TIMES, block_docs: int = 128, shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, copies, taken, shards.

    A source is cut into blocks of about ``block_docs`` documents by a hash.
    Every block is drawn as often as the target holds the whole source; for the
    rest, blocks are drawn in permuted order while they fit; the block at the
    edge gives the documents that fill the rest best, and what these leave is
    filled from the blocks after it. ``copies`` says how
    often a document is drawn, ``taken`` its words times that, ``shards`` where
    each draw goes. The same rows give the same mix.

    A null text has size 0; null sources are one source, the last. Repeated
    rows count one by one. Other columns are ignored, whatever their names.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("_h"))
    # Repeated rows become units of their own, so that none weighs a block down.
    same = slim.groupBy("_id", "source", "size", "_h").agg(F.count("*").alias("_m"))
    units = same.select("_id", "source", "size", "_h", F.explode(F.sequence(F.lit(1), F.col("_m").cast("int"))).alias("_k"))
    units = cut(units.withColumn("_u", F.xxhash64("_id", "_h", "_k", F.lit(seed))))
    sizes = cut(units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    targets = source_targets(sizes, weights, share, most_times)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0)
    plan = cut(targets.select("*", whole.cast("int").alias("_whole"), F.ceil(F.col("n") / block_docs).alias("_blocks")).withColumn("_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("_whole") * F.col("source_size"))))

    same_source = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    placed = cut(units.alias("u").join(plan.alias("p"), same_source("u", "p")).select("u.*", F.pmod("_u", "_blocks").alias("_block")))
    blocks = placed.groupBy("source", "_block").agg(F.sum("size").alias("_words"))
    blocks = blocks.withColumn("_order", F.xxhash64("source", "_block", F.lit(seed + 1))).withColumn("_range", F.shiftright("_order", 52))
    upto = running(blocks, ["source"], [F.col("_order"), F.col("_block")], ["_words"], bucket="_range")
    drawn = upto.alias("b").join(plan.alias("p"), same_source("b", "p")).select(
        "b.source", "_block", "_whole", "source_size", "target",
        (F.col("upto__words") <= F.col("_rest")).alias("_in"),
        F.when((F.col("upto__words") > F.col("_rest")) & (F.col("upto__words") - F.col("_words") < F.col("_rest")), F.col("_rest") - F.col("upto__words") + F.col("_words")).alias("_left"),
    )
    drawn = cut(drawn)
    chosen = _fill(placed, drawn, seed)
    # A block of which some documents are drawn once more takes part in the deal like a whole one.
    some = chosen.select("source", "_block", F.lit(True).alias("_some")).distinct()
    dealt = deal_blocks(drawn.alias("b").join(some.alias("c"), same_source("b", "c") & (F.col("b._block") == F.col("c._block")), "left").select("b.*", "_some"), shards, seed)

    blocks_of = drawn.alias("b").join(dealt.alias("s"), same_source("b", "s") & (F.col("b._block") == F.col("s._block")), "left").select("b.*", "s._shards")
    one = placed.alias("u").join(blocks_of.alias("b"), same_source("u", "b") & (F.col("u._block") == F.col("b._block"))).select("u.*", "b._whole", "b.source_size", "b.target", "b._in", "b._shards")
    one = one.alias("u").join(chosen.alias("e"), same_source("u", "e") & (F.col("u._u") == F.col("e._u")) & (F.col("u._k") == F.col("e._k")) & (F.col("u._h") == F.col("e._h")) & F.col("u._id").eqNullSafe(F.col("e._id")), "left")
    copies = F.col("_whole") + (F.col("_in") | F.coalesce("e._edge", F.lit(False))).cast("int")
    return one.select(
        F.col("u._id").alias(id_col), "u.source", "u.size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("u.size")).cast("long").alias("taken"),
        F.slice(F.coalesce("_shards", F.array().cast("array<int>")), F.lit(1), copies).alias("shards"), F.col("u._h").alias("_h"),
    )


def deal_blocks(drawn: DataFrame, shards: int, seed: int) -> DataFrame:
    """source, _block, _shards: the output shard of every draw of a block.

    A splitting tree: a node's draws go to its two children in exact numbers by
    a random order, so how many of each source go left is a multivariate
    hypergeometric draw. The order is cut into ranges, so no node is one task.
    """
    times = F.col("_whole") + (F.col("_in") | F.coalesce("_some", F.lit(False))).cast("int")
    draws = drawn.where(times > 0).select("source", "_block", F.explode(F.sequence(F.lit(1), times)).alias("_pass"), F.lit(0).alias("_node"))
    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        order = F.xxhash64("source", "_block", "_pass", F.lit(seed + 100 + level))
        tagged = draws.withColumns({"_o": order, "_range": F.shiftright(order, 52), "_one": F.lit(1).cast("long")})
        ranked = running(tagged, ["_node"], [F.col("_o"), F.col("source"), F.col("_block"), F.col("_pass")], ["_one"], bucket="_range")
        # What a child gets is in proportion to the shards below it.
        step = 1 << (math.ceil(math.log2(shards)) - level - 1)
        here = F.least(F.lit(2 * step), F.lit(shards) - F.col("_node"))
        left = F.round(F.col("total__one") * F.least(F.lit(step), here) / here)
        draws = cut(ranked.select("source", "_block", "_pass", (F.col("_node") + F.when(F.col("upto__one") > left, step).otherwise(0)).alias("_node")))
    return draws.groupBy("source", "_block").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pass", "_node"))), lambda x: x["_node"]).alias("_shards"))


_UNIT = ["size", "_u", "_k", "_h", "_id"]


def _fill(placed: DataFrame, drawn: DataFrame, seed: int) -> DataFrame:
    """source, _block, the unit and ``_edge``: units of blocks not drawn that fill what whole blocks leave of each target.

    The block at the edge goes first. Of the others, in permuted order, those
    that fit at all are taken as long as their sum fits, or the largest alone if
    it fills more; so each round leaves less than half, and a long text never
    keeps the place of shorter ones behind it. At last one more unit, the
    smallest, is taken if that comes nearer.
    """
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    of_unit = lambda a, b: same(a, b) & (F.col(f"{a}._id").eqNullSafe(F.col(f"{b}._id"))) & (F.col(f"{a}._u") == F.col(f"{b}._u")) & (F.col(f"{a}._k") == F.col(f"{b}._k")) & (F.col(f"{a}._h") == F.col(f"{b}._h"))
    edge = drawn.where("_left IS NOT NULL").select("source", "_block", "_left")
    chosen = cut(_edge_documents(placed, edge))
    held = chosen.groupBy("source").agg(F.sum("size").alias("_held"))
    left = cut(edge.alias("e").join(held.alias("h"), same("e", "h"), "left").select("e.source", (F.col("_left") - F.coalesce("_held", F.lit(0))).alias("_left")).where("_left > 0"))
    # Sources whose target is met take no further part.
    undrawn = drawn.where("NOT _in").alias("b").join(left.alias("l"), same("b", "l")).select("b.source", "_block", "l._left")
    free = placed.where("size > 0").alias("u").join(undrawn.alias("b"), same("u", "b") & (F.col("u._block") == F.col("b._block"))).select("u.source", "u._block", *[f"u.{c}" for c in _UNIT], "_left")
    free = cut(free.alias("f").join(chosen.alias("c"), of_unit("f", "c"), "left_anti"))
    least = free.groupBy("source").agg(F.min(F.struct(*_UNIT, "_block")).alias("_least"))
    rounds, fits = [chosen], free
    while True:
        fits = cut(fits.where("size <= _left"))
        if fits.isEmpty():
            break
        order = F.xxhash64("source", "_block", F.lit(seed + 1))
        ranged = fits.withColumns({"_order": order, "_range": F.shiftright(order, 52)})
        upto = running(ranged, ["source"], [F.col(c) for c in ("_order", "_block", *_UNIT)], ["size"], bucket="_range")
        sums = upto.groupBy("source").agg(F.max(F.when(F.col("upto_size") <= F.col("_left"), F.col("upto_size"))).alias("_sum"), F.max(F.struct(*_UNIT)).alias("_big"))
        alone = F.col("_big.size") > F.col("_sum")
        take = F.when(alone, F.struct(*[f"u.{c}" for c in _UNIT]).eqNullSafe(F.col("_big"))).otherwise(F.col("upto_size") <= F.col("_left"))
        marked = cut(upto.alias("u").join(sums.alias("s"), same("u", "s")).select("u.source", "_block", *[f"u.{c}" for c in _UNIT], (F.col("_left") - F.greatest("_sum", "_big.size")).alias("_left"), take.alias("_take")))
        rounds.append(marked.where("_take").select("source", "_block", *_UNIT))
        fits = marked.where("NOT _take").drop("_take")
    taken = rounds[0]
    for part in rounds[1:]:
        taken = taken.unionByName(part)
    if len(rounds) > 1:
        more = taken.groupBy("source").agg(F.sum("size").alias("_held"))
        left = edge.alias("e").join(more.alias("h"), same("e", "h"), "left").select("e.source", (F.col("_left") - F.coalesce("_held", F.lit(0))).alias("_left"))
        rest = free.alias("f").join(taken.alias("c"), of_unit("f", "c"), "left_anti")
        least = rest.groupBy("source").agg(F.min(F.struct(*_UNIT, "_block")).alias("_least"))
    last = least.alias("m").join(left.alias("l"), same("m", "l")).where("_left > 0 AND _least.size < 2 * _left").select("m.source", "_least.*")
    return cut(taken.unionByName(last).withColumn("_edge", F.lit(True)))


def _edge_documents(placed: DataFrame, edge: DataFrame) -> DataFrame:
    """The units of each source's block at the edge that fill what is left: the largest that still fit, in turn.

    At most one block per source, and a block is bounded, so its units fit one row.
    """
    here = F.col("u.source").eqNullSafe(F.col("b.source")) & (F.col("u._block") == F.col("b._block"))
    unit = F.struct((-F.col("u.size")).alias("s"), "u._u", "u._id", "u._h", "u._k")
    lists = placed.alias("u").join(edge.alias("b"), here).groupBy("b.source", "b._block").agg(F.array_sort(F.collect_list(unit)).alias("_all"), F.first("_left").alias("_left"))
    start = F.struct(F.col("_left").alias("left"), F.array().cast("array<boolean>").alias("fits"))
    fill = lambda acc, x: F.struct(
        (acc["left"] - F.when(-x["s"] <= acc["left"], -x["s"]).otherwise(0)).alias("left"),
        F.concat(acc["fits"], F.array(-x["s"] <= acc["left"])).alias("fits"),
    )
    filled = lists.select("source", "_block", "_all", F.aggregate("_all", start, fill).alias("_f"))
    fit = F.transform(F.filter(F.arrays_zip(F.col("_all").alias("x"), F.col("_f.fits").alias("fits")), lambda z: z["fits"]), lambda z: z["x"])
    return filled.select("source", "_block", F.explode(fit).alias("x")).select("source", "_block", (-F.col("x.s")).alias("size"), "x._u", "x._k", "x._h", "x._id")


def mixed_documents(docs: DataFrame, shards: int = 16, seed: int = 7, part_words: int = 8_000_000, **options) -> DataFrame:
    """The drawn rows of ``docs``, one per draw, dealt to their shards and shuffled inside each.

    A shard is as many partitions as its words ask for, about ``part_words``
    each, by the leading digits of the hash that shuffles it. Repeated rows, of
    one id and text, share their draws.
    """
    found = mix(docs, shards=shards, seed=seed, **options).where("copies > 0")
    draws = found.groupBy(F.col("doc_id").alias("_id"), "_h").agg(F.flatten(F.collect_list("shards")).alias("_shards"), F.count("*").alias("_rows"), F.sum("taken").alias("_words"))
    draws = cut(draws)
    parts = max(1, math.ceil((draws.agg(F.sum("_words")).first()[0] or 0) / (shards * part_words)))
    # Whole rows in one column, so that none of their names can clash.
    text = docs.select(F.struct(*docs.columns).alias("_all"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h"))
    joined = text.alias("d").join(draws.alias("m"), F.col("d._id").eqNullSafe(F.col("m._id")) & (F.col("d._h") == F.col("m._h")))
    once = joined.select("d.*", "m._shards", "m._rows")
    # Of repeated rows one stands for all draws; other rows need no numbering.
    if not draws.where("_rows > 1").limit(1).isEmpty():
        place = F.row_number().over(W.partitionBy("_id", "_h").orderBy(F.lit(0)))
        many = once.where("_rows > 1").withColumn("_p", place).where("_p = 1").drop("_p")
        once = once.where("_rows = 1").unionByName(many)
    order = F.xxhash64("_id", "_h", F.lit(seed))
    rows = once.withColumns({"_shard": F.explode("_shards"), "_order": order})
    part = F.col("_shard") * parts + F.floor(F.shiftrightunsigned("_order", 32) * parts / F.lit(1 << 32)).cast("int")
    return rows.repartitionById(shards * parts, part).sortWithinPartitions("_order").select("_all.*")


@query("op6_mixing")
def op6_mixing(spark, sf):
    return mix(table(spark, sf, "documents")).drop("_h", "source")
