"""Prefix trie of conversations from padded matrices of turn ids, one range of sequences at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CRC_TABLE, crc32_sql, cut, join_narrow, query, stored, table
from .mixing import words_in

#: A turn's id: 16 bytes of its SHA-256, then its words as four bytes.
ID_BYTES = 20
#: Columns of one padded matrix; longer sequences go on in a next one, so padding stays below this many ids a row.
WIDTH = 16
#: Turns of one range of sequences.
SHARD_TURNS = 250_000

_NODE = (
    "edge boolean, key binary, parent_key binary, depth int, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, words long, n_ends long, end_key binary"
)
_ROOT = b"\0" * 16


def turn_id(role: Column, text: Column) -> Column:
    """The id of a turn; equal role and text, equal id."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.unhex(F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(words_in(text)), 8, "0")))


def turn_sequences(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns array<binary>: every conversation's turn ids by turn, a missing turn first.

    A null role or text is empty. Turns of one number stand in the order of
    their ids, and a repeated row is a turn of its own. Rows without a
    conversation id belong to none and are left out. Texts are not moved: a
    conversation is held as 20 bytes a turn.
    """
    slim = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("t"), turn_id(F.col(role_col), F.col(text_col)).alias("i")).alias("_s")
    )
    ordered = slim.groupBy("conv_id").agg(F.sort_array(F.collect_list("_s")).alias("_s"))
    return ordered.select("conv_id", F.col("_s.i").alias("turns"))


def branched(sequences: DataFrame, base: Column, heads: Column, most: int) -> DataFrame:
    """Sequences whose first turns are those of another conversation.

    ``base`` names the conversation that lends its first turns, ``heads`` how
    many (at most ``most``); as many of the own turns are left out.
    """
    held = cut(sequences)
    # Ids are unique on the lending side, so a borrower meets one row.
    lent = held.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_lent"))
    asked = held.withColumns({"_base": base, "_h": heads})
    first = F.slice(F.coalesce("_lent", F.expr("cast(array() AS array<binary>)")), F.lit(1), F.col("_h"))
    own = F.slice("turns", F.col("_h") + 1, F.size("turns"))
    return asked.join(lent, "_base", "left").select("conv_id", F.concat(first, own).alias("turns"))


def paths(sequences: DataFrame) -> DataFrame:
    """conv_id, seq binary, end_key binary: the turn ids in one string of bytes, and its digest."""
    seq = F.unhex(F.array_join(F.transform("turns", F.hex), ""))
    return sequences.select("conv_id", seq.alias("seq")).withColumn("end_key", F.unhex(F.md5("seq")))


def prefix_trie(walks: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the trie over ``walks`` (conv_id, seq, end_key; see ``paths``).

    conv_id (smallest member), depth, parent_conv_id (null at the root),
    n_convs, n_children, n_leaves, saved_tokens, n_ends, end_key (null where no
    conversation ends). Equal sequences are counted first, so a conversation
    that a third of all share is one row. The others are cut into ranges of
    their order; a range is one matrix sorted by itself. A node that also holds
    rows of another range is a prefix of its range's first or last sequence:
    only those are added up across ranges, a few per range. An empty table
    has no node.
    """
    counted = walks.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("end_key").alias("end_key"))
    distinct = stored(counted)
    if shards is None:
        held = distinct.agg(F.sum(F.octet_length("seq"))).first()[0] or 0
        shards = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // (ID_BYTES * SHARD_TURNS)))
    parts = stored(distinct.repartitionByRange(shards, "seq").select("seq", "n", "conv_id", "end_key").mapInArrow(_shard, _NODE))
    edges = stored(_combined(parts.where("edge")))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends", "end_key"]
    above = edges.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_above"))
    inner = parts.where("NOT edge")
    named = join_narrow(inner.where("parent_key IS NOT NULL").drop("parent_conv_id"), above, ["parent_key"], "inner").withColumnRenamed("_above", "parent_conv_id")
    return inner.where("parent_key IS NULL").select(names).unionByName(named.select(names)).unionByName(edges.select(names))


def _combined(edges: DataFrame) -> DataFrame:
    """The nodes that several ranges hold: sums by key, then leaves and savings passed up from the deepest.

    One row per depth of a range's first and last sequence is left here, so one
    task sees a few rows per range, never conversations.
    """
    summed = edges.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends")], F.max("end_key").alias("end_key"),
    )
    names = ["key", "parent_key", "depth", "words", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends", "end_key"]

    def passed_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = {r["key"]: r for batch in batches for r in batch.to_pylist()}
        for r in nodes.values():
            if r["depth"]:
                nodes[r["parent_key"]]["n_children"] += 1
                r["parent_conv_id"] = nodes[r["parent_key"]]["conv_id"]
        # The sums of a node hold all inner nodes below it already; only what the edges add is passed up.
        added = {k: [int(not r["n_children"]), (r["n_convs"] - 1) * r["words"]] for k, r in nodes.items()}
        for key, r in sorted(nodes.items(), key=lambda item: -item[1]["depth"]):
            leaves, saved = added[key]
            r["n_leaves"] += leaves
            r["saved_tokens"] += saved
            if r["depth"]:
                above = added[r["parent_key"]]
                above[0] += leaves
                above[1] += saved
        if nodes:
            yield _batch([{**r, "edge": True} for r in nodes.values()])

    return summed.select(names).repartition(1).mapInArrow(passed_up, _NODE)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"boolean": pa.bool_(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}
    fields = [pair.split() for pair in _NODE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields], [n for n, _ in fields])


def _chain(seq: bytes) -> list[bytes]:
    """The key of every prefix of a sequence, the empty one first."""
    keys = [_ROOT]
    for at in range(0, len(seq), ID_BYTES):
        keys.append(hashlib.blake2b(keys[-1] + seq[at : at + ID_BYTES], digest_size=16).digest())
    return keys


def sort_sequences(codes: np.ndarray, lengths: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Order of ragged rows of positive codes, and how many leading codes each shares with the row before it.

    Codes lie in matrices of ``width`` columns padded with zero. Rows that are
    equal in one matrix and go on are told apart in the next.
    """
    starts = np.cumsum(lengths) - lengths
    group, shared = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rows, base = np.arange(len(lengths)), 0
    while len(rows):
        columns = np.arange(base, base + width)
        inside = columns < lengths[rows, None]
        matrix = np.zeros((len(rows), width), np.int64)
        matrix[inside] = codes[(starts[rows, None] + columns)[inside]]
        # The shorter of two rows with equal columns comes first; rows of one group stay together.
        local = np.lexsort((lengths[rows], *matrix.T[::-1], group[rows]))
        rows, matrix = rows[local], matrix[local]
        new_group = np.append(True, group[rows][1:] != group[rows][:-1])
        changed = np.ones((len(rows), width + 1), bool)
        changed[:, 0] = new_group
        changed[1:, 1:] = matrix[1:] != matrix[:-1]
        changed = np.logical_or.accumulate(changed, axis=1)
        common = np.where(new_group, 0, np.minimum(width - changed[:, 1:].sum(axis=1), np.maximum(lengths[rows] - base, 0)))
        shared[rows[~new_group]] = base + common[~new_group]
        # Rows that end here are in place; their places in the whole order follow from the group's first place.
        first = np.maximum.accumulate(np.where(new_group, np.arange(len(rows)), 0))
        place = group[rows] + np.arange(len(rows)) - first
        split = changed[:, -1].copy()
        split[1:] |= lengths[rows[:-1]] <= base + width
        group[rows] = place[np.maximum.accumulate(np.where(split, np.arange(len(rows)), 0))]
        base += width
        # Only rows that are tied with another one need a further matrix.
        tied = np.zeros(len(rows), bool)
        same = (group[rows][1:] == group[rows][:-1]) & (lengths[rows[:-1]] > base)
        tied[1:] |= same
        tied[:-1] |= same
        rows = rows[tied]
    order = np.argsort(group, kind="stable")
    return order, shared[order]


def _shard(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All nodes of one range of distinct sequences; those on its first or last sequence are marked as edges."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    whole = pa.Table.from_batches(tables)
    seqs = whole.column("seq").to_pylist()
    n, conv = (whole.column(c).to_numpy().astype(np.int64) for c in ("n", "conv_id"))
    ends = whole.column("end_key").to_pylist()
    raw = np.frombuffer(b"".join(seqs), np.uint8).reshape(-1, ID_BYTES)
    lengths = np.array([len(s) // ID_BYTES for s in seqs], np.int64)
    high, low = (np.ascontiguousarray(raw[:, a : a + 8]).view(">u8").ravel() for a in (0, 8))
    words = np.ascontiguousarray(raw[:, 16:]).view(">u4").ravel().astype(np.int64)
    by = np.lexsort((low, high))
    new = np.append(True, (high[by][1:] != high[by][:-1]) | (low[by][1:] != low[by][:-1]))[: len(by)]
    codes = np.empty(len(by), np.int64)
    codes[by] = np.cumsum(new)
    order, shared = sort_sequences(codes, lengths)
    starts = (np.cumsum(lengths) - lengths)[order]
    lengths, n, conv = lengths[order], n[order], conv[order]
    last = len(order) - 1
    first_keys, last_keys = _chain(seqs[order[0]]), _chain(seqs[order[last]])
    # A sequence is a leaf unless the next one goes on from it. Those at the edges are settled later.
    leaf = np.append(shared[1:] < lengths[:-1], True)
    leaf[[0, last]] = False
    shared[0] = -1
    gain = np.zeros(len(order), np.int64)
    below = np.zeros(0, np.int64)  # first rows of the nodes one level deeper
    deepest = int(lengths.max())
    for depth in range(deepest, -1, -1):
        bounds = np.flatnonzero(shared < depth)
        counts, smallest, leaves = (f.reduceat(v, bounds) for f, v in ((np.add, n), (np.minimum, conv), (np.add, leaf.astype(np.int64))))
        is_node = lengths[bounds] >= depth
        stop = np.append(bounds[1:], last + 1)
        edge = is_node & ((bounds == 0) | (stop == last + 1))
        weight = np.zeros(len(bounds), np.int64)
        if depth:
            weight[is_node] = words[starts[bounds[is_node]] + depth - 1]
        own = np.where(edge, 0, (counts - 1) * weight)
        gain[bounds] += own
        saved = np.add.reduceat(gain, bounds)
        children = np.bincount(np.searchsorted(bounds, below, "right") - 1, minlength=len(bounds))
        keep = np.flatnonzero(is_node)
        at, on_edge = bounds[keep], edge[keep]
        if depth:
            up = np.flatnonzero(shared < depth - 1)
            over = np.searchsorted(up, at, "right") - 1
            up_stop = np.append(up[1:], last + 1)[over]
            up_edge = (up[over] == 0) | (up_stop == last + 1)
            parent = np.minimum.reduceat(conv, up)[over]
            # A parent on the edge is named by its key until all ranges are added up.
            parent_keys = [(first_keys if a == 0 else last_keys)[depth - 1] if e else None for a, e in zip(up[over].tolist(), up_edge.tolist())]
            parents = pa.array(np.where(up_edge, 0, parent), mask=up_edge)
        else:
            parent_keys, parents = [None] * len(keep), pa.nulls(len(keep), pa.int64())
        stops_here = lengths[at] == depth
        columns = [
            pa.array(on_edge),
            pa.array([(first_keys if a == 0 else last_keys)[depth] if e else None for a, e in zip(at.tolist(), on_edge.tolist())], pa.binary()),
            pa.array(parent_keys, pa.binary()), pa.array(np.full(len(keep), depth, np.int32)), pa.array(smallest[keep]), parents,
            *[pa.array(v[keep].astype(np.int64)) for v in (counts, children, leaves, saved, weight)],
            pa.array(np.where(stops_here, n[at], 0)), pa.array([ends[order[a]] if s else None for a, s in zip(at.tolist(), stops_here.tolist())], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, [pair.split()[0] for pair in _NODE.split(", ")])
        # Children on the edge are counted when the ranges are added up.
        below = at[~on_edge]


def ending_digests(walks: DataFrame, chunk_bits: int = 8) -> DataFrame:
    """end_key, ends_sha256: the digest of the comma-joined ids that end at one node, in order.

    Ids are put together by ranges first. The parts of a node are sorted by
    Spark and hashed as they stream by, so memory follows neither the node nor
    the partition.
    """
    chunks = walks.groupBy("end_key", F.shiftright("conv_id", chunk_bits).alias("_c")).agg(F.sort_array(F.collect_list("conv_id")).alias("_ids"))
    placed = chunks.repartition("end_key").sortWithinPartitions("end_key", "_c").select("end_key", F.array_join(F.col("_ids").cast("array<string>"), ",").alias("_ids"))

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for k, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if k == key:
                    state.update(b"," + ids.encode())
                else:
                    if state:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
            if done:
                yield _digest_rows(done)
        if state:
            yield _digest_rows([(key, state.hexdigest())])

    return placed.mapInArrow(digests, "end_key binary, ends_sha256 string")


def _digest_rows(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    keys, digests = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests)], ["end_key", "ends_sha256"])


@query(
    "op11_prefix_trie",
    """
    WITH """
    + CRC_TABLE
    + """,
    own AS (
      SELECT conv_id, list(struct_pack(
               id := sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')),
               w := len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) ORDER BY turn NULLS FIRST) AS s
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    drawn AS (
      SELECT conv_id, s, conv_id - conv_id % 20 AS base,
             ("""
    + crc32_sql("conv_id::VARCHAR")
    + """ % 4)::INT AS h
      FROM own, tab),
    walks AS (
      SELECT d.conv_id, list_concat(CASE WHEN b.s IS NULL THEN [] ELSE b.s[1:h] END, d.s[h + 1:]) AS s
      FROM drawn d LEFT JOIN own b ON b.conv_id = d.base),
    steps AS (SELECT conv_id, s[1:d] AS k, d, d = len(s) AS ends, s[d].w AS w FROM walks, unnest(range(0, len(s) + 1)) u(d)),
    nodes AS (
      SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(max(w), 0) AS w,
             coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS e
      FROM steps GROUP BY k, d),
    kids AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
    full_nodes AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN kids c ON c.k = n.k),
    sums AS (
      SELECT k[1:j] AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * w) AS saved
      FROM full_nodes, unnest(range(0, d + 1)) u(j) GROUP BY 1)
    SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
           s.saved::BIGINT AS saved_tokens, sha256(n.e) AS ends_sha256
    FROM full_nodes n JOIN sums s ON s.k = n.k LEFT JOIN nodes p ON n.d > 0 AND p.k = n.k[1:n.d - 1]
    """,
)
def op11_prefix_trie(spark, sf):
    conv = F.col("conv_id")
    heads = (F.crc32(conv.cast("string").cast("binary")) % 4).cast("int")
    sequences = branched(turn_sequences(table(spark, sf, "conversations")), conv - conv % 20, heads, 3)
    walks = stored(paths(sequences))
    nodes = stored(prefix_trie(walks).withColumn("depth", F.col("depth").cast("long")))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    ended = nodes.where("end_key IS NOT NULL").join(ending_digests(walks), "end_key").select(names)
    return nodes.where("end_key IS NULL").withColumn("ends_sha256", F.sha2(F.lit(b""), 256)).select(names).unionByName(ended)
