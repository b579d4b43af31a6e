"""Packing documents into training sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Merger
from .common import cut, query, table
from .tokens import VOCABULARY
from .workers import in_workers

#: Pieces that one task packs together.
POOL = 8192
_PIECE = "piece int, start long, length int, ids_crc32 long"


def cut_pieces(docs: DataFrame, size: int = 2048, path: str = VOCABULARY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32: each text's ids and ``end_id``, cut where they pass ``size``."""
    tail = end_id.to_bytes(4, "little")

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(path)
        for batch in batches:
            rows: list[tuple] = []
            # Texts become objects one group at a time.
            for row, ids in enumerate(merger.encode(t.as_py() or "" for t in batch.column(1))):
                ids += tail
                n = len(ids) // 4
                # Only the first piece may be shorter.
                ends = range((n - 1) % size + 1, n + 1, size)
                for k, end in enumerate(ends):
                    start = max(0, end - size)
                    rows.append((row, k, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
            at, *values = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.int32(), pa.int64()))]],
                ["_id", "piece", "start", "length", "ids_crc32"],
            )

    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return in_workers(slim, pieces, f"_id {slim.schema['_id'].dataType.simpleString()}, {_PIECE}")


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """Available lengths, as often as they are there at most, whose sum comes nearest to ``room`` from below.

    Bit s of a number says that some choice sums to s. Long lengths first; it
    stops as soon as ``room`` itself is reached.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        if length > room:
            continue
        left, times = min(counts[length], room // length), 1
        # A count is taken as powers of two and a rest, so few steps stand for many pieces.
        while left > 0:
            times = min(times, left)
            before = reach
            reach |= (reach << (length * times)) & mask
            if reach != before:
                steps.append((length, times, before))
            left, times = left - times, times * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, []
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            chosen += [length] * times
            at -= length * times
    return chosen


def pack_lengths(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """The bin and the offset of each length: the longest left opens a bin, the fullest choice of the others fills it."""
    where: dict[int, list[int]] = {}
    for i, length in enumerate(lengths):
        where.setdefault(length, []).append(i)
    counts = {k: len(v) for k, v in where.items()}
    order = sorted(counts, reverse=True)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    number = 0
    while order:
        first = order[0]
        counts[first] -= 1
        chosen = [first, *(fullest(counts, order, size - first) if first < size else [])]
        for length in chosen[1:]:
            counts[length] -= 1
        offset = 0
        for length in chosen:
            i = where[length].pop()
            bins[i], offsets[i] = number, offset
            offset += length
        for length in set(chosen):
            if not counts[length]:
                order.remove(length)
        number += 1
    return bins, offsets


def pack(docs: DataFrame, size: int = 2048, pool: int = POOL, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A piece of full length is a sequence by itself. The others are dealt evenly
    to pools of about ``pool`` pieces, whatever their document; each pool is
    packed by itself, and what its bins that are not full hold is dealt and
    packed once more, until one pool is left or nothing is gained.

    A null text is empty and is the end id alone. Repeated rows are packed one
    by one. Other columns are ignored.
    """
    pieces = cut(cut_pieces(docs, size, path, id_col=id_col, text_col=text_col).withColumn("_row", F.monotonically_increasing_id()))
    whole = pieces.where(F.col("length") == size).select("*", (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, left, level = [whole], pieces.where(F.col("length") < size).select("_row", "length"), 0
    n = left.count()
    while n:
        pools = -(-n // pool)
        last = pools == 1
        packed = cut(_pack_pools(left, pools, size, level))
        done_now = packed if last else packed.where("_full")
        done.append(pieces.join(done_now.select("_row", "sequence_id", "offset"), "_row"))
        if last:
            break
        left = cut(packed.where("NOT _full").select("_row", "length"))
        before, n, level = n, left.count(), level + 1
        # Where little became full, another round would not gain: the bins stay as they are.
        if n > before // 2:
            done[-1] = pieces.join(packed.select("_row", "sequence_id", "offset"), "_row")
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(F.col("_id").alias(id_col), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def _pack_pools(left: DataFrame, pools: int, size: int, level: int) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        # The order of rows in a group may change when a task is repeated.
        pdf = pdf.sort_values(["length", "_row"], ignore_index=True)
        bins, offsets = pack_lengths(pdf["length"].tolist(), size)
        pdf["sequence_id"] = (level << 56) + pdf["_pool"].astype("int64") * (1 << 24) + pd.Series(bins, dtype="int64")
        pdf["offset"] = pd.Series(offsets, dtype="int64")
        pdf["_full"] = pdf.groupby("sequence_id")["length"].transform("sum") == size
        return pdf[["_row", "length", "sequence_id", "offset", "_full"]]

    dealt = left.withColumn("_pool", F.pmod(F.xxhash64("_row", F.lit(level)), F.lit(pools)))
    return dealt.groupBy("_pool").applyInPandas(one, "_row long, length int, sequence_id long, offset long, _full boolean")


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark, sf):
    return pack(table(spark, sf, "documents"))
