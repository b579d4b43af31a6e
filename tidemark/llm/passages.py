"""Passages of many words that stand in several documents, by minimisers and counted runs.

Suffixes are kept only where a minimiser chooses them, so the same passage keeps
the same suffixes wherever it stands. Around those whose first words are found
in another document, every run of as many words as a passage must have is
counted by its hash; runs found in two documents are put together to passages.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fits_broadcast, join_narrow, query, table
from .jaccard import WordHashes, _mix, words_of

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Words of a minimiser's own run.
_GRAM = 8


def _hashes(text: str | None, known: WordHashes) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _runs(h: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of ``length`` words, by differences of one running sum."""
    n = len(h) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    powers = np.ones(len(h), np.uint64)
    powers[1:] = _BASE
    powers = np.multiply.accumulate(powers)
    undo = np.ones(len(h), np.uint64)
    undo[1:] = _UNDO
    undo = np.multiply.accumulate(undo)
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(h * powers, dtype=np.uint64)]
    return _mix((total[length:] - total[:n]) * undo[:n])


def chosen_places(h: np.ndarray, words: int) -> np.ndarray:
    """Places of the suffixes kept: of each half of ``words`` runs, the one with the least hash.

    A passage of ``words`` words holds one whose next ``words // 2`` words are
    still in it, at the same place of the passage wherever that stands.
    """
    window = words - words // 2 + 1
    if len(h) < words:
        return np.empty(0, np.int64)
    grams = _runs(h, _GRAM)
    view = np.lib.stride_tricks.sliding_window_view(grams, min(window, len(grams)))
    at = np.unique(view.argmin(1) + np.arange(len(view)))
    return at[at + words // 2 <= len(h)]


def repeated_passages(docs: DataFrame, words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage: id, start_word, end_word, n_words, partner_id.

    A passage is a run of at least ``words`` words of a document that also
    stands in a document of another id, named in ``partner_id``; passages that
    overlap or touch are one row. Words lie between ASCII white space, with A-Z
    in lower case. Documents without such a passage have no row.

    Documents with the same words are found first and go through as one; each
    is one passage from end to end. A null text is empty. Rows without an id
    take no part; rows that repeat an id are one document with several texts.
    Repeats inside one document alone are not reported. Other columns are
    ignored. Runs of ``words`` words are compared by hashes of 64 bits; of all
    that share words of a passage, ``partner_id`` is the smallest id, or, for a
    run first found in this document, the largest.
    """
    sets = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = sets.schema["_id"].dataType.simpleString()
    digests = cut(sets.mapInArrow(_digest, f"_id {kind}, _n long, _d1 long, _d2 long").where(F.col("_n") >= words))
    classes = digests.groupBy("_d1", "_d2").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"))
    classes = cut(classes)
    heads = cut(classes.select(F.col("_first").alias("_id")).distinct())
    # Texts without a partner in their first words are left alone from here on.
    kept = cut(join_narrow(sets.mapInArrow(_suffixes(words), f"_id {kind}, _keys array<long>"), heads, ["_id"], "left_semi"))
    suffixes = kept.select("_id", F.explode("_keys").alias("_key"))
    shared = suffixes.groupBy("_key").agg(F.min("_id").alias("_x"), F.max("_id").alias("_y")).where("_x <> _y").select("_key")
    live = suffixes.join(cut(shared).hint("shuffle_hash"), "_key").groupBy("_id").agg(F.collect_set("_key").alias("_keys"))
    live = cut(live)
    spans = _matches(sets, live, words, kind)
    whole = digests.join(classes.where("_first <> _last"), ["_d1", "_d2"]).select(
        "_id", F.lit(0).cast("long").alias("s"), F.col("_n").alias("e"), F.when(F.col("_id") == F.col("_first"), F.col("_last")).otherwise(F.col("_first")).alias("p")
    )
    each = spans.unionByName(whole).groupBy("_id").agg(F.collect_list(F.struct("s", "e", "p")).alias("_spans"))
    merged = each.mapInArrow(_merge_spans, f"_id {kind}, s long, e long, p {kind}")
    return merged.select(F.col("_id").alias(id_col), F.col("s").alias("start_word"), F.col("e").alias("end_word"), (F.col("e") - F.col("s")).alias("n_words"), F.col("p").alias("partner_id"))


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        n, d1, d2 = [], [], []
        for text in batch.column(1).to_pylist():
            h = _hashes(text, known)
            place = np.arange(1, len(h) + 1, dtype=np.uint64)
            n.append(len(h))
            d1.append(_mix(h + place * _BASE).sum(dtype=np.uint64))
            d2.append(_mix((h ^ _UNDO) + place * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *[pa.array(np.array(d, np.uint64).view(np.int64)) for d in (d1, d2)]], ["_id", "_n", "_d1", "_d2"])


def _suffixes(words: int):
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            keys = []
            for text in batch.column(1).to_pylist():
                h = _hashes(text, known)
                keys.append(np.unique(_runs(h, words // 2)[chosen_places(h, words)]))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], ["_id", "_keys"])

    return find


def _matches(sets: DataFrame, live: DataFrame, words: int, kind: str) -> DataFrame:
    """_id, s, e, p: every run of ``words`` words that stands in texts of two ids.

    Each such run holds a shared head, so only runs that hold one are counted.
    Of a run the smallest and the largest id are kept, which partial sums bring
    down before the shuffle however often it stands.
    """
    half = words // 2
    ids = cut(live.select("_id").distinct())
    texts = sets.join(F.broadcast(ids), "_id", "left_semi") if fits_broadcast(ids) else sets.join(ids, "_id", "left_semi")

    def stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                rows, at, found = [], [], []
                for row, (text, keys) in enumerate(zip(part.column(1).to_pylist(), part.column(2))):
                    h = _hashes(text, known)
                    places = chosen_places(h, words)
                    places = places[np.isin(_runs(h, half)[places], np.asarray(keys.values).view(np.uint64))]
                    if not len(places):
                        continue
                    runs = _runs(h, words)
                    starts = np.arange(len(runs))
                    # The next shared head from here on must end within the run.
                    head = np.r_[places, len(h)][np.searchsorted(places, starts)]
                    starts = starts[head + half <= starts + words]
                    for piece in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                        rows.append(row)
                        at.append(piece[0])
                        found.append(runs[piece])
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                flat = np.concatenate(found) if found else np.empty(0, np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(at, pa.int64()), lists], ["_id", "_at", "_runs"])

    # One row per stretch of runs that follow each other.
    held = cut(texts.join(live, "_id").select("_id", "_text", "_keys").mapInArrow(stretches, f"_id {kind}, _at long, _runs array<long>"))
    runs = held.select("_id", "_at", F.posexplode("_runs").alias("_k", "_run"))
    several = runs.groupBy("_run").agg(F.min("_id").alias("_x"), F.max("_id").alias("_y")).where("_x <> _y")
    met = runs.join(cut(several).hint("shuffle_hash"), "_run")
    start = F.col("_at") + F.col("_k")
    return met.select("_id", start.alias("s"), (start + words).alias("e"), F.when(F.col("_id") == F.col("_x"), F.col("_y")).otherwise(F.col("_x")).alias("p"))


def _merge_spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, kind = batch.column(1), batch.schema.field(1).type.value_type.field("p").type
        if not len(spans):
            continue
        row = np.repeat(np.arange(len(spans)), np.asarray(spans.value_lengths()))
        s, e, p = (spans.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
        # All rows on one line, each beyond the ends of those before it.
        step = int(e.max()) + 1
        order = np.argsort(s + row * step, kind="stable")
        row, p = row[order], p[order]
        start, end = s[order] + row * step, np.maximum.accumulate(e[order] + row * step)
        first = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
        row, start, end = row[first], start[first], end[np.r_[first[1:], len(end)] - 1]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(start - row * step), pa.array(end - row * step), pa.array(np.minimum.reduceat(p, first), kind)], ["_id", "s", "e", "p"])


@query("op8_suffix_array_dedup")
def op8_suffix_array_dedup(spark, sf):
    return repeated_passages(table(spark, sf, "documents"))
