"""Periodic runs of words, found on a Re-Pair grammar of each text.

A text is a list of word numbers. Frequent neighbours are replaced by one symbol
over and over, so a passage that repeats becomes one symbol that occurs often.
What runs across the middle of a symbol's expansion is computed once, at one of
its places, and copied to all others. A binary tree over the symbols that are
left joins them, so every run lies whole in the expansion of some symbol and
crosses its middle; parts of a run found in smaller symbols are merged into it.

Many texts are worked through as one array; each has word numbers of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CRC_TABLE, SPACE, crc32_sql, query, table

#: Words of texts that are worked through together, and candidate places at once.
GROUP_WORDS, GROUP_PLACES = 200_000, 1_000_000


def _names(codes: np.ndarray, step: int) -> np.ndarray:
    """A number for each pair of codes ``step`` apart, equal for equal pairs, -1 where the second is past the end."""
    out = np.full(len(codes), -1, np.int64)
    if len(codes) > step:
        key = codes[:-step] * np.int64(int(codes.max()) + 2) + codes[step:]
        # Codes of -1 name nothing, and neither does a pair with one.
        fine = (codes[:-step] >= 0) & (codes[step:] >= 0)
        out[:-step][fine] = np.unique(key[fine], return_inverse=True)[1]
    return out


def doubled_names(words: np.ndarray) -> list[np.ndarray]:
    """Names of all stretches of 1, 2, 4, .. words, as far as some stretch occurs twice."""
    levels = [words]
    while True:
        names = _names(levels[-1], 1 << (len(levels) - 1))
        known = names[names >= 0]
        if not len(known) or len(known) == known.max() + 1:
            return levels
        levels.append(names)


def _right(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Where the equal words from i and j (i < j) on end, as places of i; j stays below ``stop``."""
    i, gap = i.copy(), j - i
    for k in range(len(levels) - 1, -1, -1):
        size, names = 1 << k, levels[k]
        # Of the largest size there may be several in a row, of the others one.
        while True:
            fits = i + gap + size <= stop
            at = np.where(fits, i, 0)
            same = fits & (names[at] == names[np.where(fits, i + gap, 0)]) & (names[at] >= 0)
            i[same] += size
            if k < len(levels) - 1 or not same.any():
                break
    return i


def _left(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The first place of the equal words that end before i and j; i stays at ``start`` or above."""
    i, gap = i.copy(), j - i
    for k in range(len(levels) - 1, -1, -1):
        size, names = 1 << k, levels[k]
        while True:
            fits = i - size >= start
            at = np.where(fits, i - size, 0)
            same = fits & (names[at] == names[np.where(fits, i - size + gap, 0)]) & (names[at] >= 0)
            i[same] -= size
            if k < len(levels) - 1 or not same.any():
                break
    return i


def grammar(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair in rounds over all texts at once.

    Gives rule, place, middle, end of every replaced pair (its rule's number,
    and where its expansion begins, has its middle and ends), and the places
    where the symbols that are left begin. In a round a pair is replaced
    wherever it occurs more often than the pairs that overlap it there, ties by
    a hash; it must occur twice at least. ``text`` numbers the text of a word.
    """
    symbols, places = words.astype(np.int64), np.arange(len(words), dtype=np.int64)
    next_symbol, found, rules = int(words.max()) + 1, [], 0
    while len(symbols) > 1:
        inside = text[places[1:]] == text[places[:-1]]
        key = symbols[:-1] * np.int64(next_symbol) + symbols[1:]
        _, pair, counts = np.unique(np.where(inside, key, -1), return_inverse=True, return_counts=True)
        twins = inside & (symbols[:-1] == symbols[1:])
        rank = np.where(inside, counts[pair], 0)
        if rank.max() < 2:
            break
        mixed = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        # One order of pairs: by count, then by hash, then by number.
        order = np.lexsort((np.arange(len(counts)), _per_pair(mixed, pair, len(counts)), counts))
        weight = np.empty(len(counts), np.int64)
        weight[order] = np.arange(len(counts))
        weight = np.where(rank >= 2, weight[pair] + 1, 0)
        before, after = np.append(0, weight[:-1]), np.append(weight[1:], 0)
        best = (weight > 0) & (weight >= before) & (weight >= after)
        if twins.any():
            # Along equal symbols every other pair is taken.
            run = np.flatnonzero(best)
            first = np.append(True, (np.diff(run) > 1) | (weight[run][1:] != weight[run][:-1]))
            begin = np.maximum.accumulate(np.where(first, np.arange(len(run)), 0))
            best[run[(np.arange(len(run)) - begin) % 2 == 1]] = False
        at = np.flatnonzero(best)
        # A pair of equal symbols that is left once, as in three in a row, is no rule.
        often = np.bincount(pair[at], minlength=len(counts)) >= 2
        at = at[often[pair[at]]]
        if not len(at):
            break
        numbers = np.cumsum(np.bincount(pair[at], minlength=len(counts)) > 0) - 1
        rule = numbers[pair[at]]
        ends = np.append(places[2:], len(words))
        end = np.minimum(ends[at], _text_end(text, places[at]))
        found.append((rule + rules, places[at], places[at + 1], end))
        symbols[at] = rule + next_symbol
        left = np.ones(len(symbols), bool)
        left[at + 1] = False
        symbols, places = symbols[left], places[left]
        new = int(rule.max()) + 1
        rules, next_symbol = rules + new, next_symbol + new
    empty = np.zeros(0, np.int64)
    rule, place, middle, end = (np.concatenate([f[k] for f in found]) if found else empty for k in range(4))
    return rule, place, middle, end, places


def _per_pair(values: np.ndarray, pair: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, values.dtype)
    out[pair] = values
    return out


def _text_end(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.searchsorted(text, text[places], "right")


def _tree(places: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """place, middle, end of the nodes of a balanced binary tree over each text's symbols."""
    out, begins, ends = [], places, np.append(places[1:], len(text))
    ends = np.minimum(ends, _text_end(text, begins))
    while True:
        owner = text[begins]
        first = np.searchsorted(owner, owner, "left")
        even = (np.arange(len(begins)) - first) % 2 == 0
        has_mate = np.append(even[:-1] & (owner[1:] == owner[:-1]), False)
        at = np.flatnonzero(has_mate)
        if not len(at):
            break
        out.append((begins[at], begins[at + 1], ends[at + 1]))
        ends = ends.copy()
        ends[at] = ends[at + 1]
        begins, ends = begins[even], ends[even]
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate([o[k] for o in out]) if out else empty for k in range(3))


def _crossing(levels, trigrams, place, middle, end, shortest) -> tuple[np.ndarray, ...]:
    """node, start, stop, period: runs within [place, end) that hold the words on both sides of ``middle``.

    Of a run, the words equal to those one period later form a stretch of six
    or more, and it or its shift holds the word before the middle; so it holds
    the three words that end there or the three that begin there. All other
    places of those three words within the node give the periods to try.
    """
    order = np.argsort(trigrams, kind="stable")
    sorted_names = trigrams[order]
    # Name and place in one number, to find a node's places of a name by two searches.
    span = np.int64(len(trigrams) + 1)
    keys = sorted_names * span + order
    parts = []
    for begin in (middle - 3, middle - 1):
        node = np.flatnonzero((begin >= place) & (begin + 3 <= end) & (end - place >= shortest))
        node = node[trigrams[begin[node]] >= 0]
        name = trigrams[begin[node]] * span
        low = np.searchsorted(keys, name + place[node], "left")
        high = np.searchsorted(keys, name + end[node] - 3, "right")
        many = high - low
        # In slices, so that memory does not follow the number of places.
        cuts = np.searchsorted(np.cumsum(many), np.arange(GROUP_PLACES, int(many.sum()) + GROUP_PLACES, GROUP_PLACES), "left") + 1
        for some in np.split(np.arange(len(node)), np.unique(np.minimum(cuts, len(node)))):
            if not len(some):
                continue
            count = many[some]
            which = np.repeat(some, count)
            other = order[low[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)]
            mine = begin[node[which]]
            keep = other != mine
            which, other, mine = node[which[keep]], other[keep], mine[keep]
            i, j = np.minimum(mine, other), np.maximum(mine, other)
            right = _right(levels, i, j, end[which])
            left = _left(levels, i, j, place[which])
            period = j - i
            stop = right + period
            good = (stop - left >= np.maximum(shortest, 2 * period)) & (left < middle[which]) & (stop > middle[which])
            parts.append(np.stack([which[good], left[good], stop[good], period[good]]))
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.unique(np.concatenate(parts, axis=1), axis=1))


def find_runs(words: np.ndarray, text: np.ndarray, shortest: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, stop, period of all runs in texts laid end to end, by start and period.

    ``words`` are numbers from 0 that no two texts share, ``text`` the number of
    each word's text in rising order. ``shortest`` is 12 or more.
    """
    levels = doubled_names(words)
    pairs = levels[1] if len(levels) > 1 else _names(words, 1)
    # Three words are two overlapping pairs.
    trigrams = _names(pairs, 1)
    rule, place, middle, end, places = grammar(words, text)
    # One place stands for a rule: its first.
    _, first = np.unique(rule, return_index=True)
    node, start, stop, period = _crossing(levels, trigrams, place[first], middle[first], end[first], shortest)
    # To all places of the rule in the derivation.
    by = np.argsort(rule, kind="stable")
    low, high = (np.searchsorted(rule[by], rule[first][node], side) for side in ("left", "right"))
    which = np.repeat(np.arange(len(node)), high - low)
    copies = place[by][np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange(len(which))]
    shift = copies - place[first][node[which]]
    top = _tree(places, text)
    _, *joined = _crossing(levels, trigrams, *top, shortest)
    return merged(*(np.concatenate([a, b]) for a, b in zip((start[which] + shift, stop[which] + shift, period[which]), joined)))


def merged(start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of one period that share a period's words become one run; of equal intervals the smallest period stays."""
    if not len(start):
        return start, stop, period
    by = np.lexsort((-stop, start, period))
    start, stop, period = start[by], stop[by], period[by]
    # Farthest stop so far within a period: periods are told apart by an offset.
    offset = period * np.int64(int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + offset) - offset
    new = np.append(True, (period[1:] != period[:-1]) | (reach[:-1] - start[1:] < period[1:]))
    at = np.flatnonzero(new)
    start, stop, period = start[at], np.maximum.reduceat(stop, at), period[at]
    by = np.lexsort((period, stop, start))
    start, stop, period = start[by], stop[by], period[by]
    new = np.append(True, (start[1:] != start[:-1]) | (stop[1:] != stop[:-1]))
    by = np.lexsort((period[new], start[new]))
    return start[new][by], stop[new][by], period[new][by]


def _may_repeat(words: list[bytes], width: int = 6) -> bool:
    """Whether some ``width`` words in a row occur twice, as they do in every run; by hashes, so it may say yes in vain."""
    if len(words) < 2 * width:
        return False
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        mixed = mixed * np.uint64(0x100000001B3) + h[k : len(words) - width + 1 + k]
    mixed.sort()
    return bool((mixed[1:] == mixed[:-1]).any())


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats after its first period."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, stop, period in runs:
        gone[start + period] += 1
        gone[stop] -= 1
    kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()
    return b" ".join([words[i] for i in kept])


def runs_of_texts(texts: list[list[bytes]], shortest: int = 12) -> list[list[tuple[int, int, int]]]:
    """(start, stop, period) of the runs in each text, given as words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    group, held = [], 0
    for k, words in enumerate(texts):
        if _may_repeat(words):
            group.append(k)
            held += len(words)
        if group and (held >= GROUP_WORDS or k == len(texts) - 1):
            _solve(texts, group, shortest, out)
            group, held = [], 0
    if group:
        _solve(texts, group, shortest, out)
    return out


def _solve(texts: list[list[bytes]], group: list[int], shortest: int, out: list[list[tuple[int, int, int]]]) -> None:
    numbers, parts = 0, []
    for k in group:
        seen: dict[bytes, int] = {}
        parts.append(np.array([seen.setdefault(w, len(seen)) for w in texts[k]], np.int64) + numbers)
        numbers += len(seen)
    sizes = np.array([len(p) for p in parts])
    text = np.repeat(np.arange(len(parts)), sizes)
    base = np.cumsum(sizes) - sizes
    for s, e, p in zip(*(x.tolist() for x in find_runs(np.concatenate(parts), text, shortest))):
        t = int(text[s])
        out[group[t]].append((s - int(base[t]), e - int(base[t]), p))


_RUN = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame, shortest: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, runs, collapsed text.

    A run is a stretch of words with smallest period q and at least
    max(shortest, 2 q) words that no neighbouring word extends; runs are given
    by start and period, words counted from 0. ``collapsed`` joins by one space
    the words that no run repeats after its first period. A null or blank text
    has no run and collapses to an empty one. Rows are dealt with one by one, so
    repeated rows and ids are kept; other columns are ignored. Texts are never
    cut; small ones are worked through together, a few MB at a time.
    """
    if shortest < 12:
        raise ValueError("shortest is 12 or more")

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            for at, texts in _portions(batch.column(1)):
                words = [(t or b"").split() for t in texts]
                runs = runs_of_texts(words, shortest)
                flat = [r for found_ in runs for r in found_]
                offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
                values = pa.StructArray.from_arrays(
                    [pa.array([v[0] for v in flat], pa.int64()), pa.array([v[1] - v[0] for v in flat], pa.int64()), pa.array([v[2] for v in flat], pa.int64())], fields=list(one)
                )
                texts_out = pa.array([_collapsed(w, r) for w, r in zip(words, runs)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(offsets), values), texts_out], ["_id", "runs", "collapsed"])

    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    out = slim.mapInArrow(found, f"_id {slim.schema['_id'].dataType.simpleString()}, runs {_RUN}, collapsed binary")
    return out.select(F.col("_id").alias(id_col), "runs", F.col("collapsed").cast("string").alias("collapsed"))


def _portions(column: pa.Array, most: int = 8_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch, about ``most`` bytes at a time."""
    at, held, size = 0, [], 0
    for text in column:
        held.append(text.as_py())
        size += len(held[-1] or b"")
        if size >= most:
            yield at, held
            at, held, size = at + len(held), [], 0
    if held:
        yield at, held


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` whose texts of every tenth hash of an id go on periodically from some word, as the contract asks."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text_col), f"[{SPACE}]+"), lambda w: w != "")
    hit = docs.select(id_col, text_col, h.alias("_h"), F.when(h % 10 == 0, words).alias("_words"))
    hit = hit.withColumns({"_g": F.floor(F.col("_h") / 10), "_n": F.when(F.size("_words") > 0, F.size("_words").cast("long"))})
    hit = hit.withColumn("_a", F.col("_g") % F.col("_n"))
    hit = hit.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    back = lambda i: F.col("_a") + (i - F.col("_a")) % F.col("_p")
    chosen = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("_n") - 1),
        lambda i: F.get("_words", F.when(i < F.col("_a"), i).otherwise(back(i)).cast("int")),
    )
    return hit.select(id_col, F.when(F.col("_n").isNotNull(), F.array_join(chosen, " ")).otherwise(F.col(text_col)).alias(text_col))


@query(
    "op13_periodic_runs",
    """
    WITH """
    + CRC_TABLE
    + """,
    d AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, """
    + crc32_sql("doc_id::VARCHAR")
    + """ AS h FROM documents, tab),
    e AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS hit, h // 10 AS g, (h // 10) % len(w) AS a FROM d),
    f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
    words AS (
      SELECT doc_id, i, CASE WHEN hit AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS x
      FROM f, unnest(range(n)) u(i)),
    six AS (
      SELECT doc_id, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o
                        || ' ' || lead(x, 4) OVER o || ' ' || lead(x, 5) OVER o AS k
      FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM six a JOIN six b ON a.doc_id = b.doc_id AND a.k = b.k AND a.i < b.i),
    stretches AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS z FROM pairs),
    zones AS (SELECT doc_id, q, min(i) AS s, count(*) + 5 + q AS len FROM stretches GROUP BY doc_id, q, z),
    runs AS (SELECT doc_id, s, len, min(q) AS q FROM zones WHERE len >= greatest(12, 2 * q) GROUP BY doc_id, s, len),
    per AS (
      SELECT doc_id, count(*) AS n_runs, first(s ORDER BY len DESC, s, q) AS s, first(len ORDER BY len DESC, s, q) AS len,
             first(q ORDER BY len DESC, s, q) AS q, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines
      FROM runs GROUP BY doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
    kept AS (
      SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t
      FROM words WHERE (doc_id, i) NOT IN (SELECT (doc_id, i) FROM gone) GROUP BY doc_id)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, len AS length, q AS period, 1000 * len // q AS exponent_milli,
           sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
    FROM documents LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
)
def op13_periodic_runs(spark, sf):
    found = periodic_runs(planted(table(spark, sf, "documents")))
    # The greatest of these is the longest run, then the one that starts first, then the shortest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    line = lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    length, period = F.col("_best.length"), -F.col("_best.period")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
