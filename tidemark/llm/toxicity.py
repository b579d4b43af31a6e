"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are given per document. Which tokens of a toxic document are toxic is
found from counts over the training rows: words and word beginnings that toxic
documents hold far more often than clean ones. The field is trained on those
labelled tokens and has, besides a bias, a weight for each such feature, a
start weight and transition weights, so a weak cue counts more beside a strong.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, query, table
from .jaccard import WordHashes, hashed_shingles, words_of
from .workers import in_workers

_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BEGINNINGS = (3, 4, 5, 6)
_WINDOW = 64


@dataclass
class Field:
    """A trained field with the states clean (0) and toxic (1)."""

    weights: dict[str, float]
    bias: float
    start: float
    trans: np.ndarray  # [from, to]


def features(word: str) -> list[str]:
    """Names of a word's features: the word, and its beginnings marked with *."""
    word = word.lower()
    return [word, *(word[:n] + "*" for n in _BEGINNINGS if len(word) > n)]


def _beginnings(words: Column, n: int) -> Column:
    """The first n characters of the words that have more, marked as features() marks them."""
    return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))


def _cue_counts(train: DataFrame) -> DataFrame:
    """feature, n_toxic, n_clean: in how many training documents of each kind a feature stands."""
    words = F.array_distinct(F.split(F.lower("_text"), _SPLIT))
    starts = [_beginnings(words, n) for n in _BEGINNINGS]
    names = F.array_distinct(F.concat(words, *starts))
    each = train.select("_toxic", F.explode(names).alias("feature")).where("feature <> ''")
    return each.groupBy("feature").agg(F.count_if(F.col("_toxic") == 1).alias("n_toxic"), F.count_if(F.col("_toxic") == 0).alias("n_clean"))


def toxic_cues(train: DataFrame, n_toxic: int, n_clean: int, most_cues: int = 3000) -> dict[str, bool]:
    """The features that mark toxic documents most surely.

    They are at least 8 times as likely there, by a likelihood ratio far above
    what features without meaning reach, since near copies of a document repeat its words.
    The value says whether nine in ten training documents with it are toxic:
    only words with such a feature are labelled toxic, in toxic documents.
    """
    a, b = F.col("n_toxic"), F.col("n_clean")
    odds = F.log((a + 0.5) / (n_toxic + 1)) - F.log((b + 0.5) / (n_clean + 1))
    share = n_toxic / (n_toxic + n_clean)
    part = lambda x, of: F.when(x > 0, x * F.log(x / ((a + b) * of))).otherwise(0.0)
    sure = 2 * (part(a, share) + part(b, 1 - share))
    found = _cue_counts(train).where(odds >= np.log(8.0)).withColumn("sure", sure)
    found = found.where("sure >= 28").orderBy(F.desc("sure"), "feature").limit(most_cues)
    return {r["feature"]: r["sure"] for r in found.select("feature", (a >= 9 * b).alias("sure")).collect()}


def _windows(train: DataFrame, cues: dict[str, bool]) -> DataFrame:
    """at, cue, toxic: the windows of 64 words that hold a cue; rows with an empty ``at`` count the others below zero."""
    index = {c: i for i, c in enumerate(cues)}

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, known = re.compile(_WORD), {}
        for batch in batches:
            at, cue, toxic = [], [], []
            none = 0
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = word.findall(text)
                for begin in range(0, len(words), _WINDOW):
                    a, c = [], []
                    for i, w in enumerate(words[begin : begin + _WINDOW]):
                        ids = known.get(w)
                        if ids is None:
                            ids = known[w] = [index[f] for f in features(w) if f in index]
                        a += [i] * len(ids)
                        c += ids
                    if a:
                        at.append(a), cue.append(c), toxic.append(y)
                    else:
                        none += 1
            at.append([]), cue.append([]), toxic.append(-none)
            known = known if len(known) < 200_000 else {}
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array(cue, pa.list_(pa.int32())), pa.array(toxic, pa.int64())], ["at", "cue", "toxic"])

    return in_workers(train.select("_text", "_toxic"), find, "at array<int>, cue array<int>, toxic long")


def train_field(train: DataFrame, n_toxic: int, n_clean: int, most_windows: int = 10_000, rounds: int = 80) -> Field:
    """Fit the field on at most about ``most_windows`` windows with a cue; those without are counted in full."""
    cues = toxic_cues(train, n_toxic, n_clean)
    windows = cut(_windows(train, cues))
    none = windows.where("size(at) = 0").agg(F.coalesce(F.sum(-F.col("toxic")), F.lit(0))).first()[0]
    held = windows.where("size(at) > 0")
    share = most_windows / max(most_windows, held.count())
    kept = held.where(F.pmod(F.xxhash64("at", "cue", "toxic"), F.lit(1 << 20)) < share * (1 << 20)).limit(2 * most_windows)
    rows = sorted((list(r["at"]), list(r["cue"]), r["toxic"]) for r in kept.collect())
    return _fit(rows, none * share, cues, rounds)


def _fit(rows: list[tuple], none: float, cues: dict[str, bool], rounds: int) -> Field:
    # The last sequence stands for all windows without a cue.
    n, k = len(rows) + 1, len(cues)
    seq = np.repeat(np.arange(n - 1), [len(r[0]) for r in rows]).astype(int)
    at = np.array([i for r in rows for i in r[0]], int)
    cue = np.array([i for r in rows for i in r[1]], int)
    gold = np.zeros((n, _WINDOW))
    if len(rows):
        sure = np.array([r[2] for r in rows], bool)[seq] & np.array(list(cues.values()))[cue]
        gold[seq[sure], at[sure]] = 1.0
    mass = np.r_[np.ones(n - 1), max(none, 1.0)]
    mass /= mass.sum() / n
    w, head = np.zeros(k), np.array([-4.0, -1.0, -1.0, -1.0, 0.0])  # bias, start, clean-toxic, toxic-clean, toxic-toxic
    state = np.zeros((2, k + 5))
    pairs = lambda a, b: (mass[:, None] * a * b).sum()
    for step in range(1, rounds + 1):
        bias, start, ct, tc, tt = head
        score = np.full((n, _WINDOW), bias)
        np.add.at(score, (seq, at), w[cue])
        e = np.exp(np.minimum(score, 30.0))
        trans = np.exp(np.array([[0.0, ct], [tc, tt]]))
        alpha, beta = np.empty((n, _WINDOW, 2)), np.empty((n, _WINDOW, 2))
        a = np.stack([np.ones(n), np.exp(start) * e[:, 0]], 1)
        alpha[:, 0] = a / a.sum(1, keepdims=True)
        for t in range(1, _WINDOW):
            a = alpha[:, t - 1] @ trans
            a[:, 1] *= e[:, t]
            alpha[:, t] = a / a.sum(1, keepdims=True)
        beta[:, -1] = 1.0
        for t in range(_WINDOW - 2, -1, -1):
            b = beta[:, t + 1].copy()
            b[:, 1] *= e[:, t + 1]
            b = b @ trans.T
            beta[:, t] = b / b.sum(1, keepdims=True)
        p = alpha * beta
        p /= p.sum(2, keepdims=True)
        after = beta[:, 1:].copy()
        after[:, :, 1] *= e[:, 1:]
        both = alpha[:, :-1, :, None] * trans * after[:, :, None, :]
        both /= both.sum((2, 3), keepdims=True)
        # Expected minus given counts, with a quadratic penalty.
        over = p[:, :, 1] - gold
        g0, g1 = gold[:, :-1], gold[:, 1:]
        grad = np.r_[
            np.bincount(cue, mass[seq] * over[seq, at], k) if k else [],
            (mass[:, None] * over).sum(), (mass * over[:, 0]).sum(),
            pairs(both[:, :, 0, 1], 1) - pairs(1 - g0, g1), pairs(both[:, :, 1, 0], 1) - pairs(g0, 1 - g1), pairs(both[:, :, 1, 1], 1) - pairs(g0, g1),
        ] + 0.05 * np.r_[w, head]
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        move = 0.25 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, head = w - move[:k], head - move[k:]
    bias, start, ct, tc, tt = map(float, head)
    return Field(dict(zip(cues, w.tolist())), bias, start, np.array([[0.0, ct], [tc, tt]]))


class Tagger:
    """Marginals of one text after another. Words without a cue are alike, so runs of them are powers of one matrix."""

    def __init__(self, field: Field, most_cached: int = 300_000):
        self.field, self.most_cached = field, most_cached
        self.known: dict[str, float] = {}
        step = np.exp(field.trans) * np.array([1.0, np.exp(field.bias)])
        values, vectors = np.linalg.eig(step)
        order = np.argsort(-values.real)
        self.ratio = float(values.real[order[1]] / values.real[order[0]])
        right, left = vectors.real[:, order], np.linalg.inv(vectors.real[:, order])
        self.parts = [np.outer(right[:, i], left[i]) for i in (0, 1)]
        self.trans = np.exp(field.trans)
        stay = np.abs(right[:, 0]) * np.abs(left[0])
        self.floor = float(stay[1] / stay.sum())

    def _gap(self, n: int) -> np.ndarray:
        """n steps over words without a cue, up to a factor."""
        return self.parts[0] + self.ratio**n * self.parts[1]

    def scores(self, words: list[str]) -> list[float]:
        known, weights = self.known, self.field.weights
        if len(known) > self.most_cached:
            known.clear()
        for word in set(words).difference(known):
            known[word] = sum(weights.get(f, 0.0) for f in features(word))
        return list(map(known.__getitem__, words))

    def marginals(self, scores: list[float]) -> tuple[list[int], list[float]]:
        """Places of the words with a cue, and how likely each is toxic."""
        at = np.flatnonzero(scores).tolist()
        if not at:
            return at, []
        e = [np.array([1.0, np.exp(min(30.0, self.field.bias + scores[i]))]) for i in at]
        start = np.array([1.0, np.exp(self.field.start)])
        alphas, here = [], None
        for k, i in enumerate(at):
            if here is None:
                # Words before the first cue: the start, then steps over background.
                first = start if i == 0 else (start * [1.0, np.exp(self.field.bias)]) @ self._gap(i - 1) @ self.trans
            else:
                first = here @ self._gap(i - at[k - 1] - 1) @ self.trans
            here = first * e[k]
            here = here / here.sum()
            alphas.append(here)
        beta = self._gap(len(scores) - at[-1] - 1) @ np.ones(2)
        out = []
        for k in range(len(at) - 1, -1, -1):
            both = alphas[k] * beta
            out.append(float(both[1] / both.sum()))
            if k:
                beta = self._gap(at[k] - at[k - 1] - 1) @ (self.trans @ (e[k] * beta))
                beta = beta / beta.sum()
        return at, out[::-1]


def learn(docs: DataFrame, labels: DataFrame, most_labelled: int = 4000, held_out_of: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Field | None:
    """A field trained on labelled rows whose crc32 of the id, as text, is not divisible by ``held_out_of``.

    At most about ``most_labelled`` toxic rows and three times as many clean
    ones are used, picked by a hash of the id. Rows without an id or label teach
    nothing, and an id with several labels counts as toxic if any is. None where
    there are no labels of both kinds.
    """
    given = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_toxic")).where("_id IS NOT NULL AND _toxic IS NOT NULL")
    given = given.where(_fold(F.col("_id"), held_out_of) != 0).groupBy("_id").agg((F.max("_toxic") > 0).cast("int").alias("_toxic"))
    sizes = {r["_toxic"]: r["n"] for r in given.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    rate = F.when(F.col("_toxic") == 1, min(1.0, most_labelled / sizes[1])).otherwise(min(1.0, 3 * most_labelled / sizes[0]))
    picked = given.where(F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 20)) < rate * (1 << 20)).limit(5 * most_labelled)
    # Bounded by most_labelled, so it may be broadcast.
    train = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")).join(F.broadcast(picked), "_id")
    # Copies of a text, near ones too, teach once: mostly they have the same least hashes.
    train = cut(_with_least_hashes(train).dropDuplicates(["_h", "_toxic"]).drop("_h"))
    n = {r["_toxic"]: r["n"] for r in train.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    return train_field(train, n.get(1, 0), n.get(0, 0)) if len(n) == 2 else None


def _with_least_hashes(train: DataFrame) -> DataFrame:
    """_text, _toxic and _h, of three hash functions the least values of three neighbouring words, by which copies are known."""

    factors = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)

    def least(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            found = [hashed_shingles(words_of(t), 3, known) for t in batch.column(0).to_pylist()]
            h = [b"".join((f * factor).min().tobytes() for factor in factors) if len(f) else b"" for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(h, pa.binary())], ["_text", "_toxic", "_h"])

    return in_workers(train.select("_text", "_toxic"), least, "_text string, _toxic int, _h binary")


def _fold(id_: Column, of: int) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(of))


def scored(rows: DataFrame, field: Field | None) -> DataFrame:
    """score and spans for rows of (_row, _text); ``_row`` is carried along, whatever it is."""
    if field is None:
        return rows.select("_row", F.lit(0.0).alias("score"), F.array().cast(_SPANS).alias("spans"))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger, word = Tagger(field), re.compile(_WORD)
        for batch in batches:
            found, spans = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                words = word.findall(text)
                at, p = tagger.marginals(tagger.scores(words))
                found.append(min(1.0, max(p, default=tagger.floor * bool(words))))
                spans.append(_spans(text, word, [(i, x) for i, x in zip(at, p) if x >= 0.5]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array(spans, _SPAN_ARROW)], ["_row", "score", "spans"])

    kind = rows.schema["_row"].dataType.simpleString()
    return in_workers(rows.select("_row", "_text"), score, f"_row {kind}, score double, spans {_SPANS}")


def toxicity(docs: DataFrame, labels: DataFrame, held_out_of: int = 5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted, spans.

    The field is trained by ``learn``, which takes the other options. The score
    is the largest marginal of any word, so it does not rise with a text's
    length; without a cue it is the share the field gives a plain word, and 0
    without any word. ``spans`` has start, end (characters) and p of each run
    of words more likely toxic than not.

    A null text is empty. Without labels of both kinds every score is 0.
    Repeated rows are scored one by one. Labels, language, source and the id are
    no inputs of a score; other columns are ignored.
    """
    field = learn(docs, labels, held_out_of=held_out_of, id_col=id_col, text_col=text_col, **options)
    out = scored(docs.select(F.col(id_col).alias("_row"), F.col(text_col).alias("_text")), field)
    held = F.coalesce(_fold(F.col("_row"), held_out_of) == 0, F.lit(False))
    return out.select(F.col("_row").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with a score under one half, all columns as they are. Decided row by row, without a join."""
    field = learn(docs, labels, text_col=text_col, **options)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"))
    return scored(rows, field).where("score < 0.5").select("_row.*")


_SPANS = "array<struct<start:int,end:int,p:double>>"
_SPAN_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def _spans(text: str, word: re.Pattern, hits: list[tuple[int, float]]) -> list[dict]:
    """Character offsets of runs of neighbouring hits."""
    if not hits:
        return []
    wanted, out, last = dict(hits), [], -2
    for i, m in enumerate(word.finditer(text)):
        if i in wanted:
            if i == last + 1:
                out[-1] |= {"end": m.end(), "p": max(out[-1]["p"], wanted[i])}
            else:
                out.append({"start": m.start(), "end": m.end(), "p": wanted[i]})
            last = i
        if i >= hits[-1][0]:
            break
    return out


@query("op4_toxicity")
def op4_toxicity(spark, sf):
    return toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))
