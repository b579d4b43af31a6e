"""Byte-level BPE over many pre-tokens at once, in numpy.

Texts are cut into pre-tokens by the classes of their code points, and each
distinct pre-token is merged once. A batch of pre-tokens is one flat array of
symbols with the start of each sequence. In a round every sequence that still
has a mergeable pair finds its lowest-ranked pair and merges all places of it;
rounds end when no sequence has one. Symbols that survive are the token ids.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The classes by which the vocabulary's byte-level splitter cuts text, with Unicode's white space spelt out.
_WHITE = r"\t-\r \x85\xa0  -     　"
_KINDS = (_WHITE, r"\p{L}", r"\p{N}")
_OTHER = len(_KINDS)
#: What makes a pre-token with an apostrophe before it.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

_FREE = np.int32(2**31 - 1)


@functools.cache
def _kinds(end: int) -> np.ndarray:
    """The class of every code point below ``end``: its place in ``_KINDS``, 0 being white space, or ``_OTHER``."""
    points = "".join(map(chr, range(end)))
    kinds = np.full(len(points), _OTHER, np.uint8)
    for kind, chars in enumerate(_KINDS):
        for run in regex.finditer(f"[{chars}]+", points):
            kinds[run.start() : run.end()] = kind
    return kinds


def pre_token_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each code point of joined texts; ``first`` says where texts begin, and is true past the end.

    It cuts as this pattern does, text by text, with L, N and S for letters, numbers and white space:
    's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^SLN]+|S+(?![^S])|S+
    """
    kind = _kinds(0x10000 if points.max() < 0x10000 else 0x110000)[points]
    begins = first.copy()
    inner = ~first[1:-1]
    white = kind == 0
    begins[1:-1] |= kind[1:] != kind[:-1]
    # A run that follows a space takes it along.
    begins[1:-1] &= ~((points[:-1] == ord(" ")) & ~white[1:] & inner)
    # Of white space before something else, the last character stands apart from the rest.
    begins[:-2] |= white[:-1] & ~white[1:] & inner
    quotes = np.flatnonzero((points == ord("'")) & begins[:-1])
    for ending in _ENDINGS:
        at = quotes[quotes + len(ending) < len(points)]
        for k, letter in enumerate(ending, 1):
            at = at[(points[at + k] == ord(letter)) & ~first[at + k]]
        begins[at + 1] = False
        begins[at + 1 + len(ending)] = True
    return begins[:-1]


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merger:
    """Merges of one vocabulary file, and the ids of pre-tokens seen lately."""

    def __init__(self, path: str, most_cached: int = 400_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        names = _byte_names()
        self.first = np.zeros(256, np.int32)
        for name, byte in names.items():
            self.first[byte] = vocab[name]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._split = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.width = max([*vocab.values(), *self.special.values()]) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.fromiter((vocab[a] for a, _ in pairs), np.int64, len(pairs))
        right = np.fromiter((vocab[b] for _, b in pairs), np.int64, len(pairs))
        made = np.fromiter((vocab[a + b] for a, b in pairs), np.int64, len(pairs))
        self._fill_table(left * self.width + right, made)
        self.most_cached = most_cached
        self._forget()

    def _fill_table(self, keys: np.ndarray, made: np.ndarray) -> None:
        """Open-addressed by two hashes of the pair: one look finds nearly all, a second look the rest."""
        self.kind = np.uint32 if self.width**2 < 2**32 else np.uint64
        keys = keys.astype(self.kind)
        self.shift = self.kind(8 * self.kind().itemsize - max(10, int(len(keys)).bit_length() + 2))
        slots = int(np.iinfo(self.kind).max >> self.shift) + 1
        # No pair has the largest key.
        self.keys = np.full((2, slots), np.iinfo(self.kind).max, self.kind)
        self.ranks = np.full((2, slots), _FREE, np.int32)
        self.made = made.astype(np.int32)
        todo = np.arange(len(keys))
        for side in (0, 1):
            slot = self._slot(keys[todo], side)
            _, here = np.unique(slot, return_index=True)
            self.keys[side, slot[here]] = keys[todo[here]]
            self.ranks[side, slot[here]] = todo[here]
            todo = np.delete(todo, here)
        self.rest = {int(keys[i]): int(i) for i in todo}
        self._rest_keys = np.sort(np.fromiter(self.rest, self.kind, len(self.rest)))

    def _slot(self, key: np.ndarray, side: int) -> np.ndarray:
        factor = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[side] >> (64 - 8 * key.itemsize) | 1
        return key * self.kind(factor) >> self.shift

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(self.kind) * self.kind(self.width) + right.astype(self.kind)
        slot = self._slot(key, 0)
        out = np.where(self.keys[0].take(slot) == key, self.ranks[0].take(slot), _FREE)
        miss = np.flatnonzero(out == _FREE)
        key = key.take(miss)
        slot = self._slot(key, 1)
        out[miss] = np.where(self.keys[1].take(slot) == key, self.ranks[1].take(slot), _FREE)
        if self.rest:
            place = np.minimum(np.searchsorted(self._rest_keys, key), len(self._rest_keys) - 1)
            at = np.flatnonzero(self._rest_keys[place] == key)
            out[miss[at]] = [self.rest[int(k)] for k in key[at]]
        return out

    def merge(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All surviving symbols of the non-empty byte strings of these sizes, and how many each has."""
        symbols = self.first[data]
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        done_symbols, done_owner = [], []
        ranks = np.full(len(symbols), _FREE)
        ranks[:-1] = np.where(owner[1:] == owner[:-1], self.rank(symbols[:-1], symbols[1:]), _FREE)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(symbols)])
            lowest = np.repeat(np.minimum.reduceat(ranks, starts), lengths)
            over = lowest == _FREE
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
                stay = ~over
                symbols, owner, ranks, lowest = symbols[stay], owner[stay], ranks[stay], lowest[stay]
                if not len(symbols):
                    break
            here = ranks == lowest
            # In a run such as "aaa" the pair's places overlap: from the left, every second one counts.
            if (here[1:] & here[:-1]).any():
                at = np.flatnonzero(here)
                new = np.r_[True, (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])]
                begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                here[at[(np.arange(len(at)) - begin) % 2 == 1]] = False
            at = np.flatnonzero(here)
            symbols[at] = self.made[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
            # Only pairs with a new symbol change; each merge before it has taken one place.
            made = at - np.arange(len(at))
            near = np.concatenate([made, made[made > 0] - 1])
            ranks[near] = _FREE
            near = near[near < len(symbols) - 1]
            near = near[owner[near] == owner[near + 1]]
            ranks[near] = self.rank(symbols[near], symbols[near + 1])
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(sizes))

    def _forget(self) -> None:
        # No pre-token is a special string, which the split takes before.
        self.words = pa.array([s.encode() for s in self.special], pa.large_binary())
        self.ids = np.array([*self.special.values()], "<u4")
        self.counts = np.ones(len(self.special), np.int64)

    def places(self, words: pa.LargeBinaryArray) -> np.ndarray:
        """Where each of the distinct pre-tokens stands in ``words``; new ones are merged and put there."""
        if len(self.words) > self.most_cached:
            self._forget()
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(at.is_null())
        place = at.fill_null(-1).to_numpy().astype(np.int64)
        place[place < 0] = np.arange(len(self.words), len(self.words) + len(new))
        _, bounds, data = new.buffers()
        bounds, data = np.frombuffer(bounds, np.int64, len(new) + 1), np.frombuffer(data or b"", np.uint8)
        parts = [slice(begin, min(begin + 6_000, len(new))) for begin in range(0, len(new), 6_000)]
        merged = [self.merge(data[bounds[p.start] : bounds[p.stop]], np.diff(bounds[p.start : p.stop + 1])) for p in parts]
        self.words = pa.concat_arrays([self.words, new])
        self.ids = np.concatenate([self.ids, *(symbols.astype("<u4") for symbols, _ in merged)])
        self.counts = np.concatenate([self.counts, *(counts for _, counts in merged)])
        return place

    def encode(self, texts: Iterable[str], characters: int = 2_000_000) -> Iterable[bytes]:
        """The ids of each text, in groups of texts of about so many characters: in a group each distinct pre-token is looked up once."""
        group: list[str] = []
        held = 0
        for text in texts:
            group.append(text)
            held += len(text)
            if held >= characters:
                yield from self._flush(group)
                group, held = [], 0
        yield from self._flush(group)

    def _flush(self, group: list[str]) -> Iterable[bytes]:
        edges = np.cumsum([0, *map(len, group)])
        text = "".join(group)
        if not text:
            return [b""] * len(group)
        data = text.encode()
        plain = len(data) == len(text)
        points = np.frombuffer(data, np.uint8) if plain else np.frombuffer(text.encode("utf-32-le"), "<u4")
        first = np.zeros(len(points) + 1, bool)
        first[edges] = True
        # A special string is a token, and what stands beside it is cut as if it were a text.
        special = [(at + m.start(), at + m.end()) for t, at in zip(group, edges.tolist()) for m in self._split.finditer(t)] if self._split and self._split.search(text) else []
        for a, b in special:
            first[[a, b]] = True
        begins = pre_token_starts(points, first)
        for a, b in special:
            begins[a + 1 : b] = False
        starts = np.flatnonzero(begins)
        bounds = np.append(starts, len(points))
        if not plain:
            sizes = 1 + (points >= 0x80).astype(np.uint8) + (points >= 0x800) + (points >= 0x10000)
            bounds = np.append(0, np.cumsum(sizes, dtype=np.int64)[bounds[1:] - 1])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        which = self.places(words.dictionary)[words.indices.to_numpy()]
        taken = self.counts[which]
        ends = np.cumsum(taken)
        ids = self.ids[np.repeat((np.cumsum(self.counts) - self.counts)[which] - ends + taken, taken) + np.arange(ends[-1])].tobytes()
        at = (4 * np.append(0, ends)[np.searchsorted(starts, edges)]).tolist()
        return map(ids.__getitem__, map(slice, at[:-1], at[1:]))
