"""Which parameters a search tries next, and which trials it gives up.

A space entry is ("int", low, high), ("float", low, high) or ("choice", values).
All of this runs on the driver over the handful of trials made so far; the fits
are the Spark jobs.
"""

from __future__ import annotations

import math
import random
import statistics
from dataclasses import dataclass, field


def draw(space: dict[str, tuple], rng: random.Random) -> dict:
    """One random point of a search space."""
    out = {}
    for name, (kind, *limits) in space.items():
        if kind == "int":
            out[name] = rng.randint(*limits)
        elif kind == "float":
            out[name] = rng.uniform(*limits)
        else:
            out[name] = rng.choice(limits[0])
    return out


class RandomDraws:
    """Every trial is drawn by chance."""

    def suggest(self, space: dict[str, tuple], rng: random.Random) -> dict:
        return draw(space, rng)

    def learn(self, params: dict, loss: float | None) -> None:
        pass


@dataclass
class ParzenDraws:
    """Draws near good trials and away from bad ones.

    Trials are split by their loss into a good part and the rest. For every
    parameter a density is laid over the values of either part: bumps at the
    values that were tried, and one over the whole range, so that nothing is
    ruled out. Of ``candidates`` values drawn from the good density, the one
    whose good density is highest against the other is tried. The first
    ``startup`` trials are drawn by chance. The same seed and losses give the
    same trials.
    """

    startup: int = 10
    candidates: int = 24
    share: float = 0.1
    history: list[tuple[float, dict]] = field(default_factory=list)

    def learn(self, params: dict, loss: float | None) -> None:
        """What a trial cost; one that failed counts as the worst."""
        self.history.append((math.inf if loss is None or math.isnan(loss) else loss, dict(params)))

    def suggest(self, space: dict[str, tuple], rng: random.Random) -> dict:
        if len(self.history) < self.startup or not space:
            return draw(space, rng)
        # Stable: of equal losses the earlier trial counts as better.
        ranked = sorted(range(len(self.history)), key=lambda i: self.history[i][0])
        n = max(1, math.ceil(self.share * len(ranked)))
        good, rest = ([self.history[i][1] for i in part] for part in (ranked[:n], ranked[n:]))
        return {name: self._one(name, entry, good, rest, rng) for name, entry in space.items()}

    def _one(self, name: str, entry: tuple, good: list[dict], rest: list[dict], rng: random.Random):
        near, far = ([p[name] for p in part if name in p] for part in (good, rest))
        if entry[0] == "choice":
            values = list(entry[1])
            weigh = lambda seen: [1.0 + sum(s == v for s in seen) for v in values]
            a, b = weigh(near), weigh(far)
            tried = rng.choices(range(len(values)), a, k=self.candidates)
            best = max(tried, key=lambda i: a[i] / sum(a) / (b[i] / sum(b)))
            return values[best]
        kind, low, high = entry
        if low == high:
            return low
        l, g = _Bumps(near, low, high, kind == "int"), _Bumps(far, low, high, kind == "int")
        return max((l.sample(rng) for _ in range(self.candidates)), key=lambda x: math.log(l.density(x)) - math.log(g.density(x)))


class _Bumps:
    """An even mixture of normal bumps cut off at the limits of a range, one of them as wide as the range."""

    def __init__(self, values: list[float], low: float, high: float, whole: bool):
        self.low, self.high, self.whole = float(low), float(high), whole
        if whole:
            # A whole number stands for the interval around it.
            self.low, self.high = low - 0.5, high + 0.5
        width = self.high - self.low or 1.0
        self.bumps = [((self.low + self.high) / 2, width)]
        placed = sorted(values)
        for i, v in enumerate(placed):
            # As wide as the farther gap to its neighbours, within bounds.
            before = v - (placed[i - 1] if i else self.low)
            after = (placed[i + 1] if i + 1 < len(placed) else self.high) - v
            self.bumps.append((v, min(width, max(before, after, width / min(100.0, 1.0 + len(placed))))))

    @staticmethod
    def _below(x: float, bump: tuple[float, float]) -> float:
        return 0.5 * (1.0 + math.erf((x - bump[0]) / (bump[1] * math.sqrt(2.0))))

    def sample(self, rng: random.Random) -> float:
        bump = rng.choice(self.bumps)
        for _ in range(100):
            x = rng.gauss(*bump)
            if self.low <= x <= self.high:
                break
        else:
            x = rng.uniform(self.low, self.high)
        return min(int(self.high - 0.5), max(int(self.low + 0.5), round(x))) if self.whole else x

    def density(self, x: float) -> float:
        total = 0.0
        for bump in self.bumps:
            inside = self._below(self.high, bump) - self._below(self.low, bump)
            if self.whole:
                mass = self._below(x + 0.5, bump) - self._below(x - 0.5, bump)
            else:
                mass = math.exp(-0.5 * ((x - bump[0]) / bump[1]) ** 2) / (bump[1] * math.sqrt(2.0 * math.pi))
            total += mass / inside
        return max(total / len(self.bumps), 1e-300)


@dataclass
class MedianPruner:
    """Gives up a trial whose mean so far is worse than the median of earlier ones after as many folds.

    Never among the first ``startup`` trials. Losses: smaller is better.
    """

    startup: int = 5
    paths: list[list[float]] = field(default_factory=list)

    @property
    def ready(self) -> bool:
        return len(self.paths) >= self.startup

    def hopeless(self, losses: list[float]) -> bool:
        """Whether to stop after these folds."""
        step = len(losses)
        earlier = [sum(p[:step]) / step for p in self.paths if len(p) >= step]
        return len(earlier) >= self.startup and sum(losses) / step > statistics.median(earlier)

    def keep(self, losses: list[float]) -> None:
        self.paths.append(list(losses))


def sampler(name: str, startup: int = 10) -> RandomDraws | ParzenDraws:
    if name == "parzen":
        return ParzenDraws(startup)
    if name == "random":
        return RandomDraws()
    raise ValueError(f"unknown sampler: {name}")
