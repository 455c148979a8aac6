"""Seeded search over settings: trials drawn where good ones are dense and others are not (tree of Parzen estimators)."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

#: Trials drawn at random before the densities say anything; candidates that each further trial is chosen from.
STARTUP, CANDIDATES = 10, 24


@dataclass(frozen=True)
class Choice:
    """One of some values, which are in no order."""

    values: tuple

    def draw(self, r: random.Random) -> object:
        return r.choice(self.values)

    def near(self, seen: Sequence, r: random.Random) -> object:
        return r.choices(self.values, [self._weight(seen, v) for v in self.values])[0]

    def density(self, seen: Sequence, value: object) -> float:
        return self._weight(seen, value) / (len(seen) + 1)

    def _weight(self, seen: Sequence, value: object) -> float:
        return sum(v == value for v in seen) + 1 / len(self.values)


@dataclass(frozen=True)
class Span:
    """A number between two bounds, on a logarithmic scale or not, whole or not."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def _ends(self) -> tuple[float, float]:
        low, high = (self.low - 0.5, self.high + 0.5) if self.whole else (self.low, self.high)
        return (math.log(low), math.log(high)) if self.log else (low, high)

    def _value(self, x: float) -> float:
        v = math.exp(x) if self.log else x
        return min(max(round(v) if self.whole else v, self.low), self.high)

    def draw(self, r: random.Random) -> float:
        return self._value(r.uniform(*self._ends()))

    def _kernels(self, seen: Sequence) -> list[tuple[float, float]]:
        """Centre and width of a bell for each trial, as wide as to its farther neighbour, and of a flat one over the whole span."""
        low, high = self._ends()
        at = sorted(math.log(v) if self.log else v for v in seen)
        least = (high - low) / min(100, len(at) + 2)
        padded = [low, *at, high]
        return [(x, min(max(x - padded[i], padded[i + 2] - x, least), high - low)) for i, x in enumerate(at)] + [((low + high) / 2, high - low)]

    def near(self, seen: Sequence, r: random.Random) -> float:
        low, high = self._ends()
        centre, width = r.choice(self._kernels(seen))
        while not low <= (x := r.gauss(centre, width)) <= high:
            pass
        return self._value(x)

    def density(self, seen: Sequence, value: float) -> float:
        low, high = self._ends()
        x = math.log(value) if self.log else value
        below = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
        bells = [math.exp(-0.5 * ((x - c) / w) ** 2) / (math.sqrt(2 * math.pi) * w * (below((high - c) / w) - below((low - c) / w))) for c, w in self._kernels(seen)]
        return sum(bells) / len(bells)


def suggest(space: Mapping[str, Choice | Span], tried: Sequence[tuple[dict, float]], r: random.Random, startup: int = STARTUP, candidates: int = CANDIDATES) -> dict:
    """The next settings to try. The best tenth of the trials (at most 25) and the others give a density each, by setting; of ``candidates`` draws from the first, the one with the highest ratio of both is taken."""
    if len(tried) < startup:
        return {name: one.draw(r) for name, one in space.items()}
    ranked = sorted(tried, key=lambda t: -t[1])
    cut = min(math.ceil(len(ranked) / 10), 25)
    good, rest = ([t[0] for t in part] for part in (ranked[:cut], ranked[cut:]))
    out = {}
    for name, one in space.items():
        here, there = [s[name] for s in good], [s[name] for s in rest]
        drawn = [one.near(here, r) for _ in range(candidates)]
        out[name] = max(drawn, key=lambda v: math.log(one.density(here, v)) - math.log(one.density(there, v)))
    return out


def maximise(value: Callable[[dict], float | None], space: Mapping[str, Choice | Span], *, trials: int, seed: int = 42, timeout_s: float = math.inf, clock: Callable[[], float] = time.monotonic, startup: int = STARTUP) -> tuple[dict, float]:
    """The settings with the highest value of ``trials``, and that value. A trial that fails or has no value is passed over and not drawn near; none starts after ``timeout_s``. RuntimeError if none completes."""
    r, tried, end = random.Random(seed), [], clock() + timeout_s
    for _ in range(trials):
        if clock() > end:
            break
        settings = suggest(space, tried, r, startup)
        try:
            found = value(settings)
        except Exception:  # one bad setting must not end the search
            continue
        if found is not None and math.isfinite(found):
            tried.append((settings, found))
    if not tried:
        raise RuntimeError("no trial completed")
    return max(tried, key=lambda t: t[1])
