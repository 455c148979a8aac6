"""The search of settings: against random draws on a known surface, budgets, failures, densities."""

import dataclasses
import math
import random

import pytest

from riskloom.operators import boosting, model
from riskloom.operators.search import Choice, Span, maximise, suggest

SPACE = {"x": Span(-5, 5), "rate": Span(1e-4, 1, log=True), "depth": Span(1, 12, whole=True), "kind": Choice(("a", "b", "c"))}


def surface(s):
    """One peak, at x = 1.5, rate = 0.03, depth = 7, kind b."""
    return -((s["x"] - 1.5) ** 2) - (math.log10(s["rate"]) + 1.52) ** 2 - 0.1 * (s["depth"] - 7) ** 2 - (s["kind"] != "b")


def test_better_than_random_draws():
    ours, theirs = [], []
    for seed in range(20):
        ours.append(maximise(surface, SPACE, trials=60, seed=seed)[1])
        theirs.append(maximise(surface, SPACE, trials=60, seed=seed, startup=60)[1])
    assert sum(a > b for a, b in zip(ours, theirs, strict=True)) >= 15
    assert sum(ours) > 0.6 * sum(theirs)  # distances to the peak


def test_seeded_within_bounds_and_budget():
    seen = []

    def value(s):
        seen.append(s)
        return surface(s)

    assert maximise(value, SPACE, trials=30, seed=3) == maximise(surface, SPACE, trials=30, seed=3) and len(seen) == 30
    assert all(-5 <= s["x"] <= 5 and 1e-4 <= s["rate"] <= 1 and s["depth"] in range(1, 13) and s["kind"] in "abc" for s in seen)
    ticks = iter([0.0, 1.0, 2.0, 99.0])
    seen.clear()
    maximise(value, SPACE, trials=50, timeout_s=10, clock=lambda: next(ticks))
    assert len(seen) == 2


def test_failures_are_passed_over():
    def value(s):
        if s["kind"] == "a":
            raise ValueError
        return None if s["kind"] == "c" else math.nan if s["x"] > 4 else s["x"]

    best, found = maximise(value, SPACE, trials=80)
    assert best["kind"] == "b" and found == best["x"] <= 4
    with pytest.raises(RuntimeError):
        maximise(lambda s: 1 / 0, SPACE, trials=3)


@pytest.mark.parametrize("one", [Span(2, 9), Span(1e-3, 10, log=True)])
def test_densities_add_up_to_one(one):
    low, high = one._ends()
    for seen in ([], [3.0], [2.5, 3.0, 8.9, 8.9]):
        n = 20_000
        at = [low + (high - low) * (k + 0.5) / n for k in range(n)]
        assert sum(one.density(seen, math.exp(x) if one.log else x) for x in at) * (high - low) / n == pytest.approx(1, abs=1e-3)
    assert sum(Choice((1, 2, 3)).density([1, 1], v) for v in (1, 2, 3)) == pytest.approx(1)


def test_good_trials_draw_near():
    tried = [({"x": x}, -abs(x - 2)) for x in [-4.0, -3, -2, -1, 0, 1, 2.1, 3, 4, 4.5] * 2]
    r = random.Random(1)
    drawn = [suggest({"x": SPACE["x"]}, tried, r)["x"] for _ in range(50)]
    assert sum(abs(x - 2) < 1.5 for x in drawn) > 35


def test_spaces_of_the_families():
    """Every family has a space, of settings that there are; what is drawn from it makes a setting and, for leaf-wise trees, a way to grow."""
    known = {f.name for f in dataclasses.fields(model.Hyper)}
    assert set(model.SPACES) == set(model.FAMILIES)
    for space in model.SPACES.values():
        assert set(space) <= known
        for seed in range(20):
            h = model.Hyper(**suggest(space, [], random.Random(seed)))
            assert boosting.Growth(depth=h.depth, subsample=h.subsample, columns=h.columns, lasso=h.lasso, ridge=h.shrink, min_gain=h.min_gain).most_leaves >= 2
