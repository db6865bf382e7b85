"""Raking that converges slowly, and targets out of reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import mixing

CELLS = "__source string, __lang string, __topic string, tokens long"


def slow_cells():
    """A hot source in one language, 20 in another, one hundredth strays: reachable, and slow to reach."""
    rows = [("hot", "a", "t", 990_000), ("hot", "b", "t", 10_000)]
    for i in range(20):
        rows += [(f"s{i}", "b", "t", 99_000), (f"s{i}", "a", "t", 1_000)]
    return rows


def far_off(rows, flatten=mixing.FLATTEN):
    """How far any sum of fitted rows is off, as a share of all tokens."""
    total = sum(r["tokens"] for r in rows)
    worst = 0.0
    for d in mixing.DIMENSIONS:
        had, now = {}, {}
        for r in rows:
            had[r[f"__{d}"]] = had.get(r[f"__{d}"], 0) + r["tokens"]
            now[r[f"__{d}"]] = now.get(r[f"__{d}"], 0) + r["weight"]
        whole = sum(n**flatten for n in had.values())
        worst = max(worst, *(abs(now[k] - n**flatten / whole * total) / total for k, n in had.items()))
    return worst


def test_slow_targets_are_met(spark):
    report = {}
    rows = mixing.rake(spark.createDataFrame(slow_cells(), CELLS), report=report).collect()
    assert far_off(rows) <= 2e-6
    assert report["met"] and not report["proved_unreachable"] and report["rounds"] > 2 and report["distance"] <= 1e-6


def test_unreachable_targets_are_proved_and_reported(spark):
    # all of x is a and all of y is b, but the sources are wanted even and the languages 9 to 1
    cells = spark.createDataFrame([("x", "a", "t", 500), ("y", "b", "t", 500)], CELLS)
    targets = {d: spark.createDataFrame(list(zip(names, shares)), "category string, share double") for d, names, shares in (("source", "xy", (0.5, 0.5)), ("lang", "ab", (0.9, 0.1)))}
    report = {}
    mixing.rake(cells, targets, report=report)
    assert report["proved_unreachable"] and not report["met"] and report["distance"] == pytest.approx(0.4) and report["rounds"] < 10
    report = {}
    mixing.rake(cells, {"source": targets["source"].where("category = 'x'")}, report=report)
    assert report["proved_unreachable"] and not report["met"]


def test_reachable_targets_are_never_called_unreachable():
    rng = np.random.default_rng(4)
    for _ in range(200):
        codes = [rng.integers(0, k, 40) for k in (6, 4, 3)]
        start = rng.integers(1, 1000, 40) * (rng.random(40) < 0.8)
        there = start * rng.random(40) ** 3
        goals = [np.bincount(c, there, k) * (start.sum() / there.sum()) for c, k in zip(codes, (6, 4, 3))]
        _, report = mixing._rake_arrays(codes, goals, start, 3000, 1e-6)
        assert not report["proved_unreachable"] and report["met"]


def test_many_cells_take_the_same_steps(spark, monkeypatch):
    cells = spark.createDataFrame(slow_cells() + [("none", "a", "t", 0)], CELLS)
    shown = lambda **k: {(r["__source"], r["__lang"]): r["weight"] for r in mixing.rake(cells, **k).collect()}
    one, other = {}, {}
    want = shown(max_rounds=3, report=one)
    monkeypatch.setattr(mixing, "MAX_CELLS", 0)
    assert shown(max_rounds=3, report=other) == pytest.approx(want)
    assert other.pop("distance") == pytest.approx(one.pop("distance")) and one == other
