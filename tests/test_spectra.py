"""Spectra against a plain transform of the whole signal, the way back, and windows added up."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import spectra


def blocked(spark, signals, block):
    rows = [(name, a, x[a : a + block].tolist()) for name, x in signals.items() for a in range(0, max(len(x), 1), block)]
    return spark.createDataFrame(rows, "recording string, first long, samples array<short>").repartition(5)


def by_hand(x, window, hop):
    left = (window - hop) // 2
    n = -(-len(x) // hop)
    padded = np.zeros((n - 1) * hop + window)
    padded[left : left + len(x)] = x / 32768
    return np.array([np.fft.rfft(padded[t * hop : t * hop + window] * spectra.hann(window)) for t in range(n)])


@pytest.fixture(scope="module")
def some():
    rng = np.random.default_rng(2)
    return {f"r{n}": rng.integers(-20000, 20000, n).astype(np.int16) for n in (1, 39, 320, 641, 1280, 5003, 9600)}


@pytest.mark.parametrize("window, hop, block", [(64, 16, 320), (640, 320, 640), (64, 32, 640)])
def test_frames_cross_rows(spark, some, window, hop, block):
    got = {}
    for r in spectra.spectra(blocked(spark, some, block), block, window, hop).collect():
        got.setdefault(r.recording, {})[r.frame] = np.array(r.re) + 1j * np.array(r.im)
    for name, x in some.items():
        want = by_hand(x, window, hop)
        assert sorted(got[name]) == list(range(len(want)))
        assert np.allclose([got[name][t] for t in range(len(want))], want, atol=1e-9)


def test_the_way_back_is_within_a_millionth(spark, some):
    window, hop, block = 64, 16, 320
    frames = spectra.spectra(blocked(spark, some, block), block, window, hop)
    lengths = spark.createDataFrame([(k, len(v)) for k, v in some.items()], "recording string, n long")
    back = {}
    for r in spectra.signals(frames, lengths, block, window, hop).orderBy("recording", "first").collect():
        assert r["first"] == len(back.setdefault(r.recording, []))
        back[r.recording] += r["values"]
    for name, x in some.items():
        assert len(back[name]) == len(x) and np.abs(np.array(back[name]) - x / 32768).max() < 1e-6


def test_mel_bands(spark, some):
    got = {(r.recording, r.frame): r.bands for r in spectra.log_mel(blocked(spark, some, 640), 640, 640, 320).collect()}
    bank = spectra.mel_bank(321)
    assert bank.shape == (321, 80) and (bank >= 0).all() and np.allclose(bank.sum(1)[12:300], 1, atol=0.2)
    want = np.log(np.abs(by_hand(some["r5003"], 640, 320)) @ bank + 1e-10)
    assert np.allclose([got["r5003", t] for t in range(len(want))], want)


def test_constant_windows_add_up_to_a_constant(spark):
    windows = spark.range(40).select((F.col("id") % 2).alias("rec"), (F.floor(F.col("id") / 2) * 27).alias("start"), F.array_repeat(F.lit(2.5), 30).alias("values"))
    got = {}
    for r in spectra.added_up(spectra.faded(windows, 3), ["rec"], 100).orderBy("rec", "first").collect():
        assert r["first"] == len(got.setdefault(r.rec, []))
        got[r.rec] += r["values"]
    assert {k: len(v) for k, v in got.items()} == {0: 543, 1: 543} and all(abs(x - 2.5) < 1e-12 for v in got.values() for x in v)


def test_windows_meet_as_weighted_means(spark):
    rows = [("a", -2, [9.0, 9.0, 1.0, 2.0], [1.0, 1.0, 1.0, 3.0]), ("a", 1, [4.0, 5.0, 6.0], [1.0, 0.0, 2.0]), ("b", 5, [7.0], [1.0]), ("b", 0, [], [])]
    frame = spark.createDataFrame(rows, "rec string, start long, values array<double>, weights array<double>")
    got = {(r.rec, r["first"]): r["values"] for r in spectra.added_up(frame, ["rec"], 2).collect()}
    assert got == {("a", 0): [1.0, 2.5], ("a", 2): [0.0, 6.0], ("b", 4): [0.0, 7.0]}


def test_wrapping(spark):
    rows = spark.createDataFrame([([1, 2, 3],), ([],), ([1, 2, 3, 4],), ([5],)], "x array<int>")
    assert [r[0] for r in rows.select(spectra.wrapped(F.col("x"), 4)).collect()] == [[1, 2, 3, 1], [], [1, 2, 3, 4], [5, 5, 5, 5]]
