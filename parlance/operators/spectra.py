"""Short-time spectra of long signals, log-mel bands, the way back, and windows added up to one curve.

A signal is rows of equal blocks (recording, first, samples), as audio files are read.  A
block's frames reach into its neighbours; only those edges are sent there, by recording
and block, so a long recording's blocks are worked on side by side and no row holds a
recording.  On the way back a block's frames are added up where they are, and only sums
meet: each block of positions gets the few pieces that overlap it.

Padding is that of a spectrum without centring: half a window less half a hop of
silence on both sides, and silence up to a whole number of hops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The spectrum's parameters for 16 kHz speech.
WINDOW, HOP, MELS, RATE, TOP_HZ, FLOOR = 640, 320, 80, 16_000, 8000.0, 1e-10


def hann(n: int) -> np.ndarray:
    """The periodic raised cosine."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def mel_bank(n_freqs: int, n_mels: int = MELS, rate: int = RATE, top_hz: float = TOP_HZ) -> np.ndarray:
    """Triangles between points evenly spaced on the mel scale, (frequency, band)."""
    mel = np.linspace(0, 2595 * np.log10(1 + top_hz / 700), n_mels + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    freq = np.linspace(0, rate // 2, n_freqs)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((freq - low) / (mid - low), (high - freq) / (high - mid)))


def with_edges(blocks: DataFrame, block: int, window: int = WINDOW, hop: int = HOP) -> DataFrame:
    """(recording, k, samples, before, after): every block with its neighbours' edges, one shuffle by recording and block."""
    if block % hop or block < window:
        raise ValueError("a block is a whole number of hops and no shorter than a window")
    left = (window - hop) // 2
    right = window - hop - left
    k = F.floor(F.col("first") / block)
    n = F.size("samples")
    sent = F.array(
        F.struct(k.alias("k"), F.lit(0).alias("side"), F.col("samples").alias("x")),
        F.struct((k + 1).alias("k"), F.lit(1).alias("side"), F.slice("samples", F.greatest(n - left + 1, F.lit(1)), left).alias("x")),
        F.struct((k - 1).alias("k"), F.lit(2).alias("side"), F.slice("samples", 1, right).alias("x")),
    )
    each = blocks.where(F.col("samples").isNotNull() & (n > 0)).select("recording", F.explode(sent).alias("s")).select("recording", "s.*")
    side = lambda i: F.coalesce(F.max(F.when(F.col("side") == i, F.col("x"))), F.array().cast("array<short>"))
    return each.groupBy("recording", "k").agg(side(0).alias("samples"), side(1).alias("before"), side(2).alias("after")).where(F.size("samples") > 0)


def _frames(samples: np.ndarray, before: np.ndarray, after: np.ndarray, window: int, hop: int) -> np.ndarray:
    left = (window - hop) // 2
    n = -(-len(samples) // hop)
    held = np.zeros((n - 1) * hop + window)
    held[left - len(before) : left] = before
    held[left : left + len(samples)] = samples
    if n * hop == len(samples):  # a shorter block is a recording's last
        held[left + len(samples) :][: len(after)] = after[: len(held) - left - len(samples)]
    return np.lib.stride_tricks.sliding_window_view(held, window)[::hop]


def _each_block(blocks: DataFrame, block: int, window: int, hop: int, schema: str, columns) -> DataFrame:
    """One row a frame: ``columns`` makes Arrow columns of a block's spectrum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = hann(window)
        for batch in batches:
            for recording, k, *sides in zip(*[batch.column(c) for c in ("recording", "k", "samples", "before", "after")]):
                frames = _frames(*[s.values.to_numpy(zero_copy_only=False).astype(float) / 32768 for s in sides], window, hop)
                made = columns(np.fft.rfft(frames * shape, axis=1))
                first = k.as_py() * (block // hop)
                yield pa.RecordBatch.from_arrays([pa.array([recording.as_py()] * len(frames)), pa.array(np.arange(first, first + len(frames))), *made.values()], names=["recording", "frame", *made])

    return with_edges(blocks, block, window, hop).mapInArrow(run, f"recording string, frame long, {schema}")


def _rows(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(x).reshape(-1), kind))


def spectra(blocks: DataFrame, block: int, window: int = WINDOW, hop: int = HOP) -> DataFrame:
    """(recording, frame, re, im) of every frame of every recording."""
    return _each_block(blocks, block, window, hop, "re array<double>, im array<double>", lambda s: {"re": _rows(s.real, pa.float64()), "im": _rows(s.imag, pa.float64())})


def log_mel(blocks: DataFrame, block: int, window: int = WINDOW, hop: int = HOP, n_mels: int = MELS, rate: int = RATE, top_hz: float = TOP_HZ) -> DataFrame:
    """(recording, frame, bands): the logarithm of the magnitudes' sums over mel bands."""
    bank = mel_bank(window // 2 + 1, n_mels, rate, top_hz)
    return _each_block(blocks, block, window, hop, "bands array<double>", lambda s: {"bands": _rows(np.log(np.abs(s) @ bank + FLOOR), pa.float64())})


def added_up(pieces: DataFrame, keys: list[str], block: int) -> DataFrame:
    """(keys, first, values): one curve from overlapping pieces (start, values, weights), block by block.

    A place's value is the weighted mean of the pieces that reach it, 0 where none
    weighs anything.  Pieces are cut at the blocks' borders and padded to a block, so
    only those that overlap a block meet, as many as windows overlap; places before 0
    are left out, and a recording's last block ends with its last piece.
    """
    start, n = F.col("start"), F.size("values")
    reach = F.sequence(F.greatest(F.floor(start / block), F.lit(0)), F.floor((start + n - 1) / block))
    cut = pieces.where((n > 0) & (start + n > 0)).withColumn("b", F.explode(reach))
    low, high = F.greatest(F.col("start"), F.col("b") * block), F.least(F.col("start") + F.size("values"), (F.col("b") + 1) * block)
    zeros = lambda k: F.array_repeat(F.lit(0.0), k.cast("int"))
    part = lambda c: F.concat(zeros(low - F.col("b") * block), F.slice(c, (low - F.col("start") + 1).cast("int"), (high - low).cast("int")), zeros((F.col("b") + 1) * block - high))
    weighed = F.zip_with("values", "weights", lambda x, w: x * w)
    each = cut.select(*keys, "b", (high - F.col("b") * block).alias("n"), F.struct(low.alias("low"), part(weighed).alias("x"), part(F.col("weights")).alias("w")).alias("p"))
    add = lambda c: F.aggregate(F.col("ps"), zeros(F.lit(block)), lambda s, p: F.zip_with(s, p[c], lambda a, b: a + b))
    # in one order, so that sums don't depend on which piece came first
    met = each.groupBy(*keys, "b").agg(F.array_sort(F.collect_list("p")).alias("ps"), F.max("n").cast("int").alias("n"))
    curve = F.zip_with(add("x"), add("w"), lambda x, w: F.when(w > 0, x / w).otherwise(0.0))
    return met.select(*keys, (F.col("b") * block).alias("first"), F.slice(curve, F.lit(1), F.col("n")).alias("values"))


def faded(windows: DataFrame, overlap: int) -> DataFrame:
    """Windows (start, values) with weights that rise over the overlap at their start and fall over that at their end."""
    n = F.size("values")
    return windows.withColumn("weights", F.transform("values", lambda x, i: F.least(F.lit(1.0), (i + 1) / (overlap + 1), (n - i) / F.lit(overlap + 1))))


def signals(frames: DataFrame, lengths: DataFrame, block: int, window: int = WINDOW, hop: int = HOP) -> DataFrame:
    """(recording, first, values): signals from their spectra, cut back to ``lengths`` (recording, n).

    Squared windows weigh the frames, so a spectrum that wasn't changed gives the signal it
    came from, wherever some window isn't 0.
    """
    per, left = block // hop, (window - hop) // 2

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        shape, at = hann(window), (pdf["frame"].to_numpy() - pdf["frame"].iloc[0]) * hop
        wave = np.fft.irfft(np.array(pdf["re"].tolist()) + 1j * np.array(pdf["im"].tolist()), window, axis=1) * shape
        total, weight = np.zeros(at[-1] + window), np.zeros(at[-1] + window)
        for a, row in zip(at, wave):
            total[a : a + window] += row
            weight[a : a + window] += shape**2
        mean = np.divide(total, weight, out=np.zeros_like(total), where=weight > 1e-12)
        return pd.DataFrame({"recording": [pdf["recording"].iloc[0]], "start": [int(pdf["frame"].iloc[0]) * hop - left], "values": [mean.tolist()], "weights": [weight.tolist()]})

    dealt = frames.withColumn("k", F.floor(F.col("frame") / per))
    pieces = dealt.groupBy("recording", "k").applyInPandas(add, "recording string, start long, values array<double>, weights array<double>")
    curve = added_up(pieces, ["recording"], block).join(lengths, "recording").where(F.col("first") < F.col("n"))
    return curve.select("recording", "first", F.slice("values", F.lit(1), F.least(F.col("n") - F.col("first"), F.lit(block)).cast("int")).alias("values"))


def wrapped(samples: Column, segment: int) -> Column:
    """Samples repeated from their start up to a multiple of ``segment``."""
    n = F.size(samples)
    need = (F.ceil(n / segment) * segment - n).cast("int")
    return F.when(n > 0, F.concat(samples, F.slice(F.flatten(F.array_repeat(samples, F.ceil(need / n).cast("int") + 1)), F.lit(1), need))).otherwise(samples)
