"""Word alignment: validity, issues, and repair of times that run backwards."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values, in milliseconds.
WORD_SLACK, CHUNK_SLACK, BACK_SLACK = 500, 20, 80


def word_valid(start: Column, end: Column, seg_start: Column, seg_end: Column) -> Column:
    return (end > start) & (start >= seg_start - WORD_SLACK) & (end <= seg_end + WORD_SLACK)


def issues(units: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per unit the rules it breaks: reversed, outside the chunk, before what was already said, empty."""
    reach = F.max("end_ms").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    rule = lambda name, broken: F.when(broken, F.lit(name))
    found = F.array(
        rule("reversed", F.col("end_ms") < F.col("start_ms")),
        rule("before_chunk", F.col("start_ms") < F.col("chunk_start_ms") - CHUNK_SLACK),
        rule("after_chunk", F.col("end_ms") > F.col("chunk_end_ms") + CHUNK_SLACK),
        rule("non_monotone", F.col("start_ms") < F.col("reach") - BACK_SLACK),
        rule("empty", F.trim("unit") == ""),
    )
    return units.withColumn("reach", reach).withColumn("issues", F.array_compact(found)).drop("reach")


def sane(start: Column, end: Column, duration: Column) -> Column:
    return (end >= start - 1) & (end <= duration * 1.1)


def longest_non_decreasing(x: list[int]) -> list[int]:
    """Positions of a longest subsequence that never falls: of several, the one that ends first, and before each place the first that can be.

    The places that end runs of one length have falling values, so the first of them
    that isn't too large is found by halving.
    """
    ends, places, before = [], [], [-1] * len(x)  # by length: negated values, which rise, and their places
    lowest = []  # the least value that ends each length
    for i, v in enumerate(x):
        k = bisect.bisect_right(lowest, v)
        if k:
            before[i] = places[k - 1][bisect.bisect_left(ends[k - 1], -v)]
        if k == len(lowest):
            lowest.append(v)
            ends.append([-v])
            places.append([i])
        else:
            lowest[k] = v
            ends[k].append(-v)
            places[k].append(i)
    if not x:
        return []
    i, out = places[-1][0], []
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def repair(x: list[int]) -> list[int]:
    """What stands between two kept places takes the nearer one's value where it is one or two, else lies on the line between them.

    Ahead of the first kept place and behind the last its value holds.
    """
    if not x:
        return []
    values, kept, place = np.array(x), np.array(longest_non_decreasing(x)), np.arange(len(x))
    n_before = np.searchsorted(kept, place, "right")
    low, high = kept[np.maximum(n_before - 1, 0)], kept[np.minimum(np.searchsorted(kept, place), len(kept) - 1)]
    between = np.maximum(high - low - 1, 0)
    nearer = np.where(place - low <= high - place, values[low], values[high])
    line = np.trunc(values[low] + (values[high] - values[low]) / (between + 1) * (place - low)).astype(values.dtype)
    return np.where((low >= place) | (high <= place) | (between <= 2), nearer, line).tolist()


def repaired(rows: DataFrame, column: str = "times") -> DataFrame:
    """``rows`` with an array column's times repaired, a row at a time but a batch a call."""

    @F.pandas_udf("array<long>")
    def fix(times: pd.Series) -> pd.Series:
        return times.map(lambda x: None if x is None else repair([int(v) for v in np.asarray(x)]))

    return rows.withColumn("fixed", fix(F.col(column).cast("array<long>")))


def repair_stats(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Backward steps before and after, and how many times changed."""
    falls = lambda c: F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), F.lit(0), lambda s, i: s + F.when(F.get(F.col(c), i) < F.get(F.col(c), i - 1), 1).otherwise(0))
    changed = F.size(F.filter(F.zip_with(F.col(before).cast("array<long>"), F.col(after), lambda a, b: a != b), lambda x: x))
    return rows.agg(F.sum(falls(before)).alias("falls_before"), F.sum(falls(after)).alias("falls_after"), F.sum(changed).alias("n_changed"))


def matched_in_order(sentences: list[str], said: list[str]) -> list[int] | None:
    """Positions of the sentences, matched exactly and in order; None if one is missing."""
    at, out = 0, []
    for s in sentences:
        try:
            at = said.index(s, at)
        except ValueError:
            return None
        out.append(at)
        at += 1
    return out


def ordered_match(wanted: DataFrame, said: DataFrame, key: str) -> DataFrame:
    """(key, ord, pos): each recording's wanted sentences (ord, text) at their places among those said (pos, text)."""

    def fold(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("ord"), right.sort_values("pos")
        found = matched_in_order(left["text"].tolist(), right["text"].tolist())
        if found is None or left.empty:
            return pd.DataFrame({key: [], "ord": [], "pos": []})
        return pd.DataFrame({key: left[key].to_numpy(), "ord": left["ord"].to_numpy(), "pos": right["pos"].to_numpy()[found]})

    return wanted.groupBy(key).cogroup(said.groupBy(key)).applyInPandas(fold, f"{key} {dict(wanted.dtypes)[key]}, ord long, pos long")


def best_shift(rows: DataFrame, first: str, second: str, limit: int) -> DataFrame:
    """``rows`` with the shift of the second waveform, within ``limit`` samples, at which the two differ least on average."""

    @F.pandas_udf("long")
    def search(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append(None)
                continue
            x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
            cost = {}
            # nearer shifts first, so that they win ties
            for s in sorted(range(-limit, limit + 1), key=abs):
                p, q = x[max(s, 0) : len(y) + s], y[max(-s, 0) : len(x) - s]
                n = min(len(p), len(q))
                if n > 0:
                    cost[s] = np.abs(p[:n] - q[:n]).mean()
            out.append(min(cost, key=cost.get) if cost else None)
        return pd.Series(out, dtype="Int64")

    return rows.withColumn("shift", search(F.col(first), F.col(second)))
