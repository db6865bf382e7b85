"""Phrase-level text conversion with dictionaries of any practical size.

A conversion is a chain of stages, as from one script to another and on to a region's
words; each stage is a set of dictionaries whose longest phrase at a place wins, from left
to right.  A stage's phrases lie in a trie of flat arrays, which is broadcast.  A batch of
texts walks it for all places at once, a level at a time: only places whose characters
still follow some phrase go on, so the work is linear in the text, whatever the number of
phrases.

A trie has at most a node for each of its phrases' characters; ``MAX_CHARACTERS`` bounds
what is collected and broadcast, and more is refused.  Null texts stay null, empty ones
empty.  Of several translations of one phrase the least is taken.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_CHARACTERS = 20_000_000
#: Wider than any code point; a text's end is marked by what no phrase can hold.
BITS, END = 21, (1 << 21) - 1
#: Characters of text that are walked at a time.
CHARACTERS = 1 << 20


class Trie:
    """Phrases and what they turn into, as arrays: edges sorted by node and character."""

    def __init__(self, phrases: Iterable[tuple[str, str]]):
        children: list[dict[int, int]] = [{}]
        value, self.targets = [-1], []
        for source, target in phrases:
            node = 0
            for ch in map(ord, source):
                if (following := children[node].get(ch)) is None:
                    following = children[node][ch] = len(children)
                    children.append({})
                    value.append(-1)
                node = following
            if source:
                value[node] = len(self.targets)
                self.targets.append(target)
        pairs = sorted(((node << BITS) | ch, to) for node, edges in enumerate(children) for ch, to in edges.items())
        self.keys, self.to = np.array([k for k, _ in pairs], np.int64), np.array([t for _, t in pairs], np.int32)
        self.value = np.array(value, np.int32)

    def longest(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places that begin a phrase, the longest one's length there, and its number."""
        best, length = np.full(len(codes), -1, np.int32), np.zeros(len(codes), np.int32)
        places, nodes, depth = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        while len(places) and len(self.keys):
            inside = places + depth < len(codes)
            places, nodes = places[inside], nodes[inside]
            wanted = (nodes << BITS) | codes[places + depth]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            found = self.keys[at] == wanted
            places, nodes, depth = places[found], self.to[at[found]].astype(np.int64), depth + 1
            ends = self.value[nodes] >= 0
            best[places[ends]], length[places[ends]] = self.value[nodes[ends]], depth
        places = np.flatnonzero(length)
        return places, length[places], best[places]

    def convert(self, texts: list[str]) -> list[str]:
        joined = np.concatenate([np.append(np.frombuffer(t.encode("utf-32-le"), "<u4").astype(np.int64), END) for t in texts]) if texts else np.empty(0, np.int64)
        first = np.cumsum([0] + [len(t) + 1 for t in texts])
        places, lengths, numbers = self.longest(joined)
        bounds = np.searchsorted(places, first)
        out = []
        for k, text in enumerate(texts):
            pieces, done, mine = [], 0, slice(bounds[k], bounds[k + 1])
            for place, length, number in zip((places[mine] - first[k]).tolist(), lengths[mine].tolist(), numbers[mine].tolist()):
                if place >= done:
                    pieces += (text[done:place], self.targets[number])
                    done = place + length
            out.append("".join([*pieces, text[done:]]) if pieces else text)
        return out


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(source, target) from lines of a phrase, a tab, and its translations separated by spaces, of which the first counts; # begins a remark."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & F.col("value").contains("\t"))
    parts = F.split("value", "\t", 2)
    return lines.select(parts[0].alias("source"), F.split(parts[1], " ")[0].alias("target"))


def trie_of(*dictionaries: DataFrame) -> Trie:
    """One stage: the phrases of all its dictionaries; where two have the same phrase, the earlier dictionary's counts."""
    found: dict[str, str] = {}
    for d in dictionaries:
        each = d.where("source is not null and source <> '' and target is not null").groupBy("source").agg(F.min("target").alias("target"))
        size = each.agg(F.coalesce(F.sum(F.length("source") + F.length("target")), F.lit(0))).first()[0]
        if size > MAX_CHARACTERS:
            raise ValueError(f"a dictionary of {size} characters is beyond the bound of {MAX_CHARACTERS}")
        found = {r["source"]: r["target"] for r in each.collect()} | found
    return Trie(sorted(found.items()))


def converter(spark: SparkSession, *stages: Trie):
    """A function from a text column to its conversion by all stages in turn."""
    shared = spark.sparkContext.broadcast(stages)

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        out = texts.tolist()
        given = [i for i, t in enumerate(out) if t is not None]
        while given:
            size, n = 0, 0
            while n < len(given) and (not n or size + len(out[given[n]]) <= CHARACTERS):
                size, n = size + len(out[given[n]]), n + 1
            mine, given = given[:n], given[n:]
            texts_now = [out[i] for i in mine]
            for trie in shared.value:
                texts_now = trie.convert(texts_now)
            for i, t in zip(mine, texts_now):
                out[i] = t
        return pd.Series(out, dtype=object)

    def of(text: Column) -> Column:
        return convert(text)

    return of
