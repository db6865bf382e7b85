"""Conversion by large dictionaries against a plain longest match."""

import random
import time

import pytest
from pyspark.sql import functions as F

from parlance.functions import conversion


def by_hand(text, phrases):
    out, i, longest = [], 0, max(map(len, phrases), default=0)
    while i < len(text):
        n = next((n for n in range(min(longest, len(text) - i), 0, -1) if text[i : i + n] in phrases), 0)
        out.append(phrases[text[i : i + n]] if n else text[i])
        i += max(n, 1)
    return "".join(out)


def test_longest_phrase_from_the_left():
    rng = random.Random(2)
    for _ in range(150):
        phrases = {"".join(rng.choice("ab头发😀\n") for _ in range(rng.randint(1, 5))): rng.choice(["", "X", "頭", "ab"]) for _ in range(rng.randint(0, 25))}
        texts = ["".join(rng.choice("abc头发展😀\n") for _ in range(rng.choice([0, 1, 30]))) for _ in range(6)]
        assert conversion.Trie(sorted(phrases.items())).convert(texts) == [by_hand(t, phrases) for t in texts]


def test_fifty_thousand_phrases_in_linear_time():
    rng = random.Random(3)
    phrases = {"".join(chr(rng.randrange(0x4E00, 0x5200)) for _ in range(rng.randint(1, 6))): str(k) for k in range(50_000)}
    trie = conversion.Trie(sorted(phrases.items()))
    text = "".join(chr(rng.randrange(0x4E00, 0x5200)) for _ in range(60_000))
    assert trie.convert([text])[0] == by_hand(text, phrases)
    took = []
    for n in (3, 30):
        began = time.process_time()
        trie.convert([text * n])
        took.append(time.process_time() - began)
    assert took[1] < 25 * took[0]


def test_stages_and_files(spark, tmp_path):
    (tmp_path / "phrases.txt").write_text("# remark\n头发\t頭髮 头髪\n软件\t軟件\n", encoding="utf-8")
    (tmp_path / "characters.txt").write_text("发\t發\n头\t頭\n软\t軟\n", encoding="utf-8")
    (tmp_path / "region.txt").write_text("軟件\t軟體\n", encoding="utf-8")
    read = lambda n: conversion.read_dictionary(spark, str(tmp_path / n))
    convert = conversion.converter(spark, conversion.trie_of(read("phrases.txt"), read("characters.txt")), conversion.trie_of(read("region.txt")))
    rows = [(1, "头发的软件"), (2, None), (3, ""), (4, "头 发"), (5, "plain"), (6, "头发" * 600_000)]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i int, t string").select("i", convert(F.col("t")).alias("t")).collect()}
    assert got == {1: "頭髮的軟體", 2: None, 3: "", 4: "頭 發", 5: "plain", 6: "頭髮" * 600_000}


def test_a_dictionary_beyond_the_bound_is_refused(spark, monkeypatch):
    monkeypatch.setattr(conversion, "MAX_CHARACTERS", 5)
    with pytest.raises(ValueError):
        conversion.trie_of(spark.createDataFrame([("abc", "xyz")], "source string, target string"))
    empty = conversion.trie_of(spark.createDataFrame([], "source string, target string"))
    assert empty.convert(["as it was"]) == ["as it was"]
