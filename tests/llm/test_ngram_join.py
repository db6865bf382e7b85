"""The Jaccard join against all pairs compared by hand."""

import random
import re

import numpy as np
import pytest

from parlance.llm import ngram_join
from parlance.llm import textbytes as tb


def by_hand(rows, width, percent):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    comp = {}
    for i, (doc, _) in enumerate(rows):
        comp[root(i)] = min(comp.get(root(i), doc), doc)
    return {doc: (len(sets[i]), comp[root(i)]) for i, (doc, _) in enumerate(rows)}


@pytest.mark.parametrize(("width", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (3, 90, 3)])
def test_components_match_all_pairs(spark, width, percent, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abÉde") for _ in range(rng.randint(1, 4)))
    line = [word() for _ in range(40)]
    texts = ["", None, " \t\n", "One", "one", "one two", "a b c", "A  B\tC"]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 8, 12, 20, 60, 200, 400]))] + (line if rng.random() < 0.5 else [])
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 2, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    # drifting chain: neighbours link, ends don't
    base = [word() for _ in range(150)]
    for k in range(30):
        base[(k * 5) % 150] = f"drift{k}"
        texts.append(" ".join(base))
    ids = rng.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts))
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n long".replace("n long", "n string")).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame, width, percent).collect()}
    want = by_hand(rows, width, percent)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows)


def test_edge_cases(spark):
    schema = "doc_id long, text string"
    assert ngram_join.jaccard_components(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (4, "A b c d e f"), (7, None)]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, schema)).collect())
    assert got == [("4", 2, 4), ("5", 2, 4), ("5", 2, 4), ("7", 0, 7), ("None", 2, None)]


def test_one_document_of_each_component_stays(spark):
    rows = [(9, "a b c d e f", "s"), (9, "a b c d e f", "r"), (3, "A b c d e f", "t"), (None, "a b c d e f", None), (6, "z y x w v", "u"), (6, "z y x w v", "q")]
    got = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((str(r.doc_id), r.source) for r in got) == [("3", "t"), ("6", "q"), ("None", None)]


def test_links_come_from_opened_groups(spark, monkeypatch):
    """Without the opening there are no links; small blocks and buckets change nothing."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(4))
    texts = []
    for size in (40, 90, 300):
        base = [word() for _ in range(size)]
        for _ in range(30):
            copy = list(base)
            for _ in range(rng.choice([1, 2, size // 30, size // 15])):
                copy[rng.randrange(size)] = word()
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    shown = lambda: {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame, 3, 90).collect()}
    want = by_hand(rows, 3, 90)
    assert len({c for _, c in want.values()}) < len(rows)
    assert shown() == want
    for name, value in (("BLOCK", 200), ("BLOCK_ROWS", 4), ("ASKED", 300), ("ASKED_ROWS", 3), ("COUNTED_ROWS", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    assert shown() == want
    monkeypatch.setattr(ngram_join, "_counted", lambda *a: (np.empty(0, np.int64), np.empty(0, np.int64)))
    # the bound and the opening alone: leaders too are behind them
    assert {c for _, c in shown().values()} == set(range(len(rows)))


def test_rows_that_share_an_id(spark):
    a, b = "one two three four five six seven", "quite another text with words of its own"
    schema = "doc_id long, text string"
    rows = [(5, a), (5, b), (3, a), (4, b), (5, ""), (8, b.upper())]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, schema)).collect())
    assert got == [(3, 3, 3), (4, 4, 3), (5, 0, 5), (5, 3, 3), (5, 4, 3), (8, 4, 3)]
    kept = lambda rows: sorted((r.doc_id, r.text) for r in ngram_join.keep_one(spark.createDataFrame(rows, schema)).collect())
    assert kept([(5, a), (5, b), (3, a)]) == [(3, a), (5, b)]
    assert kept([(9, a), (9, b), (12, b.upper()), (1, a)]) == [(1, a), (9, b)]
    assert kept([(7, a), (7, a + " "), (7, a)]) in ([(7, a)], [(7, a + " ")])


def test_one_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(1, long), (2, long.replace("w77 ", "x ")), (3, "short text of five words"), (4, long.upper())]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == {1: (119_998, 1), 2: (119_998, 1), 3: (3, 3), 4: (119_998, 1)}


@pytest.mark.parametrize(("share", "least"), [(2048, 8), (1 << 30, 2), (1, 1 << 30)])
def test_what_is_common_changes_no_link(spark, monkeypatch, share, least):
    """Documents of shared passages alone, in part and not at all: few, most or no shingles being common."""
    rng = random.Random(7)
    monkeypatch.setattr(ngram_join, "COMMON_SHARE", share)
    monkeypatch.setattr(ngram_join, "COMMON_LEAST", least)
    word = lambda: f"w{rng.randrange(5000)}"
    passages = [[word() for _ in range(rng.choice([12, 40, 90]))] for _ in range(4)]
    texts = []
    for k in range(90):
        own = [word() for _ in range(rng.choice([0, 5, 30, 120]))]
        base = own + [w for p in rng.sample(passages, rng.randint(0, 4)) for w in p]
        texts.append(" ".join(base))
        for _ in range(k % 3):
            copy = list(base)
            for _ in range(rng.choice([1, 2, 3])):
                if copy:
                    copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    rows = list(zip(rng.sample(range(10_000), len(texts)), texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    common = ngram_join.common_shingles(frame, 5)
    assert bool(common) == (least < 1 << 30)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame).collect()}
    assert got == by_hand(rows, 5, 80)


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_an_entry_whatever_is_common(percent):
    """Sets that differ as much as linked ones may, with any part of their shingles common."""
    rng = np.random.default_rng(3)
    scheme = ngram_join.Scheme(percent, 2000)
    for n in (5, 9, 20, 61, 200, 333, 1100):
        for part in (0.0, 0.3, 0.7, 0.95, 1.0):
            shared = rng.integers(0, 2**63, n).astype(np.uint64)
            apart = n * 100 // percent - n
            left = int(rng.integers(0, apart + 1))
            a = np.concatenate([shared, rng.integers(0, 2**63, left).astype(np.uint64)])
            b = np.concatenate([shared, rng.integers(0, 2**63, apart - left).astype(np.uint64)])
            assert 100 * n >= percent * (n + apart)
            is_common = set(rng.choice(shared, int(part * n), replace=False).tolist())
            found = []
            for x in (a, b):
                rare = np.array([v not in is_common for v in x.tolist()])
                found.append(set(scheme.columns(np.zeros(len(x), np.int64), x, 1, rare)[1].tolist()))
            assert found[0] & found[1]


def test_different_shingles_of_one_place_are_not_common_together(spark, monkeypatch):
    """As in very many runs: places meet again and again by chance, shingles don't."""
    monkeypatch.setattr(ngram_join, "FLUSH", 1 << 13)
    monkeypatch.setattr(ngram_join, "_place", lambda value: (tb.mix(value) & np.uint64(0x7FFF)).astype(np.int64))
    docs = spark.range(4000).selectExpr("id", "array_join(transform(sequence(0, 59), i -> concat('w', id, '_', i)), ' ') as text").coalesce(1)
    assert ngram_join.common_shingles(docs, 5) == {}


def test_of_too_many_common_shingles_the_most_frequent_count(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON_MOST", 40)
    passage = lambda name: " ".join(f"{name}{i}" for i in range(30))
    docs = spark.createDataFrame([(k, passage("a" if k < 40 else "b")) for k in range(50)], "id long, text string").coalesce(1)
    common = ngram_join.common_shingles(docs, 5)
    assert sum(int.from_bytes(x, "little").bit_count() for x in common.values()) == 26
    monkeypatch.undo()
    assert sum(int.from_bytes(x, "little").bit_count() for x in ngram_join.common_shingles(docs, 5).values()) == 52


def test_shingles_of_rows_are_those_of_each_by_itself():
    rng = np.random.default_rng(5)
    for width in (1, 2, 3, 5):
        count = rng.integers(0, 9, 200)
        row, hashes = np.repeat(np.arange(200), count), rng.integers(0, 5, count.sum()).astype(np.uint64)
        of, value = tb.row_shingles(row, hashes, width, 200)
        for k in range(200):
            mine = hashes[row == k]
            _, want = tb.row_shingles(np.zeros(len(mine), np.int64), mine, width, 1)
            assert value[of == k].tolist() == want.tolist() == sorted(set(want.tolist()))
            assert len(want) == (min(len(mine), 1) if len(mine) < width else len({tuple(mine[i : i + width]) for i in range(len(mine) - width + 1)}))
