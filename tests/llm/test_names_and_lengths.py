"""Columns with awkward names and types, repeated rows, and numbers far from 0."""

import math
import random

import pytest
from pyspark.sql import functions as F

from parlance.llm import decontaminate, mixing, ngram_join, sharding, topk, toxicity

NAMES = ["__id", "__n", "__part", "__at", "SHARD", "row", "id", "n", "part", "at", "first", "d2", "h2", "h", "hits", "hash", "items", "__p", "__source", "__topic", "draw", "tokens", "cell", "score", "a.b", "b`c", "component_id", "key"]


@pytest.fixture(scope="module")
def clashing(spark):
    texts = ["one two three four five six", "one two three four five six", "tiny words of another kind here", None, "", "a b"]
    docs = spark.createDataFrame([(i // 2, t, "en", "s%d" % (i % 2)) for i, t in enumerate(texts)] * 2, "doc_id long, text string, lang string, source string")
    return docs.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES], F.create_map(F.lit("k"), F.col("doc_id")).alias("m"), F.lit(None).cast("void").alias("nothing"))


@pytest.mark.parametrize("name", ["assign", "mix", "mix_p", "remove_documents", "remove_spans", "keep_one", "toxicity"])
def test_other_columns_go_through(spark, clashing, name):
    bench = spark.createDataFrame([(1, "tiny words")], "item_id long, text string")
    found = {
        "assign": lambda: sharding.assign(clashing.drop("nothing"), 3),
        "mix": lambda: mixing.mix(clashing, flatten=1.0),
        "mix_p": lambda: mixing.mix(clashing, flatten=1.0, with_probability=True),
        "remove_documents": lambda: decontaminate.remove_documents(clashing, bench),
        "remove_spans": lambda: decontaminate.remove_spans(clashing, bench),
        "keep_one": lambda: ngram_join.keep_one(clashing),
        "toxicity": lambda: toxicity.remove_scored(clashing.drop("nothing"), toxicity.NEVER),
    }[name]()
    rows = found.collect()
    assert 0 < len(rows) <= 12
    for c in [c for c in clashing.columns if c != "nothing" and not (name == "assign" and c == "SHARD")]:
        assert c in found.columns
        assert all(r[c] == f"own {c}" for r in rows) or c not in NAMES
    assert all(r["m"] == {"k": r["doc_id"]} for r in rows)


def test_shards_of_one_huge_text(spark):
    rows = [(i, "x" * (3_000_000 if i == 4 else 5)) for i in range(10)]
    out = {r.doc_id: r for r in sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()}
    assert out[4]["size"] == 3_000_008 and sorted(out) == list(range(10))


def top_by_hand(rows, k=5):
    far = 1 << 62
    whole = [(i, [max(-far, min(far, math.floor(256 * x))) for x in v]) for i, v in rows]
    asked = {}
    for i, v in whole:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, (len(v), v)), (len(v), v))
    out = {}
    for q, (n, qv) in asked.items():
        best = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(qv, v)))), i) for i, v in whole if i != q and len(v) == n)[:k]
        out |= {(q, r): (i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


def test_top_k_of_large_numbers_mixed_lengths_and_repeated_ids(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([1e8, 1.0, -1e8, 3.0]), 1.0]) for i in range(120)] + [(i + 1000, [1.0, 2.0, 3.0 * i]) for i in range(60)]
    rows += [(50, [9.0]), (100, [4.0, 4.0]), (2000, [1e300, -1e300]), (2050, [1e300, 1.0]), (2051, [7.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(frame).collect()}
    assert got == top_by_hand(rows)


def test_products_are_exact_at_every_size():
    import numpy as np

    for size in (1 << 10, 1 << 28, 1 << 40, 1 << 60):
        a, b = (np.array([[size, -size, 3], [1, size - 1, -size]], np.int64) for _ in range(2))
        want = [[max(-(1 << 63), min((1 << 63) - 1, sum(int(x) * int(y) for x, y in zip(p, q)))) for q in b] for p in a]
        assert topk.products(a, b).tolist() == want
