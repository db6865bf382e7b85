"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from parlance.llm import resampling as rs

UPPER = {c: c + 32 for c in range(65, 91)}


def features(text, longest=1):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def by_hand(docs, target, percent, buckets, longest, min_words):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x, longest)[1]) for texts in ([d[1] for d in docs], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in docs:
        words, found = features(text, longest)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranked = [(*r, k if k <= len(able) * percent // 100 else None) for k, r in enumerate(able, 1)]
    return Counter(ranked + [(*r, None) for r in out if r[1] < min_words])


@pytest.mark.parametrize("longest, buckets", [(1, 10_000), (3, 500), (2, 1 << 16)])
def test_resampling_matches_python(spark, longest, buckets):
    rng = random.Random(longest)
    vocabulary = ["the", "Of", "été", "x" * 60, "9", "naïve", "z" * 49, "😀k", "a"] + [f"w{i}" for i in range(60)]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "_"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(300)] + [(5, None), (6, ""), (None, text(40)), (7, "?! ;"), (8, text(9000))]
    docs += [(900, "one two three " * 9)] * 250
    target = [text(30) for _ in range(20)] + [None, ""]
    frame = spark.createDataFrame([(*d, 1.5, "own") for d in docs], "doc_id long, text string, score double, weight string").repartition(7)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = rs.resample(frame, bench, percent=30, buckets=buckets, longest=longest)
    assert Counter(map(tuple, got.collect())) == by_hand(docs, target, 30, buckets, longest, 20)
    kept = rs.drawn(frame, got)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got.collect() if r["rank"]}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "word " * 25)], "doc_id long, text string")
    assert rs.resampling_digest(none, one).collect() == []
    r = rs.resampling_digest(one, none).collect()
    assert len(r) == 1 and r[0].n_features == 25 and r[0]["rank"] is None  # a tenth of one document is none


def test_a_block_keeps_its_documents_apart():
    data = np.frombuffer("ab cdef gh".encode(), np.uint8)
    words, sizes, found = rs.buckets_of(data, np.array([0, 0, 4, 4, 10, 10]), 10_000, 2)
    assert words.tolist() == [0, 2, 0, 2, 0] and sizes.tolist() == [0, 3, 0, 3, 0]
    assert found.tolist() == [zlib.crc32(x) % 10_000 for x in (b"ab", b"c", b"ab c", b"def", b"gh", b"def gh")]
