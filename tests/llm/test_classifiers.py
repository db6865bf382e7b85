"""Quality and toxicity: held-out accuracy, tolerance and edge cases."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from parlance.llm import quality, toxicity

SCHEMA = "doc_id long, text string, lang string, score string"
SF = "/root/testdata/sf0.1"


def accuracy(spark, digest, target, folds, fold):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = digest(docs, labels).join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in out)
    held = [r for r in out if r.held_out]
    return sum(r.predicted == r[target] for r in held) / len(held)


def test_quality_held_out_accuracy(spark):
    assert accuracy(spark, quality.quality_digest, "quality", 4, 2) >= 0.97


def test_toxicity_held_out_accuracy(spark):
    assert accuracy(spark, toxicity.toxicity_digest, "toxic", 5, 0) >= 0.96


@pytest.fixture(scope="module")
def insults(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["th", "on", "er", "an", "re", "st", "ing"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(900):
        words = [word() for _ in range(rng.randint(20, 60))]
        if i % 3 == 0:
            for bad in rng.sample(["blockhead", "dimwit", "numbskull"], 2):
                words.insert(rng.randrange(len(words)), bad)
        docs.append((i, " ".join(words), "en", "clash"))
        labels.append((i, 1, int(i % 3 == 0)))
    clean = " ".join(word() for _ in range(50))
    extra = {2001: clean, 2002: clean + " dim-wit", 2003: clean + " d i m w i t", 2004: clean + " blockkhead", 2005: "DIMWIT", 2006: "", 2007: None, 2008: "?!", 2009: clean * 300 + " numbskull"}
    docs += [(k, v, None, None) for k, v in extra.items()] + [(2005, "DIMWIT", None, None), (None, clean, None, None)]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_tolerates_gaps_and_insertions(spark, insults):
    docs, labels = insults
    out = toxicity.toxicity_digest(docs, labels).collect()
    assert len(out) == docs.count()
    got = {r.doc_id: r.predicted for r in out}
    assert [got[k] for k in range(2001, 2010)] == [0, 1, 1, 1, 1, 0, 0, 0, 1] and got[None] == 0
    kept = {r.doc_id for r in toxicity.remove_toxic(docs, labels).collect()}
    assert 2001 in kept and 2002 not in kept and None in kept
    assert toxicity.remove_toxic(docs, labels).columns == docs.columns


def test_without_labels(spark, insults):
    docs, labels = insults
    none = labels.where("false")
    assert {r.score for r in quality.quality_digest(docs.limit(20), none).collect()} == {0.5}
    assert {r.predicted for r in toxicity.toxicity_digest(docs.limit(20), none).collect()} == {0}
    assert quality.quality_digest(docs.where("false"), labels).collect() == []
    assert toxicity.toxicity_digest(docs.where("false"), labels).collect() == []


def subsequences(x):
    """Every gapped subsequence of three and four characters within six, one by one, with its weight."""
    out = Counter()
    for n in (3, 4):
        for at in itertools.combinations(range(len(x)), n):
            if at[-1] - at[0] < 6:
                out[bytes(x[i] for i in at)] += 0.6 ** (at[-1] - at[0] - (n - 1))
    return out


def most(x):
    """What a unit of that length can share with itself, were all its subsequences different."""
    return math.sqrt(sum(0.6 ** (2 * (at[-1] - at[0] - (n - 1))) for n in (3, 4) for at in itertools.combinations(range(len(x)), n) if at[-1] - at[0] < 6))


def kernel_by_hand(a, b):
    x, y = b"\0" + a + b"\0", b"\0" + b + b"\0"
    one, other = subsequences(x), subsequences(y)
    return sum(v * other[u] for u, v in one.items()) / most(x) / most(y) + toxicity.SAME**2 * (a == b)


def test_table_is_the_kernel():
    """A decision equals the bias plus the landmarks' weighted kernel values."""
    rng = random.Random(1)
    landmarks = sorted({bytes(rng.choices(range(1, 6), k=rng.randint(2, 9))) for _ in range(6)})
    others = [bytes(rng.choices(range(1, 6), k=rng.randint(1, 12))) for _ in range(20)]
    alpha = np.array([0.5, -1.0, 2.0, 0.25, 1.5, -0.75])[: len(landmarks)]
    who, feature, value = toxicity._vectors(landmarks)
    table = np.zeros(3 << toxicity.BITS)
    np.add.at(table, feature, value * alpha[who])
    words = landmarks + others
    chars, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    found = toxicity.Model(table, 0.25, 1.0, 0.0).decide(chars, np.append(0, ends[:-1]), ends)
    for w, d in zip(words, found):
        assert d == pytest.approx(0.25 + sum(k * kernel_by_hand(w, x) for k, x in zip(alpha, landmarks)), abs=1e-4)


def test_accented_letters_spelled_out_are_one_unit():
    data = np.frombuffer("un c r é t i n ici".encode(), np.uint8)
    _, starts, ends, row = toxicity.units(data, np.array([0, len(data)]))
    assert (ends - starts).tolist() == [2, 7, 3] and row.tolist() == [0, 0, 0]


def test_votes_by_hand():
    """The score of quality's vote, with every cosine taken one by one."""
    rng = np.random.default_rng(2)
    counts = np.abs(rng.normal(size=(90, quality.TERMS))).astype(np.float32) * (rng.random((90, quality.TERMS)) < 0.05)
    y = (np.arange(60) % 3 == 0).astype(int)
    model = quality.Model(counts[:60], y, (300.0, 100.0))
    got = model.score(np.vstack([counts[60:], np.zeros((1, quality.TERMS), np.float32)]))
    for k in range(30):
        v = (counts[60 + k] * model.idf) @ model.directions
        near = []
        for i in range(60):
            u = (counts[i] * model.idf) @ model.directions
            near.append((float(v @ u / np.linalg.norm(v) / np.linalg.norm(u)), i))
        votes = [(max(c, 0) ** 8 * (100 / 20 if y[i] else 300 / 40), y[i]) for c, i in sorted(near, reverse=True)[: quality.NEIGHBOURS]]
        assert got[k] == pytest.approx(sum(w for w, good in votes if good) / sum(w for w, _ in votes), abs=1e-3)
    assert got[30] == 0.25
