"""Top-k search, mixing and decontamination against plain Python."""

import hashlib
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from parlance.llm import decontaminate, mixing, topk

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_is_exact(spark, seed):
    rng = random.Random(seed)
    same = [rng.uniform(-1, 1) for _ in range(8)]
    rows = [(i, list(same) if rng.random() < 0.4 else [rng.uniform(-1, 1) for _ in range(8)]) for i in range(400)]
    rows += [(1000, None), (1001, [None] * 8), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (None, same), (1004, [1.0])]
    frame = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, id string").repartition(3)
    import numpy as np

    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for q, qv in good:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in good if i != q)[:5]
            want |= {(q, r): (i, -s) for r, (s, i) in enumerate(best, 1)}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(frame).collect()}
    assert got == want and len(want) == 40
    assert topk.top_k(frame.where("vec_id is null")).collect() == []
    assert len(topk.top_k(frame.where("vec_id <= 2")).collect()) == 2


def contamination_by_hand(text, items):
    words = WORD.findall(low(text))
    hit, found = set(), set()
    for item, body in items:
        w = WORD.findall(low(body))
        size = min(13, len(w))
        for window in {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w and item is not None else ():
            for s in range(len(words) - size + 1):
                if tuple(words[s : s + size]) == window:
                    hit |= set(range(s, s + size))
                    found.add(str(item))
    return len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)


def test_decontamination_matches_python(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["the", "of", "Élan", "éclair", "a", "stone", "RIVER", "ß", "x1", "ocean"]
    some = lambda n: rng.choices(vocabulary, k=n)
    items = [(k, " ".join(some(rng.choice([1, 3, 12, 13, 14, 30])) + ["z%d" % (k % 7)])) for k in range(20)] + [(30, None), (None, "the of a stone"), (31, "--"), (32, "tiny")]
    rows = [(0, None), (1, ""), (2, "?!"), (2, "?!"), (3, "Tiny " + "w " * 19), (4, "tiny " + "w " * 20), (None, "tiny")]
    for i in range(60):
        words = some(rng.choice([0, 5, 40, 300]))
        for _ in range(rng.choice([0, 1, 2])):
            at = rng.randint(0, len(words))
            words[at:at] = (rng.choice(items)[1] or "").split()[: rng.choice([99, 13, 12])]
        rows.append((100 + i, rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in words)))
    rows += rows[-10:]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, h string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in rows:
        n, hit, found, bad = contamination_by_hand(t, items)
        want.append((str(i), n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bad))
    for windows, anchors in ((200_000, 20_000), (0, 3)):
        monkeypatch.setattr(decontaminate, "MAX_WINDOWS", windows)
        monkeypatch.setattr(decontaminate, "MAX_ANCHORS", anchors)
        got = [(str(r[0]), *r[1:]) for r in decontaminate.decontamination_digest(docs, bench).collect()]
        assert sorted(got) == sorted(want)
    assert any(w[5] for w in want) and not all(w[5] for w in want)
    kept = decontaminate.remove_documents(docs, bench).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted((str(i), str(t)) for (i, t), w in zip(rows, want) if not w[5])
    cleaned = decontaminate.remove_spans(docs.select("doc_id", "text"), bench).collect()
    assert len(cleaned) == len(rows)
    left = sorted((str(r.doc_id), len(WORD.findall(low(r.text)))) for r in cleaned)
    assert left == sorted((w[0], w[1] - w[2]) for w in want)
    nothing = decontaminate.decontamination_digest(docs, bench.where("false")).collect()
    assert len(nothing) == len(rows) and not any(r.contaminated for r in nothing)
    assert decontaminate.decontamination_digest(docs.where("false"), bench).collect() == []


def test_raking_meets_marginals_and_keeps_by_probability(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 30) + rng.choice(["", "@", " | ", "Copyright"]), rng.choice("ab") if rng.random() < 0.3 else "hot", rng.choice(["en", "de", None]), 0.5) for i in range(3000)]
    rows += [(9000, None, "empty", "en", 0.1), (None, "", None, None, None)] + rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, probability double")
    cells = [r.asDict() for r in mixing.probabilities(docs, flatten=0.5).collect()]
    total = sum(c["tokens"] for c in cells)
    # the same by hand
    key = lambda c: (c["__source"], c["__lang"], c["__topic"])
    weight = {key(c): float(c["tokens"]) for c in cells}
    goal = []
    for d in range(3):
        names = {k[d] for k, w in weight.items() if w}
        sums = {n: sum(w for k, w in weight.items() if k[d] == n) ** 0.5 for n in names}
        goal.append({n: s / sum(sums.values()) * total for n, s in sums.items()})
    for _, d in itertools.product(range(60), range(3)):
        now = {}
        for k, w in weight.items():
            now[k[d]] = now.get(k[d], 0) + w
        weight = {k: w * goal[d].get(k[d], 0) / now[k[d]] if now[k[d]] else w for k, w in weight.items()}
    for c in cells:
        assert c["weight"] == pytest.approx(weight[key(c)], rel=1e-4, abs=1e-6)
    top = max(weight[key(c)] / c["tokens"] for c in cells if c["tokens"])
    p = {key(c): weight[key(c)] / c["tokens"] / top if c["tokens"] else 1.0 for c in cells}
    kept = mixing.mix(docs, flatten=0.5)
    assert kept.columns == docs.columns
    n = kept.count()
    want = sum(p[key(r)] for r in mixing.keyed(docs).collect())
    assert abs(n - want) < 4 * math.sqrt(want) + 5
    assert sorted(map(str, kept.collect())) == sorted(map(str, mixing.mix(docs.repartition(3), flatten=0.5).select(docs.columns).collect()))
    assert kept.where("doc_id = 9000").count() == 1
    assert mixing.mix(docs.where("false")).collect() == []
    to = spark.createDataFrame([("hot", 0.5), ("a", 0.5), ("absent", 9.0)], "category string, share double")
    fitted = {r["__source"]: r.w for r in mixing.probabilities(docs, {"source": to}).groupBy("__source").agg(F.sum("weight").alias("w")).collect()}
    assert fitted["hot"] == pytest.approx(total / 2, rel=0.02) and fitted["b"] == pytest.approx(0)
