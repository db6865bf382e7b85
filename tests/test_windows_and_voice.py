"""Stitching by the longest agreement, two-threshold speech, and streamed answers, against plain Python."""

import json
import random

import pytest

from parlance.operators import spans
from parlance.streaming import states
from tests.test_states import Feed, at


def test_borders():
    rng = random.Random(6)
    for _ in range(4000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in "xy")
        most = rng.choice([None, 0, 2, 5])
        limit = min(len(a), len(b), len(b) if most is None else most)
        assert spans.border(a, b, most) == max(n for n in range(limit + 1) if a.endswith(b[:n]))
    assert spans.border("x" + "ab" * 200_000, "ab" * 300_000) == 400_000


@pytest.mark.parametrize("size, step, most", [(50, 30, None), (7, 5, 2), (3, 2, 1)])
def test_stitched_windows_are_the_text(spark, size, step, most):
    rng = random.Random(size)
    texts = {k: "".join(rng.choice("abcdefghij 😀é\n") for _ in range(rng.randint(1, 400))) for k in range(20)} | {90: "aaaa" * 30 if most else "q", 91: ""}
    rows = [(k, i, t[i * step : i * step + size]) for k, t in texts.items() for i in range(max(1, -(-(len(t) - (size - step)) // step)))] + [(92, 0, None), (92, 1, "x")]
    got = {r.k: r.text for r in spans.stitched(spark.createDataFrame(rows, "k int, i int, text string"), ["k"], "i", most=most).collect()}
    assert got == texts | {92: "x"}


def voiced_by_hand(frames, high, low, frame_ms, min_speech, min_silence):
    on, out = False, []
    for at_ms, p in frames:
        now = True if p >= high else False if p < low else on
        if now and not on:
            out.append([at_ms, None])
        elif on and not now:
            out[-1][1] = at_ms
        on = now
    if on:
        out[-1][1] = frames[-1][0] + frame_ms
    joined = []
    for a, b in out:
        if joined and a - joined[-1][1] < min_silence:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    return [(a, b) for a, b in joined if b - a >= min_speech]


@pytest.mark.parametrize("chunk", [100, 1000, 10**9])
def test_speech_by_two_thresholds_across_chunks(spark, chunk):
    rng, rows = random.Random(7), []
    for rec in range(12):
        p = rng.random()
        for k in range(rng.randint(1, 300)):
            p = min(1.0, max(0.0, p + rng.uniform(-0.3, 0.3)))
            rows.append((rec, 32 * k, p))
    got = {}
    for r in spans.voiced(spark.createDataFrame(rows, "rec int, at_ms long, probability double"), ["rec"], 0.6, 0.4, 32, 100, 96, chunk).orderBy("rec", "start_ms").collect():
        got.setdefault(r.rec, []).append((r.start_ms, r.end_ms))
    want = {rec: voiced_by_hand([(a, p) for k, a, p in rows if k == rec], 0.6, 0.4, 32, 100, 96) for rec in range(12)}
    assert got == {k: v for k, v in want.items() if v}


def test_streamed_answers_come_once_and_whole(spark, tmp_path):
    rng, rows = random.Random(8), []
    texts = {f"s{k}": [rng.choice(["the ", "é", "", "😀 x", "end"]) for _ in range(rng.randint(1, 12))] for k in range(8)}
    for k, pieces in texts.items():
        rows += [{"stream_id": k, "ts": at(i), "n": i, "piece": p, "last": i == len(pieces) - 1} for i, p in enumerate(pieces)]
    rows += rng.sample(rows, 10)
    rng.shuffle(rows)
    gap = [{"stream_id": "gap", "ts": at(0), "n": n, "piece": f"p{n}", "last": n == 3} for n in (0, 1, 3)]
    feed = Feed(spark, tmp_path, states.PIECES, lambda s: states.token_texts(s, "30 minutes", 600_000, 3_600_000))
    feed.put(gap)
    for k in range(0, len(rows), 9):
        feed.put(rows[k : k + 9])
    feed.put([{"stream_id": "clock", "ts": at(300), "n": 1, "piece": "", "last": False}])
    feed.run()
    feed.put([dict(rows[0], ts=at(2)), {"stream_id": "clock", "ts": at(301), "n": 2, "piece": "", "last": False}])
    out = feed.run()
    assert sorted((r.stream_id, r.status, r.n_pieces, r.text) for r in out if r.stream_id != "clock") == sorted([("gap", "stalled", 2, "p0p1"), *((k, "done", len(v), "".join(v)) for k, v in texts.items())])
    left = spark.read.format("statestore").option("path", feed.checkpoint).option("stateVarName", "progress").load()
    assert {r[0] for r in left.selectExpr("key.stream_id").collect()} <= {"clock"}
    assert json.dumps(rows[0])
