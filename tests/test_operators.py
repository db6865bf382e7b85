"""The library's operators against hand-worked values."""

import io
import math
import random
import wave

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators import alignment, iterative_cut, models, reports, spans, speakers
from parlance.sources import transcripts
from parlance.streaming import jobs


def one(spark, schema, rows, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_tagged_transcripts(spark):
    raw = ["[0.00][S01]是我用AI跑出来的。[1.50]", "[0.00][S01]a\nb[1.50][2][S02]c[3.25]", "noise [x]", ""]
    got = one(spark, "t string", [(r,) for r in raw], tx.parse_tagged(F.col("t")))
    assert [[tuple(s) for s in g] for g in got] == [[(0.0, "S01", "是我用AI跑出来的。", 1.5)], [(0.0, "S01", "a\nb", 1.5), (2.0, "S02", "c", 3.25)], [], []]


def test_lexicon(spark):
    texts = ["對對對", "不對", "對不起", "面對", "對的", "沒錯對啊確實"]
    assert one(spark, "t string", [(t,) for t in texts], F.size(tx.spans_of(F.col("t"), tx.LEXICON))) == [3, 0, 0, 1, 1, 3]
    hits = reports.kwic(spark.createDataFrame([(1, "沒錯對啊確實")], "id int, text string"), tx.LEXICON, 1).orderBy("start").collect()
    assert [(h.start, h.end, h.match, h.prev, h.next, h.around) for h in hits] == [(0, 2, "沒錯", "^", "對", "沒錯對"), (2, 3, "對", "錯", "啊", "錯對啊"), (4, 6, "確實", "啊", "$", "啊確實")]


def test_units(spark):
    t = [("對abc 12,好x",)]
    assert one(spark, "t string", t, tx.units(F.col("t"))) == [["對", "abc", "12", "好", "x"]]
    assert one(spark, "t string", t, tx.unit_index(F.col("t"))) == [[0, 1, 1, 1, None, 2, 2, None, 3, 4]]
    assert one(spark, "t string", [("don't 好的 é2!",)], tx.units_wide(F.col("t"))) == [["don't", "好", "的", "é2"]]
    assert one(spark, "t string", [("don't-do 好",)], tx.units_early(F.col("t"))) == [["don't-do", "好"]]


def test_times_and_names(spark):
    assert one(spark, "s double", [(3661.5,), (59.9996,)], tx.timecode(F.col("s"))) == ["01:01:01.500", "00:00:60.000"]
    assert one(spark, "s double", [(59.9996,)], tx.timecode(F.col("s"), carry=True)) == ["00:01:00.000"]
    assert one(spark, "s double", [(3661.5,), (-1.0,)], tx.ass_time(F.col("s"))) == ["1:01:01.50", "0:00:00.00"]
    assert one(spark, "f string", [("A.WAV",), ("noext",), ("x.my_long-suffix9",)], tx.suffix(F.col("f"))) == [".wav", ".audio", ".mylongsuf"]
    assert one(spark, "f string", [(" a, b，,c ",)], tx.hot_words(F.col("f"))) == ["a, b, c"]
    assert one(spark, "a string, b string", [("", "S1"), (None, ""), ("G1", "S1")], tx.named_speaker(F.col("a"), F.col("b"))) == ["S1", "UNKNOWN", "G1"]
    assert one(spark, "p array<string>", [(["x", "y"],)], tx.highlight(F.col("p"), F.lit(1), "<", ">")) == ["x<y>"]
    assert one(spark, "n int", [(7,), (10,)], tx.wrap_pad(F.col("n"), 5)) == [3, 0]


def test_model_answers(spark):
    rows = [('```json\n{"a": 1}\n```',), ("plain words",), ('{"a": 2}',)]
    got = one(spark, "t string", rows, tx.json_or_raw(F.col("t"), "a int"))
    assert [(g.value.a if g.value else None, g.raw_response) for g in got] == [(1, None), (None, "plain words"), (2, None)]
    assert one(spark, "t string", [('{"triples":[{"subject":"s","predicate":"p","object":"o"}]}',)], F.size(tx.triples(F.col("t")))) == [1]
    bins = [0.0] * 12
    bins[2] = bins[3] = 5.0
    bins[4 + 0] = 1.0
    bins[8 + 3] = 9.0
    assert one(spark, "l array<double>", [(bins,), (bins[:5],)], tx.argmax_bins(F.col("l"), 4)) == [[160, 0, 240], None]
    paired = one(spark, "w array<string>, m array<int>", [(["a", "b"], [0, 160, 160, 320]), (["a", "b"], [0, 1, 2])], tx.paired(F.col("w"), F.col("m"), 1.0))
    assert [tuple(x) for x in paired[0]] == [("a", 1.0, 1.16), ("b", 1.16, 1.32)] and paired[1] is None


@pytest.mark.parametrize(("x", "want"), [
    ([0, 80, 400, 160, 240], [0, 80, 80, 160, 240]), ([0, 80, 900, 880, 860, 160, 240], [0, 80, 100, 120, 140, 160, 240]), ([0, 80, 900, 880, 160, 240], [0, 80, 80, 160, 160, 240]),
    ([500, 0, 80, 160], [0, 0, 80, 160]), ([0, 80, 160, 40], [0, 80, 160, 160]), ([], []),
])
def test_repair_goldens(x, want):
    assert alignment.repair(x) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=30))
def test_repair_never_falls_and_keeps_order(x):
    out = alignment.repair(x)
    assert out == sorted(out) and len(out) == len(x)
    if x == sorted(x):
        assert out == x


def test_kept_counts():
    def keep(n):
        for _ in range(2):
            n = speakers.kept_count(n)
        return n

    assert [keep(n) for n in (1, 2, 3, 4, 5, 12, 20, 50, 100)] == [1, 2, 3, 3, 3, 3, 5, 12, 25]


def test_windows(spark):
    def windows(dur, overlap, stop):
        rows = spans.windows(spark.createDataFrame([(dur,)], "d long"), "d", 30, overlap, stop).orderBy("k").collect()
        return [(r.start_ms, r.end_ms) for r in rows]

    assert windows(58, 2, False) == [(0, 30), (28, 58), (56, 58)]
    assert windows(57, 3, True) == [(0, 30), (27, 57)]
    assert windows(58, 3, True) == [(0, 30), (27, 57), (54, 58)]
    assert windows(0, 3, True) == []


def test_islands_are_idempotent(spark):
    rows = [(1, 0, 1000), (1, 1030, 2000), (1, 1500, 1600), (1, 3000, 4000), (2, 0, 10)]
    frame = spark.createDataFrame(rows, "k int, start_ms long, end_ms long")
    once = spans.islands(frame, ["k"], [])
    got = sorted((r.k, r.start_ms, r.end_ms, r.n) for r in once.collect())
    assert got == [(1, 0, 2000, 3), (1, 3000, 4000, 1), (2, 0, 10, 1)]
    again = sorted((r.k, r.start_ms, r.end_ms) for r in spans.islands(once.drop("n"), ["k"], []).collect())
    assert again == [g[:3] for g in got]


def test_overlap_join_meets_each_pair_once(spark):
    rng = random.Random(1)
    make = lambda n: [(rng.randrange(2), i, (s := rng.randrange(900)), s + rng.randrange(1, 400)) for i in range(n)]
    a, b = make(40), make(40)
    left = spark.createDataFrame(a, "k int, id int, start_ms long, end_ms long")
    right = spark.createDataFrame(b, "k int, r_id int, r_start_ms long, r_end_ms long")
    got = sorted((r.id, r.r_id) for r in spans.overlap_join(left, right, ["k"], 100).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])


def test_iterative_cut_statuses():
    talk = [(0, 900, "S1", "a"), (1000, 2500, "S2", "b"), (2600, 3400, "S1", "c"), (3500, 9000, "S2", "d"), (9100, 9500, "S1", "e")]
    hear = lambda a, b: [(max(s, a) - a, min(e, b) - a, w, t) for s, e, w, t in talk if s < b and e > a]
    rows = list(iterative_cut.plan(10_000, hear, nominal=5000))
    assert [r["status"] for r in rows] == ["ok", "ok", "fallback-blind-cut", "final"]
    assert rows[0]["end_cut_abs_ms"] == 2500 and rows[1]["start_abs_ms"] == 2200
    assert [k["text"] for k in rows[0]["kept"]] == ["a", "b"]
    assert [r["status"] for r in iterative_cut.plan(3000, lambda a, b: [], 1500)] == ["empty-advance", "final-empty"]


def groups_of(seed, parts=4, per=3, dim=6):
    rng = np.random.default_rng(seed)
    part = [p for p in range(parts) for _ in range(per)]
    c = rng.normal(size=(len(part), dim))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    kept = [c[i] + 0.5 * rng.normal(size=(4, dim)) for i in range(len(part))]
    return part, c, kept


def all_shares(clusters, parts, centroid, kept):
    """Share of each cluster's kept vectors that are nearest to each cluster it may merge with."""
    centres = np.array([centroid[c].mean(0) for c in clusters])
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    out = np.zeros((len(clusters), len(clusters)))
    for i, c in enumerate(clusters):
        allowed = [j for j in range(len(clusters)) if not parts[i] & parts[j]]
        ballots = np.concatenate([kept[m] for m in c])
        if allowed and len(ballots):
            out[i, allowed] = np.bincount(np.argmax(ballots @ centres[allowed].T, axis=1), minlength=len(allowed)) / len(ballots)
    return out


def stopped_at(part, c, kept, tau):
    """The partition by merging only while the best affinity is above tau."""
    clusters, parts = [[i] for i in range(len(part))], [{p} for p in part]
    while True:
        a = all_shares(clusters, parts, c, kept)
        both, best = np.minimum(a, a.T), None
        for i in range(len(clusters)):
            for j in range(i + 1, len(clusters)):
                if not parts[i] & parts[j] and (best is None or both[i, j] > both[best]):
                    best = (i, j)
        if best is None or both[best] <= tau:
            return sorted(tuple(sorted(x)) for x in clusters)
        i, j = best
        clusters[i], parts[i] = clusters[i] + clusters[j], parts[i] | parts[j]
        del clusters[j], parts[j]


@pytest.mark.parametrize("seed", range(12))
def test_one_merge_run_gives_every_threshold(seed):
    part, c, kept = groups_of(seed)
    log = speakers.agglomerate(part, c, kept)
    for m in log:
        assert len({part[i] for i in m["members"]}) == len(m["members"])
    for tau in speakers.TAUS:
        assert [tuple(x) for x in speakers.partition_at(log, len(part), tau)] == stopped_at(part, c, kept, tau)


def test_plateaus(spark):
    def auto(stab):
        rows = [(0, i, t, s) for i, (t, s) in enumerate(zip(speakers.TAUS, stab))]
        return speakers.auto_tau(spark.createDataFrame(rows, "r int, i int, tau double, stability double"), ["r"]).first().auto_tau

    assert auto([None] + [1.0] * 12) == 0.4
    assert auto([None, 1.0, 1.0, 1.0, 1.0, 0.5, 0.9, 0.5, 0.9, 1.0, 1.0, 1.0, 1.0]) == 0.2


def test_empty_pair_sets_are_alike(spark):
    rows = [(0, 0, []), (0, 1, []), (0, 2, ["0-1"]), (0, 3, ["0-1", "0-2"])]
    out = speakers.stabilities(spark.createDataFrame(rows, "r int, i int, pairs array<string>"), ["r"]).orderBy("i").collect()
    assert [r.stability for r in out] == [None, 1.0, 0.0, 0.5]


def test_even_sample_and_margin(spark):
    rows = [(g, i, [float(g == 0), float(g == 1)]) for g in (0, 1) for i in range(20 if g else 5)]
    frame = spark.createDataFrame(rows, "speaker int, vec_id int, embedding array<double>").withColumn("recording_id", F.lit(0))
    n = {r.speaker: r["count"] for r in speakers.evenly_sampled(frame, ["speaker"], "vec_id").groupBy("speaker").count().collect()}
    assert n == {0: 5, 1: 8}
    assert speakers.separation(frame, ["recording_id"]).first().margin == pytest.approx(1.0)


def test_combined_json_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"video_id": "v", "parts": [{"part": 0, "start_abs_s": 1.5, "duration_s": 2, "status": "ok"}, {"index": 1, "offset_s": 3.5, "duration_s": 2}], "segments": [{"start": 0.25, "end": 1.0, "speaker": "S01", "text": "好", "part": 0}]}', encoding="utf-8")
    doc = transcripts.read_combined(spark, str(tmp_path / "a.json"))
    assert [(p.part, p.offset_ms, p.status) for p in transcripts.parts(doc).orderBy("part").collect()] == [(0, 1500, "ok"), (1, 3500, "ok")]
    seg = transcripts.segments(doc)
    assert [tuple(r)[1:] for r in seg.collect()] == [(0, 0, 250, 1000, "S01", "好", None)]
    transcripts.write_segments(seg, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    assert transcripts.result(seg).first().speaker == "S01"


def test_audio_sources(spark, tmp_path):
    for name in ("ann.wav", "bob.wav"):
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(2), w.setsampwidth(2), w.setframerate(16000)
            w.writeframes(np.array([[16384, 0]] * 8, "<i2").tobytes())
    (tmp_path / "c.mp3").write_bytes(b"not audio")
    files = transcripts.audio_files(spark, str(tmp_path))
    assert sorted(r.speaker for r in transcripts.speakers(files).collect()) == ["ann", "bob", "c"]
    got = {r.path[-7:]: r for r in transcripts.decoded(files).collect()}
    assert got["ann.wav"].n == 8 and got["ann.wav"].rate == 16000 and got["ann.wav"].samples == [0.25] * 8

    names = spark.createDataFrame([(1, "a.wav"), (2, "a.wav"), (3, "b.wav")], "t int, name string")
    assert [r.stored for r in transcripts.without_collisions(names, "t").orderBy("t").collect()] == ["a.wav", "a_1.wav", "b.wav"]
    assert transcripts.renamed(names, "a.wav", "b.wav").where("name = 'a.wav'").count() == 2


def test_subtitles_and_manifest(spark):
    rows = spark.createDataFrame([(1, 0, 500, [("a", 0, 10), ("b", 100, 400)])], "seg_id int, start_ms long, end_ms long, units array<struct<unit:string,start_ms:long,end_ms:long>>")
    out = [r.event for r in transcripts.subtitle_events(rows).orderBy("k").collect()]
    assert out[0] == "Dialogue: 0,0:00:00.00,0:00:00.50,Default,,0,0,0,,ab" and "0:00:00.00,0:00:00.08" in out[1] and len(out) == 3
    m = transcripts.manifest(spark.createDataFrame([("r", 61000, 61500)], "recording_id string, start_ms long, end_ms long"), "out").first()
    assert (m.file, m.timecode, m.duration_ms) == ("out/clip_0001.mkv", "00:01:01.000", 500)


def test_models_at_the_boundary(spark):
    audio = spark.createDataFrame([(1, b"abc"), (2, b"")], "id int, audio binary")
    heard = models.requests(audio, "transcribe", limit=1, at_once=1).select("id", F.size(tx.parse_tagged(F.col("raw"))).alias("n")).collect()
    assert [r.n for r in heard] == [1, 1]
    assert models.apply(audio, "embed").select(F.size("embedding")).distinct().first()[0] == 16
    tries = []

    def shaky(x):
        tries.append(x)
        if len(tries) < 3:
            raise OSError
        return x

    assert models.with_retries(shaky, sleep=lambda s: None)(7) == 7 and len(tries) == 3


def test_job_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k, kind in enumerate(["upload", "start", "finish"]):
        (source / f"{k}.json").write_text(f'{{"job_id": "j1", "ts": "2024-01-01T00:0{k}:00", "kind": "{kind}"}}\n')
    events = jobs.read_events(spark, str(source), per_batch=10)
    q = jobs.state_changes(events).writeStream.format("memory").queryName("jobs_out").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert [(r.job_id, r.status, r.n_events) for r in spark.sql("select * from jobs_out").collect()] == [("j1", "done", 3)]
    seen = []
    q = jobs.run_queue(events, lambda df, n: seen.extend(r.job_id for r in df.collect()), str(tmp_path / "c2"))
    q.processAllAvailable()
    q.stop()
    assert seen == ["j1"]


def test_waveforms(spark):
    wave_ = [0.0, 0.0, 1.0, -2.0, 3.0, 0.0, 0.0, 0.0]
    frame = spark.createDataFrame([(wave_, wave_[2:] + [0.0, 0.0]), (wave_, wave_), (wave_, None)], "a array<double>, b array<double>")
    assert [r["shift"] for r in alignment.best_shift(frame, "a", "b", 3).collect()] == [2, 0, None]
    assert frame.select(transcripts.peak_normalised(F.col("a"))).first()[0][3:5] == pytest.approx([-2 / 3, 1.0])
    assert [len(x) for x in frame.select(transcripts.blocks(F.col("a"), 3)).first()[0]] == [3, 3, 2]
    bounds = transcripts.sample_range(F.lit(0.25), F.lit(0.5), 8)
    assert frame.select(transcripts.sliced(F.col("a"), bounds)).first()[0] == [1.0, -2.0]
