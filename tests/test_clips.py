"""Clips from matches, slices of audio, labels, and the streams' orders."""

import io
import json
import random
import wave

import numpy as np
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators import alignment, clips, iterative_cut, spans, speakers
from parlance.sources import transcripts
from parlance.streaming import jobs

MATCH = "array<struct<word:string,start_ms:long,end_ms:long,raw_start_ms:long,raw_end_ms:long,valid:boolean>>"


def test_clips_merge_in_match_order_and_across_segments(spark):
    m = lambda word, a, b, ra=None, rb=None, valid=None: (word, a, b, ra, rb, valid)
    rows = [
        # the third is earlier than the second, so it joins what the second made; an invalid and a timeless one don't count
        (1, 1, None, [m("a", 1000, 1200), m("b", 5000, 5100), m("c", 4000, 5150), m("d", 0, 9, valid=False), m("e", None, 4)]),
        (1, 2, True, [m("f", 5190, 5300, valid=True), m("g", 9000, 9000, 9000, 9400), m("h", 9900, 9900, 9900, 9800)]),
        (1, 3, False, [m("x", 100, 900)]),
        (1, 4, True, [m("y", 1, 2, valid=False)]),
    ]
    segments = spark.createDataFrame(rows, f"rec int, seg_id int, ok boolean, matches {MATCH}")
    got = clips.clip_list(segments, ["rec"], F.lit(20_000)).orderBy("index").collect()
    assert [(r.start_ms, r.end_ms, r.words, r.sources) for r in got] == [
        (1000, 1300, ["a"], ["fixed"]), (5000, 5300, ["b", "c", "f"], ["fixed"] * 3), (9000, 9400, ["g"], ["raw_window"]), (9700, 10100, ["h"], ["t_pad"]),
    ]
    assert [r.file for r in got][:2] == ["clips/clip_0001.mkv", "clips/clip_0002.mkv"] and got[1].timecode == "00:00:05.000"
    plan = clips.encode_plan(clips.clip_list(segments, ["rec"], F.lit(20_000)), "nvenc", limit=2).orderBy("index").collect()
    assert [(r.seek_s, r.length_s, r.codec, r.tries, r.waits_s) for r in plan] == [("1.000", "0.300", "h264_nvenc", 3, [2.0, 4.0]), ("5.000", "0.300", "h264_nvenc", 3, [2.0, 4.0])]


def test_matches_meet_their_units(spark):
    rows = [("對 abc對確實", [("對", 0, 80), ("abc", 80, 160), ("對", 160, 160), ("確", 160, 240), ("實", 240, 320)])]
    frame = spark.createDataFrame(rows, "text string, units array<struct<unit:string,start_ms:long,end_ms:long>>")
    got = frame.select(clips.matched_units(F.col("text"), F.col("units"))).first()[0]
    assert [(m.word, m.start, m.end, m.first, m.last, m.start_ms, m.end_ms, m.issue) for m in got] == [
        ("對", 0, 1, 0, 0, 0, 80, None), ("對", 5, 6, 2, 2, 160, 160, "empty span"), ("確實", 6, 8, 3, 4, 160, 320, None),
    ]
    space = frame.select(clips.matched_units(F.col("text"), F.col("units"), " ")).first()[0]
    assert space[0].issue == "no unit" and space[0].start_ms is None


def test_phrases_before_characters(spark):
    said = spark.createDataFrame([("头发发展\n发",)], "t string").select(tx.convert_phrases(F.col("t"), {"头发": "頭髮", "发展": "發展"}, "发", "發")).first()[0]
    assert said == "頭髮發展\n發"


def test_slices_are_exact_to_the_sample(spark, tmp_path):
    samples = (np.arange(4000) % 300).astype(int).tolist()
    audio = spark.createDataFrame([(1, samples)], "rec int, samples array<int>")
    where = spark.createDataFrame([(1, 0.0, 0.1), (1, 0.1, 0.25), (1, 0.2, 9.0)], "rec int, start_s double, end_s double")
    transcripts.write_slices(audio, where, ["rec"], str(tmp_path / "s"))
    got = {}
    for r in spark.read.parquet(str(tmp_path / "s")).collect():
        with wave.open(io.BytesIO(r.content)) as w:
            assert (w.getframerate(), w.getnchannels(), w.getsampwidth()) == (16000, 1, 2)
            got[r.start_s] = np.frombuffer(w.readframes(w.getnframes()), "<i2").tolist()
    assert got == {0.0: samples[:1600], 0.1: samples[1600:4000], 0.2: samples[3200:]}


def test_names_are_never_overwritten(spark):
    names = spark.createDataFrame([(1, "x.wav"), (2, "x.wav"), (3, "x_1.wav"), (4, "y")], "k int, name string")
    stored = [r.stored for r in transcripts.without_collisions(names, "k").orderBy("k").collect()]
    assert stored[0] == "x.wav" and stored[2:] == ["x_1.wav", "y"] and len(set(stored)) == 4
    assert sorted(r.name for r in transcripts.without_stem(names, "x").collect()) == ["x_1.wav", "y"]


def test_labels_and_ties(spark):
    groups = spark.createDataFrame([(0, 0, "S1", 50), (0, 1, "S1", 10), (0, 2, "S2", 90), (0, 2, "S3", 1)], "rec int, part int, speaker string, first_ms int")
    clusters = spark.createDataFrame([(0, 0, "S1", 7), (0, 2, "S2", 7), (0, 1, "S1", 3)], "rec int, part int, speaker string, cluster int")
    got = {(r.part, r.speaker): (r.gid, r.resolved) for r in speakers.labels(clusters, groups, ["rec"]).collect()}
    assert got == {(1, "S1"): ("G01", True), (0, "S1"): ("G02", True), (2, "S2"): ("G02", True), (2, "S3"): ("U_p2_S3", False)}
    tally = spark.createDataFrame([(0, 0, "S1", 1, s, 4) for s in ("S3", "S1", "S2")], "rec int, part int, speaker string, t_part int, t_speaker string, n long")
    assert speakers.majority(tally, ["rec"]).first().winner.t_speaker == "S1"


def test_repeat_flags(spark):
    lines = ["abcdef", "abcdef", "abcdeg", "", "", "x", "xy", "xy"]
    flags = spark.createDataFrame([(lines,)], "l array<string>").select(spans.repeat_flags(F.col("l"))).first()[0]
    assert flags == [False, True, False, False, True, False, False, True]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "d int, k int, text string")
    assert [r.repeats for r in spans.near_repeats(rows, ["d"], "k").orderBy("k").collect()] == flags


def test_fades_sum_to_one_over_an_overlap(spark):
    rows = spark.range(100).select(spans.fade(F.col("id"), F.lit(100), 9).alias("w")).collect()
    w = [r.w for r in rows]
    assert all(abs(a + b - 1) < 1e-9 for a, b in zip(w[91:], w[:9])) and w[50] == 1.0


def written(folder, rows):
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps(r) for r in rows))


def test_a_job_of_one_moment_is_done(spark, tmp_path):
    written(tmp_path / "in", [{"job_id": "j", "ts": "2024-01-01T00:00:00Z", "kind": k} for k in ("finish", "start", "upload")])
    stream = jobs.state_changes(jobs.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("moment").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    stream.processAllAvailable()
    stream.stop()
    assert spark.table("moment").first().status == "done"


def test_the_kept_places_are_those_of_the_quadratic_rule():
    def by_hand(x):
        best, before = [1] * len(x), [-1] * len(x)
        for i in range(len(x)):
            for j in range(i):
                if x[j] <= x[i] and best[j] + 1 > best[i]:
                    best[i], before[i] = best[j] + 1, j
        i, out = best.index(max(best)), []
        while i >= 0:
            out.append(i)
            i = before[i]
        return out[::-1]

    rng = random.Random(1)
    for _ in range(3000):
        x = [rng.randrange(rng.choice([3, 10, 100])) for _ in range(rng.randint(1, 40))]
        assert alignment.longest_non_decreasing(x) == by_hand(x)
    assert alignment.longest_non_decreasing([]) == []
