"""Audio and subtitle files: exact round trips, ranges that lose nothing, and writes that leave nothing when they fail."""

import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.sources import files


def all_files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


@pytest.fixture(scope="module")
def recordings(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("wav")
    files.register(spark)
    rng = np.random.default_rng(1)
    data = {f"r{k}": rng.integers(-32768, 32768, n).tolist() for k, n in enumerate([0, 1, 999, 1000, 1001, 5000, 12_345])}
    rows = spark.createDataFrame([(k, 16000, v) for k, v in data.items()], "name string, rate int, samples array<short>").repartition(3)
    rows.write.format("wav").mode("append").save(str(folder))
    return folder, data


@pytest.mark.parametrize("block, most", [(1000, 1 << 26), (1000, 700), (7, 4096), (333, 2001), (160_000, 64)])
def test_a_round_trip_is_exact_however_files_are_cut(spark, recordings, block, most):
    folder, data = recordings
    rows = spark.read.format("wav").option("block", block).option("partition_bytes", most).load(str(folder)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.recording, r["first"])):
        assert r.rate == 16000 and r.channels == 1 and r["first"] == len(got.setdefault(r.recording, [])) and len(r.samples) <= block
        got[r.recording] += r.samples
    assert got == data
    assert len(rows) == sum(max(-(-len(v) // block), 1) for v in data.values())


def test_plans_use_sizes_alone():
    plan = files.planned([("b", 250), ("a", 10), ("c", 30), ("d", 0)], 100)
    assert [[(r.path, r.low, r.high) for r in p] for p in plan] == [[("a", 0, 10)], [("b", 0, 100)], [("b", 100, 200)], [("b", 200, 250), ("c", 0, 30), ("d", 0, 0)]]


def test_other_files_and_odd_heads(spark, tmp_path):
    files.register(spark)
    (tmp_path / "bad.wav").write_bytes(b"no audio at all")
    (tmp_path / "short.WAV").write_bytes(b"RIFF")
    (tmp_path / "notes.txt").write_text("x")
    with wave.open(str(tmp_path / "two.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000), w.writeframes(np.arange(8, dtype="<i2").tobytes())
    odd = (tmp_path / "two.wav").read_bytes()
    (tmp_path / "extra.wav").write_bytes(odd[:36] + b"LIST" + (3).to_bytes(4, "little") + b"abc\0" + odd[36:])
    got = {r.recording: (r.rate, r.channels, r.samples) for r in spark.read.format("wav").load(str(tmp_path)).collect()}
    assert got == {"bad": (None, None, None), "short": (None, None, None), "two": (8000, 2, list(range(8))), "extra": (8000, 2, list(range(8)))}


def test_failed_writes_leave_nothing(spark, tmp_path):
    files.register(spark)
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"n{i}", 16000, [i]) for i in range(8)], "name string, rate int, samples array<short>").repartition(4)
    rows.write.format("wav").mode("append").save(folder)
    before = all_files(folder)
    assert before == ["_SUCCESS", *(f"n{i}.wav" for i in range(8))]
    new = rows.withColumn("name", F.concat(F.lit("m"), "name"))
    failing = new.withColumn("rate", F.when(F.col("name") == "mn5", F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("rate")))
    for bad in (failing, rows, new.union(new.limit(1)), new.withColumn("name", F.lit("a/b"))):
        with pytest.raises(Exception):
            bad.write.format("wav").mode("append").save(folder)
        assert all_files(folder) == before
    new.write.format("wav").mode("append").save(folder)
    assert len(all_files(folder)) == 17


def test_slices_and_subtitles(spark, tmp_path):
    audio = spark.createDataFrame([(1, list(range(3000)))], "rec int, samples array<short>")
    spans = spark.createDataFrame([(1, 0.0101, 0.02, "a"), (1, 0.1, 0.5, "b")], "rec int, start_s double, end_s double, name string")
    files.write_slices(audio, spans, ["rec"], "name", str(tmp_path / "s"))
    got = {r.recording: r.samples for r in spark.read.format("wav").load(str(tmp_path / "s")).collect()}
    assert got == {"a": list(range(162, 320)), "b": list(range(1600, 3000))}
    events = spark.createDataFrame([("x", k, f"Dialogue: {k},é") for k in range(5)] + [("y", 0, "Dialogue: only")], "name string, k int, event string").repartition(5)
    files.write_subtitles(events, "name", ["k"], str(tmp_path / "t"))
    lines = (tmp_path / "t" / "x.ass").read_text(encoding="utf-8").split("\n")
    assert lines[1] == "Title: x" and lines[-6:] == [*(f"Dialogue: {k},é" for k in range(5)), ""]
    assert all_files(tmp_path / "t") == ["_SUCCESS", "x.ass", "y.ass"]


def test_dealt_turns_become_compressed_files_in_order(spark, tmp_path):
    from parlance.sources import transcripts

    said = {0: ["a ", "bé ", "c"], 1: [], 2: ["only"]}
    data = [((r, s), 100 * s, 100 * s + 90, [(u, 0, 10) for u in units]) for r in range(3) for s, units in reversed(said.items())]
    rows = spark.createDataFrame(data, "seg_id struct<rec:int,seg:int>, start_ms long, end_ms long, units array<struct<unit:string,start_ms:long,end_ms:long>>").repartition(5)
    events = transcripts.subtitle_events(rows.repartition(2, "seg_id.rec").sortWithinPartitions("seg_id"))
    assert "Exchange" not in events._jdf.queryExecution().executedPlan().toString().split("Sort", 1)[0]  # lines themselves aren't shuffled
    files.write_dealt_subtitles(events.withColumn("name", F.concat(F.lit("n"), "seg_id.rec")), "name", str(tmp_path / "z"), "gzip")
    files.write_subtitles(events.withColumn("name", F.concat(F.lit("n"), "seg_id.rec")), "name", ["seg_id", "k"], str(tmp_path / "p"))
    assert all_files(tmp_path / "z") == ["_SUCCESS", "n0.ass.gz", "n1.ass.gz", "n2.ass.gz"]
    read = lambda folder, kind: {r.value for r in spark.read.option("pathGlobFilter", kind).text(str(tmp_path / folder), wholetext=True).collect()}
    assert read("z", "*.ass.gz") == read("p", "*.ass") and len(read("z", "*.ass.gz")) == 3
    lines = [x.split(",,0,0,0,,")[1] for x in (tmp_path / "p" / "n1.ass").read_text(encoding="utf-8").split("\n") if x.startswith("Dialogue")]
    assert lines == ["a bé c", r"{\c&H00FFFF&}a {\r}bé c", r"a {\c&H00FFFF&}bé {\r}c", r"a bé {\c&H00FFFF&}c{\r}", "", "only", r"{\c&H00FFFF&}only{\r}"]
    with pytest.raises(Exception):
        files.write_dealt_subtitles(events.withColumn("name", F.lit("x")), "name", str(tmp_path / "q"), "other")


def test_ranges_go_to_a_bounded_number_of_tasks(spark, recordings):
    folder, data = recordings
    plan = files.planned([(f"f{i:04}", 1000) for i in range(3000)], 700)
    bounded = files.gathered(plan, 1000)
    assert len(plan) == 6000 and len(bounded) == 1000 and [r for p in bounded for r in p] == [r for p in plan for r in p]
    assert {len(p) for p in bounded} == {6} and files.gathered([], 5) == []
    rows = spark.read.format("wav").option("block", 100).option("partition_bytes", 700).option("max_partitions", 3).load(str(folder))
    assert rows.rdd.getNumPartitions() == 3
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r.recording, r["first"])):
        got[r.recording] = got.get(r.recording, []) + r.samples
    assert got == data
