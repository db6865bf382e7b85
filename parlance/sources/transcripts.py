"""Reading and writing transcripts, parts, speaker folders, subtitles and manifests."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import text as tx

SEGMENT = "struct<start:double,end:double,speaker:string,text:string,part:int,speaker_global:string>"
PART = (
    "struct<part:int,start_abs_s:double,duration_s:double,status:string,end_cut_abs_s:double,kept:int,"
    "index:int,offset_s:double,file:string>"
)
COMBINED = f"video_id string, source string, total_duration_s double, note string, parts array<{PART}>, segments array<{SEGMENT}>"
AUDIO = ("wav", "mp3", "flac", "ogg")


def read_combined(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file JSON transcripts, one row each."""
    return spark.read.schema(COMBINED).option("multiLine", True).json(path)


def segments(combined: DataFrame) -> DataFrame:
    """One row for each segment, in file order, times in milliseconds."""
    s = combined.select(F.col("video_id").alias("recording_id"), F.posexplode("segments").alias("seg_ord", "s"))
    ms = lambda c: F.bround(F.col(c) * 1000).cast("long")
    return s.select("recording_id", F.col("s.part").alias("part"), F.col("seg_ord").cast("long").alias("seg_ord"), ms("s.start").alias("start_ms"), ms("s.end").alias("end_ms"), "s.speaker", "s.text", "s.speaker_global")


def parts(combined: DataFrame) -> DataFrame:
    """Parts of either version in one shape: number and absolute start from whichever keys the file has."""
    p = combined.select(F.col("video_id").alias("recording_id"), F.explode("parts").alias("p"))
    ms = lambda c: F.bround(c * 1000).cast("long")
    return p.select(
        "recording_id",
        F.coalesce("p.part", "p.index").alias("part"),
        ms(F.coalesce("p.start_abs_s", "p.offset_s")).alias("offset_ms"),
        ms(F.col("p.duration_s")).alias("duration_ms"),
        F.coalesce("p.status", F.lit("ok")).alias("status"),
        ms(F.col("p.end_cut_abs_s")).alias("end_cut_ms"),
    )


def write_segments(rows: DataFrame, path: str, kind: str = "json") -> None:
    """A row each; a failed job leaves nothing half-written (the commit protocol renames)."""
    rows.write.mode("overwrite").format(kind).save(path)


def result(rows: DataFrame) -> DataFrame:
    """The served shape of a segment."""
    return rows.select(
        "recording_id", "seg_ord", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"),
        tx.named_speaker(F.col("speaker_global"), F.col("speaker")).alias("speaker"), "text",
    )


def not_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work without an ``ok`` result yet."""
    return work.join(done.where("status = 'ok'").select(*keys).distinct(), keys, "left_anti")


def gathered(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return work.join(done.where("status = 'ok'"), keys)


def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    """The binary files under a folder with path, name, stem, suffix and size; contents are read only if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select("path", "length", "content", name.alias("name"), F.regexp_extract(name, r"^(.*)\.[^.]*$", 1).alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("suffix")).where(F.col("suffix").isin(*AUDIO))


def speakers(files: DataFrame) -> DataFrame:
    """(speaker, path, size_kb): a file's stem names the speaker; a stem with two files is told apart by ``n_files``."""
    n = F.count("*").over(Window.partitionBy("stem"))
    return files.select(F.col("stem").alias("speaker"), "path", F.bround(F.col("length") / 1024, 1).alias("size_kb"), n.alias("n_files"))


def without_collisions(names: DataFrame, order: str) -> DataFrame:
    """Names as stored: the second of a name gets _1, the third _2, before the suffix.

    A made name that some upload has itself gets underscores more until it is free, so
    nothing is overwritten.
    """
    k = F.row_number().over(Window.partitionBy("name").orderBy(order)) - 1
    stem, suffix = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"(\.[^.]*)$", 1)
    first = names.withColumn("__turn", k).withColumn("stored", F.when(F.col("__turn") == 0, F.col("name")).otherwise(F.concat(stem, F.lit("_"), F.col("__turn").cast("string"), suffix)))
    taken = names.select(F.col("name").alias("__taken")).distinct()
    met = first.join(taken, (F.col("__turn") > 0) & (F.col("stored") == F.col("__taken")), "left")
    # a name with two underscores in a row before its number comes from no other name unless that is there too
    free = F.concat(stem, F.lit("__"), F.col("__turn").cast("string"), F.lit("_"), F.substring(F.sha2("name", 256), 1, 8), suffix)
    return met.withColumn("stored", F.when(F.col("__taken").isNotNull(), free).otherwise(F.col("stored"))).drop("__turn", "__taken")


def without_stem(names: DataFrame, stem: str) -> DataFrame:
    """The names left when every file of a stem, whatever its suffix, is deleted."""
    return names.where(~F.equal_null(F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.lit(stem)))


def wav_bytes(samples: Column, rate: int = 16000) -> Column:
    """Mono 16-bit WAV files of arrays of samples."""

    @F.pandas_udf("binary")
    def encode(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            data = io.BytesIO()
            with wave.open(data, "wb") as w:
                w.setnchannels(1)
                w.setsampwidth(2)
                w.setframerate(rate)
                w.writeframes(np.asarray([] if row is None else row, "<i2").tobytes())
            out.append(data.getvalue())
        return pd.Series(out)

    return encode(samples.cast("array<smallint>"))


def write_slices(audio: DataFrame, spans: DataFrame, keys: list[str], folder: str, rate: int = 16000) -> None:
    """Each span (start_s, end_s) of a recording's samples as a WAV file's bytes, exact to the sample, by recording and span."""
    cut = audio.join(spans, keys).withColumn("b", sample_range(F.col("start_s"), F.col("end_s"), rate))
    cut.select(*keys, "start_s", "end_s", wav_bytes(sliced(F.col("samples"), F.col("b")), rate).alias("content")).write.mode("overwrite").parquet(folder)


def summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The served result's head: number of segments, the distinct speakers in order, and how many they are."""
    named = rows.select(*keys, tx.named_speaker(F.col("speaker_global"), F.col("speaker")).alias("speaker"))
    counted = named.groupBy(*keys, "speaker").agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.sum("n").alias("n_segments"), F.count("*").alias("n_speakers"), F.sort_array(F.collect_list("speaker")).alias("speakers"))


def renamed(names: DataFrame, old: str, new: str) -> DataFrame:
    """A rename that is refused where the new name is taken."""
    taken = names.where(F.col("name") == new).limit(1).count() > 0
    return names if taken else names.withColumn("name", F.when(F.col("name") == old, F.lit(new)).otherwise(F.col("name")))


def decoded(files: DataFrame) -> DataFrame:
    """Sampling rate, length and mono samples in -1..1 of 16-bit WAV files; null where a file is something else."""

    @F.pandas_udf("struct<rate:int,n:long,samples:array<float>>")
    def decode(content: pd.Series) -> pd.DataFrame:
        rows = []
        for data in content:
            try:
                with wave.open(io.BytesIO(data)) as w:
                    if w.getsampwidth() != 2:
                        raise ValueError
                    pcm = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
                    rows.append((w.getframerate(), len(pcm), (pcm.mean(1) / 32768).astype(np.float32)))
            except (wave.Error, EOFError, ValueError):
                rows.append((None, None, None))
        return pd.DataFrame(rows, columns=["rate", "n", "samples"])

    return files.select("path", decode("content").alias("pcm")).select("path", "pcm.*")


def duration_s(n: Column, rate: Column) -> Column:
    return n / rate


def sample_range(start_s: Column, end_s: Column, rate: int = 16000) -> Column:
    """Exact half-open sample numbers of a span."""
    return F.struct(F.bround(start_s * rate).cast("long").alias("first"), F.bround(end_s * rate).cast("long").alias("stop"))


def sliced(samples: Column, bounds: Column) -> Column:
    return F.slice(samples, (bounds["first"] + 1).cast("int"), (bounds["stop"] - bounds["first"]).cast("int"))


def padded_chunk(start_ms: Column, end_ms: Column, total_ms: Column, pad: int = 200) -> Column:
    return F.struct(F.greatest(start_ms - pad, F.lit(0)).alias("start_ms"), F.least(end_ms + pad, total_ms).alias("end_ms"))


def subtitle_events(rows: DataFrame) -> DataFrame:
    """Subtitle lines: the sentence over its whole time, then one line for each unit (min 80 ms) with it coloured.

    ``rows`` has seg_id, start_ms, end_ms and units (array of unit, start_ms, end_ms).  Every line
    says the whole sentence, so rows are best dealt and sorted before: lines come in their order.
    """
    line = lambda layer, a, b, said: F.concat(F.lit(f"Dialogue: {layer},"), tx.ass_time(a / 1000), F.lit(","), tx.ass_time(b / 1000), F.lit(",Default,,0,0,0,,"), said)
    names = F.transform("units", lambda u: u["unit"])
    last = F.coalesce(F.size("units"), F.lit(0)) - 1
    each = rows.select("seg_id", "start_ms", "end_ms", "units", names.alias("names"), F.explode(F.sequence(F.lit(-1), F.greatest(last, F.lit(-1)))).alias("k"))
    each = each.withColumn("u", F.when(F.col("k") >= 0, F.get("units", F.col("k"))))
    base = line(0, F.col("start_ms"), F.col("end_ms"), F.array_join("names", ""))
    marked = line(1, F.col("u.start_ms"), F.greatest(F.col("u.end_ms"), F.col("u.start_ms") + 80), tx.highlight(F.col("names"), F.col("k")))
    return each.select("seg_id", "k", F.when(F.col("k") < 0, base).otherwise(marked).alias("event"))


def manifest(clips: DataFrame, folder: str, suffix: str = "mkv") -> DataFrame:
    """Clips numbered in time, with file, length and time code."""
    n = F.row_number().over(Window.partitionBy("recording_id").orderBy("start_ms", "end_ms"))
    numbered = clips.withColumn("index", n)
    return numbered.withColumns({
        "file": F.concat(F.lit(f"{folder}/clip_"), F.lpad(F.col("index").cast("string"), 4, "0"), F.lit(f".{suffix}")),
        "duration_ms": F.col("end_ms") - F.col("start_ms"),
        "timecode": tx.timecode(F.col("start_ms") / 1000),
    })


def peak_normalised(samples: Column) -> Column:
    """Samples scaled so that the loudest is 1; silence stays as it is."""
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x)))
    return F.when(peak > 0, F.transform(samples, lambda x: x / peak)).otherwise(samples)


def blocks(samples: Column, length: int) -> Column:
    """The samples in pieces of at most ``length``."""
    n = F.ceil(F.size(samples) / length).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(samples, k * length + 1, F.lit(length)))).otherwise(F.array())
