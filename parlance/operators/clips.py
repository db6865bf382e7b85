"""From matched words to a plan of clips: source rows, windows, merging, numbering, encoding.

Times are integer milliseconds.  A segment's matches stay in one array, so their own
merging is an in-row fold; everything across segments is keyed by recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators import spans

#: Encoders with their arguments, seconds before a clip is given up, tries and the wait between them.
ENCODERS = {"x264": ("libx264", "-preset veryfast -crf 20"), "av1": ("libsvtav1", "-preset 8 -crf 32"), "nvenc": ("h264_nvenc", "-preset p4 -cq 23")}
TIMEOUT_S, TRIES, WAIT_S = 300, 3, 2.0
MERGED = "array<struct<start_ms:bigint,end_ms:bigint,words:array<string>,sources:array<string>>>"


def usable_matches(segments: DataFrame) -> DataFrame:
    """Segments that aren't marked as failed, with the matches that aren't marked invalid and have a window.

    ``matches`` is an array of (word, start_ms, end_ms, raw_start_ms, raw_end_ms, valid);
    a missing ``ok`` or ``valid`` counts as true.
    """
    kept = F.filter("matches", lambda m: ~F.equal_null(m["valid"], F.lit(False)))
    windows = F.transform(kept, lambda m: F.struct(spans.clip_window(m["start_ms"], m["end_ms"], m["raw_start_ms"], m["raw_end_ms"]).alias("w"), m["word"].alias("word")))
    whole = F.filter(windows, lambda x: x["w"]["source"] != "invalid")
    return segments.where(~F.equal_null(F.col("ok"), F.lit(False))).withColumn("windows", whole).where(F.size("windows") > 0)


def merged_in_segment(windows: Column, gap: int = spans.MERGE_GAP) -> Column:
    """Windows, in the order of their matches, joined to the one before where it is at most ``gap`` away."""
    fresh = lambda x: F.struct(x["w"]["start_ms"].cast("long").alias("start_ms"), x["w"]["end_ms"].cast("long").alias("end_ms"), F.array(x["word"]).alias("words"), F.array(x["w"]["source"]).alias("sources"))
    last = lambda out: F.element_at(out, -1)
    longer = lambda out, x: F.struct(
        last(out)["start_ms"].alias("start_ms"), F.greatest(last(out)["end_ms"], x["w"]["end_ms"]).alias("end_ms"),
        F.array_append(last(out)["words"], x["word"]).alias("words"), F.array_append(last(out)["sources"], x["w"]["source"]).alias("sources"),
    )
    step = lambda out, x: F.when((F.size(out) > 0) & (x["w"]["start_ms"] - F.try_element_at(out, F.lit(-1))["end_ms"] <= gap), F.array_append(F.slice(out, F.lit(1), F.size(out) - 1), longer(out, x))).otherwise(F.array_append(out, fresh(x))).cast(MERGED)
    return F.aggregate(windows, F.array().cast(MERGED), step)


def merged_across(clips: DataFrame, keys: list[str], order: list[str], gap: int = spans.MERGE_GAP) -> DataFrame:
    """Clips of neighbouring segments joined where at most ``gap`` lies between; words and sources go end to end."""
    w = Window.partitionBy(*keys).orderBy("start_ms", *order)
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start_ms") - reach > gap), 1).otherwise(0)
    numbered = clips.withColumn("new", new).withColumn("island", F.sum("new").over(w)).withColumn("k", F.row_number().over(w))
    each = F.array_sort(F.collect_list(F.struct("k", "words", "sources")))
    flat = lambda name: F.flatten(F.transform("each", lambda x: x[name])).alias(name)
    return numbered.groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), each.alias("each")).select(*keys, "start_ms", "end_ms", flat("words"), flat("sources"))


def clip_list(segments: DataFrame, keys: list[str], total: Column, folder: str = "clips", suffix: str = "mkv") -> DataFrame:
    """All clips of a recording in time: merged, at least the least length, apart from the next, numbered."""
    inside = usable_matches(segments).select(*keys, "seg_id", F.posexplode(merged_in_segment(F.col("windows"))).alias("k", "c")).select(*keys, "seg_id", "k", "c.*")
    merged = merged_across(inside, keys, ["seg_id", "k"])
    capped = spans.clip_caps(merged, keys, total).drop("end_ms").withColumnRenamed("capped_ms", "end_ms")
    index = F.row_number().over(Window.partitionBy(*keys).orderBy("start_ms"))
    return capped.withColumn("index", index).withColumns({
        "file": F.concat(F.lit(f"{folder}/clip_"), F.lpad(F.col("index").cast("string"), 4, "0"), F.lit(f".{suffix}")),
        "duration_ms": F.col("end_ms") - F.col("start_ms"),
        "timecode": tx.timecode(F.col("start_ms") / 1000),
    })


def encode_plan(clips: DataFrame, encoder: str = "x264", limit: int | None = None, tries: int = TRIES) -> DataFrame:
    """What an external encoder is asked for each clip; ``limit`` plans only the first of every recording."""
    codec, arguments = ENCODERS[encoder]
    seconds = lambda ms: F.format_string("%.3f", ms / 1000.0)
    rows = clips if limit is None else clips.where(F.col("index") <= limit)
    waits = F.array(*[F.lit(WAIT_S * n) for n in range(1, tries)]).cast("array<double>")
    return rows.select(
        "*", seconds(F.col("start_ms")).alias("seek_s"), seconds(F.col("duration_ms")).alias("length_s"), F.lit(codec).alias("codec"), F.lit(arguments).alias("arguments"),
        F.lit(TIMEOUT_S).alias("timeout_s"), F.lit(tries).alias("tries"), waits.alias("waits_s"),
    )


def matched_units(text: Column, units: Column, pattern: str = tx.LEXICON) -> Column:
    """array<struct<word, start, end, first, last, start_ms, end_ms, issue>>: a pattern's matches joined to aligned units through their characters.

    ``units`` is an array of (unit, start_ms, end_ms) in the order of ``tx.units``.  A
    match whose first or last character is in no unit has an issue and no times.
    """
    of = tx.unit_index(text)
    at = lambda i: F.get(units, i)

    def joined(index: Column) -> Column:
        def one(m: Column) -> Column:
            first, last = F.get(index, m["start"]), F.get(index, m["end"] - 1)
            start, end = at(first)["start_ms"], at(last)["end_ms"]
            issue = F.when(first.isNull() | last.isNull(), "no unit").when(end <= start, "empty span")
            return F.struct(m["match"].alias("word"), m["start"].alias("start"), m["end"].alias("end"), first.alias("first"), last.alias("last"), start.alias("start_ms"), end.alias("end_ms"), issue.alias("issue"))

        return F.transform(tx.spans_of(text, pattern), one)

    return F.get(F.transform(F.array(of), joined), F.lit(0))
