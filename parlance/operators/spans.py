"""Time spans: shifting, cutting, padding, merging, windows, overlap joins.

Times are integer milliseconds.  Every operator works within a key (a recording or
a segment), so work spreads over keys; none needs all rows in one place.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tolerances of the iterative cut, pads and clip lengths, in milliseconds.
HEAD_TOLERANCE, TAIL_MARGIN = 50, 2000
PAD_LIMIT, MERGE_GAP, MIN_CLIP, NEXT_GAP, END_GAP = 150, 50, 300, 10, 33
RAW_LIMIT, POINT_PAD = 600, 200


def shift(segments: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """Part-relative times to absolute ones.  Parts are few to a recording; Spark picks the join."""
    return segments.join(parts.select(*keys, "offset_ms"), keys).withColumns({c: F.col(c) + F.col("offset_ms") for c in ("start_ms", "end_ms")}).drop("offset_ms")


def out_of_bounds(start: Column, end: Column, duration: Column) -> Column:
    return (end > duration + 5000) | (start < -5000)


def head_kept(end: Column, cut: Column, part: Column) -> Column:
    """After the first part, what ends within the tolerance of the cut is a repeat."""
    return (part == 0) | (end > cut + HEAD_TOLERANCE)


def tail_kept(end: Column, cut: Column) -> Column:
    return end <= cut


def anchors(segments: DataFrame, keys: list[str], duration: Column) -> DataFrame:
    """Each part's anchor: the last segment in start order, but not the final one, that ends well before the part does."""
    w = Window.partitionBy(*keys).orderBy(F.col("start_ms").desc(), F.col("seg_ord").desc())
    ranked = segments.withColumn("rn", F.row_number().over(w)).where((F.col("rn") >= 2) & (F.col("end_ms") <= duration - TAIL_MARGIN))
    return ranked.groupBy(*keys).agg(F.min_by(F.struct("seg_ord", "start_ms", "end_ms"), "rn").alias("anchor")).select(*keys, "anchor.*")


def gap_pads(spans: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Padding before and after: two fifths of the gap to the neighbour, at most the limit."""
    w = Window.partitionBy(*keys).orderBy("start_ms", *order)
    pad = lambda gap: F.when(gap.isNull(), PAD_LIMIT).otherwise(F.least(F.lit(PAD_LIMIT), F.floor(F.greatest(gap, F.lit(0)) * 2 / 5)))
    return spans.withColumns({"pad_before": pad(F.col("start_ms") - F.lag("end_ms").over(w)).cast("long"), "pad_after": pad(F.lead("start_ms").over(w) - F.col("end_ms")).cast("long")})


def islands(spans: DataFrame, keys: list[str], order: list[str], gap: int = MERGE_GAP) -> DataFrame:
    """Spans no further apart than ``gap`` become one; n counts them."""
    w = Window.partitionBy(*keys).orderBy("start_ms", "end_ms", *order)
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start_ms") - reach > gap), 1).otherwise(0)
    numbered = spans.withColumn("new", new).withColumn("island", F.sum("new").over(w))
    return numbered.groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n")).drop("island")


def clip_caps(clips: DataFrame, keys: list[str], total: Column) -> DataFrame:
    """At least the minimum long, but never past the end or into the next clip."""
    w = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    longer = F.least(F.greatest("end_ms", F.col("start_ms") + MIN_CLIP), total - END_GAP)
    following = F.lead("start_ms").over(w) - NEXT_GAP
    return clips.withColumn("capped_ms", F.least(longer, F.coalesce(following, longer)).cast("long"))


def clip_window(start: Column, end: Column, raw_start: Column, raw_end: Column) -> Column:
    """struct<start_ms, end_ms, source>: the repaired span, a short raw one, a padded point, or invalid."""
    raw = raw_end - raw_start
    source = F.when(start.isNull() | end.isNull(), "invalid").when(end > start, "fixed").when((raw > 0) & (raw <= RAW_LIMIT), "raw_window").otherwise("t_pad")
    return F.struct(
        F.when(source == "fixed", start).when(source == "raw_window", raw_start).when(source == "t_pad", F.greatest(start - POINT_PAD, F.lit(0))).alias("start_ms"),
        F.when(source == "fixed", end).when(source == "raw_window", raw_end).when(source == "t_pad", start + POINT_PAD).alias("end_ms"),
        source.alias("source"),
    )


def windows(recordings: DataFrame, duration: str, length: int, overlap: int, stop_at_end: bool) -> DataFrame:
    """Sliding windows.  Either as long as they start within, or until one reaches the end."""
    step, d = length - overlap, F.col(duration)
    last = F.ceil(d / step) - 1
    if stop_at_end:
        last = F.least(last, F.greatest(F.ceil((d - length) / step), F.lit(0)))
    k = F.explode(F.when(d > 0, F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    return recordings.select("*", k.alias("k")).select(*recordings.columns, "k", (F.col("k") * step).alias("start_ms"), F.least(F.col("k") * step + length, d).alias("end_ms"))


def sampled(frame_no: Column, source_fps: Column, fps: float) -> Column:
    """Every k-th frame, k at least 1."""
    return F.pmod(frame_no, F.greatest(F.floor(source_fps / fps), F.lit(1))) == 0


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bucket: int) -> DataFrame:
    """Pairs of spans (start_ms, end_ms; r_start_ms, r_end_ms) that overlap.

    Both sides are dealt to time buckets, so the join has an equality key and a long
    recording is spread; a pair is only kept in the first bucket that both are in.
    """
    put = lambda df, a, b: df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.greatest(F.col(b) - 1, F.col(a)) / bucket))))
    joined = put(left, "start_ms", "end_ms").join(put(right, "r_start_ms", "r_end_ms"), [*keys, "bucket"])
    first = F.floor(F.greatest("start_ms", "r_start_ms") / bucket)
    return joined.where((F.col("start_ms") < F.col("r_end_ms")) & (F.col("r_start_ms") < F.col("end_ms")) & (F.col("bucket") == first)).drop("bucket")


def injected(windows_: DataFrame, segments: DataFrame, keys: list[str], bucket: int = 60_000) -> DataFrame:
    """For each window the text said in it, in order (context injection)."""
    right = segments.select(*keys, F.col("start_ms").alias("r_start_ms"), F.col("end_ms").alias("r_end_ms"), "seg_ord", "text")
    pairs = overlap_join(windows_, right, keys, bucket)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_start_ms", "seg_ord", "text"))), lambda s: s["text"]), "\n")
    return pairs.groupBy(*windows_.columns).agg(said.alias("context"), F.count("*").alias("n_segments"))


def one_axis(transcript: DataFrame, visual: DataFrame) -> DataFrame:
    """Two streams of rows on one time axis, transcript before visual at the same time."""
    both = transcript.withColumn("kind", F.lit("1_transcript")).unionByName(visual.withColumn("kind", F.lit("2_visual")), allowMissingColumns=True)
    return both.orderBy("start_ms", "kind")


def speech_islands(frames: DataFrame, keys: list[str], threshold: float = 0.5, min_silence: int = 300) -> DataFrame:
    """Speech intervals from frame probabilities: voiced frames, joined across short silences."""
    return islands(frames.where(F.col("probability") >= threshold), keys, [], min_silence)


def voiced(frames: DataFrame, keys: list[str], high: float = 0.5, low: float = 0.35, frame_ms: int = 32, min_speech: int = 250, min_silence: int = 300, chunk_ms: int = 300_000) -> DataFrame:
    """Speech (start_ms, end_ms) from frames (at_ms, probability) by two thresholds.

    A frame at ``high`` or more turns speech on, one below ``low`` turns it off, any other
    leaves it as it was.  A long recording is scanned in chunks of time side by side: each
    gets the last decision before it from the chunks' own last decisions, one row a
    chunk.  Silences shorter than ``min_silence`` don't end speech, and what is then
    shorter than ``min_speech`` isn't any.
    """
    decided = F.when(F.col("probability") >= high, 1).when(F.col("probability") < low, 0)
    marked = frames.select(*keys, "at_ms", F.floor(F.col("at_ms") / chunk_ms).alias("chunk"), decided.alias("d"))
    ends = marked.groupBy(*keys, "chunk").agg(F.max_by("d", F.when(F.col("d").isNotNull(), F.struct("at_ms", "d"))).alias("d"), F.max("at_ms").alias("until"))
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "chunk", F.coalesce(F.last("d", ignorenulls=True).over(earlier), F.lit(0)).alias("carried"))
    inside = Window.partitionBy(*keys, "chunk").orderBy("at_ms", "d")
    state = F.coalesce(F.last("d", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("carried"))
    scanned = marked.join(carried, [*keys, "chunk"]).withColumn("on", state)
    turns = scanned.withColumn("was", F.coalesce(F.lag("on").over(inside), F.col("carried"))).where("`on` <> was")
    # turns alternate, so each that goes on lasts until the next, the last one until the recording's last frame ends
    until = ends.groupBy(*keys).agg((F.max("until") + frame_ms).alias("until"))
    following = F.lead("at_ms").over(Window.partitionBy(*keys).orderBy("at_ms", "on"))
    spoken_ = turns.withColumn("end_ms", following).join(until, keys).where("`on` = 1").select(*keys, F.col("at_ms").alias("start_ms"), F.coalesce("end_ms", "until").alias("end_ms"))
    return islands(spoken_, keys, [], min_silence - 1).where(F.col("end_ms") - F.col("start_ms") >= min_speech).drop("n")


def border(last: str, text: str, most: int | None = None) -> int:
    """The length of the longest end of ``last`` that ``text`` begins with, in time linear in both."""
    n = min(len(last), len(text), len(text) if most is None else most)
    if not n:
        return 0
    head, tail = text[:n], last[len(last) - n :]
    fall, k = [0] * n, 0
    for i in range(1, n):
        while k and head[i] != head[k]:
            k = fall[k - 1]
        k += head[i] == head[k]
        fall[i] = k
    k = 0
    for i, ch in enumerate(tail):
        if k == n:
            k = fall[k - 1]
        while k and ch != head[k]:
            k = fall[k - 1]
        k += ch == head[k]
    return k


def stitched(windows_: DataFrame, keys: list[str], order: str, text: str = "text", least: int = 1, most: int | None = None) -> DataFrame:
    """One text for each key from windows that repeat the end of the one before.

    What a window repeats is the longest end of its neighbour that it begins with, at
    most ``most`` and no shorter than ``least`` characters, else nothing.  Null windows are
    empty.  The text of a key is one row.
    """

    @F.pandas_udf("int")
    def repeated(last: pd.Series, now: pd.Series) -> pd.Series:
        found = [border(a, b, most) for a, b in zip(last, now)]
        return pd.Series([n if n >= least else 0 for n in found])

    said = windows_.withColumn("__said", F.coalesce(F.col(text), F.lit("")))
    before = F.coalesce(F.lag("__said").over(Window.partitionBy(*keys).orderBy(order)), F.lit(""))
    cut = said.withColumn("__last", before).withColumn("__n", repeated("__last", "__said"))
    rest = cut.select(*keys, F.struct(F.col(order).alias("k"), F.expr("substring(__said, __n + 1)").alias("t")).alias("p"), "__n")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "")
    return rest.groupBy(*keys).agg(joined.alias(text), F.count("*").alias("n_windows"), F.sum("__n").alias("n_repeated"))


def chunk_id(keys: list[str], order: list[str], size: int = 20) -> Column:
    return F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size)


def grams(line: Column) -> Column:
    """The distinct runs of three characters of a line (all of a shorter one), as 64-bit hashes."""
    chars = F.split(line, "")
    run = lambda cs, n: F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(cs, i), F.coalesce(F.get(cs, i + 1), F.lit("")), F.coalesce(F.get(cs, i + 2), F.lit(""))))
    return F.array_distinct(F.flatten(F.transform(F.array(chars), lambda cs: run(cs, F.length(line)))))


def repeat_flags(lines: Column, similarity: float = 0.8) -> Column:
    """For each of a text's lines whether it repeats the one before: shared three-character runs over all of them.

    Lines stay in their row, so nothing is exploded, shuffled or sorted.
    """

    def flags(sets: Column) -> Column:
        def repeats(mine: Column, i: Column) -> Column:
            last = F.get(sets, i - 1)
            shared = F.size(F.array_intersect(mine, last))
            return F.coalesce((i > 0) & (shared >= similarity * (F.size(mine) + F.size(last) - shared)), F.lit(False))

        return F.transform(sets, repeats)

    return F.flatten(F.transform(F.array(F.transform(lines, grams)), flags))


def near_repeats(lines: DataFrame, keys: list[str], order: str, similarity: float = 0.8) -> DataFrame:
    """The same for lines that are rows of their own."""
    w = Window.partitionBy(*keys).orderBy(order)
    with_last = lines.withColumn("grams", grams(F.col("text"))).withColumn("last", F.lag("grams").over(w))
    shared = F.size(F.array_intersect("grams", "last"))
    return with_last.withColumn("repeats", F.coalesce(shared >= similarity * (F.size("grams") + F.size("last") - shared), F.lit(False))).drop("grams", "last")


def neighbours(results: DataFrame, keys: list[str], order: str, reach: int | None) -> DataFrame:
    """Each window with the results before and after it (one swarm round's view), ``reach`` on either side.

    A reach of None is all of them, and a recording's rows then grow with the square of
    its windows.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    return results.withColumns({
        "before": F.collect_list("text").over(w.rowsBetween(Window.unboundedPreceding if reach is None else -reach, -1)),
        "after": F.collect_list("text").over(w.rowsBetween(1, Window.unboundedFollowing if reach is None else reach)),
    })


def spoken(segments: DataFrame, speech: DataFrame, keys: list[str], bucket: int = 60_000) -> DataFrame:
    """Segments that overlap some interval of speech (recognition over speech only)."""
    right = speech.select(*keys, F.col("start_ms").alias("r_start_ms"), F.col("end_ms").alias("r_end_ms"))
    return overlap_join(segments, right, keys, bucket).select(segments.columns).distinct()


def fade(at: Column, length: Column, overlap: int) -> Column:
    """A window's weight at a place within it: rising over the overlap at its start, falling over that at its end."""
    return F.least(F.lit(1.0), (at + 1) / (overlap + 1), (length - at) / (overlap + 1))
