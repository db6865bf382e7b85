"""Named queries that write files and give what is read from them again, each with SQL over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.plans.adapters import TALK, table, talk
from parlance.plans.catalogue import query
from parlance.sources import files, transcripts
from parlance.sources.shared import fresh_folder

SAMPLES = "v as (select vec_id // 10 as rec, cast(vec_id % 10 as bigint) as k, embedding as e from embeddings), n as (select rec, sum(64) over (partition by rec order by k rows between unbounded preceding and 1 preceding) as before, e from v), s as (select rec, coalesce(before, 0) + i - 1 as pos, cast(floor(10000 * cast(e[i] as double)) as bigint) as x from (select *, unnest(range(1, 65)) as i from n))"


def _audio(spark: SparkSession, sf_dir: str) -> str:
    """A folder of recordings, ten vectors each, as WAV files."""
    v = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("rec"), "vec_id", F.transform("embedding", lambda x: F.floor(10000 * x.cast("double")).cast("smallint")).alias("x"))
    whole = v.groupBy("rec").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "x"))), lambda s: s["x"])).alias("samples"))
    folder = f"{fresh_folder(spark, 'audio')}/wav"
    files.register(spark)
    whole.select(F.concat(F.lit("rec"), F.col("rec")).alias("name"), F.lit(16000).alias("rate"), "samples").write.format("wav").mode("append").save(folder)
    return folder


@query(f"with {SAMPLES} select 'rec' || rec as recording, cast(pos // 100 * 100 as bigint) as first, cast(count(*) as integer) as n, cast(sum(x * (pos % 100 + 1)) as bigint) as total from s group by rec, pos // 100")
def wav_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings written as WAV files and read again in rows of 100 samples, by ranges of 700 bytes."""
    rows = spark.read.format("wav").option("block", 100).option("partition_bytes", 700).load(_audio(spark, sf_dir))
    total = F.aggregate(F.transform("samples", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.select("recording", "first", F.size("samples").alias("n"), total.alias("total"))


@query("with r as (select vec_id // 10 as rec, count(*) * 64 as n from embeddings group by all) select 'rec' || rec as speaker, round_even((2 * n + 44) / 1024, 1) as size_kb, 1 as n_files, n / 16000 as duration_s from r")
def speaker_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder's files as speakers, with what their heads say."""
    folder = _audio(spark, sf_dir)
    found = transcripts.audio_files(spark, folder)
    heads = transcripts.decoded(found).select("path", transcripts.duration_s(F.col("n"), F.col("rate")).alias("duration_s"))
    return transcripts.speakers(found).join(heads, "path").select("speaker", "size_kb", F.col("n_files").cast("int").alias("n_files"), "duration_s")


TIME = "(cs{0} // 360000) || ':' || lpad(cast(cs{0} % 360000 // 6000 as varchar), 2, '0') || ':' || lpad(cast(cs{0} % 6000 // 100 as varchar), 2, '0') || '.' || lpad(cast(cs{0} % 100 as varchar), 2, '0')"
HEAD = "\n".join(files.ASS_HEAD).replace("'", "''").split("{name}")


@query(rf"""with {TALK}, s as (select recording_id, part, seg_ord, start_ms as a, end_ms as b, regexp_extract_all(replace(text, chr(10), '\N'), '[^ ]+ *') as u from talk),
 x as (select recording_id, part, seg_ord, -1 as k, a as s, b as e, 0 as layer, array_to_string(u, '') as said from s
 union all select recording_id, part, seg_ord, k, a + k * 30, greatest(a + k * 30 + 30 * (k % 4), a + k * 30 + 80), 1, array_to_string(u[:k], '') || '{{\c&H00FFFF&}}' || u[k + 1] || '{{\r}}' || array_to_string(u[k + 2:], '') from (select *, unnest(range(0, len(u))) as k from s)),
 c as (select *, cast(round_even(s / 1000 * 100, 0) as bigint) as cs1, cast(round_even(e / 1000 * 100, 0) as bigint) as cs2 from x), l as (select *, 'Dialogue: ' || layer || ',' || {TIME.format(1)} || ',' || {TIME.format(2)} || ',Default,,0,0,0,,' || said as event from c)
 select 'r' || recording_id || '_' || part as name, count(*) as n_events, md5('{HEAD[0]}' || 'r' || recording_id || '_' || part || '{HEAD[1]}' || chr(10) || string_agg(event || chr(10), '' order by seg_ord, k)) as content from l group by recording_id, part""")
def subtitle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subtitle file for each part, word by word over its turns, written and read again.

    Every line says its whole turn again: turns are dealt before they become lines, and files are compressed.
    """
    unit = lambda u, i: F.struct(u.alias("unit"), (F.col("start_ms") + i * 30).alias("start_ms"), (F.col("start_ms") + i * 30 + 30 * (i % 4)).alias("end_ms"))
    words = F.regexp_extract_all(F.replace("text", F.lit("\n"), F.lit(r"\N")), F.lit("[^ ]+ *"), F.lit(0))
    rows = talk(spark, sf_dir).select(F.struct("recording_id", "part", "seg_ord").alias("seg_id"), "start_ms", "end_ms", F.transform(words, unit).alias("units"))
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "seg_id.recording_id", "seg_id.part").sortWithinPartitions("seg_id")
    events = transcripts.subtitle_events(dealt).select(F.concat(F.lit("r"), F.col("seg_id.recording_id"), F.lit("_"), F.col("seg_id.part")).alias("name"), "event")
    folder = f"{fresh_folder(spark, 'subtitles')}/ass"
    files.write_dealt_subtitles(events, "name", folder, "gzip")
    read = spark.read.option("pathGlobFilter", "*.ass.gz").text(folder, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.ass\.gz$", 1)
    return read.select(name.alias("name"), F.regexp_count("value", F.lit("(?m)^Dialogue: ")).cast("long").alias("n_events"), F.md5(F.col("value").cast("binary")).alias("content"))


@query(f"with {TALK} select recording_id, part, cast(row_number() over (partition by recording_id order by part, seg_ord) - 1 as bigint) as seg_ord, cast(start_ms as bigint) as start_ms, cast(end_ms as bigint) as end_ms, speaker, md5(text) as text from talk")
def combined_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recording written as a combined transcript document and its segments read again."""
    rows = talk(spark, sf_dir)
    fields = [(F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.col("speaker"), F.col("text"), F.col("part"), F.lit(None).cast("string").alias("speaker_global")]
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("part", "seg_ord", F.struct(*fields).alias("s")))), lambda x: x["s"])
    whole = rows.groupBy("recording_id").agg(in_order.alias("segments")).select(F.col("recording_id").cast("string").alias("video_id"), F.lit("talk").alias("source"), F.array().cast(f"array<{transcripts.PART}>").alias("parts"), "segments")
    folder = f"{fresh_folder(spark, 'combined')}/json"
    transcripts.write_segments(whole, folder)
    # a document a line here; the reader also takes documents over many lines
    read = spark.read.schema(transcripts.COMBINED).json(folder)
    return transcripts.segments(read).select(F.col("recording_id").cast("long").alias("recording_id"), "part", "seg_ord", "start_ms", "end_ms", "speaker", F.md5(F.col("text").cast("binary")).alias("text"))


@query(f"with {TALK}, d as (select recording_id, part, count(*) as kept from talk where part % 3 <> 1 group by all) select recording_id, part, seg_ord, kept from talk join d using (recording_id, part)")
def gathered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with the results of those parts that are done, read from the parts' own files."""
    rows = talk(spark, sf_dir)
    results = rows.groupBy("recording_id", "part").agg(F.count("*").alias("kept")).withColumn("status", F.when(F.col("part") % 3 == 1, "error").otherwise("ok"))
    folder = f"{fresh_folder(spark, 'parts')}/json"
    transcripts.write_segments(results, folder)
    done = spark.read.schema(results.schema).json(folder)
    return transcripts.gathered(rows, done, ["recording_id", "part"]).select("recording_id", "part", "seg_ord", "kept")
