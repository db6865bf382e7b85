"""Named queries over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators import alignment, iterative_cut as cutting, reports, spans, speakers
from parlance.plans.adapters import MARKS, TALK, VOICES, marks, table, talk, voices
from parlance.sources import transcripts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- transcripts ------------------------------------------------------------

def _shift_parsed(said: DataFrame) -> DataFrame:
    """The segments (``tag``, ``body``) written as one tagged text for each part, parsed again, and shifted by the part's start."""
    raw = said.groupBy("recording_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("seg_ord", tx.render_tagged(F.col("start_ms"), F.col("tag"), F.col("body"), F.col("end_ms")).alias("t")))).alias("ts")
    )
    parsed = raw.select("recording_id", "part", F.col("ts.seg_ord").alias("ords"), F.posexplode(tx.parse_tagged(F.array_join(F.transform("ts", lambda t: t["t"]), ""))).alias("i", "s"))
    rows = parsed.select("recording_id", "part", F.get("ords", F.col("i")).alias("seg_ord"), F.col("s.start").cast("long").alias("start_ms"), F.col("s.end").cast("long").alias("end_ms"), "s.speaker", "s.text")
    offsets = said.select("recording_id", "part").distinct().withColumn("offset_ms", F.col("part").cast("long") * 1000000)
    return spans.shift(rows, offsets, ["recording_id", "part"])


@query(f"""with {TALK} select recording_id, part, seg_ord - 0 as seg_ord, part * 1000000 + start_ms as start_ms, part * 1000000 + end_ms as end_ms,
 case speaker when 'user' then 'S01' when 'assistant' then 'S02' else 'S03' end as speaker, trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') as text from talk""")
def segment_shift_parse_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged text written for each part, parsed again, and shifted by the part's start.  Turns are whole: nothing is stripped but the white space around them."""
    said = talk(spark, sf_dir).withColumns({
        "tag": F.when(F.col("speaker") == "user", "S01").when(F.col("speaker") == "assistant", "S02").otherwise("S03"),
        "body": tx.escape_tags(F.col("text")),
    })
    return _shift_parsed(said).withColumn("text", tx.unescape_tags(F.col("text")))


@query(f"""with {TALK}, g as (select recording_id, speaker, count(*) as n_segments, cast(sum(end_ms - start_ms) as bigint) as speech_ms, array_to_string(list_sort(list(distinct part)), ',') as parts,
 min(start_ms + part * 100000) as first_ms, max(end_ms + part * 100000) as last_ms from talk group by all)
 select *, 'G' || lpad(cast(row_number() over (partition by recording_id order by first_ms, speaker) as varchar), 2, '0') as label from g""")
def speaker_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = talk(spark, sf_dir).withColumns({c: F.col(c) + F.col("part") * F.lit(100000) for c in ("start_ms", "end_ms")})
    return speakers.rollup(rows, ["recording_id"]).withColumn("parts", F.array_join(F.col("parts").cast("array<string>"), ","))


@query(f"""with {TALK}, m as (select distinct part, speaker, 'G' || part || speaker as gid from talk where part % 2 = 0)
 select recording_id, part, seg_ord, speaker, coalesce(gid, 'U_p' || part || '_' || speaker) as speaker_global from talk left join m using (part, speaker)""")
def speaker_map_left_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = talk(spark, sf_dir)
    mapping = rows.where("part % 2 = 0").select("part", "speaker").distinct().withColumn("gid", F.concat(F.lit("G"), F.col("part").cast("string"), "speaker"))
    return speakers.with_global(rows, mapping).select("recording_id", "part", "seg_ord", "speaker", "speaker_global")


@query(f"""with {TALK} select recording_id, seg_ord, start_ms, end_ms, end_ms - start_ms as duration_ms,
 coalesce(nullif(case when part % 3 = 0 then '' when part % 3 = 1 then 'G01' end, ''), nullif(speaker, ''), 'UNKNOWN') as speaker, length(text) as n from talk""")
def result_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = talk(spark, sf_dir).withColumn("speaker_global", F.when(F.col("part") % 3 == 0, "").when(F.col("part") % 3 == 1, "G01"))
    return transcripts.result(rows).withColumn("n", F.length("text").cast("long")).drop("text")


@query(f"""with {TALK}, d as (select recording_id, part, max(end_ms) as d from talk group by all), r as (select t.*, d, row_number() over (partition by recording_id, part order by start_ms desc, seg_ord desc) as rn from talk t join d using (recording_id, part))
 select recording_id, part, arg_min(seg_ord, rn) as seg_ord, arg_min(start_ms, rn) as start_ms, arg_min(end_ms, rn) as end_ms from r where rn >= 2 and end_ms <= d - 500 group by all""")
def anchor_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = talk(spark, sf_dir)
    total = F.max("end_ms").over(Window.partitionBy("recording_id", "part"))
    return spans.anchors(rows.withColumn("total", total + spans.TAIL_MARGIN - 500), ["recording_id", "part"], F.col("total"))


@query(f"""with {TALK} select recording_id, part, seg_ord, start_ms, end_ms from talk where (part = 0 or end_ms > 300 + 50) and end_ms <= 3000""")
def head_tail_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = talk(spark, sf_dir)
    kept = rows.where(spans.head_kept(F.col("end_ms"), F.lit(300), F.col("part")) & spans.tail_kept(F.col("end_ms"), F.lit(3000)))
    return kept.select("recording_id", "part", "seg_ord", "start_ms", "end_ms")


@query(f"""with {TALK} select recording_id, part, seg_ord, (end_ms > 2000 + 5000 or start_ms < -5000) as flagged from talk""")
def bounds_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk(spark, sf_dir).select("recording_id", "part", "seg_ord", spans.out_of_bounds(F.col("start_ms"), F.col("end_ms"), F.lit(2000)).alias("flagged"))


@query(f"""with {TALK}, t as (select recording_id, part, max(end_ms) as dur from talk group by all)
 select recording_id, part, k, k * 270 as start_ms, least(k * 270 + 300, dur) as end_ms from t, lateral (select unnest(range(0, cast(ceil(dur / 270.0) as bigint))) as k) where dur > 0""")
def sliding_windows_swarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = talk(spark, sf_dir).groupBy("recording_id", "part").agg(F.max("end_ms").alias("dur"))
    return spans.windows(total, "dur", 300, 30, False).drop("dur")


@query(f"""with {TALK}, t as (select recording_id, part, max(end_ms) as dur from talk group by all)
 select recording_id, part, k, k * 270 as start_ms, least(k * 270 + 300, dur) as end_ms from t, lateral (select unnest(range(0, cast(ceil(dur / 270.0) as bigint))) as k) where dur > 0 and (k = 0 or (k - 1) * 270 + 300 < dur)""")
def sliding_windows_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = talk(spark, sf_dir).groupBy("recording_id", "part").agg(F.max("end_ms").alias("dur"))
    return spans.windows(total, "dur", 300, 30, True).drop("dur")


@query(f"""with {TALK}, t as (select recording_id, part, max(end_ms) as dur from talk group by all), w as (select recording_id, part, k, k * 500 as ws, least(k * 500 + 1000, dur) as we from t, lateral (select unnest(range(0, cast(ceil(dur / 500.0) as bigint))) as k) where dur > 0)
 select w.recording_id, w.part, k, count(*) as n_segments, md5(string_agg(text, chr(10) order by s.start_ms, seg_ord)) as context from w join talk s on w.recording_id = s.recording_id and w.part = s.part and ws < s.end_ms and s.start_ms < we group by all""")
def context_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = talk(spark, sf_dir)
    w = spans.windows(rows.groupBy("recording_id", "part").agg(F.max("end_ms").alias("dur")), "dur", 1000, 500, False)
    return spans.injected(w, rows, ["recording_id", "part"], 2000).select("recording_id", "part", "k", "n_segments", F.md5(F.col("context").cast("binary")).alias("context"))


@query(f"""with {TALK}, b as (select recording_id, part, start_ms, 'transcript' as kind, seg_ord as ord from talk union all select recording_id, part, seg_ord * 500, 'visual', seg_ord from talk)
 select b.*, row_number() over (partition by recording_id, part order by start_ms, kind, ord) as place from b""")
def two_stream_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = talk(spark, sf_dir)
    said = rows.select("recording_id", "part", "start_ms", F.lit("transcript").alias("kind"), F.col("seg_ord").alias("ord"))
    seen = rows.select("recording_id", "part", (F.col("seg_ord") * 500).alias("start_ms"), F.lit("visual").alias("kind"), F.col("seg_ord").alias("ord"))
    return said.unionByName(seen).withColumn("place", F.row_number().over(Window.partitionBy("recording_id", "part").orderBy("start_ms", "kind", "ord")))


@query(f"""with {TALK} select recording_id, part, seg_ord, (row_number() over (partition by recording_id order by part, seg_ord) - 1) // 20 as chunk from talk""")
def cleaning_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk(spark, sf_dir).select("recording_id", "part", "seg_ord", spans.chunk_id(["recording_id"], ["part", "seg_ord"]).alias("chunk"))


@query(f"""with {TALK}, done as (select distinct recording_id, part from talk where part % 2 = 1) select recording_id, part, seg_ord from talk anti join done using (recording_id, part)""")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = talk(spark, sf_dir)
    done = rows.select("recording_id", "part", F.when(F.col("part") % 2 == 1, "ok").otherwise("failed").alias("status"))
    return transcripts.not_done(rows, done, ["recording_id", "part"]).select("recording_id", "part", "seg_ord")


@query(f"""with {TALK} select recording_id, round(least(max(end_ms) / 9000.0, 1), 3) as progress from talk group by all""")
def progress_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk(spark, sf_dir).groupBy("recording_id").agg(tx.progress(F.col("end_ms"), F.lit(9000.0)).alias("progress"))


@query()
def iterative_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of joined parts, cut again into nominal lengths of six seconds."""
    rows = talk(spark, sf_dir).withColumns({c: F.col(c) + F.col("part") * F.lit(8000) for c in ("start_ms", "end_ms")})
    rows = rows.withColumn("total_ms", F.max("end_ms").over(Window.partitionBy("recording_id")))
    out = cutting.iterative_cut(rows.select("recording_id", "start_ms", "end_ms", "speaker", "text", "total_ms"), "recording_id", 6000)
    return out.withColumn("n_kept", F.size("kept")).drop("kept")


@query()
def ordered_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn found again among all that was said, in order."""
    rows = talk(spark, sf_dir).withColumn("pos", F.col("part") * F.lit(1000).cast("long") + F.col("seg_ord"))
    wanted = rows.where("speaker = 'user'").select("recording_id", F.col("pos").alias("ord"), "text")
    return alignment.ordered_match(wanted, rows.select("recording_id", "pos", "text"), "recording_id")


# --- spans of events --------------------------------------------------------

PADS = "cast(case when {g} is null then 150 else least(150, floor(greatest({g}, 0) * 2 / 5.0)) end as bigint)"


@query(f"with {MARKS}, n as (select *, start_ms - lag(end_ms) over w as g1, lead(start_ms) over w - end_ms as g2 from marks window w as (partition by user_id order by start_ms, event_id)) select user_id, event_id, {PADS.format(g='g1')} as pad_before, {PADS.format(g='g2')} as pad_after from n")
def gap_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.gap_pads(marks(spark, sf_dir), ["user_id"], ["event_id"]).select("user_id", "event_id", "pad_before", "pad_after")


ISLANDS = f"""{MARKS}, r as (select *, max(end_ms) over (partition by user_id order by start_ms, end_ms, event_id rows between unbounded preceding and 1 preceding) as reach from marks),
 i as (select *, sum(case when reach is null or start_ms - reach > 50 then 1 else 0 end) over (partition by user_id order by start_ms, end_ms, event_id rows unbounded preceding) as island from r),
 m as (select user_id, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as n from i group by user_id, island)"""


@query(f"with {ISLANDS} select * from m")
def islands_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.islands(marks(spark, sf_dir), ["user_id"], ["event_id"])


@query(f"""with {ISLANDS}, l as (select *, least(greatest(end_ms, start_ms + 300), 1706745600000 - 33) as x, lead(start_ms) over (partition by user_id order by start_ms, end_ms) - 10 as nxt from m)
 select user_id, start_ms, end_ms, n, least(x, coalesce(nxt, x)) as capped_ms from l""")
def clip_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = spans.islands(marks(spark, sf_dir), ["user_id"], ["event_id"])
    return spans.clip_caps(merged, ["user_id"], F.lit(1706745600000))


@query(f"""with {MARKS} select a.user_id, a.event_id, b.event_id as other_id, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) as shared_ms from marks a join marks b on a.user_id = b.user_id and a.event_id < b.event_id and a.start_ms < b.end_ms and b.start_ms < a.end_ms""")
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = marks(spark, sf_dir).drop("event_type")
    other = m.select("user_id", F.col("event_id").alias("other_id"), F.col("start_ms").alias("r_start_ms"), F.col("end_ms").alias("r_end_ms"))
    pairs = spans.overlap_join(m, other, ["user_id"], 20_000_000).where("event_id < other_id")
    return pairs.select("user_id", "event_id", "other_id", (F.least("end_ms", "r_end_ms") - F.greatest("start_ms", "r_start_ms")).alias("shared_ms"))


@query("""with w as (select event_id, case when event_id % 7 = 0 then null else event_id % 1000 end as s, case when event_id % 11 = 0 then null else event_id % 1000 + event_id % 5 - 2 end as e, event_id % 1000 as rs, event_id % 1000 + event_id % 900 as re from events),
 c as (select *, case when s is null or e is null then 'invalid' when e > s then 'fixed' when re - rs > 0 and re - rs <= 600 then 'raw_window' else 't_pad' end as source from w)
 select event_id, source, case source when 'fixed' then s when 'raw_window' then rs when 't_pad' then greatest(s - 200, 0) end as start_ms, case source when 'fixed' then e when 'raw_window' then re when 't_pad' then s + 200 end as end_ms from c""")
def clip_window_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    start, end = F.when(e % 7 != 0, e % 1000), F.when(e % 11 != 0, e % 1000 + e % 5 - 2)
    return table(spark, sf_dir, "events").select("event_id", spans.clip_window(start, end, e % 1000, e % 1000 + e % 900).alias("w")).select("event_id", "w.*")


@query("""with f as (select user_id, event_id * 100 as start_ms, event_id * 100 + 100 as end_ms from events where value >= 20), r as (select *, max(end_ms) over (partition by user_id order by start_ms rows between unbounded preceding and 1 preceding) as reach from f),
 i as (select *, sum(case when reach is null or start_ms - reach > 6000 then 1 else 0 end) over (partition by user_id order by start_ms rows unbounded preceding) as k from r) select user_id, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as n from i group by user_id, k""")
def speech_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") * 100).alias("start_ms"), (F.col("event_id") * 100 + 100).alias("end_ms"), F.col("value").alias("probability"))
    return spans.speech_islands(frames, ["user_id"], 20.0, 6000)


@query("select event_id from events where event_id % greatest(cast(floor(30.0 / 4) as bigint), 1) = 0")
def frame_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(spans.sampled(F.col("event_id"), F.lit(30.0), 4)).select("event_id")


@query("""with p as (select user_id, event_id, event_id * 10 as s, event_id * 10 + event_id % 13 - 3 as e from events), r as (select *, max(e) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as reach from p)
 select event_id, array_to_string(list_filter([case when e < s then 'reversed' end, case when s < 5000 - 20 then 'before_chunk' end, case when e > 60000 + 20 then 'after_chunk' end, case when s < reach - 80 then 'non_monotone' end, case when event_id % 9 = 0 then 'empty' end], lambda x: x is not null), ',') as issues from r""")
def alignment_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (e * 10).alias("start_ms"), (e * 10 + e % 13 - 3).alias("end_ms"), F.lit(5000).alias("chunk_start_ms"), F.lit(60000).alias("chunk_end_ms"), F.when(e % 9 == 0, " ").otherwise("w").alias("unit"))
    return alignment.issues(rows, ["user_id"], "event_id").select("event_id", F.array_join("issues", ",").alias("issues"))


@query("select event_id, (e > s and s >= 1000 - 500 and e <= 9000 + 500) as valid from (select event_id, event_id as s, event_id + event_id % 4 - 1 as e from events)")
def word_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", alignment.word_valid(e, e + e % 4 - 1, F.lit(1000), F.lit(9000)).alias("valid"))


@query()
def lis_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: F.floor(x["value"] + x["event_id"])).alias("times"))
    return alignment.repaired(rows).select("user_id", F.array_join(F.col("fixed").cast("array<string>"), ",").alias("fixed"))


# --- reports ----------------------------------------------------------------

@query("select event_type, count(*) as n from events group by all")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_counts(table(spark, sf_dir, "events"), "event_type")


@query("""with w as (select user_id, count(*) filter (event_type = 'error') as empty_advance, count(*) filter (event_type = 'view') as fallback_blind_cut from events group by all)
 select *, array_to_string(list_filter([case when empty_advance > 0 then empty_advance || ' parts empty-advance' end, case when fallback_blind_cut > 0 then fallback_blind_cut || ' parts fallback-blind-cut' end], lambda x: x is not null), '; ') as warnings from w""")
def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "empty-advance").when(F.col("event_type") == "view", "fallback-blind-cut").otherwise("ok")
    rows = table(spark, sf_dir, "events").select("user_id", status.alias("status"))
    return reports.warnings(rows, ["user_id"]).withColumn("warnings", F.array_join("warnings", "; "))


@query("""with c as (select event_type, cast(floor(value * 100) as bigint) as v from events) select event_type, count(*) as n, cast(sum(v) as bigint) as total, min(v) as least, list_sort(list(v))[count(*) // 2 + 1] as upper_median, max(v) as largest from c group by all""")
def upper_median_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") * 100).cast("long").alias("v"))
    return reports.clip_stats(rows, ["event_type"], "v")


@query("select user_id, count(*) as n from events group by all order by n desc, user_id limit 15")
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.most_common(table(spark, sf_dir, "events"), "user_id", 15)


@query("""select event_id, cast(json_extract(props, '$.k') as bigint) as k from events""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.from_json(tx.unfence(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))), "k bigint")
    return table(spark, sf_dir, "events").select("event_id", value["k"].alias("k"))


@query("""select event_id, case when event_id % 10 = 0 then 'missing' when event_id % 17 = 0 then 'empty' when abs(event_id % 400 - 200) > 150 then 'duration' end as problem from events""")
def verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(e % 10 != 0, e % 17).alias("size"), (e % 400).alias("measured_ms"), F.lit(200).alias("duration_ms"))
    return reports.verification(rows).select("event_id", "problem")


@query("select event_id from events where event_type in ('click', 'error') and ts < timestamp '2024-01-15 00:00:00' - interval 3600 second")
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "done").otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("event_id", status.alias("status"), F.col("ts").cast("timestamp").alias("finished_at"))
    return reports.stale(rows, F.lit("2024-01-15 00:00:00").cast("timestamp"), 3600).select("event_id")


@query("""with t as (select event_id, event_id * 137 as ms from events) select event_id, lpad(cast(ms // 3600000 as varchar), 2, '0') || ':' || lpad(cast(ms % 3600000 // 60000 as varchar), 2, '0') || ':' || lpad(cast(ms % 60000 // 1000 as varchar), 2, '0') || '.' || lpad(cast(ms % 1000 as varchar), 3, '0') as timecode from t""")
def timecodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tx.timecode(F.col("event_id") * 137 / 1000, carry=True).alias("timecode"))


@query("""with n as (select event_id, 'f' || event_id % 50 || '.wav' as name from events), k as (select *, row_number() over (partition by name order by event_id) - 1 as k from n) select event_id, name, case when k = 0 then name else replace(name, '.wav', '_' || k || '.wav') end as stored from k""")
def upload_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("f"), (F.col("event_id") % 50).cast("string"), F.lit(".wav")).alias("name"))
    return transcripts.without_collisions(rows, "event_id").select("event_id", "name", "stored")


# --- words of documents -----------------------------------------------------

@query("select doc_id, len(regexp_extract_all(text, '(?i)the|und|les')) as n from documents where regexp_matches(text, '(?i)the|und|les')")
def lexicon_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where(tx.lexicon_hit(F.col("text"), "(?i)the|und|les"))
    return rows.select("doc_id", F.regexp_count("text", F.lit("(?i)the|und|les")).cast("long").alias("n"))


@query("""with h as (select unnest(regexp_extract_all(text, '.?tion.?', 0)) as m from documents), c as (select case when m[1] = 't' and m[:4] = 'tion' then '^' else m[1] end as prev from h) select prev, count(*) as n from c group by all""")
def kwic_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = reports.kwic(table(spark, sf_dir, "documents").select("text"), ".?tion.?")
    prev = F.when(F.startswith("match", F.lit("tion")), "^").otherwise(F.substring("match", 1, 1))
    return hits.groupBy(prev.alias("prev")).agg(F.count("*").alias("n"))


@query(r"select doc_id, len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]|[A-Za-z0-9]+')) as n_units, regexp_extract_all(text, '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]|[A-Za-z0-9]+')[1] as first_unit from documents")
def tokenize_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = tx.units(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(u).cast("long").alias("n_units"), F.get(u, F.lit(0)).alias("first_unit"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as k from documents),
 g as (select *, list_distinct(list_transform(range(1, greatest(length(text) - 2, 1) + 1), lambda i: substr(text, i, 3))) as grams from l), p as (select *, lag(grams) over (partition by doc_id order by k) as prev from g)
 select doc_id, count(*) as n_lines, count(*) filter (coalesce(len(list_intersect(grams, prev)) >= 0.8 * len(list_distinct(list_concat(grams, prev))), false)) as n_repeats from p group by all""")
def near_dup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(F.filter(spans.repeat_flags(lines), lambda x: x)).cast("long").alias("n_repeats"))


@query("""select doc_id, array_to_string(list_filter(list_transform(string_split(source || ', ,' || lang || ',' || source, ','), lambda x: trim(x)), lambda x: x <> ''), ', ') as prompt from documents""")
def hot_word_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.hot_words(F.concat("source", F.lit(", ,"), "lang", F.lit(","), "source")).alias("prompt"))


# --- speaker vectors --------------------------------------------------------

CENTRES = """{v}, d as (select part, speaker, unnest(range(1, 65)) as dim, e from voices), m as (select part, speaker, dim, avg(e[dim]) as x from d group by all),
 c as (select part, speaker, list(x order by dim) as l from m group by all), centres as (select part, speaker, list_transform(l, lambda x: x / sqrt(list_dot_product(l, l))) as c from c)"""


@query(f"with {CENTRES.format(v=VOICES)} select part, speaker, round(c[1], 4) + 0.0 as x1, round(c[64], 4) + 0.0 as x64 from centres")
def group_centroid_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = speakers.centroids(voices(spark, sf_dir), ["part", "speaker"])
    pick = lambda i: F.round(F.get("centroid", F.lit(i)), 4) + 0.0
    return c.select("part", "speaker", pick(0).alias("x1"), pick(63).alias("x64"))


VOTED = f"""{CENTRES.format(v=VOICES)}, s as (select v.part, v.speaker, vec_id, t.part as t_part, t.speaker as t_speaker, list_dot_product(e, c) as score from voices v join centres t on v.part <> t.part),
 b as (select part, speaker, vec_id, arg_max({{'p': t_part, 's': t_speaker}}, score) as t from s group by all), tally as (select part, speaker, t.p as t_part, t.s as t_speaker, count(*) as n from b group by all)"""


def _tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = voices(spark, sf_dir)
    return speakers.votes(v, speakers.centroids(v, ["recording_id", "part", "speaker"]), ["recording_id"])


@query(f"with {VOTED} select *, cast(floor(n * 1000 / sum(n) over (partition by part, speaker)) as bigint) as share from tally")
def vote_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = speakers.affinity(_tally(spark, sf_dir), ["recording_id"])
    return shares.select("part", "speaker", "t_part", "t_speaker", "n", F.floor(F.col("share") * 1000 + 1e-9).cast("long").alias("share"))


@query(f"with {VOTED} select part, speaker, max(n) as top_votes, cast(sum(n) as bigint) as n_votes from tally group by all")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = speakers.majority(_tally(spark, sf_dir), ["recording_id"])
    return m.select("part", "speaker", F.round(F.col("agreement") * F.col("n_votes")).cast("long").alias("top_votes"), "n_votes")


@query(f"""with {CENTRES.format(v=VOICES)}, r as (select vec_id, t.part as t_part, t.speaker as t_speaker, row_number() over (partition by vec_id order by list_dot_product(e, c) desc, t.part, t.speaker) as rank from voices, centres t) select * from r where rank <= 3""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's three nearest groups of its recording."""
    v = voices(spark, sf_dir)
    groups = speakers.centroids(v, ["recording_id", "part", "speaker"]).select("recording_id", F.col("part").alias("t_part"), F.col("speaker").alias("t_speaker"), "centroid")
    scored = v.select("recording_id", "vec_id", "embedding").join(groups, "recording_id").withColumn("score", speakers.dot(F.col("embedding"), F.col("centroid")))
    w = Window.partitionBy("vec_id").orderBy(F.col("score").desc(), "t_part", "t_speaker")
    return scored.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("vec_id", "t_part", "t_speaker", "rank")


@query(f"""with {VOICES}, s as (select speaker, list_distinct(list(part * 100 + vec_id % 10)) as x from voices group by all) select a.speaker as a, b.speaker as b, len(list_intersect(a.x, b.x)) as n_both, len(list_distinct(list_concat(a.x, b.x))) as n_all from s a join s b on a.speaker < b.speaker""")
def pair_set_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = voices(spark, sf_dir).groupBy("recording_id", "speaker").agg(F.collect_set(F.col("part") * 100 + F.col("vec_id") % 10).alias("x"))
    other = sets.select("recording_id", F.col("speaker").alias("b"), F.col("x").alias("y"))
    pairs = sets.withColumnRenamed("speaker", "a").join(other, "recording_id").where("a < b")
    return pairs.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("n_both"), F.size(F.array_union("x", "y")).cast("long").alias("n_all"))


@query()
def union_find_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = speakers.centroids(voices(spark, sf_dir), ["recording_id", "part", "speaker"])
    return speakers.union_find(c, ["recording_id"], 0.3).drop("recording_id")


# --- what Spark adds (extensions, not in the inventory's code) ----------------

@query("""select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(12, 2))) as double) as sum_qty, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by rollup (l_returnflag, l_linestatus)""")
def pricing_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return rows.rollup("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("double").alias("sum_qty"), F.count("*").alias("n"))


@query("""select n_name, count(distinct o_orderkey) as n_orders, count(*) as n_lines from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join nation on c_nationkey = n_nationkey where o_orderstatus = 'F' group by all""")
def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li, n = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "nation"))
    lines = li.groupBy("l_orderkey").agg(F.count("*").alias("k"))
    rows = o.where("o_orderstatus = 'F'").join(lines, o["o_orderkey"] == lines["l_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return rows.groupBy("n_name").agg(F.count("*").alias("n_orders"), F.sum("k").alias("n_lines"))


# the inventory's other queries, which register themselves above
from parlance.plans import clusters, conversions, inventory, storage, streams, waves  # noqa: E402, F401
