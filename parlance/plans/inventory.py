"""Named queries for the inventory's remaining operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators import alignment, clips, models, reports, spans, speakers
from parlance.plans.adapters import MARKS, TALK, VOICES, marks, table, talk, voices
from parlance.plans.catalogue import CENTRES, SQL, VOTED, _tally, query
from parlance.sources import transcripts

WORDS = "[A-Za-z]+"
# A little dictionary for conversion.
PHRASES = {"the": "THE", "then": "Then!", "and": "&", "ver": "VER", "de la": "de-la"}

# --- text -------------------------------------------------------------------


@query("select conv_id, turn, translate(text, 'aeiou', 'AEIOU') as t from conversations")
def to_traditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.to_traditional(F.col("text"), "aeiou", "AEIOU").alias("t"))


@query("""select conv_id, turn, array_to_string(list_transform(regexp_extract_all(text, '(?s)de la|then|and|the|ver|.'), lambda p: case p when 'the' then 'THE' when 'then' then 'Then!' when 'and' then '&' when 'ver' then 'VER' when 'de la' then 'de-la' else translate(p, 'xyz', 'XYZ') end), '') as t from conversations""")
def phrase_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.convert_phrases(F.col("text"), PHRASES, "xyz", "XYZ").alias("t"))


@query(r"""with u as (select doc_id, string_split(text, '') as c, regexp_extract_all(text, '[A-Za-z0-9]+') as us, string_split_regex(text, '[A-Za-z0-9]+') as gaps from documents)
 select doc_id, len(us) as n_units, cast(list_sum(list_transform(us, lambda x: length(x))) as bigint) as n_inside, cast(list_sum(list_transform(us, lambda x, i: (i - 1) * length(x))) as bigint) as total from u where len(us) > 0""")
def char_unit_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every character's unit, summed up."""
    index = table(spark, sf_dir, "documents").select("doc_id", tx.unit_index(F.col("text")).alias("x")).select("doc_id", F.array_compact("x").alias("x")).where(F.size("x") > 0)
    return index.select("doc_id", (F.array_max("x") + 1).cast("long").alias("n_units"), F.size("x").cast("long").alias("n_inside"), F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))


@query(r"select doc_id, len(w) as n, md5(array_to_string(w, '|')) as h from (select doc_id, regexp_extract_all(regexp_replace(text, '[^\p{L}\p{N}''\s]', '', 'g'), '[\p{L}\p{N}'']+') as w from documents)")
def units_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tx.units_wide(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.array_join(w, "|").cast("binary")).alias("h"))


@query(r"select doc_id, len(w) as n, md5(array_to_string(w, '|')) as h from (select doc_id, regexp_extract_all(text, '[a-zA-Z0-9''-]+|[\x{4e00}-\x{9fff}]') as w from documents)")
def units_early(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tx.units_early(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.array_join(w, "|").cast("binary")).alias("h"))


@query(r"select conv_id, turn, array_to_string(list_transform(regexp_extract_all(text, '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]|[A-Za-z0-9]+'), lambda w: w || '<timestamp><timestamp>'), '') as prompt from conversations")
def timestamp_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.timestamp_prompt(tx.units(F.col("text"))).alias("prompt"))


@query("select vec_id, array_to_string(list_transform(range(0, 4), lambda k: (list_position(embedding[k * 16 + 1:k * 16 + 16], list_max(embedding[k * 16 + 1:k * 16 + 16])) - 1) * 80), ',') as ms from embeddings")
def argmax_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(tx.argmax_bins(F.col("embedding"), 16).cast("array<string>"), ",").alias("ms"))


@query(r"""with w as (select conv_id, turn, regexp_extract_all(text, '[A-Za-z0-9]+') as w from conversations)
 select conv_id, turn, array_to_string(list_transform(w, lambda x, i: x || ':' || (5000 * conv_id + 80 * (2 * i - 2)) || '-' || (5000 * conv_id + 80 * (2 * i - 1))), ',') as units from w""")
def paired_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with a pair of times each, made absolute by the chunk's start."""
    w = tx.units(F.col("text"))
    times = F.transform(F.sequence(F.lit(0), 2 * F.size("w")), lambda k: k * 80)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", w.alias("w")).select("conv_id", "turn", tx.paired(F.col("w"), times, F.col("conv_id") * 5.0).alias("u"))
    ms = lambda x: F.bround(x * 1000).cast("long").cast("string")
    return rows.select("conv_id", "turn", F.array_join(F.transform("u", lambda u: F.concat(u["unit"], F.lit(":"), ms(u["start_s"]), F.lit("-"), ms(u["end_s"]))), ",").alias("units"))


QUIRK = """with t as (select event_id, event_id * cast(1.000249 as double) as s from events), p as (select event_id, cast(floor(s) as bigint) as w, cast(round_even((s - floor(s)) * 1000, 0) as bigint) as ms from t)"""


@query(QUIRK + """ select event_id, lpad(cast(w // 3600 as varchar), 2, '0') || ':' || lpad(cast(w % 3600 // 60 as varchar), 2, '0') || ':' || lpad(cast(w % 60 + case when ms >= 1000 then 1 else 0 end as varchar), 2, '0') || '.' || lpad(cast(case when ms >= 1000 then 0 else ms end as varchar), 3, '0') as timecode from p""")
def timecode_quirk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time codes as the reference writes them: a rounded-up second doesn't carry into minutes."""
    return table(spark, sf_dir, "events").select("event_id", tx.timecode(F.col("event_id") * F.lit(1.000249)).alias("timecode"))


@query("""with c as (select event_id, event_id * 137 // 10 as cs from events) select event_id, (cs // 360000) || ':' || lpad(cast(cs % 360000 // 6000 as varchar), 2, '0') || ':' || lpad(cast(cs % 6000 // 100 as varchar), 2, '0') || '.' || lpad(cast(cs % 100 as varchar), 2, '0') as t from c""")
def ass_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tx.ass_time(F.floor(F.col("event_id") * 137 / 10) / 100).alias("t"))


@query(r"""with n as (select page_id, regexp_extract(url, '([^/]*)$', 1) as f from pages), r as (select page_id, case when contains(f, '.') then '.' || list_last(string_split(f, '.')) else '' end as s from n), c as (select page_id, substr(regexp_replace(lower(s), '[^a-z0-9.]', '', 'g'), 1, 10) as s from r)
 select page_id, case when length(s) > 1 then s else '.audio' end as suffix from c""")
def file_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.suffix(F.regexp_extract("url", "([^/]*)$", 1)).alias("suffix"))


@query("""select event_id, case when event_id % 3 = 0 then null else cast(json_extract(props, '$.k') as bigint) end as k, case when event_id % 3 = 0 then 'no json: ' || props end as raw from events""")
def json_or_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers, fenced or bare, of which every third is no JSON."""
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("no json: "), "props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```\n"), "props", F.lit("\n```"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", tx.json_or_raw(said, "k bigint").alias("x")).select("event_id", "x.value.k", F.col("x.raw_response").alias("raw"))


@query("select user_id, event_id, event_type as subject, 'has' as predicate, cast(event_id % 7 as varchar) as object from events where event_id % 2 = 0")
def relation_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.format_string('{"subject": "%s", "predicate": "has", "object": "%s"}', "event_type", F.col("event_id") % 7)
    answer = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"triples": ['), one, F.lit("]}"))).otherwise('{"triples": []}')
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.explode(tx.triples(answer)).alias("t")).select("user_id", "event_id", "t.*")


@query("""select event_id, case when event_id % 4 = 0 then 'OVERLAP' else 'SPEAKER' end as type, case when event_id % 4 = 0 then 'OVERLAP' else event_type end as speaker, case when event_id % 4 = 0 then event_type || '+X' end as speakers,
 case when event_id % 4 <> 0 then case when event_id % 5 = 0 then 0.0 else round_even(cast(event_id % 1000 as double) / 1024, 4) end end as confidence from events""")
def diarization_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = F.when(F.col("event_id") % 4 == 0, F.array("event_type", F.lit("X"))).otherwise(F.array("event_type"))
    sure = F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 1000 / 1024)
    return table(spark, sf_dir, "events").select("event_id", tx.diarization_row(who, sure).alias("d")).select("event_id", "d.type", "d.speaker", F.array_join("d.speakers", "+").alias("speakers"), "d.confidence")


@query(r"select conv_id, turn, array_to_string(list_transform(string_split(text, ' '), lambda p, i: case when i = 2 then '{\c&H00FFFF&}' || p || '{\r}' else p end), '') as t from conversations")
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.highlight(F.split("text", " ", -1), F.lit(1)).alias("t"))


@query("select event_id, cast(ceil(event_id / 80000.0) * 80000 - event_id as bigint) as pad from events")
def wrap_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tx.wrap_pad(F.col("event_id"), 80000).cast("long").alias("pad"))


@query("""with c as (select doc_id, string_split(replace(replace(replace(text, 'the', '對'), 'not', '不'), 'and', '沒錯'), '') as ch, replace(replace(replace(text, 'the', '對'), 'not', '不'), 'and', '沒錯') as t from documents),
 n as (select doc_id, len(list_filter(range(1, len(ch) + 1), lambda i: ch[i] = '對' and (i = 1 or not list_contains(['不', '相', '互', '絕', '反', '派', '配', '視', '針'], ch[i - 1])) and (i = len(ch) or not list_contains(['於', '不', '起', '象', '應', '吧'], ch[i + 1])))) + (length(t) - length(replace(t, '沒錯', ''))) // 2 as n from c)
 select doc_id, n from n where n > 0""")
def lexicon_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affirmation lexicon with its lookarounds, over texts that are given its characters."""
    said = F.replace(F.replace(F.replace("text", F.lit("the"), F.lit("對")), F.lit("not"), F.lit("不")), F.lit("and"), F.lit("沒錯"))
    rows = table(spark, sf_dir, "documents").select("doc_id", said.alias("text")).where(tx.lexicon_hit(F.col("text")))
    return rows.select("doc_id", F.regexp_count("text", F.lit(tx.LEXICON)).cast("long").alias("n"))


@query("""with h as (select text as t, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) as k, string_split(text, ' ') as ws from conversations),
 p as (select t, list_sum(list_transform(ws[:k - 1], lambda x: length(x) + 1)) as a, w from h where w = 'of')
 select case when coalesce(a, 0) + 3 > length(t) then '$' else t[cast(coalesce(a, 0) + 3 as bigint)] end as next, t[cast(greatest(coalesce(a, 0) - 2, 1) as bigint):cast(coalesce(a, 0) + 5 as bigint)] as around, count(*) as n from p group by all""")
def kwic_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows the word ``of``, and three characters around it."""
    hits = reports.kwic(table(spark, sf_dir, "conversations").select("text"), r"(?<![^ ])of(?![^ ])")
    return hits.groupBy("next", "around").agg(F.count("*").alias("n"))


# --- alignment and clips ------------------------------------------------------

SPANNED = r"""with c as (select conv_id, turn, text, string_split(text, 'the') as ps from conversations), p as (select conv_id, turn, text, unnest(range(1, len(ps))) as k, ps from c),
 s as (select conv_id, turn, text, cast(list_sum(list_transform(ps[:k], lambda x: length(x))) + 3 * (k - 1) as bigint) as a from p),
 u as (select conv_id, turn, a, a + 3 as b, len(regexp_extract_all(substr(text, 1, a + 1), '[A-Za-z0-9]+')) - 1 as first, len(regexp_extract_all(substr(text, 1, a + 3), '[A-Za-z0-9]+')) - 1 as last from s)"""


@query(SPANNED + " select conv_id, turn, a as start, b as end, first, last, first * 160 as start_ms, last * 160 + case when last % 5 = 0 then 0 else 160 end as end_ms, case when last * 160 + case when last % 5 = 0 then 0 else 160 end <= first * 160 then 'empty span' end as issue from u")
def span_unit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a word joined to aligned units through their characters; every fifth unit has no length."""
    unit = lambda u, i: F.struct(u.alias("unit"), (i * 160).cast("long").alias("start_ms"), (i * 160 + F.when(i % 5 == 0, 0).otherwise(160)).cast("long").alias("end_ms"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.transform(tx.units(F.col("text")), unit).alias("units"))
    found = rows.select("conv_id", "turn", F.explode(clips.matched_units(F.col("text"), F.col("units"), "the")).alias("m"))
    return found.select("conv_id", "turn", "m.start", "m.end", "m.first", "m.last", "m.start_ms", "m.end_ms", "m.issue")


#: Events as matches of segments (16 events of a user each), in the order of their numbers.
MATCHES = """m as (select user_id, event_id, event_id // 64 as seg_id, event_type as word, case when event_id % 13 = 0 then null else event_id * 40 end as s, case when event_id % 13 = 0 then null else event_id * 40 + case when event_id % 4 = 0 then 0 else event_id % 90 end end as e,
 event_id * 40 + 5 as rs, event_id * 40 + event_id % 1500 as re, event_id % 6 <> 0 as valid from events),
 w as (select *, case when s is null or e is null then 'invalid' when e > s then 'fixed' when re - rs > 0 and re - rs <= 600 then 'raw_window' else 't_pad' end as source from m where valid and seg_id % 9 <> 0),
 x as (select user_id, event_id, seg_id, word, source, case source when 'fixed' then s when 'raw_window' then rs else greatest(s - 200, 0) end as a, case source when 'fixed' then e when 'raw_window' then re else s + 200 end as b from w where source <> 'invalid')"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    start = F.when(e % 13 != 0, e * 40)
    match = F.struct(
        "event_id", F.col("event_type").alias("word"), start.alias("start_ms"), (start + F.when(e % 4 == 0, 0).otherwise(e % 90)).alias("end_ms"), (e * 40 + 5).alias("raw_start_ms"), (e * 40 + e % 1500).alias("raw_end_ms"),
        F.when(e % 6 == 0, False).when(e % 6 == 1, True).alias("valid"),
    )
    rows = table(spark, sf_dir, "events").withColumn("seg_id", F.floor(e / 64))
    return rows.groupBy("user_id", "seg_id").agg(F.array_sort(F.collect_list(match)).alias("matches")).withColumn("ok", F.when(F.col("seg_id") % 9 == 0, False).when(F.col("seg_id") % 9 == 1, True))


@query(f"with {MATCHES} select user_id, seg_id, count(*) as n, array_to_string(list(source order by event_id), ',') as sources from x group by all")
def clip_source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clips.usable_matches(_segments(spark, sf_dir))
    return rows.select("user_id", "seg_id", F.size("windows").cast("long").alias("n"), F.array_join(F.transform("windows", lambda x: x["w"]["source"]), ",").alias("sources"))


def _in_order(sql: str) -> str:
    """In-segment merging in SQL, as a fold over each segment's matches in their order."""
    fold = """r as (select user_id, seg_id, 1 as pos, a as start_ms, b as end_ms, 1 as k, n from o where pos = 1
 union all select o.user_id, o.seg_id, o.pos, case when o.a - r.end_ms <= 50 then r.start_ms else o.a end, case when o.a - r.end_ms <= 50 then greatest(r.end_ms, o.b) else o.b end, case when o.a - r.end_ms <= 50 then r.k else r.k + 1 end, o.n from r join o on o.user_id = r.user_id and o.seg_id = r.seg_id and o.pos = r.pos + 1)"""
    return f"""with recursive {MATCHES}, o as (select user_id, seg_id, a, b, word, source, row_number() over (partition by user_id, seg_id order by event_id) as pos, count(*) over (partition by user_id, seg_id) as n from x), {fold},
 i as (select r.user_id, r.seg_id, r.k, arg_max(r.start_ms, r.pos) as start_ms, arg_max(r.end_ms, r.pos) as end_ms, list(o.word order by r.pos) as words, list(o.source order by r.pos) as sources from r join o on o.user_id = r.user_id and o.seg_id = r.seg_id and o.pos = r.pos group by r.user_id, r.seg_id, r.k){sql}"""


@query(_in_order(" select user_id, seg_id, k - 1 as k, start_ms, end_ms, array_to_string(words, ',') as words, array_to_string(sources, ',') as sources from i"))
def merged_in_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clips.usable_matches(_segments(spark, sf_dir)).select("user_id", "seg_id", F.posexplode(clips.merged_in_segment(F.col("windows"))).alias("k", "c"))
    return rows.select("user_id", "seg_id", "k", "c.start_ms", "c.end_ms", F.array_join("c.words", ",").alias("words"), F.array_join("c.sources", ",").alias("sources"))


LISTED = """, g as (select *, max(end_ms) over (partition by user_id order by start_ms, seg_id, k rows between unbounded preceding and 1 preceding) as reach from i),
 h as (select *, sum(case when reach is null or start_ms - reach > 50 then 1 else 0 end) over (partition by user_id order by start_ms, seg_id, k rows unbounded preceding) as isle from g),
 j as (select user_id, isle, min(start_ms) as start_ms, max(end_ms) as end_ms, flatten(list(words order by start_ms, seg_id, k)) as words from h group by user_id, isle),
 l as (select *, least(greatest(end_ms, start_ms + 300), 400000 - 33) as x, lead(start_ms) over (partition by user_id order by start_ms, end_ms) - 10 as nxt, cast(row_number() over (partition by user_id order by start_ms) as integer) as index from j)"""


@query(_in_order(LISTED + " select user_id, index, start_ms, least(x, coalesce(nxt, x)) as end_ms, least(x, coalesce(nxt, x)) - start_ms as duration_ms, 'clips/clip_' || lpad(cast(index as varchar), 4, '0') || '.mkv' as file, array_to_string(words, ',') as words from l"))
def clip_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from matches to numbered clips."""
    out = clips.clip_list(_segments(spark, sf_dir), ["user_id"], F.lit(400000))
    return out.select("user_id", "index", "start_ms", "end_ms", "duration_ms", "file", F.array_join("words", ",").alias("words"))


@query(_in_order(LISTED + " select user_id, index, printf('%.3f', start_ms / 1000.0) as seek_s, printf('%.3f', (least(x, coalesce(nxt, x)) - start_ms) / 1000.0) as length_s, 'libsvtav1' as codec, 300 as timeout_s, 3 as tries, '2.0,4.0' as waits from l where index <= 5"))
def encode_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the encoder is asked for the first five clips of each recording."""
    out = clips.encode_plan(clips.clip_list(_segments(spark, sf_dir), ["user_id"], F.lit(400000)), "av1", 5)
    return out.select("user_id", "index", "seek_s", "length_s", "codec", "timeout_s", "tries", F.array_join(F.col("waits_s").cast("array<string>"), ",").alias("waits"))


@query("""with u as (select event_id, event_id as s, event_id + event_id % 5 - 2 as e from events) select event_id, (e >= s - 1 and e <= 5000 * 1.1) as sane from u""")
def alignment_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", alignment.sane(e, e + e % 5 - 2, F.lit(5000)).alias("sane"))


@query()
def repair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the repair of every user's times changes."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: F.floor(x["value"] + x["event_id"])).alias("times"))
    return alignment.repair_stats(alignment.repaired(rows), "times", "fixed").select(*[F.col(c).cast("long").alias(c) for c in ("falls_before", "falls_after", "n_changed")])


@query("""select count(*) filter (event_type = 'click') as ok, count(*) filter (event_type = 'view') as skipped, count(*) filter (event_type = 'error') as failed, count(*) filter (event_id % 3 <> 0) as with_issues, cast(sum(event_id % 4) as bigint) as n_words, cast(sum(case when event_id % 4 >= 2 then 1 else 0 end) as bigint) as n_valid from events""")
def alignment_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    status = F.when(F.col("event_type") == "click", "ok").when(F.col("event_type") == "view", "skipped").when(F.col("event_type") == "error", "failed")
    words = F.transform(F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: k <= e % 4), lambda k: F.struct((k == 2).alias("valid")))
    rows = table(spark, sf_dir, "events").select(status.alias("status"), F.when(e % 3 != 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("issues"), words.alias("words"))
    return reports.alignment_tally(rows)


# --- SQL for the folds of the catalogue --------------------------------------

SQL["ordered_match"] = f"""with recursive {TALK}, said as (select recording_id, part * 1000 + seg_ord as pos, speaker, text from talk), want as (select *, row_number() over (partition by recording_id order by pos) as k from said where speaker = 'user'),
 m(recording_id, k, ord, pos) as (select w.recording_id, w.k, w.pos, min(s.pos) from want w join said s on s.recording_id = w.recording_id and s.text = w.text where w.k = 1 group by w.recording_id, w.k, w.pos
 union all select w.recording_id, w.k, w.pos, (select min(s.pos) from said s where s.recording_id = w.recording_id and s.text = w.text and s.pos > m.pos) from m join want w on w.recording_id = m.recording_id and w.k = m.k + 1 where m.pos is not null)
 select m.recording_id, m.ord, m.pos from m where not exists (select 1 from m x where x.recording_id = m.recording_id and x.pos is null)"""

SQL["lis_repair"] = """with recursive v as (select user_id, list(cast(floor(value + event_id) as bigint) order by event_id) as x from events group by user_id),
 d(user_id, x, i, dp, par) as (select user_id, x, 1, [1], [0] from v
 union all select user_id, x, i + 1, list_append(dp, cast(1 + coalesce(list_max(c), 0) as integer)), list_append(par, cast(case when list_max(c) is null then 0 else list_position(c, list_max(c)) end as integer)) from
 (select *, list_transform(range(1, i + 1), lambda j: case when x[j] <= x[i + 1] then dp[j] end) as c from d where i < len(x)) q),
 f as (select * from d where i = len(x)), b(user_id, idx) as (select user_id, list_position(dp, list_max(dp)) from f union all select b.user_id, f.par[b.idx] from b join f on f.user_id = b.user_id where f.par[b.idx] > 0),
 g as (select user_id, list(idx) as good from b group by user_id), o as (select f.user_id, x, good, unnest(range(1, len(x) + 1)) as k from f join g on f.user_id = g.user_id),
 p as (select user_id, x, k, list_contains(good, k) as fine, list_max(list_filter(good, lambda q: q < k)) as l, list_min(list_filter(good, lambda q: q > k)) as r from o)
 select user_id, array_to_string(list(case when fine then x[k] when l is null then x[r] when r is null then x[l] when r - l <= 3 then case when k - l <= r - k then x[l] else x[r] end else cast(trunc(x[l] + (x[r] - x[l]) / (r - l) * (k - l)) as bigint) end order by k), ',') as fixed from p group by user_id"""

FIXED, _, BY_USER = SQL["lis_repair"].partition(" select user_id, array_to_string(list(")
SQL["repair_stats"] = FIXED + ", z as (select user_id, any_value(x) as x, list(" + BY_USER.replace("), ',') as fixed from p", ") as y from p") + """),
 falls as (select list_sum(list_transform(range(2, len(x) + 1), lambda i: case when x[i] < x[i - 1] then 1 else 0 end)) as a, list_sum(list_transform(range(2, len(y) + 1), lambda i: case when y[i] < y[i - 1] then 1 else 0 end)) as b, len(list_filter(range(1, len(x) + 1), lambda i: x[i] <> y[i])) as c from z)
 select cast(sum(a) as bigint) as falls_before, cast(sum(b) as bigint) as falls_after, cast(sum(c) as bigint) as n_changed from falls"""

SQL["union_find_clusters"] = f"""with recursive {CENTRES.format(v=VOICES)}, g as (select part, speaker, c, row_number() over (order by part, speaker) as k from centres), sized as (select list(part order by k) as ps, count(*) as n from g),
 e as (select a.k as i, b.k as j, row_number() over (order by list_dot_product(a.c, b.c) desc, a.k, b.k) as rn from g a join g b on a.k < b.k and a.part <> b.part where list_dot_product(a.c, b.c) >= 0.3),
 u(step, home, ps, rejected) as (select cast(0 as bigint), range(1, n + 1), ps, 0 from sized union all
 select step + 1, case when a = b or clash then home else list_transform(home, lambda h: case when h = a or h = b then least(a, b) else h end) end, ps, rejected + case when a <> b and clash then 1 else 0 end from
 (select *, list_has_any(list_transform(list_filter(range(1, len(home) + 1), lambda q: home[q] = a), lambda q: ps[q]), list_transform(list_filter(range(1, len(home) + 1), lambda q: home[q] = b), lambda q: ps[q])) as clash from
 (select u.*, home[e.i] as a, home[e.j] as b from u join e on e.rn = u.step + 1) y) z)
 select g.part, g.speaker, cast(home[g.k] - 1 as integer) as cluster, rejected as n_rejected from g, (select * from u order by step desc limit 1) w"""

SQL["iterative_cut"] = f"""with recursive {TALK}, s as (select recording_id, list({{'s': cast(start_ms + part * 8000 as bigint), 'e': cast(end_ms + part * 8000 as bigint)}} order by start_ms + part * 8000, end_ms + part * 8000, text) as segs, cast(max(end_ms + part * 8000) as bigint) as total from talk group by recording_id),
 p(recording_id, segs, total, part, cut, a, dur, status, nxt, n, head, tail, kept) as (select recording_id, segs, total, -1, cast(-1 as bigint), cast(0 as bigint), cast(0 as bigint), '', cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint) from s
 union all select recording_id, segs, total, part, cut, a, dur, status, nxt, cast(len(h) as bigint), cast(len(h) - len(k) as bigint), cast(case when status = 'ok' then len(k) - len(list_filter(k, lambda x: a + x.e <= nxt)) else 0 end as bigint), cast(case when status = 'ok' then len(list_filter(k, lambda x: a + x.e <= nxt)) else len(k) end as bigint) from
 (select *, case when len(h) = 0 then case when fin then 'final-empty' else 'empty-advance' end when len(k) = 0 then 'empty-advance' when fin then 'final' when len(c) > 0 then 'ok' else 'fallback-blind-cut' end as status, case when len(k) > 0 and not fin and len(c) > 0 then a + c[len(c)].e else b end as nxt from
 (select *, list_filter(k[:len(k) - 1], lambda x: x.e <= dur - 2000) as c from
 (select *, case when part = 0 then h else list_filter(h, lambda x: a + x.e > cut + 50) end as k from
 (select *, list_transform(list_filter(segs, lambda x: x.s < b and x.e > a), lambda x: {{'s': greatest(x.s, a) - a, 'e': least(x.e, b) - a}}) as h, b - a as dur, b >= total - 1000 as fin from
 (select recording_id, segs, total, part + 1 as part, nxt as cut, case when part + 1 > 0 then greatest(nxt - 300, 0) else nxt end as a, least(nxt + 6000, total) as b from p where status not in ('final', 'final-empty') and nxt < total - 1000 and nxt > cut) q1) q2) q3) q4) q5)
 select recording_id, part, a as start_abs_ms, dur as duration_ms, status, nxt as end_cut_abs_ms, n as n_segments, head as n_dropped_head, tail as n_dropped_tail, kept as n_kept from p where part >= 0"""


@query("""with a as (select vec_id, embedding[1:62] as x, embedding[3:64] as y from embeddings), s as (select vec_id, x, y, unnest(range(-4, 5)) as k from a),
 c as (select vec_id, k, list_sum(list_transform(list_zip(x[greatest(k, 0) + 1:], y[greatest(-k, 0) + 1:])[:62 - abs(k)], lambda z: abs(cast(z[1] as double) - cast(z[2] as double)))) / (62 - abs(k)) as cost from s)
 select vec_id, arg_min(k, cost) as shift from c group by vec_id""")
def offset_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 62).alias("x"), F.slice("embedding", 3, 62).alias("y"))
    return alignment.best_shift(rows, "x", "y", 4).select("vec_id", "shift")


# --- sources and results ------------------------------------------------------

@query("select event_id, cast(round_even(event_id * 0.137 * 16000, 0) as bigint) as first, cast(round_even((event_id * 0.137 + 0.5) * 16000, 0) as bigint) as stop from (select event_id from events)".replace("0.137", "cast(0.137 as double)").replace("+ 0.5)", "+ cast(0.5 as double))"))
def sample_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("event_id") * F.lit(0.137)
    return table(spark, sf_dir, "events").select("event_id", transcripts.sample_range(start, start + 0.5).alias("b")).select("event_id", "b.*")


@query(f"with {MARKS} select event_id, greatest(start_ms - 200, 0) as start_ms, least(end_ms + 200, 1706745600000) as end_ms from marks")
def padded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks(spark, sf_dir).select("event_id", transcripts.padded_chunk(F.col("start_ms"), F.col("end_ms"), F.lit(1706745600000)).alias("c")).select("event_id", "c.*")


@query("select event_id from events where event_id % 50 <> 7")
def delete_by_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("f"), (F.col("event_id") % 50).cast("string"), F.when(F.col("event_id") % 2 == 0, ".wav").otherwise(".mp3"))
    return transcripts.without_stem(table(spark, sf_dir, "events").select("event_id", name.alias("name")), "f7").select("event_id")


@query("""with p as (select vec_id, list_max(list_transform(embedding, lambda x: abs(x))) as peak, embedding as e from embeddings) select vec_id, cast(round(peak * 10000) as bigint) as peak, len(list_filter(e, lambda x: abs(x) = peak)) as n_loudest, cast(ceil(len(e) / 10.0) as bigint) as n_blocks, len(e) % 10 as n_last from p""")
def amplitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak, samples at 1 after normalising, and pieces of ten samples."""
    scaled, pieces = transcripts.peak_normalised(F.col("embedding")), transcripts.blocks(F.col("embedding"), 10)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(F.array_max(F.transform("embedding", lambda x: F.abs(x))) * F.lit(10000).cast("float")).cast("long").alias("peak"), F.size(F.filter(scaled, lambda x: F.abs(x) == 1)).cast("long").alias("n_loudest"),
        F.size(pieces).cast("long").alias("n_blocks"), F.size(F.element_at(pieces, -1)).cast("long").alias("n_last"),
    )


@query(f"""with {TALK}, s as (select recording_id, coalesce(nullif(case when part % 3 = 0 then '' when part % 3 = 1 then 'G0' || part end, ''), nullif(speaker, ''), 'UNKNOWN') as speaker from talk)
 select recording_id, count(*) as n_segments, count(distinct speaker) as n_speakers, array_to_string(list_sort(list(distinct speaker)), ',') as speakers from s group by all""")
def result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = talk(spark, sf_dir).withColumn("speaker_global", F.when(F.col("part") % 3 == 0, "").when(F.col("part") % 3 == 1, F.concat(F.lit("G0"), F.col("part").cast("string"))))
    return transcripts.summary(rows, ["recording_id"]).withColumn("speakers", F.array_join("speakers", ","))


@query(f"""with {TALK}, m as (select recording_id, part, seg_ord, start_ms, end_ms, speaker from talk), n as (select recording_id, row_number() over (partition by recording_id order by start_ms + part * 100000, end_ms + part * 100000) as index, start_ms + part * 100000 as a, end_ms + part * 100000 as b from m)
 select recording_id, cast(index as integer) as index, 'out/clip_' || lpad(cast(index as varchar), 4, '0') || '.mkv' as file, b - a as duration_ms from n""")
def clip_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = talk(spark, sf_dir).withColumns({c: F.col(c) + F.col("part") * F.lit(100000) for c in ("start_ms", "end_ms")})
    return transcripts.manifest(rows.select("recording_id", "start_ms", "end_ms"), "out").select("recording_id", "index", "file", "duration_ms")


@query(f"""with {TALK}, s as (select recording_id, part, seg_ord, cast(start_ms as bigint) as a, cast(end_ms as bigint) as b, string_split(speaker, '') as u from talk),
 x as (select recording_id, part, seg_ord, -1 as k, a as s, b as e, 0 as layer, array_to_string(u, '') as said from s
 union all select recording_id, part, seg_ord, k, a + k * 30, greatest(a + k * 30 + 30 * (k % 4), a + k * 30 + 80), 1, array_to_string(list_transform(u, lambda p, i: case when i = k + 1 then '{{\\c&H00FFFF&}}' || p || '{{\\r}}' else p end), '') from (select *, unnest(range(0, len(u))) as k from s)),
 c as (select *, cast(round_even(s / 1000 * 100, 0) as bigint) as cs, cast(round_even(e / 1000 * 100, 0) as bigint) as ce from x)
 select recording_id, part, seg_ord, cast(k as integer) as k, 'Dialogue: ' || layer || ',' || (cs // 360000) || ':' || lpad(cast(cs % 360000 // 6000 as varchar), 2, '0') || ':' || lpad(cast(cs % 6000 // 100 as varchar), 2, '0') || '.' || lpad(cast(cs % 100 as varchar), 2, '0') || ',' ||
 (ce // 360000) || ':' || lpad(cast(ce % 360000 // 6000 as varchar), 2, '0') || ':' || lpad(cast(ce % 6000 // 100 as varchar), 2, '0') || '.' || lpad(cast(ce % 100 as varchar), 2, '0') || ',Default,,0,0,0,,' || said as event from c""")
def subtitle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters of each speaker's name as the units of a line."""
    unit = lambda u, i: F.struct(u.alias("unit"), (F.col("start_ms") + i * 30).alias("start_ms"), (F.col("start_ms") + i * 30 + 30 * (i % 4)).alias("end_ms"))
    rows = talk(spark, sf_dir).select(F.struct("recording_id", "part", "seg_ord").alias("seg_id"), "start_ms", "end_ms", F.transform(F.split("speaker", ""), unit).alias("units"))
    return transcripts.subtitle_events(rows).select("seg_id.*", "k", "event")


@query(f"""with {TALK}, b as (select start_ms, '1_transcript' as kind, recording_id, part, seg_ord from talk union all select seg_ord * 500, '2_visual', recording_id, part, seg_ord from talk) select kind, start_ms, count(*) as n from b group by all""")
def one_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = talk(spark, sf_dir)
    both = spans.one_axis(rows.select("start_ms", "recording_id", "part", "seg_ord"), rows.select((F.col("seg_ord") * 500).alias("start_ms"), "recording_id", "part", "seg_ord"))
    return both.groupBy("kind", "start_ms").agg(F.count("*").alias("n"))


@query(f"""with {MARKS} select a.event_id from marks a where exists (select 1 from marks b where a.user_id = b.user_id and b.event_type = 'view' and a.start_ms < b.end_ms and b.start_ms < a.end_ms)""")
def speech_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = marks(spark, sf_dir)
    return spans.spoken(m, m.where("event_type = 'view'"), ["user_id"], 20_000_000).select("event_id")


@query(f"""with {TALK} select recording_id, part, seg_ord, md5(coalesce(string_agg(text, '|') over (partition by recording_id, part order by seg_ord rows between 2 preceding and 1 preceding), '')) as before, md5(coalesce(string_agg(text, '|') over (partition by recording_id, part order by seg_ord rows between 1 following and 2 following), '')) as after from talk""")
def swarm_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans.neighbours(talk(spark, sf_dir), ["recording_id", "part"], "seg_ord", 2)
    return out.select("recording_id", "part", "seg_ord", *[F.md5(F.array_join(c, "|").cast("binary")).alias(c) for c in ("before", "after")])


@query("select event_id, cast(floor(least(1.0, (event_id % 300 + 1) / 31.0, (300 - event_id % 300) / 31.0) * 1000 + 0.0001) as bigint) as weight from events")
def window_fade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.floor(spans.fade(F.col("event_id") % 300, F.lit(300), 30) * 1000 + 0.0001).cast("long").alias("weight"))


# --- speakers -----------------------------------------------------------------

@query("select event_id, (least(value, 10) >= 1.0 and event_id % 9000 >= 3200) as embeds, least(value, 10) >= 0.5 as votes from events")
def embeddable(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero, end = F.lit(0.0), F.col("value")
    return table(spark, sf_dir, "events").select("event_id", speakers.embeddable(zero, end, F.col("event_id") % 9000).alias("embeds"), speakers.may_vote(zero, end).alias("votes"))


@query(f"""with {VOICES}, g as (select part, speaker, count(*) as n from voices group by all), r as (select *, row_number() over (partition by v.part, v.speaker order by vec_id) - 1 as i from voices v join g using (part, speaker))
 select vec_id from r where n <= 8 or list_contains(list_transform(range(0, 8), lambda k: cast(round(k * (n - 1) / 7.0) as bigint)), i)""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.evenly_sampled(voices(spark, sf_dir), ["part", "speaker"], "vec_id").select("vec_id")


@query(f"""with {CENTRES.format(v=VOICES)} select a.part as a_part, a.speaker as a_speaker, b.part as b_part, b.speaker as b_speaker, round(list_dot_product(a.c, b.c), 6) + 0.0 as cosine, a.part = b.part as same_part from centres a join centres b on (a.part, a.speaker) < (b.part, b.speaker)""")
def centroid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = speakers.centroids(voices(spark, sf_dir), ["recording_id", "part", "speaker"])
    return speakers.centroid_pairs(c, ["recording_id"]).drop("recording_id").withColumn("cosine", F.round("cosine", 6) + 0.0)


@query(f"""with {CENTRES.format(v=VOICES)}, s as (select a.part, a.speaker, b.part as t_part, b.speaker as t_speaker, row_number() over (partition by a.part, a.speaker order by list_dot_product(a.c, b.c) desc, b.part, b.speaker) as rn from centres a join centres b on a.part <> b.part) select part, speaker, t_part, t_speaker from s where rn = 1""")
def nearest_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group's nearest group among those that share no part with it."""
    pairs = speakers.centroid_pairs(speakers.centroids(voices(spark, sf_dir), ["recording_id", "part", "speaker"]), ["recording_id"]).where("not same_part")
    turned = pairs.select(*[F.col(a).alias(b) for a, b in zip(("b_part", "b_speaker", "a_part", "a_speaker", "cosine"), ("part", "speaker", "t_part", "t_speaker", "cosine"))])
    both = pairs.select(*[F.col(a).alias(b) for a, b in zip(("a_part", "a_speaker", "b_part", "b_speaker", "cosine"), ("part", "speaker", "t_part", "t_speaker", "cosine"))]).union(turned)
    w = Window.partitionBy("part", "speaker").orderBy(F.col("cosine").desc(), "t_part", "t_speaker")
    return both.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("part", "speaker", "t_part", "t_speaker")


@query(f"with {VOTED}, r as (select *, row_number() over (partition by part, speaker order by n desc, t_part, t_speaker) as rn, sum(n) over (partition by part, speaker) as total from tally) select part, speaker, t_part, t_speaker, n as top_votes, cast(total as bigint) as n_votes from r where rn = 1")
def majority_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = speakers.majority(_tally(spark, sf_dir), ["recording_id"])
    return m.select("part", "speaker", F.col("winner.t_part").alias("t_part"), F.col("winner.t_speaker").alias("t_speaker"), F.round(F.col("agreement") * F.col("n_votes")).cast("long").alias("top_votes"), "n_votes")


@query("select event_id, case when event_id % 3 = 0 then 0.4 when event_id % 2 = 0 then 0.25 when event_type = 'click' then 0.55 else 0.90 end as tau from events")
def chosen_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", speakers.chosen_tau(F.when(e % 3 == 0, 0.4), F.when(e % 2 == 0, 0.25), F.when(F.col("event_type") == "click", "campplus").otherwise("x")).alias("tau"))


SEPARATED = f"""with {VOICES}, d as (select speaker, unnest(range(1, 65)) as dim, e from voices), m as (select speaker, dim, avg(e[dim]) as x from d group by all), l as (select speaker, list(x order by dim) as l from m group by all), c as (select speaker, list_transform(l, lambda x: x / sqrt(list_dot_product(l, l))) as c from l),
 i as (select min(list_dot_product(e, c)) as intra from voices join c using (speaker)), b as (select max(list_dot_product(a.c, b.c)) as inter from c a join c b on a.speaker < b.speaker)"""


@query(f"{SEPARATED} select round(intra, 5) + 0.0 as intra, round(inter, 5) + 0.0 as inter, round(intra - inter, 5) + 0.0 as margin from i, b")
def separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.separation(voices(spark, sf_dir), ["recording_id"]).select(*[(F.round(c, 5) + 0.0).alias(c) for c in ("intra", "inter", "margin")])


@query("select round(avg(case when ((event_id % 3 = event_id % 5) = (event_id % 2 = 0)) then 1.0 else 0.0 end), 9) as accuracy, count(*) as n from events")
def pair_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return speakers.pair_accuracy(table(spark, sf_dir, "events").select((e % 3).alias("a"), (e % 5).alias("b"), (e % 2 == 0).alias("same"))).withColumn("accuracy", F.round("accuracy", 9))


@query("""select conv_id, turn, '```json' || chr(10) || '{"visual": "seen ' || length(text) || '"}' || chr(10) || '```' as response from conversations""")
def bounded_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn described by a served model's fake, at most eight requests open in all."""
    prompts = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    return models.requests(prompts, "describe", limit=8, at_once=2).drop("prompt")


@query("select conv_id, turn, md5(text) as text, cast(greatest(ceil((length(text) - 20) / 40), 1) as bigint) as n_windows from conversations where text is not null")
def window_stitching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into windows of 60 characters that overlap by 20, and put together again by what neighbours share."""
    n = F.greatest(F.ceil((F.length("text") - 20) / 40), F.lit(1)).cast("int")
    cut = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("k")).withColumn("text", F.expr("substring(text, k * 40 + 1, 60)"))
    return spans.stitched(cut, ["conv_id", "turn"], "k").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("text"), "n_windows")


@query(f"""with recursive {MARKS}, f as (select user_id, start_ms as ms, (event_id * 37 % 101) / 100 as p, row_number() over (partition by user_id order by start_ms, event_id) as n from marks),
 s(user_id, n, ms, on_) as (select user_id, cast(0 as bigint), cast(0 as bigint), 0 from f group by user_id union all select f.user_id, f.n, f.ms, case when p >= 0.5 then 1 when p < 0.35 then 0 else on_ end from s join f on f.user_id = s.user_id and f.n = s.n + 1),
 t as (select *, lag(on_) over (partition by user_id order by n) as was from s), e as (select user_id, n, ms, on_ from t where n > 0 and on_ <> was), l as (select user_id, max(ms) + 1000 as until from f group by user_id),
 r as (select user_id, ms as a, coalesce(lead(ms) over (partition by user_id order by n), until) as b, on_ from e join l using (user_id)), i as (select user_id, a, b, case when a - max(b) over (partition by user_id order by a rows between unbounded preceding and 1 preceding) < 7200000 then 0 else 1 end as new from r where on_ = 1),
 g as (select *, sum(new) over (partition by user_id order by a) as island from i) select user_id, min(a) as start_ms, max(b) as end_ms from g group by user_id, island having max(b) - min(a) >= 3600000""")
def voiced_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: two thresholds, at least two hours of silence and one of speech, scanned a day at a time."""
    frames = marks(spark, sf_dir).select("user_id", F.col("start_ms").alias("at_ms"), (F.col("event_id") * 37 % 101 / 100).alias("probability"))
    return spans.voiced(frames, ["user_id"], 0.5, 0.35, 1000, 3_600_000, 7_200_000, 86_400_000)
