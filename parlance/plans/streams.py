"""Named queries that run a stream over the tables and give what it wrote, each with the SQL of its batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.operators import iterative_cut as cutting, spans
from parlance.plans.adapters import table, talk
from parlance.plans.catalogue import SQL, query
from parlance.sources.shared import fresh_folder
from parlance.streaming import states

FOREVER_MS = 10**12
#: States that the turns' pieces share: some thousand open texts each, where there are millions.
BUCKETS = 512


def _run(made: DataFrame, folder: str) -> DataFrame:
    """All that is there now, through the stream, to files."""
    made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return made.sparkSession.read.schema(made.schema).parquet(f"{folder}/out")


def part_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a recogniser hears in every part that the batch fold plans, with the parts of a recording minutes apart."""
    rows = talk(spark, sf_dir).withColumns({c: F.col(c) + F.col("part") * F.lit(8000) for c in ("start_ms", "end_ms")})
    rows = rows.withColumn("total_ms", F.max("end_ms").over(Window.partitionBy("recording_id"))).select("recording_id", "start_ms", "end_ms", "speaker", "text", "total_ms")
    planned = cutting.iterative_cut(rows, "recording_id", 6000).select("recording_id", "part", F.col("start_abs_ms").alias("r_start_ms"), "duration_ms", (F.col("start_abs_ms") + F.col("duration_ms")).alias("r_end_ms"))
    heard = spans.overlap_join(rows.drop("total_ms"), planned, ["recording_id"], 6000)
    at = lambda c: F.greatest(F.least(c, "r_end_ms"), "r_start_ms") - F.col("r_start_ms")
    said = F.sort_array(F.collect_list(F.struct(at("start_ms").alias("start_ms"), at("end_ms").alias("end_ms"), F.col("speaker"), F.col("text"))))
    totals = rows.groupBy("recording_id").agg(F.max("end_ms").alias("total_ms"))
    segments = heard.groupBy("recording_id", "part").agg(said.alias("segments"))
    return planned.join(segments, ["recording_id", "part"], "left").join(totals, "recording_id").select(
        "recording_id", (F.timestamp_seconds(1_704_067_200 + 60 * F.col("part"))).alias("ts"), "part", F.col("r_start_ms").alias("start_ms"), "duration_ms", "total_ms", "segments"
    )


@query(SQL["iterative_cut"][: SQL["iterative_cut"].rindex("select recording_id, part")] + "select recording_id, part, status, nxt as cut_ms, greatest(nxt - 300, 0) as next_start_ms from p where part >= 0")
def iterative_cut_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The iterative cut by stream state: parts dealt to files by hash, so out of order, a file a batch."""
    folder = fresh_folder(spark, "cut-stream")
    part_feed(spark, sf_dir).repartition(4, F.xxhash64("recording_id", "part")).write.parquet(f"{folder}/in")
    feed = spark.readStream.schema(states.PARTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return _run(states.cut_states(feed, "1 day"), folder)


KINDS = {"signup": "upload", "click": "start", "view": "start", "purchase": "finish", "error": "fail", "refund": "fail"}


@query(f"""with k as (select user_id, epoch_us(ts) // 1000 as ms, case event_type {" ".join(f"when '{a}' then '{b}'" for a, b in KINDS.items())} else 'upload' end as kind from events),
 d as (select *, case kind when 'upload' then 0 when 'start' then 1 when 'finish' then 2 else 3 end as turn from k where ms < (select max(ms) - 600000 from k)),
 l as (select user_id, list(kind order by ms, turn) as kinds, max(ms) as ts_ms, count(*) as n_events from d group by user_id)
 select cast(user_id as varchar) as job_id, list_reduce(['none'] || kinds, lambda s, k: case when k = 'upload' and s = 'none' then 'queued' when k = 'start' and s = 'queued' then 'processing' when k = 'finish' and s = 'processing' then 'done' when k = 'fail' and s in ('queued', 'processing') then 'error' else s end) as status, ts_ms, n_events from l""")
def job_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as jobs: the status that the stream has settled on for each, by its last row."""
    folder = fresh_folder(spark, "job-stream")
    kind = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in KINDS.items()], F.lit("upload"))
    # the time as written, in whatever time zone the session is
    ms = F.expr("unix_date(cast(ts as date)) * 86400000L + hour(ts) * 3600000L + minute(ts) * 60000L + cast(floor(extract(second from ts) * 1000) as bigint)")
    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job_id"), F.timestamp_millis(ms).alias("ts"), kind.alias("kind"), F.lit(None).cast("string").alias("detail"), ms.alias("ms"))
    low, high = log.agg(F.min("ms"), F.max("ms")).first()
    step = ((high or 0) - (low or 0)) // 3 + 1
    for k in range(3):
        # each stretch comes as a batch of its own, to a query that goes on from the last one's checkpoint
        stretch = log.where(F.floor((F.col("ms") - F.lit(low)) / step) == k).drop("ms") if low is not None else log.drop("ms")
        stretch.write.mode("append").parquet(f"{folder}/in")
        rows = _run(states.job_states(spark.readStream.schema(stretch.schema).parquet(f"{folder}/in"), FOREVER_MS), folder)
    last = rows.groupBy("job_id").agg(F.max_by(F.struct("status", "ts"), "n_events").alias("x"), F.max("n_events").alias("n_events"))
    return last.select("job_id", F.coalesce("x.status", F.lit("none")).alias("status"), F.unix_millis("x.ts").alias("ts_ms"), "n_events")


@query("select conv_id || ':' || turn as stream_id, 'done' as status, cast(greatest(ceil(length(text) / 40), 1) as integer) as n_pieces, md5(text) as text from conversations where text is not null")
def token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a stream of pieces of 40 characters, dealt to files by hash and every third piece sent twice, put together again."""
    folder = fresh_folder(spark, "token-stream")
    n = F.greatest(F.ceil(F.length("text") / 40), F.lit(1)).cast("int")
    turns = table(spark, sf_dir, "conversations").where("text is not null").select(F.concat_ws(":", "conv_id", "turn").alias("stream_id"), "text", n.alias("size"))
    k = F.explode(F.sequence(F.lit(0), F.col("size") - 1))
    pieces = turns.select("*", k.alias("n")).select("stream_id", F.timestamp_seconds(1_704_067_200 + F.col("n")).alias("ts"), "n", F.expr("substring(text, n * 40 + 1, 40)").alias("piece"), (F.col("n") == F.col("size") - 1).alias("last"))
    pieces.union(pieces.where("n % 3 = 0")).repartition(3, F.xxhash64("stream_id", "n", F.rand(1))).write.parquet(f"{folder}/in")
    feed = spark.readStream.schema(states.PIECES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return _run(states.token_texts(feed, "1 day", buckets=BUCKETS), folder).withColumn("text", F.md5(F.col("text").cast("binary")))
