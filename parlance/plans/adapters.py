"""The test tables seen as recordings, segments and speaker vectors (integer milliseconds)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as segments: a turn lasts a millisecond a character; eight conversations are the parts of a recording."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    n = F.length("text").cast("long")
    before = F.coalesce(F.sum(n).over(w), F.lit(0))
    return table(spark, sf_dir, "conversations").select(
        F.floor(F.col("conv_id") / 8).alias("recording_id"), (F.col("conv_id") % 8).cast("int").alias("part"), F.col("turn").alias("seg_ord"),
        before.alias("start_ms"), (before + n).alias("end_ms"), F.col("role").alias("speaker"), "text",
    )


TALK = """talk as (select conv_id // 8 as recording_id, cast(conv_id % 8 as int) as part, turn as seg_ord, b as start_ms, b + length(text) as end_ms, role as speaker, text
 from (select *, cast(coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as bigint) as b from conversations))"""


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans of a user's timeline, as long as their value says."""
    # the time as written, in whatever time zone the session is
    start = F.expr("unix_date(cast(ts as date)) * 86400000L + hour(ts) * 3600000L + minute(ts) * 60000L + cast(floor(extract(second from ts) * 1000) as bigint)")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", start.alias("start_ms"), (start + F.floor(F.col("value") * 100000).cast("long")).alias("end_ms"))


MARKS = "marks as (select user_id, event_id, event_type, epoch_us(ts) // 1000 as start_ms, epoch_us(ts) // 1000 + cast(floor(value * 100000) as bigint) as end_ms from events)"


def voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as vectors of one recording: label is the speaker, five parts."""
    return table(spark, sf_dir, "embeddings").select(F.lit(0).alias("recording_id"), (F.col("vec_id") % 5).cast("int").alias("part"), F.col("label").alias("speaker"), "vec_id", "embedding")


VOICES = "voices as (select cast(vec_id % 5 as int) as part, label as speaker, vec_id, cast(embedding as double[]) as e from embeddings)"


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same vectors dealt to three recordings, so that folds by recording run side by side."""
    v = voices(spark, sf_dir)
    return v.withColumn("recording_id", (F.floor(F.col("vec_id") / 5) % 3).cast("int"))


MEETINGS = "voices as (select cast(vec_id // 5 % 3 as int) as recording_id, cast(vec_id % 5 as int) as part, label as speaker, vec_id, cast(embedding as double[]) as e from embeddings)"
