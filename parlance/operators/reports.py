"""Counts, warnings, clip statistics, word-context histograms and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as tx

FAILED = ("empty-advance", "fallback-blind-cut")


def status_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def warnings(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Per recording how many parts ended badly, and the text to show for it."""
    n = parts.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in FAILED])
    said = F.array_compact(F.array(*[F.when(F.col(s.replace("-", "_")) > 0, F.concat(F.col(s.replace("-", "_")).cast("string"), F.lit(f" parts {s}"))) for s in FAILED]))
    return n.withColumn("warnings", said)


def upper_median(values: Column) -> Column:
    """The element at position n // 2 of the sorted values."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def clip_stats(clips: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Count, sum, least, upper median and largest.  The median is exact by rank, not by gathering a key's values."""
    from pyspark.sql import Window

    counted = clips.groupBy(*keys, column).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    placed = counted.withColumns({"upto": F.sum("c").over(w.orderBy(column)), "n": F.sum("c").over(w)})
    return placed.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.sum(F.col("c") * F.col(column)).alias("total"),
        F.min(column).alias("least"),
        F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col(column))).alias("upper_median"),
        F.max(column).alias("largest"),
    )


def kwic(rows: DataFrame, pattern: str, width: int = 3) -> DataFrame:
    """One row for each hit, with its characters around it.  Only texts with a hit are scanned for places."""
    hits = rows.where(F.col("text").rlike(pattern)).withColumn("hit", F.explode(tx.spans_of(F.col("text"), pattern)))
    return hits.select(*[c for c in rows.columns if c != "text"], "hit.*", tx.context(F.col("text"), F.col("hit.start"), F.col("hit.end"), width).alias("c")).select("*", "c.*").drop("c")


def most_common(rows: DataFrame, column: str, n: int) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def verification(clips: DataFrame, tolerance: int = 150) -> DataFrame:
    """What is wrong with each written clip: missing, empty, or of another length than planned."""
    problem = F.when(F.col("size").isNull(), "missing").when(F.col("size") == 0, "empty").when(F.abs(F.col("measured_ms") - F.col("duration_ms")) > tolerance, "duration")
    return clips.withColumn("problem", problem)


def stale(jobs: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    return jobs.where(F.col("status").isin("done", "error") & (F.col("finished_at") < now - F.expr(f"interval {int(ttl_seconds)} seconds")))


def alignment_tally(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.size("issues") > 0).alias("with_issues"), F.sum(F.size("words")).alias("n_words"), F.sum(F.size(F.filter("words", lambda w: w["valid"]))).alias("n_valid"),
    )
