"""Bounded samples of labelled documents for fitting a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.runtime import named


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether a row's labels are kept for measuring: crc32(id as text) mod folds = fold."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, target: str, folds: int, fold: int, per_class: int) -> DataFrame:
    """(doc_id, text, y) of at most ``per_class`` labelled ids of each class, off the held-out fold.

    The ids with the smallest hashes are taken, so the sample is the same however
    the tables are dealt; an id with conflicting labels takes its larger one, an id
    with several texts the one of the smallest hash.  At most twice ``per_class`` ids
    are broadcast to find their texts, and as many rows come out.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & ~held_out("doc_id", folds, fold))
    each = usable.groupBy(F.col("doc_id").alias("id")).agg(F.max(target).cast("int").alias("y"))
    order = F.xxhash64(F.lit("sample"), "id")
    parts = [each.where(F.col("y") == y).orderBy(order, "id").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(parts[0].union(parts[1]))
    texts = docs.select(named("doc_id").alias("doc_id"), named("text").cast("string").alias("text"))
    found = texts.join(ids, F.col("doc_id") == F.col("id"))
    return found.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "t.text", "y")
