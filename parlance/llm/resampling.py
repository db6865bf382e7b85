"""Importance resampling of documents towards a target text distribution.

An external sort-count.  One pass over the texts writes, for runs of documents, a
packed stream of 16-bit feature buckets with the documents' offsets in it; all later
work reads those streams, a third of the text's size, and no text again.  Counts come
from sorting each stream and run-length encoding it; a bucket's gain compares its share
in the target with its share in the corpus; a document's weight is the sum of its
features' gains, gathered by bucket and added up between offsets.  Seeded Gumbel noise
on the weight makes taking the highest scores a draw without replacement.

Streams and scores are written to the session's shared folder, so that a lost executor
costs the tasks it ran and no bucket is computed twice.  The gains are one number a bucket,
``buckets`` in all, and are broadcast.  Ranks come from a range-partitioned sort and the
partitions' sizes, one number each.

Null and empty texts have no features, weight 0 and no rank.  Repeated rows count each
time and are drawn one by one; ties go to the smaller id (null last).  An empty target or
corpus works: its counts are 0.  A null id draws its noise as an empty one.  No column but
the id and the text is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm import textbytes as tb
from parlance.llm.runtime import cut, named, shuffle_width

BUCKETS, LONGEST_RUN, SEED, MIN_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
#: Words are runs of digits, small letters and any byte beyond ASCII, after A-Z is lowered.
WORD = tb.byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
SPACE = np.frombuffer(b" ", np.uint8)

STREAM = "ids array<long>, n_words array<long>, offsets array<long>, stream binary"


def buckets_of(data: np.ndarray, offsets: np.ndarray, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's number of words and of features, and all features' buckets in order of rows."""
    lowered, n = tb.LOWER[data], len(offsets) - 1
    starts, ends, row = tb.words(lowered, offsets, WORD)
    registers, rows, found = None, [], []
    for length in range(1, longest + 1):
        first = len(starts) - length + 1
        if first <= 0:
            break
        if length > 1:
            gap = np.zeros(first, np.int64)
            registers = tb.crc32_spans(SPACE, gap, gap + 1, registers[:first])
        registers = tb.crc32_spans(lowered, starts[length - 1 :], ends[length - 1 :], registers)
        inside = row[:first] == row[length - 1 :]
        rows.append(row[:first][inside])
        found.append((registers[inside] % np.uint32(buckets)).astype(np.uint16))
    rows, found = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((rows, np.int64), (found, np.uint16)))
    if longest > 1:
        found = found[np.argsort(rows, kind="stable")]
    return np.bincount(row, minlength=n), np.bincount(rows, minlength=n), found


def streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """Blocks of documents: their ids, words and offsets, and the packed buckets of all their features."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit 16 bits")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in tb.runs(batch.column(1)):
                words, sizes, found = buckets_of(data, offsets, buckets, longest)
                ids = batch.column(0).slice(first, len(sizes)).to_pylist()
                places = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([x], pa.list_(pa.int64())) for x in (ids, words, places)), pa.array([found.astype("<u2").tobytes()], pa.binary())], names=["ids", "n_words", "offsets", "stream"]
                )

    return docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text")).mapInArrow(pack, STREAM)


def counts(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): every stream sorted and run-length encoded, summed within tasks before the shuffle."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                ordered = np.sort(np.frombuffer(packed.as_py(), "<u2"), kind="stable")
                heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, int)
                total[ordered[heads]] += np.diff(np.append(heads, len(ordered)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return blocks.select("stream").mapInArrow(encode, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    n, t, s = len(corpus), int(target.sum()), int(corpus.sum())
    return np.array([math.floor(1000 * math.log(((a + 1) * (s + n)) / ((b + 1) * (t + n)))) for a, b in zip(target.tolist(), corpus.tolist())], np.int64)


def _dense(found: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for r in found.collect():  # at most one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): gains gathered along each stream and added up between offsets."""
    shared = blocks.sparkSession.sparkContext.broadcast(gain)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, places, packed in zip(*batch.columns):
                places = places.values.to_numpy(zero_copy_only=False)
                sizes = np.diff(places)
                total, some = np.zeros(len(sizes), np.int64), sizes > 0
                if some.any():
                    # an empty document would read its follower's first gain, so only others are added up
                    total[some] = np.add.reduceat(shared.value[np.frombuffer(packed.as_py(), "<u2")], places[:-1][some])
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(sizes), pa.array(total)], names=["doc_id", "n_words", "n_features", "weight"])

    return blocks.select("ids", "n_words", "offsets", "stream").mapInArrow(gather, "doc_id long, n_words long, n_features long, weight long")


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Thousandths of a standard Gumbel variate that only the seed and the id decide, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` with ``rank`` 1, 2, 3... on the highest ``percent`` of those documents that have enough words."""
    scored = cut(scored)
    fits = F.col("n_words") >= min_words
    # the last key tells equal rows apart, so that many of them can be dealt to several tasks
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col("row")]
    candidates = scored.where(fits).withColumn("row", F.monotonically_increasing_id())
    ordered = cut(candidates.repartitionByRange(shuffle_width(scored.sparkSession), *order).sortWithinPartitions(*order))
    placed = ordered.drop("row").withColumn("at", F.monotonically_increasing_id())
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before, seen = [], 0
    for r in placed.groupBy(part.cast("int").alias("part")).count().orderBy("part").collect():  # one row a partition
        before.append((r["part"], seen))
        seen += r["count"]
    starts = F.broadcast(scored.sparkSession.createDataFrame(before, "part int, before long"))
    place = F.col("before") + within + 1
    drawn = placed.withColumn("part", part.cast("int")).join(starts, "part").withColumn("rank", F.when(place <= seen * percent // 100, place)).drop("part", "before", "at")
    return drawn.unionByName(scored.where(~fits).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, longest: int = LONGEST_RUN, seed: int = SEED, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; drawn ones have a rank."""
    blocks = cut(streams(docs, id_col, text_col, buckets, longest))
    wanted = streams(target, target.columns[0], text_col, buckets, longest)
    gain = gains(_dense(counts(wanted, buckets), buckets), _dense(counts(blocks, buckets), buckets))
    scored = weights(blocks, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(scored, percent, min_words)


def drawn(docs: DataFrame, result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents, with all their columns, whose id has a rank."""
    ids = result.where("rank is not null").select(F.col("doc_id").alias("__drawn_id"))
    return docs.join(ids, named(id_col).cast("long").eqNullSafe(F.col("__drawn_id")), "left_semi")


def resampling_digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
