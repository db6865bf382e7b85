"""Token counts from an exact histogram of encoded lengths.

Each document is encoded with a public vocabulary file (its path is a parameter)
and only its length leaves the scan.  Documents are aggregated by length; suffix
sums over that histogram then answer, for every context limit ``L``, how many
documents reach it, how many tokens stay when each is cut at ``L``, and at which
quantile of documents it lies.  Lengths are taken in blocks, so that neither the
block totals nor the lengths of one block grow with the number of documents.

Between two lengths of the histogram the truncated total is linear, so its rows
answer every limit: see ``at_limits``.

Runs of space of any length, and texts of one letter repeated, are counted like others.
Null or empty text: length 0, counted.  An empty table gives no rows.  Equal rows
count each time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.runtime import named, unwrapped

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's own way of cutting a text into pieces before merging (fixed value).
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 1024


#: Space as the cutting rule knows it, in runs too long for its look-ahead, which steps back through a run a character at a time.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{20000,}")


def _made(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


@cache
def _encoding(path: str):
    with open(path, "rb") as f:
        return _made(f.read())


def token_count(encoding, text: str) -> int:
    """Tokens of a text.  A long run of space is cut off by hand as the rule would: all of it but the last character, which goes with what follows."""
    n, at = 0, 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() - (run.end() < len(text))
        n += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._core_bpe.encode_single_piece(text[run.start() : end].encode()))
        at = end
    return n + len(encoding.encode_ordinary(text[at:]))


_shipped: dict = {}


def with_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns and ``n_tokens`` of every document; a kept column of that name gives way to it.

    The vocabulary is read where the query is made and shipped (a few megabytes).
    """
    with open(vocabulary, "rb") as f:
        data = f.read()
    shared, key = docs.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()
    keep = tuple(c for c in keep if c.lower() != "n_tokens")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _shipped:  # once for each worker process
            _shipped[key] = _made(shared.value)
        encoding = _shipped[key]
        for batch in batches:
            n = pa.array([token_count(encoding, t.as_py()) if t.is_valid else 0 for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=["row", "n_tokens"])

    row = F.struct(*[named(c) for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    source = docs.select(row.alias("row"), named(text_col).cast("string").alias("text"))
    out = source.mapInArrow(measure, source.select("row").schema.add("n_tokens", "long"))
    return out.select(*unwrapped(out, list(keep)), "n_tokens")


def histogram(lengths: DataFrame) -> DataFrame:
    """One row for each length in use, with suffix sums.

    context_limit; n_docs of just that length; docs_reaching (at least as long);
    tokens_total; tokens_truncated (each document cut at the limit); tokens_lost;
    quantile (share of documents no longer than the limit).
    """
    counts = lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_after"),
        F.sum("d").over(everything).alias("docs"),
        F.sum("t").over(everything).alias("tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    reaching, tokens_reaching = F.sum("n_docs").over(inside) + F.col("d_after"), F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside) + F.col("t_after")
    truncated = F.col("tokens") - tokens_reaching + reaching * F.col("n_tokens")
    return counts.join(after, "block").select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        reaching.alias("docs_reaching"),
        F.col("tokens").alias("tokens_total"),
        truncated.alias("tokens_truncated"),
        (F.col("tokens") - truncated).alias("tokens_lost"),
        ((F.col("docs") - reaching + F.col("n_docs")) / F.col("docs")).alias("quantile"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """tokens_truncated and docs_over (cut) for any context limits."""
    spark = hist.sparkSession
    asked = F.broadcast(spark.createDataFrame([(int(x),) for x in limits], "context_limit long"))
    h = hist.select(F.col("context_limit").alias("len"), "n_docs")
    return (
        asked.join(h)
        .groupBy("context_limit")
        .agg(F.sum(F.least("len", "context_limit") * F.col("n_docs")).alias("tokens_truncated"), F.sum(F.when(F.col("len") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("docs_over"))
    )


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share ``q`` of the documents doesn't pass."""
    return hist.where(F.col("quantile") >= q).agg(F.min("context_limit").alias("n_tokens"))
