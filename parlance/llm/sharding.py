"""Contiguous shards of near-equal byte size.

Rows are put in one total order by range partitioning, so that no task holds
more than its share.  Each partition reports its bytes and rows; a prefix sum of
those few totals gives every partition its place in the global byte line, and a
running sum inside the partition gives every row its own.  Shard ``s`` holds the
rows whose first byte lies in the ``s``-th of ``n_shards`` equal pieces of that
line, so two shards differ by less than one row's size at either end.

Order: doc_id (null first), then text checksum, size, and a row number within
the scan that only separates equal rows, so that a doc_id or text repeated in a
third of the rows still spreads over many partitions.

Empty table: no rows.  Null text: 8 bytes, checksum 0.  Empty text: 8 bytes.
Equal rows get different slots.  Columns of the input named like a result column
(in either case) are replaced by the result; any other name, type or number of
columns goes through as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.runtime import cut, named, shuffle_width, unwrapped

ROW_OVERHEAD = 8
ADDED = ("size", "text_crc32", "shard", "slot")


def assign(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add size, text_crc32, shard and slot to the ``keep`` columns (default: all)."""
    columns = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ADDED]
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    keyed = docs.select(
        F.struct(*[named(c) for c in columns], F.lit(0).alias("none")).alias("row"),  # never an empty struct
        (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        named(id_col).alias("id"),
        F.monotonically_increasing_id().alias("n"),
    )
    order = ["id", "text_crc32", "size", "n"]
    placed = cut(
        keyed.repartitionByRange(shuffle_width(docs.sparkSession), *order)
        .sortWithinPartitions(*order)
        .select("row", "size", "text_crc32", F.spark_partition_id().alias("part"))
    )
    # one row for each partition: as many as tasks, whatever the data
    totals = sorted((r["part"], r["bytes"], r["rows"]) for r in placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect())
    bases, at_byte, at_row = {}, 0, 0
    for part, size, rows in totals:
        bases[part] = (at_byte, at_row)
        at_byte, at_row = at_byte + size, at_row + rows
    whole = max(at_byte, 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            if carry is None:
                carry = bases[t["part"][0].as_py()]
            size = t["size"].to_numpy()
            ends = carry[0] + np.cumsum(size)
            start = ends - size
            # exact integers: start * n_shards may pass 2**63 beyond exabytes only
            shard = np.minimum(start * n_shards // whole, n_shards - 1).astype(np.int32)
            at = carry[1] + np.arange(len(size), dtype=np.int64)
            carry = (int(ends[-1]), int(at[-1]) + 1)
            t = t.drop_columns(["part"]).append_column("shard", pa.array(shard)).append_column("at", pa.array(at))
            yield from t.to_batches()

    schema = T.StructType([f for f in placed.schema.fields if f.name != "part"] + [T.StructField("shard", T.IntegerType()), T.StructField("at", T.LongType())])
    numbered = placed.mapInArrow(place, schema)
    first = numbered.groupBy("shard").agg(F.min("at").alias("first"))  # one row for each shard
    joined = numbered.join(F.broadcast(first), "shard")
    return joined.select(*unwrapped(joined, columns), "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))


def shard_digest(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    out = assign(docs, n_shards, keep=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
