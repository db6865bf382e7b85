"""Exact top-k search by distributed histogram selection.

All scores are computed, but none is stored or shuffled.  Scores are integers, so
each query's k-th highest is found by refining a histogram: a round counts scores
in equal bins over the query's current range, picks the bin with the k-th, and the
next round bins that bin.  The first range needs no scores: by the norms no product
can lie outside of it.  A task only reports its topmost bins, up to k scores a query: what
lies below cannot hold the k-th.  Once a query's range is one value, that value is
the threshold; a last pass keeps the scores above it, and of those equal to it at
most k of the smallest ids a task, which settles ties exactly.

Queries and candidates are cut into blocks of bounded size, each of vectors of one
length, and each block of the one meets each block of the other: a stated query set
against all rows.  Vectors of different lengths have no product and never meet.

Vectors that are null, empty or hold null or non-finite components take no part, nor do
rows with a null id.  Rows with equal ids are all candidates, but never for a query
of that id; equal rows of a query id are one query, and of different vectors under
one query id the least is the query (shorter first, then by component).  Fewer than k candidates:
all of them.  Components are exact whole numbers up to 2**62 either way and stay at
those ends beyond; scores stay at the ends of a long.  Empty tables give no rows;
other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.runtime import cut, named

BLOCK = 2048
BINS = 4096
SCALE = 256
#: Where components, and scores, stay.
FAR, LOW, HIGH = 1 << 62, -(1 << 63), (1 << 63) - 1


def _scaled(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) as whole numbers."""
    with np.errstate(over="ignore"):
        x = np.floor(x * SCALE)
    far = np.abs(x) >= float(FAR)
    return np.where(far, np.where(x > 0, FAR, -FAR), np.where(far, 0, x).astype(np.int64))


def _blocks(vectors: DataFrame) -> DataFrame:
    """Rows (dim, ids, matrix) of at most BLOCK vectors of one length, the matrix as bytes of int64."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush(dim: int):
            ids, rows = (np.concatenate(x) for x in zip(*held.pop(dim)))
            for i in range(0, len(ids), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids[i : i + BLOCK]], pa.list_(pa.int64())), pa.array([rows[i : i + BLOCK].tobytes()], pa.binary())], names=["dim", "ids", "matrix"])

        for batch in batches:
            lists = batch.column(1)
            size = lists.value_lengths().to_numpy()
            for dim in np.unique(size).tolist():
                rows = np.flatnonzero(size == dim)
                held.setdefault(dim, []).append((batch.column(0).to_numpy()[rows], _scaled(lists.take(pa.array(rows)).flatten().to_numpy().reshape(-1, dim))))
                if sum(len(x) for x, _ in held[dim]) >= 4 * BLOCK:
                    yield from flush(dim)
        for dim in list(held):
            yield from flush(dim)

    return vectors.mapInArrow(pack, "dim int, ids array<bigint>, matrix binary")


def _read(batch: pa.RecordBatch, i: int, a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column(a)[i].values.to_numpy()
    return ids, np.frombuffer(batch.column(b)[i].as_py(), np.int64).reshape(len(ids), -1)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: by doubles while every sum is below 2**53, by longs below 2**63, else by Python's integers."""
    largest = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * q.shape[1]
    if largest < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if largest < 1 << 63:
        return q @ c.T
    return np.clip(q.astype(object) @ c.astype(object).T, LOW, HIGH).astype(np.int64)


def _scores(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, candidate ids, scores, usable) of one pair of blocks of the same length."""
    q_ids, q = _read(batch, i, "q_ids", "q_matrix")
    c_ids, c = _read(batch, i, "ids", "matrix")
    return q_ids, c_ids, products(q, c), q_ids[:, None] != c_ids[None, :]


def _same_length(batch: pa.RecordBatch) -> Iterator[int]:
    return (i for i in range(batch.num_rows) if batch.column("q_dim")[i].as_py() == batch.column("dim")[i].as_py())


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries ``id % every == 0``."""
    v = F.col("v")
    usable = vectors.select(named(id_col).cast("long").alias("id"), named(vector_col).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    candidates = cut(_blocks(usable))
    asked = cut(usable.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct(F.size("v").alias("dim"), "v")).alias("q")).select("id", "q.v"))
    queries = cut(_blocks(asked.coalesce(-(-asked.count() // BLOCK) or 1))).select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many candidates a block has for each query, and the most its products can be."""
        for batch in batches:
            for i in _same_length(batch):
                (q_ids, q), (c_ids, c) = _read(batch, i, "q_ids", "q_matrix"), _read(batch, i, "ids", "matrix")
                some = (q_ids[:, None] != c_ids[None, :]).sum(1)
                # rounding up by more than a sum of squares can be off
                norm = lambda x: np.sqrt((x.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
                most = np.minimum(norm(q) * norm(c).max(initial=0.0) + 1, 2.0**62)
                ok = some > 0
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[ok]), pa.array(most[ok].astype(np.int64)), pa.array(some[ok].astype(np.int64))], names=["q", "most", "n"])

    ranges = queries.crossJoin(candidates).mapInArrow(sized, "q long, most long, n long").groupBy("q").agg(F.max("most").alias("most"), F.sum("n").alias("n"))
    # need: how many of the range's topmost scores are still wanted; norms that may pass 2**62 say nothing
    far = F.col("most") >= F.lit(1 << 62)
    state = cut(ranges.select("q", F.when(far, F.lit(LOW)).otherwise(-F.col("most")).alias("low"), F.when(far, F.lit(HIGH)).otherwise(F.col("most")).alias("high"), F.least(F.lit(k), F.col("n")).cast("long").alias("need")))

    def attached(now: DataFrame) -> DataFrame:
        """Each pair of blocks with the state of the query block's queries."""
        each = queries.select(F.col("q_ids")[0].alias("block"), F.explode("q_ids").alias("q"))
        of = each.join(now, "q").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("q", "low", "high", "need"))).alias("state"))
        ready = cut(queries.join(of, F.col("q_ids")[0] == F.col("block")).select("q_dim", "q_ids", "q_matrix", "state"))
        return ready.coalesce(-(-ready.count() // 4) or 1).crossJoin(candidates)  # blocks, not rows

    def _states(batch: pa.RecordBatch, i: int, q_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        s = batch.column("state")[i].values
        known = {n: s.field(n).to_numpy() for n in ("q", "low", "high", "need")}
        at = np.minimum(np.searchsorted(known["q"], q_ids), len(known["q"]) - 1)
        return known["q"][at] == q_ids, known["low"][at], known["high"][at], known["need"][at]

    def width_of(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Scores a bin, as a whole number: the same here and where bins are turned back into scores."""
        return (high.astype(np.uint64) - low.astype(np.uint64)) // np.uint64(BINS) + np.uint64(1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in _same_length(batch):
                q_ids, _, scores, ok = _scores(batch, i)
                here, low, high, need = _states(batch, i, q_ids)
                ok &= here[:, None] & (scores >= low[:, None]) & (scores <= high[:, None])
                # the distance may pass a signed long, never an unsigned one
                apart = scores.astype(np.uint64) - low.astype(np.uint64)[:, None]
                bins = np.where(ok, apart // width_of(low, high)[:, None], 0).astype(np.int64)
                some = np.flatnonzero(ok.any(1))
                # as many queries at a time as their bins have room for
                for at in range(0, len(some), 256):
                    rows = some[at : at + 256]
                    flat = np.bincount((np.arange(len(rows))[:, None] * BINS + bins[rows])[ok[rows]], minlength=len(rows) * BINS).reshape(-1, BINS)
                    above = flat[:, ::-1].cumsum(1)[:, ::-1] - flat
                    q, b = np.nonzero((flat > 0) & (above < need[rows][:, None]))
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[rows[q]]), pa.array(b.astype(np.int64)), pa.array(flat[q, b].astype(np.int64))], names=["q", "bin", "n"])

    while not state.where("low < high").isEmpty():
        counts = attached(state.where("low < high")).mapInArrow(count, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("q").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
        holding = counts.withColumn("above", F.coalesce(F.sum("n").over(w), F.lit(0))).join(state, "q").where("above < need and above + n >= need")
        per = F.expr(f"cast((cast(high as decimal(20,0)) - cast(low as decimal(20,0))) div {BINS} as decimal(20,0)) + 1")
        # sums beyond a long only arise where the range's top is nearer
        bottom = F.col("low").cast("decimal(38,0)") + F.col("bin") * F.col("per")
        top = F.least(bottom + F.col("per") - 1, F.col("high").cast("decimal(38,0)"))
        refined = holding.withColumn("per", per.cast("decimal(20,0)")).select("q", bottom.cast("long").alias("low"), top.cast("long").alias("high"), (F.col("need") - F.col("above")).alias("need"))
        state = cut(refined.union(state.where("low >= high")))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in _same_length(batch):
                q_ids, c_ids, scores, ok = _scores(batch, i)
                here, low, _, need = _states(batch, i, q_ids)
                ok &= here[:, None] & (scores >= low[:, None])
                q, c = np.nonzero(ok)
                found = scores[q, c]
                order = np.lexsort((c_ids[c], ~found, q))
                q, c, found = q[order], c[order], found[order]
                first = np.searchsorted(q, q)
                some = np.arange(len(q)) - first < k
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[q[some]]), pa.array(c_ids[c[some]]), pa.array(found[some])], names=["query_id", "vec_id", "score"])

    kept = attached(state).mapInArrow(keep, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
