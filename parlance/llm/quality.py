"""Document quality by nearest-neighbour voting in a latent space.

A document's terms describe how it is written, in any language: the shapes of its
words (runs of lower case, capitals, digits, single signs), shapes of neighbouring
words, word lengths, words said again at once or after one or two others, and
hashed word beginnings at a low weight.  Terms are hashed to ``TERMS`` columns and
weighted by the square root of their share and by inverse document frequency; a
truncated singular value decomposition of the labelled sample gives ``RANK`` latent
directions.

The labelled vectors are at most ``2 * PER_CLASS`` (a fixed bound), so they are
broadcast, and every document is compared with all of them: exact cosines, a block
of documents times all labelled vectors at once.  The ``NEIGHBOURS`` nearest vote
with their label; a vote weighs the similarity over that of chance, and is
corrected for the class's share in the sample, so that the score estimates the
share of good documents among all that look alike.

Whole texts are read.  Null and empty texts get the sample's share of good labels.
Repeated rows get equal scores.  Without any usable label every score is 0.5.
Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import labelled
from parlance.llm import textbytes as tb

TERMS, RANK, NEIGHBOURS = 2048, 32, 24
#: The bound of the labelled sample, for each class.
PER_CLASS = 2500
FOLDS, FOLD, THRESHOLD = 4, 2, 0.7
#: Documents whose terms are held at a time.
ROWS = 512
U64 = np.uint64

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of weighted term counts, divided by the number of words."""
    n = len(offsets) - 1
    starts, ends, row = tb.words(data, offsets, tb.NOT_SPACE)
    out = np.zeros((n, TERMS), np.float32)
    if not len(starts):
        return out
    kind = _CLASS[data]
    turn = np.ones(len(kind), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[starts] = True
    place = np.concatenate([[0], np.cumsum(turn)])
    shape = tb.span_hashes(kind[turn], place[starts], place[ends])
    word = tb.span_hashes(tb.LOWER[data], starts, ends)
    begin = tb.span_hashes(tb.LOWER[data], starts, np.minimum(ends, starts + 3))
    together = lambda k: row[k:] == row[:-k]
    terms = [(row, tb.mix(shape), 1.0), (row, tb.mix(np.minimum(ends - starts, 24).astype(U64) + U64(77)), 0.5), (row, tb.mix(begin ^ U64(991)), 0.2)]
    with np.errstate(over="ignore"):
        if len(row) > 1:
            same = together(1)
            terms.append((row[1:][same], tb.mix(shape[:-1][same] * U64(3) + shape[1:][same]), 0.7))
        for k in (1, 2, 3):
            if len(row) > k:
                again = together(k) & (word[k:] == word[:-k])
                terms.append((row[k:][again], np.full(again.sum(), tb.mix(np.array([k], U64))[0]), 2.0))
    count = np.maximum(np.bincount(row, minlength=n), 1)
    flat = np.zeros(n * TERMS)
    for r, value, weight in terms:
        flat += weight * weight * np.bincount(r * TERMS + (value % U64(TERMS)).astype(np.int64), minlength=n * TERMS)
    return np.sqrt(flat.reshape(n, TERMS) / count[:, None]).astype(np.float32)


class Model:
    """Latent directions, labelled vectors and votes."""

    def __init__(self, counts: np.ndarray, y: np.ndarray, shares: tuple[float, float]):
        self.prior = shares[1] / (shares[0] + shares[1]) if sum(shares) else 0.5
        present = (counts > 0).sum(0)
        self.idf = np.log((1 + len(y)) / (1 + present)).astype(np.float32) + 1
        x = counts * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        # the latent directions are the leading eigenvectors of the terms' inner products
        value, vector = np.linalg.eigh((x.T @ x).astype(np.float64))
        self.directions = vector[:, ::-1][:, : min(RANK, len(value))].astype(np.float32)
        self.vectors = self.project(counts)
        seen = np.array([(y == 0).sum(), (y == 1).sum()])
        self.votes = np.where(y == 1, shares[1] / max(seen[1], 1), shares[0] / max(seen[0], 1)).astype(np.float32)
        self.good = (y == 1).astype(np.float32)

    def project(self, counts: np.ndarray) -> np.ndarray:
        v = (counts * self.idf) @ self.directions
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        some = np.flatnonzero(counts.any(1))
        if not len(self.vectors) or not len(some):
            return out
        cosine = self.project(counts[some]) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        sim = np.take_along_axis(cosine, near, 1)
        weight = np.clip(sim, 0, None) ** 8 * self.votes[near]
        total = weight.sum(1)
        voted = (weight * self.good[near]).sum(1) / np.maximum(total, 1e-12)
        out[some] = np.where(total > 1e-12, voted, self.prior)
        return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, folds: int = FOLDS, fold: int = FOLD) -> Model:
    """A model of the labelled rows off the held-out fold."""
    train = labelled.sample(docs, labels, "quality", folds, fold, per_class)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in tb.runs(batch.column("text"), max_rows=ROWS):
                counts = term_counts(data, offsets)
                n = len(counts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), batch.column("y").slice(first, n), pa.array([c.tobytes() for c in counts], pa.binary())], names=["doc_id", "y", "counts"])

    # bounded rows: at most per_class ids of each label
    rows = sorted(train.mapInArrow(vectors, "doc_id long, y int, counts binary").collect(), key=lambda r: (r["doc_id"], r["counts"]))
    counts = np.array([np.frombuffer(r["counts"], np.float32) for r in rows], np.float32).reshape(-1, TERMS)
    all_of = labels.where(F.col("quality").isin(0, 1) & ~labelled.held_out("doc_id", folds, fold)).groupBy("quality").count().collect()
    shares = {r["quality"]: float(r["count"]) for r in all_of}
    return Model(counts, np.array([r["y"] for r in rows], int), (shares.get(0, 0.0), shares.get(1, 0.0)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in tb.runs(batch.column(1), max_rows=ROWS):
                found = np.clip(shared.value.score(term_counts(data, offsets)), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(found)), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(measure, "doc_id long, score double")


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", labelled.held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
