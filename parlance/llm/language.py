"""Language identification by a convolutional network over bytes.

A text's bytes, A-Z lowered, are cut into windows of a fixed length that overlap by the
widest filter less one, so that every run of bytes a filter can see lies in some window.
Bytes are embedded; filters of several widths run over each window, their highest response
over all places is kept (max pooling, then a ramp), and a softmax layer gives the window's
language.  A document's probabilities are its windows' means, weighted by length, so whole
texts decide.  The network is trained here, in numpy, by stochastic gradient descent.

It learns from a bounded sample: ``PER_LANGUAGE`` ids of each of the ``LANGUAGES`` most
frequent languages, ``PER_TEXT`` windows evenly spread over each text; at most
``LANGUAGES * PER_LANGUAGE * PER_TEXT`` windows reach the driver.  The network's weights
(tens of kilobytes) are broadcast.

Null texts, and texts without a letter of any script, are ``und`` with score 0; so is every
text where nothing could be learned.  Empty windows don't occur.  Repeated rows get equal
answers.  The language column is read for training alone, other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm import labelled
from parlance.llm import textbytes as tb
from parlance.llm.runtime import named

WINDOW, WIDTHS, FILTERS, DEPTH = 128, (3, 4, 5), 20, 8
#: The bounds of the training sample.
LANGUAGES, PER_LANGUAGE, PER_TEXT = 128, 300, 4
EPOCHS, BATCH, RATE = 6, 64, 0.004
FOLDS, FOLD, UNKNOWN = 4, 2, "und"
#: The code of what lies behind a text's end.
PAD = 256
STEP = WINDOW - max(WIDTHS) + 1
#: Windows of a matrix product; its operands then stay in the processor's cache.
ROWS = 64


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all rows as codes, with each one's row and its number of bytes."""
    size = np.diff(offsets)
    n = np.where(size > 0, np.maximum(-(-(size - (WINDOW - STEP)) // STEP), 1), 0)
    row = np.repeat(np.arange(len(size)), n)
    first = offsets[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * STEP
    held = np.minimum(offsets[1:][row] - first, WINDOW)
    padded = np.concatenate([tb.LOWER[data].astype(np.int16), np.full(WINDOW, PAD, np.int16)])
    codes = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[first]
    return np.where(np.arange(WINDOW) < held[:, None], codes, PAD), row, held


class Network:
    """Embedding, filters of each width, and the softmax layer; ``languages`` names its outputs."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embedding = rng.normal(0, 0.5, (PAD + 1, DEPTH)).astype(np.float32)
        self.embedding[PAD] = 0
        self.filters = [rng.normal(0, (2 / (w * DEPTH)) ** 0.5, (w * DEPTH, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.bias, self.out, self.out_bias]

    def responses(self, codes: np.ndarray, width: int, filters: np.ndarray) -> np.ndarray:
        """Every filter's answer at every place of every window."""
        embedded = self.embedding[codes]
        places = WINDOW - width + 1
        patches = np.empty((len(codes), places, width * DEPTH), np.float32)
        for k in range(width):
            patches[:, :, k * DEPTH : (k + 1) * DEPTH] = embedded[:, k : k + places]
        return (patches.reshape(-1, width * DEPTH) @ filters).reshape(len(codes), places, -1)

    def pooled(self, codes: np.ndarray) -> np.ndarray:
        """Every filter's highest answer in each window; places lie side by side, so that shifts and maxima run along memory."""
        n, widest = len(codes), max(WIDTHS)
        embedded = np.take(np.ascontiguousarray(self.embedding.T), codes.reshape(-1), axis=1)
        shifted = np.zeros((widest * DEPTH, n * WINDOW), np.float32)
        for k in range(widest):
            shifted[k * DEPTH : (k + 1) * DEPTH, : n * WINDOW - k] = embedded[:, k:]
        best = []
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            answers = (f.T @ shifted[: w * DEPTH]).reshape(FILTERS, n, WINDOW)[:, :, : WINDOW - w + 1]
            best.append(answers.max(2).T + b)
        return np.maximum(np.concatenate(best, 1), 0)

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        found = np.empty((len(codes), len(self.languages)), np.float32)
        for a in range(0, len(codes), ROWS):
            found[a : a + ROWS] = softmax(self.pooled(codes[a : a + ROWS]) @ self.out + self.out_bias)
        return found

    def gradients(self, codes: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy, for every parameter; only the places that won the pooling take part."""
        n, each = len(codes), np.arange(len(codes))[:, None]
        won = []
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            answers = self.responses(codes, w, f)
            at = answers.argmax(1)
            won.append((at, np.take_along_axis(answers, at[:, None], 1)[:, 0] + b))
        raw = np.concatenate([v for _, v in won], 1)
        hidden = np.maximum(raw, 0)
        error = softmax(hidden @ self.out + self.out_bias)
        error[np.arange(n), y] -= 1
        error /= n
        back = (error @ self.out.T) * (raw > 0)
        embedding, filters, bias = np.zeros_like(self.embedding), [], []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            d, at = back[:, k * FILTERS : (k + 1) * FILTERS], won[k][0]
            seen = codes[each[..., None], at[..., None] + np.arange(w)]
            patches = self.embedding[seen].reshape(n, FILTERS, w * DEPTH)
            filters.append(np.einsum("nf,nfk->kf", d, patches))
            bias.append(d.sum(0))
            np.add.at(embedding, seen, (d[..., None] * f.T[None]).reshape(n, FILTERS, w, DEPTH))
        embedding[PAD] = 0
        return [embedding, *filters, *bias, hidden.T @ error, error.sum(0)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(codes: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = EPOCHS) -> Network:
    """A network fitted to windows and their languages, with moment estimates for each weight's step."""
    net, rng = Network(languages), np.random.default_rng(11)
    first, second, t = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()], 0
    # every language is drawn equally often, as often as the largest
    own = [np.flatnonzero(y == k) for k in range(len(languages))]
    most = max(map(len, own), default=0)
    for epoch in range(epochs):
        order = rng.permutation(np.concatenate([np.resize(rng.permutation(i), most) for i in own if len(i)]) if most else np.empty(0, int))
        rate = RATE * (1 - epoch / epochs)
        for a in range(0, len(order), BATCH):
            mine, t = order[a : a + BATCH], t + 1
            for p, g, m, v in zip(net.parameters(), net.gradients(codes[mine], y[mine]), first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return net


def sample(docs: DataFrame, folds: int = FOLDS, fold: int = FOLD, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> DataFrame:
    """(lang, id, text) of a bounded number of ids of each language, those with the smallest hashes, off the held-out fold."""
    usable = docs.select(named("doc_id").alias("doc_id"), named("lang").cast("string").alias("lang"), named("text").cast("string").alias("text"))
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~labelled.held_out("doc_id", folds, fold))
    common = usable.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(languages)
    ids = usable.select("lang", F.col("doc_id").alias("id")).join(F.broadcast(common.select("lang")), "lang").withColumn("h", F.xxhash64(F.lit("language"), "id"))
    # first within parts of a language, so that a frequent one is not ranked by one task
    for keys in (["lang", F.pmod("h", F.lit(64))], ["lang"]):
        ids = ids.withColumn("rn", F.dense_rank().over(Window.partitionBy(*keys).orderBy("h", "id"))).where(F.col("rn") <= per_language).drop("rn").distinct()
    found = usable.withColumnRenamed("doc_id", "id").join(F.broadcast(ids.drop("h")), ["lang", "id"])
    return found.groupBy("lang", "id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("lang", "id", "t.text")


def fit(docs: DataFrame, folds: int = FOLDS, fold: int = FOLD, per_language: int = PER_LANGUAGE, per_text: int = PER_TEXT) -> Network | None:
    """The network of a corpus; None where no row is fit to learn from."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in tb.runs(batch.column("text")):
                codes, row, held = windows(data, offsets)
                of_row = np.bincount(row, minlength=len(offsets) - 1)
                place = np.arange(len(row)) - np.repeat(np.cumsum(of_row) - of_row, of_row)
                # the windows nearest to an even spread
                keep = (place * per_text // of_row[row] != (place - 1) * per_text // of_row[row]) | (of_row[row] <= per_text)
                rows = (row[keep] + first).tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").take(pa.array(rows)), batch.column("id").take(pa.array(rows)), pa.array(place[keep]), pa.array([c.tobytes() for c in codes[keep].astype("<i2")], pa.binary())],
                    names=["lang", "id", "place", "codes"],
                )

    train_on = sample(docs, folds, fold, per_language)
    schema = f"lang string, id {dict(train_on.dtypes)['id']}, place long, codes binary"
    # bounded rows: languages times ids times windows of a text
    rows = sorted(train_on.mapInArrow(cut_up, schema).collect(), key=lambda r: (r["lang"], r["id"], r["place"]))
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    codes = np.array([np.frombuffer(r["codes"], "<i2") for r in rows])
    return train(codes, np.array([languages.index(r["lang"]) for r in rows]), languages)


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    source = docs.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("lettered"), named(text_col).cast("string").alias("text"))
    if network is None:
        return source.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        names = np.array([*net.languages, UNKNOWN], object)
        for batch in batches:
            for first, data, offsets in tb.runs(batch.column("text"), limit=1 << 20):
                codes, row, held = windows(data, offsets)
                n = len(offsets) - 1
                total = np.zeros((n, len(net.languages)))
                np.add.at(total, row, net.probabilities(codes) * held[:, None])
                size = np.bincount(row, held, n)
                some = batch.column("lettered").slice(first, n).to_numpy(zero_copy_only=False).astype(bool) & (size > 0)
                best = np.where(some, total.argmax(1), len(names) - 1)
                score = np.where(some, np.clip(total.max(1) / np.maximum(size, 1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return source.mapInArrow(read, "doc_id long, lang_pred string, score double")


def language_digest(docs: DataFrame) -> DataFrame:
    found = identify(docs, fit(docs))
    return found.select("doc_id", labelled.held_out("doc_id", FOLDS, FOLD).alias("held_out"), "lang_pred", "score")
