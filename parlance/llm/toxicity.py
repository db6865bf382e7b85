"""Toxic documents by a subsequence string-kernel support vector machine.

A text is cut into units: words without their punctuation, and runs of
single-character words (spelled-out ones) joined.  Two units are alike by the
gap-weighted subsequences of three and four characters that they share: each
counts with a weight that falls with every character it skips, up to a span of
six.  A character put into, taken from or changed in an insult thus leaves most of
its subsequences.  The kernel is normed by what a unit of that length can hold.

Fitting (in one task, on a bounded sample of labelled documents): character
runs and words that occur in toxic documents and practically never in others, by
documents and not by copies, mark the offending units of toxic documents; these,
with variants that have inserted and doubled characters, and the units of clean
documents are the labelled short sentences.  A Nyström map on ``LANDMARKS``
landmark units turns the kernel into vectors, on which a linear machine with
squared hinge loss is fitted; the clean units it likes best are added and it is
fitted again.

Scoring: the decision is linear in kernel values with the landmarks, and these are
sums over shared subsequences, so the landmarks fold into one table of subsequence
weights.  A document's units are looked up in it, all of the text, with repeated
units of a batch looked up once; the worst unit decides, and a logistic curve
fitted to the sample's documents makes it a probability.

Null and empty texts and texts without letters or digits score the least of all.
Repeated rows get equal scores.  Without both kinds of label every score is 0.
Other columns aren't read.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm import labelled
from parlance.llm import textbytes as tb
from parlance.llm.runtime import named, unwrapped, whole_row

#: The bounds of the labelled sample (for each class) and of the landmarks.
PER_CLASS, LANDMARKS = 4000, 640
FOLDS, FOLD, THRESHOLD = 5, 0, 0.5
SPAN, DECAY = 6, 0.6
#: What being the very same unit adds to the kernel.
SAME = 0.7
RIDGE = 1e-5
BITS = 18
U64 = np.uint64

#: Subsequences as offsets from their first character, with their weights.
SHAPES = [(o, DECAY ** (o[-1] - len(o))) for n in (2, 3) for o in itertools.combinations(range(1, SPAN), n)]

# codes: 0 start and end, 1-26 letters, 27-36 digits, then bytes of other letters
_CODE = np.full(256, 255, np.uint8)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[48:58] = np.arange(27, 37)
_CODE[128:] = 37 + np.arange(128) % 27


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(characters, starts, ends, row) of the units of a run of texts."""
    starts, ends, row = tb.words(data, offsets, tb.NOT_SPACE)
    code = _CODE[data]
    keep = code != 255
    place = np.concatenate([[0], np.cumsum(keep)])
    # a letter of several bytes is one character
    upto = np.concatenate([[0], np.cumsum(keep & ((data & 0xC0) != 0x80))])
    single = upto[ends] - upto[starts] == 1
    chars, starts, ends = code[keep], place[starts], place[ends]
    some = ends > starts
    starts, ends, row, single = starts[some], ends[some], row[some], single[some]
    new = np.ones(len(starts), bool)
    new[1:] = ~(single[1:] & single[:-1] & (row[1:] == row[:-1]))
    last = np.ones(len(starts), bool)
    last[:-1] = new[1:]
    return chars, starts[new], ends[last], row[new]


def _laid_out(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen units' characters, each unit between two end marks, and where each begins."""
    size = ends - starts
    begin = np.cumsum(size + 2) - (size + 2)
    out = np.zeros(int((size + 2).sum()), np.uint32)
    inner = np.ones(len(out), bool)
    inner[begin] = False
    inner[begin + size + 1] = False
    source = np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)
    out[inner] = chars[source]
    return out, begin


def _features(text: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each shape: the features, whether they lie in one unit, and the weight."""
    m = len(text)
    size = np.diff(np.append(begin, m))
    end = np.repeat(begin + size, size).astype(np.int64)
    room = end - np.arange(m)
    shifted = [text << np.uint32(6 * k) for k in range(4)]
    for offsets, weight in SHAPES:
        far = offsets[-1]
        if m <= far:
            continue
        packed = shifted[0][: m - far].copy()
        for k, o in enumerate(offsets, 1):
            packed |= shifted[k][o : m - far + o]
        if len(offsets) == 3:
            packed *= np.uint32(2654435761)
            packed >>= np.uint32(32 - BITS)
            packed |= np.uint32(1 << BITS)
        yield packed, room[: m - far] > far, weight


def _wholes(text: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each unit one feature that only the very same unit has."""
    return (tb.span_hashes(text.astype(np.uint8), begin, np.append(begin[1:], len(text))) & U64((1 << BITS) - 1)).astype(np.int64) + (2 << BITS)


def _norms(size: np.ndarray) -> np.ndarray:
    """What a unit of ``size`` characters (with its end marks) can share at most with itself, its subsequences being distinct."""
    total = np.zeros(len(size))
    for offsets, weight in SHAPES:
        total += np.maximum(size - offsets[-1], 0) * weight**2
    return np.sqrt(np.maximum(total, 1e-9))


def _vectors(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normed sparse vectors of units given as code bytes: (unit, feature, value)."""
    chars = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    text, begin = _laid_out(chars, np.concatenate([[0], ends[:-1]]), ends)
    size = np.diff(np.append(begin, len(text)))
    owner, norm = np.repeat(np.arange(len(words)), size), _norms(size)
    unit, feature, value = [], [], []
    for packed, ok, weight in _features(text, begin):
        unit.append(owner[: len(ok)][ok])
        feature.append(packed[ok])
        value.append(np.full(int(ok.sum()), weight))
    unit, feature, value = np.concatenate(unit), np.concatenate(feature).astype(np.int64), np.concatenate(value)
    value /= norm[unit]
    whole = np.arange(len(words))
    return np.append(unit, whole), np.append(feature, _wholes(text, begin)), np.append(value, np.full(len(words), SAME))


class Model:
    def __init__(self, table: np.ndarray, bias: float, slope: float, shift: float):
        self.table, self.bias, self.slope, self.shift = table.astype(np.float32), bias, slope, shift

    def decide(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The machine's decision for each unit."""
        if not len(starts):
            return np.empty(0)
        text, begin = _laid_out(chars, starts, ends)
        total = np.zeros(len(text), np.float32)
        for packed, ok, weight in _features(text, begin):
            total[: len(ok)] += self.table[packed] * (ok * np.float32(weight))
        return np.add.reduceat(total, begin) / _norms(ends - starts + 2) + SAME * self.table[_wholes(text, begin)] + self.bias

    def worst(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The highest decision of each row's units; -inf if it has none."""
        out = np.full(len(offsets) - 1, -np.inf)
        chars, starts, ends, row = units(data, offsets)
        if len(starts):
            _, first, back = np.unique(tb.span_hashes(chars, starts, ends), return_index=True, return_inverse=True)
            np.maximum.at(out, row, self.decide(chars, starts[first], ends[first])[back])
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.worst(data, offsets) + self.shift, -60, 60)))


NEVER = Model(np.zeros(3 << BITS), -1.0, 0.0, -60.0)


def _clusters(marks: np.ndarray) -> np.ndarray:
    """A number for each document; those that share any mark have the same."""
    parent = np.arange(len(marks))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in range(marks.shape[1]):
        first: dict[int, int] = {}
        for i, m in enumerate(marks[:, k].tolist()):
            a, b = root(i), root(first.setdefault(m, i))
            parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(len(marks))])


class Units:
    """The distinct units of some documents: code characters of all, end to end."""

    def __init__(self, packed: list[bytes]):
        blob = b"\xff".join(packed) + b"\xff"
        chars = np.frombuffer(blob, np.uint8)
        stops = np.flatnonzero(chars == 255)
        starts = np.concatenate([[0], stops[:-1] + 1])
        of = np.searchsorted(np.cumsum([len(p) + 1 for p in packed]), starts, "right")
        some = stops > starts
        self.chars, self.starts, self.ends, self.doc = chars, starts[some], stops[some], of[some]
        self.n = len(packed)

    def word(self, i: int) -> bytes:
        return self.chars[self.starts[i] : self.ends[i]].tobytes()

    def distinct(self) -> np.ndarray:
        """A place of each different unit, ordered by what it says."""
        _, first = np.unique(tb.span_hashes(self.chars, self.starts, self.ends), return_index=True)
        return first

    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """(unit, slot) of what may give a unit away: all of it, and its runs of four and five characters."""
        text, begin = _laid_out(self.chars, self.starts, self.ends)
        m, size = len(text), np.diff(np.append(begin, len(text)))
        owner, room = np.repeat(np.arange(len(begin)), size), np.repeat(begin + size, size) - np.arange(m)
        unit, slot = [np.arange(len(begin))], [tb.span_hashes(text.astype(np.uint8), begin, begin + size)]
        for n in (4, 5):
            packed = np.zeros(max(m - n + 1, 0), U64)
            for k in range(n):
                packed = (packed << U64(6)) | text[k : m - n + 1 + k].astype(U64)
            ok = room[: len(packed)] >= n
            unit.append(owner[: len(packed)][ok])
            slot.append(tb.mix(packed[ok] + U64(n << 40)))
        return np.concatenate(unit), (np.concatenate(slot) & U64(SLOTS - 1)).astype(np.int64)


#: Runs are counted in a table of this size; two that share a slot count together.
SLOTS = 1 << 25


def _count(packed: list[bytes], cluster: np.ndarray) -> np.ndarray:
    """In how many clusters of documents each slot occurs."""
    out = np.zeros(SLOTS, np.uint16)
    order = np.argsort(cluster, kind="stable")
    new = np.flatnonzero(np.append(True, np.diff(cluster[order]) != 0))
    # batches of about 100 documents that don't part a cluster
    cuts = np.append(np.unique(new[np.minimum(np.searchsorted(new, np.arange(0, len(order), 100)), len(new) - 1)]), len(order))
    for low, high in zip(cuts[:-1], cuts[1:]):
        some = order[low:high]
        units = Units([packed[i] for i in some])
        unit, slot = units.slots()
        pair = np.unique(cluster[some][units.doc[unit]].astype(np.int64) * SLOTS + slot)
        np.add.at(out, pair % SLOTS, np.uint16(1))
    return out


def telling_slots(packed: list[bytes], y: np.ndarray, cluster: np.ndarray, in_clean: np.ndarray, n_clean: int) -> np.ndarray:
    """Slots that only toxic documents fill, too often for chance, counted by cluster of copies."""
    if not y.any():
        return np.zeros(SLOTS, bool)
    toxic = np.flatnonzero(y)
    n_toxic = len(np.unique(cluster[toxic]))
    base = n_toxic / (n_toxic + n_clean)
    seen = _count([packed[i] for i in toxic], cluster[toxic])
    least = max(3, int(np.ceil(12 / max(-np.log(min(base, 0.6)), 0.5))))
    # few slots are filled that often, so only these are compared
    often = np.flatnonzero(seen >= least)
    out = np.zeros(SLOTS, bool)
    out[often[in_clean[often] <= 0.02 * seen[often]]] = True
    return out


def _variants(word: bytes, rng: np.random.Generator) -> list[bytes]:
    """The word with a character put in, and with one doubled."""
    at, new = int(rng.integers(1, max(len(word), 2))), bytes([int(rng.integers(1, 27))])
    twice = int(rng.integers(0, len(word)))
    return [word[:at] + new + word[at:], word[: twice + 1] + word[twice:]]


#: Shared features that a kernel's slice writes out at a time.
ENTRIES = 1 << 20


def _machine(words: list[bytes], y: np.ndarray, marks: list[bytes]) -> tuple[np.ndarray, float]:
    """The table and bias of a machine fitted to units, with the given landmarks."""
    lu, lf, lv = _vectors(marks)
    order = np.argsort(lf, kind="stable")
    lu, lf, lv = lu[order], lf[order], lv[order]
    columns, first = np.unique(lf, return_index=True)
    many = np.diff(np.append(first, len(lf)))

    def kernel_of(some: list[bytes]) -> np.ndarray:
        """Kernel values of units with the landmarks, over the features they share."""
        u, f, v = _vectors(some)
        at = np.minimum(np.searchsorted(columns, f), len(columns) - 1)
        shared = columns[at] == f
        u, at, v = u[shared], at[shared], v[shared]
        ends, out = np.cumsum(many[at]), np.zeros(len(some) * len(marks))
        # long units share very many features with landmarks: about ``ENTRIES`` of them are written out at a time, in order
        cuts = np.unique(np.searchsorted(ends, np.arange(0, (ends[-1] if len(ends) else 0) + ENTRIES, ENTRIES)))
        for low, high in zip(cuts[:-1], cuts[1:]):
            own = slice(low, high)
            n = many[at[own]]
            entry = np.arange(int(n.sum())) + np.repeat(first[at[own]] - (np.cumsum(n) - n), n)
            np.add.at(out, np.repeat(u[own], n) * len(marks) + lu[entry], np.repeat(v[own], n) * lv[entry])
        return out.reshape(len(some), -1)

    value, vector = np.linalg.eigh(kernel_of(marks))
    good = value > 1e-5 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    # the kernel is turned into vectors a slice at a time, and never there as a whole
    x = np.ones((len(words), root.shape[1] + 1))
    for low in range(0, len(words), 512):
        x[low : low + 512, :-1] = kernel_of(words[low : low + 512]) @ root
    sign, cost = np.where(y, 1.0, -1.0), np.where(y, len(y) / max(2 * y.sum(), 1), len(y) / max(2 * (~y).sum(), 1))
    ridge = np.eye(x.shape[1]) * RIDGE * len(y)
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    active = np.ones(len(y), bool)
    for _ in range(30):
        left, right = ridge.copy(), np.zeros(len(w))
        for low in range(0, len(x), 2048):
            mine = active[low : low + 2048]
            used = x[low : low + 2048][mine]
            left += (used * cost[low : low + 2048][mine][:, None]).T @ used
            right += used.T @ (cost * sign)[low : low + 2048][mine]
        w = np.linalg.solve(left, right)
        now = sign * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    table = np.zeros(3 << BITS)
    np.add.at(table, lf, lv * (root @ w[:-1])[lu])
    return table, float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift, with the smoothed targets that keep separable data finite."""
    t = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    cost = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1))
    a = np.stack([x, np.ones(len(x))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (cost * p * (1 - p))[:, None]).T @ a + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (cost * (t - p)) - 1e-6 * w)
        w += step / max(1.0, np.abs(step).max() / 5)
    return float(w[0]), float(w[1])


def fit_units(packed: list[bytes], y: np.ndarray, marks: np.ndarray, seed: int = 0) -> Model:
    """A model from documents' packed unit sets, their labels and the marks that tell copies."""
    y = y.astype(bool)
    if not y.any() or y.all():
        return NEVER
    cluster = _clusters(marks)
    in_clean = _count([p for p, t in zip(packed, y) if not t], cluster[~y])
    telling, left, n_clean = np.zeros(SLOTS, bool), y.copy(), len(np.unique(cluster[~y]))
    toxic = np.flatnonzero(y)

    def offending_units() -> Iterator[tuple[int, bytes]]:
        """(document, unit) of the toxic documents' units with a telling slot."""
        for low in range(0, len(toxic), 100):
            units = Units([packed[i] for i in toxic[low : low + 100]])
            unit, slot = units.slots()
            for i in np.unique(unit[telling[slot]]):
                yield toxic[low + units.doc[i]], units.word(i)

    for _ in range(3):
        # toxic documents that nothing gave away yet stand out better by themselves
        found = telling_slots(packed, left, cluster, in_clean, n_clean)
        if not found.any():
            break
        telling |= found
        left = y.copy()
        left[[d for d, _ in offending_units()]] = False
    counts = Counter(u for _, u in offending_units())
    del in_clean, telling
    positive = [u for u, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    if not positive:
        return NEVER
    rng = np.random.default_rng(seed)
    good = Units([p for p, t in zip(packed, y) if not t])
    offending = set(positive)
    places = np.array([i for i in good.distinct() if good.word(i) not in offending], np.int64)
    if not len(places):
        return NEVER
    clean = lambda chosen: [good.word(i) for i in places[chosen]]
    more = [v for u in positive[:2000] for v in _variants(u, rng)]
    right = positive[:4000] + [v for v in more if len(v) > 3]
    wrong = clean(rng.choice(len(places), min(4000, len(places)), replace=False))
    for _ in range(5):
        labels = np.repeat([True, False], [len(right), len(wrong)])
        near = positive[: LANDMARKS // 2]
        table, bias = _machine(right + wrong, labels, near + wrong[-(LANDMARKS - len(near)) :])
        model = Model(table, bias, 1.0, 0.0)
        liked = np.concatenate([model.decide(good.chars, good.starts[places[i : i + 50_000]], good.ends[places[i : i + 50_000]]) for i in range(0, len(places), 50_000)])
        hard = np.argsort(-liked, kind="stable")[:1500]
        known = set(wrong)
        wrong += [u for u in clean(hard[::-1]) if u not in known]
    worst = np.full(len(y), -10.0)
    for low in range(0, len(packed), 200):
        some = Units(packed[low : low + 200])
        np.maximum.at(worst, low + some.doc, model.decide(some.chars, some.starts, some.ends))
    slope, shift = _logistic(worst, y)
    return Model(table, bias, max(slope, 1e-3), shift)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, folds: int = FOLDS, fold: int = FOLD) -> Model:
    """A model of the labelled rows off the held-out fold."""
    train = labelled.sample(docs, labels, "toxic", folds, fold, per_class)
    salts = [U64(k * 0x1234567 + 1) for k in range(4)]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in tb.runs(batch.column("text")):
                n = len(offsets) - 1
                chars, starts, ends, row = units(data, offsets)
                sets = [set() for _ in range(n)]
                blob = chars.tobytes()
                for r, a, b in zip(row.tolist(), starts.tolist(), ends.tolist()):
                    sets[r].add(blob[a:b])
                r, value = tb.row_shingles(row, tb.span_hashes(chars, starts, ends), 5, n)
                marks = np.full((n, len(salts)), np.iinfo(np.int64).max)
                for k, salt in enumerate(salts):
                    np.minimum.at(marks[:, k], r, tb.mix(value ^ salt).view(np.int64))
                names = ["doc_id", "y", "units", "marks"]
                cut = lambda c: batch.column(c).slice(first, n)
                packed = pa.array([b"\xff".join(sorted(s)) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([cut("doc_id"), cut("y"), packed, pa.array([m.tobytes() for m in marks], pa.binary())], names=names)

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: (r["doc_id"], r["units"]))
        if rows:
            marks = np.array([np.frombuffer(r["marks"], np.int64) for r in rows])
            # a document without units is a copy of none
            bare = marks[:, 0] == np.iinfo(np.int64).max
            marks[bare] = -np.arange(1, bare.sum() + 1)[:, None]
            model = fit_units([r["units"] for r in rows], np.array([r["y"] for r in rows]), marks)
            yield pa.RecordBatch.from_arrays([pa.array([model.table.tobytes()], pa.binary()), *(pa.array([float(x)]) for x in (model.bias, model.slope, model.shift))], names=["table", "bias", "slope", "shift"])

    # bounded rows, at most per_class ids of each label, meet in one task
    sampled = train.mapInArrow(gather, "doc_id long, y int, units binary, marks binary").repartition(1)
    fitted = sampled.mapInArrow(fit_all, "table binary, bias double, slope double, shift double").first()
    return NEVER if fitted is None else Model(np.frombuffer(fitted["table"], np.float32), fitted["bias"], fitted["slope"], fitted["shift"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    return with_score(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")), model).select("doc_id", "score")


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column of scores in place of any of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    rows = docs.select(whole_row(docs), named(text_col).cast("string").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in tb.runs(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(offsets) - 1), pa.array(shared.value.score(data, offsets), pa.float64())], names=["row", "score"])

    scored = rows.mapInArrow(measure, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
    return scored.select(*unwrapped(scored, kept), F.col("score").alias(name))


def remove_scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score at least ``threshold``."""
    name = "score"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return with_score(docs, model, name=name).where(F.col(name) < threshold).select(*[named(c) for c in docs.columns])


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The same, by a model fitted to the labelled among ``docs``."""
    return remove_scored(docs, fit(docs, labels), threshold)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", labelled.held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
