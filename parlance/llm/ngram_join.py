"""Exact n-gram Jaccard join by a token-group matrix, without all-pairs work.

A document is the set of its distinct word shingles, as 64-bit hashes.  Documents
with equal sets are one node.  Two nodes link when ``100 * |A & B| >= percent *
|A | B|``; then they differ in at most ``S * (100 - percent) / (100 + percent)``
shingles, S being the sum of their sizes.

1.  *Partition.*  Similar documents are put in one group, and a document need only
    query the groups that may hold a partner.  For that, sizes are cut into classes
    so that linked nodes lie in the same or in neighbouring classes.  For a class
    whose linked nodes differ in at most d shingles, the shingles are dealt by hash
    into d + 1 parts and as many more as may be empty by chance; linked nodes then
    agree in the whole of at least one part that isn't empty.  Unlike a single frequent
    shingle, a part's content recurs almost only in near copies, however common a
    line or passage is.  A part of nothing but shingles that many documents have, though,
    says little: it counts only for a node with more such parts than are to spare, as
    linked nodes agree in one part more than that.  The document of least id that has a
    part leads it (within each task first, so that no part's entries meet in one place for a
    text that a third of all rows share), and a node's home is the group of its least leader.
2.  *Unions.*  A group is cut into blocks of bounded size, each with the group's
    leader.  A block stores the union of its members' shingles, as a bit set of hashes
    first, and after that of those left as shingles, with which of them more than
    one member has.  What a query shares with the union (less what only it brought there)
    bounds its overlap with every member, and only where ``overlap * 100 >=
    percent * |query|`` is the block opened for it.  All links are found there.
3.  *Opening.*  The queries that the bound lets through are counted against the leader, a
    member like others, and those it doesn't link with against all members.  A block
    emits a spanning forest, not pairs; the components of these links already join most
    copies.
4.  *The rest.*  A node then queries the other groups that may hold a partner, and
    the other blocks of its own if it isn't in its leader's component, unless all
    members are in its component already.  Bound and opening are as before.

No pair of nodes that links is missed: it shares a part, hence that part's
leader; of the two, the one whose home is the larger queries the other's home, and
they are compared there unless they are in one component already.  Nothing is
capped.  Hash collisions would matter only at 64 bits (shingle) and 128 bits (set).

Null or empty text, or one without words: an empty set, linked with nothing.
Fewer words than ``width``: the whole sequence is the one shingle.  Null ids take
no part and get no component.  Repeated rows are equal sets.  Rows of different
text under one id are one document: links of any of them reach the others, except
that an empty one keeps its own id.  ``keep_one`` goes by rows instead, and leaves one
of each component: in a chain of links, what it removes may be unlike what stays.  Empty tables give no rows.  Other columns are
carried by ``keep_one`` whatever their names and types, and not read elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm import textbytes as tb
from parlance.llm.components import components
from parlance.llm.runtime import cut, let_go, named, shuffle_width, unwrapped, whole_row

U64 = np.uint64
#: Shingles and members of a group's block, and of a block that others query.
BLOCK, BLOCK_ROWS = 1 << 18, 1024
ASKED, ASKED_ROWS = 1 << 22, 1 << 14
#: Queries and members that are counted against each other at a time.
COUNTED_ROWS = 4096
#: Entries a task holds before it hands them on.
FLUSH = 2_000_000
#: Bits of the filter that keeps texts without any candidate from being read again; its size is fixed.
FILTER_BITS = 1 << 23
#: A shingle is common if, in runs of documents, more than one in so many has it, and that many in all.
COMMON_SHARE, COMMON_LEAST = 2048, 8
#: As many shingles are common at most, those that most documents have: others seldom fall on their places in the filter.
COMMON_MOST = FILTER_BITS // 8
#: Bytes of text cut into shingles at a time: its arrays stay in a core's cache.
SHINGLE_BYTES = 1 << 19


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each shingle, shingle) for runs of a batch's texts."""
    for first, data, offsets in tb.runs(column, SHINGLE_BYTES):
        data = tb.LOWER[data]
        starts, ends, row = tb.words(data, offsets, tb.NOT_SPACE)
        row, value = tb.row_shingles(row, tb.span_hashes(data, starts, ends), width, len(offsets) - 1)
        yield first, len(offsets) - 1, row, value


def _sums(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sum of 64-bit values by row, modulo 2**64."""
    out = np.zeros(n, U64)
    np.add.at(out, row, value)
    return out


def _set_keys(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.bincount(row, minlength=n)
    return size, tb.mix(_sums(row, tb.mix(value), n)), tb.mix(_sums(row, tb.mix(value ^ U64(0x5DEECE66D)), n))


def _sketches(row: np.ndarray, value: np.ndarray, size: np.ndarray) -> pa.Array:
    """Each row's shingles as a hashed bit set, its length a power of two of at least twice their number."""
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits // 64)])
    place = (tb.mix(value ^ U64(0x94D049BB)) & (bits - 1).astype(U64)[row]).astype(np.int64)
    out = np.zeros(base[-1], U64)
    np.bitwise_or.at(out, base[row] + place // 64, U64(1) << (place % 64).astype(U64))
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((base * 8).astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def _folded(packed: list[bytes], words: int) -> np.ndarray:
    """Bit sets at a shorter length: their pieces are laid on each other."""
    return np.array([np.bitwise_or.reduce(np.frombuffer(p, U64).reshape(-1, words), axis=0) for p in packed])


def may_link(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets can link, by their bit sets (last axis).

    A bit that only one of them has stands for at least one shingle that only it has,
    so this bounds what they share from above and never turns a link away.
    """
    shared = np.minimum(na - np.bitwise_count(a & ~b).sum(-1, dtype=np.int64), nb - np.bitwise_count(b & ~a).sum(-1, dtype=np.int64))
    return shared * 100 >= percent * (na + nb - shared)


class Scheme:
    """Size classes and, for each, how many parts shingles are dealt into."""

    def __init__(self, percent: int, largest: int):
        tops, low = [], 1
        while low <= largest * 2 + 10:
            tops.append(low * 100 // percent)
            low = tops[-1] + 1
        tops.append(low * 100 // percent)
        self.tops = np.array(tops)
        apart = 2 * self.tops * (100 - percent) // (100 + percent)
        # some parts stay without a rare shingle by chance; as many are to spare, so that others seldom have to count,
        # even for the smallest sets of the class before, which use this one too, and with a fifth of common shingles
        size, self.spare = 0.8 * np.concatenate([[1, 1], self.tops[:-2]]), np.ones(len(apart))
        for _ in range(8):
            parts = apart + 1 + self.spare
            empty = parts * np.exp(-size / parts)
            self.spare = np.maximum(1, np.ceil(empty + 4 * np.sqrt(empty)))
        self.spare = np.where(apart > 0, np.minimum(self.spare, apart + 1), 0).astype(np.int64)
        self.parts = apart + 1 + self.spare

    def columns(self, row: np.ndarray, value: np.ndarray, n: int, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) entries of the matrix; ``rare`` tells the shingles that aren't common.

        Linked rows agree in more parts than are to spare.  If one of these has a rare shingle,
        it is among the entries of both.  If none has, both have more parts without any than are
        to spare, and then all filled ones count; and if none is filled, the empty ones.
        """
        size = np.bincount(row, minlength=n)
        mine = np.searchsorted(self.tops, size)
        rows, columns = [], []
        spread = tb.mix(value ^ U64(0x632BE59BD9B4E019))
        for k in (mine, mine + 1):
            count = np.where(size > 0, self.parts[k], 0)
            base = np.cumsum(count) - count
            with np.errstate(over="ignore"):
                part = tb.mix(spread + k.astype(U64)[row]) % count.astype(U64)[row]
            cell = base[row] + part.astype(np.int64)
            cells = int(count.sum())
            filled = np.bincount(cell, minlength=cells)
            owner = np.repeat(np.arange(n), count)
            content = _sums(cell, tb.mix(value), cells)
            with np.errstate(over="ignore"):
                column = tb.mix(content + tb.mix((np.arange(cells) - base[owner]).astype(U64) * U64(1 << 20) + k.astype(U64)[owner]))
            told = np.bincount(cell[rare], minlength=cells) > 0
            over = lambda parts: (np.bincount(owner[parts], minlength=n) > self.spare[k])[owner]  # noqa: B023, E731
            use = told | (over(~told) & (filled > 0)) | over(filled == 0)
            rows.append(owner[use])
            columns.append(column[use])
        return np.concatenate(rows), np.concatenate(columns)


def _first_of_runs(x: np.ndarray) -> np.ndarray:
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return keep


def _lead(column: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Columns with their leaders, then (member, leader, how many columns) for the other documents, and these columns."""
    order = np.lexsort((doc, column))
    column, doc = column[order], doc[order]
    first = _first_of_runs(column)
    leader = doc[first][np.cumsum(first) - 1]
    other = np.flatnonzero(doc != leader)
    other = other[np.lexsort((leader[other], doc[other]))]
    starts = np.flatnonzero(_first_of_runs(doc[other]) | _first_of_runs(leader[other]))
    sizes = np.diff(np.append(starts, len(other)))
    return column[first], doc[first], doc[other][starts], leader[other][starts], sizes, column[other]


def _packed(parts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of parts as binary values."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * 8
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(parts.astype(U64).tobytes())])


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in the fewest bytes that hold all of them."""
    return x.astype(np.min_scalar_type(x.max())).tobytes() if len(x) else b""


def widened(packed: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that ``narrow`` packed."""
    return np.frombuffer(packed, f"<u{len(packed) // n}").astype(np.uint64) if n else np.empty(0, np.uint64)


def pack_leaders(leader: np.ndarray) -> bytes:
    """Leaders in order: the first, how many different ones, the bytes of all steps between these, the steps, and the repeats."""
    starts = np.flatnonzero(_first_of_runs(leader)) if len(leader) else np.empty(0, np.int64)
    # from one signed number to a larger one, a step is right modulo 2**64
    steps = narrow(np.diff(leader[starts].view(U64), prepend=leader[:1].view(U64)))
    head = np.array([leader[0] if len(leader) else 0, len(starts), len(steps)], np.int64)
    return head.tobytes() + steps + narrow(np.diff(np.append(starts, len(leader))))


def unpack_leaders(packed: bytes) -> np.ndarray:
    first, n, size = np.frombuffer(packed[:24], np.int64).tolist()
    each = np.cumsum(widened(packed[24 : 24 + size], n), dtype=U64) + np.array([first], np.int64).view(U64)
    return np.repeat(each.view(np.int64), widened(packed[24 + size :], n).astype(np.int64))


def follow(near: pa.Table, far: pa.Table) -> pa.Table:
    """(member, leader) of parts that a document leads in a task only: the leaders of just the parts that member shares with it."""

    def read(table: pa.Table, of: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        packed = table["parts"].to_pylist()
        sizes = np.array([len(x) // 8 for x in packed], np.int64)
        mid, other = np.repeat(table["mid"].to_numpy(), sizes), np.repeat(table[of].to_numpy(), sizes)
        with np.errstate(over="ignore"):
            return tb.mix(np.frombuffer(b"".join(packed), U64) + tb.mix(mid.view(U64))), mid, other

    part, mid, member = read(near, "member")
    known, _, leader = read(far, "leader")
    if len(known):
        order = np.argsort(known, kind="stable")
        known, leader = known[order], leader[order]
        at = np.minimum(np.searchsorted(known, part), len(known) - 1)
        mid = np.where(known[at] == part, leader[at], mid)
    order = np.lexsort((mid, member))
    member, mid = member[order], mid[order]
    keep = (_first_of_runs(member) | _first_of_runs(mid)) & (member != mid)
    return pa.table({"member": member[keep], "leader": mid[keep]})


def _place(value: np.ndarray) -> np.ndarray:
    return (tb.mix(value ^ U64(0x2545F4914F6CDD1D)) & U64(FILTER_BITS - 1)).astype(np.int64)


def _pages(places: DataFrame) -> DataFrame:
    """(b, bits): a set of ``place`` (from 0, under FILTER_BITS) as pieces of a bit map: at most FILTER_BITS bits."""
    at = F.col("place").cast("long") + 1  # bitmaps count from 1
    bits = places.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p"))
    return bits.groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))


def _bitmap(places: DataFrame) -> dict[int, bytes]:
    return {r["b"]: bytes(r["bits"]) for r in _pages(places).collect()}


def _with_presence(rows: DataFrame, places: DataFrame, name: str) -> DataFrame:
    """``rows`` (with ``place``) and whether their place is among ``places``, by a broadcast bit map."""
    at = F.col("place").cast("long") + 1
    pages = F.broadcast(_pages(places).select(F.col("b").alias(f"{name}_b"), F.col("bits").alias(f"{name}_bits")))
    joined = rows.join(pages, F.bitmap_bucket_number(at) == F.col(f"{name}_b"), "left")
    bit = F.expr(f"(shiftright(cast(conv(hex(substring({name}_bits, cast(bitmap_bit_position(place + 1L) div 8 as int) + 1, 1)), 16, 10) as int), cast(bitmap_bit_position(place + 1L) % 8 as int)) & 1) = 1")
    return joined.withColumn(name, F.coalesce(bit, F.lit(False))).drop(f"{name}_b", f"{name}_bits")


def _id_place() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("place")


def _id_filter(ids: DataFrame) -> dict[int, bytes]:
    """The places of ``id`` as a bit map."""
    return _bitmap(ids.select(_id_place()))


def _unpacked(pieces: dict[int, bytes]) -> np.ndarray:
    table, size = np.zeros(FILTER_BITS, bool), 8 * 4096
    for bucket, packed in pieces.items():
        at = (bucket - 1) * size
        table[at : at + size] = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")
    return table


def common_shingles(docs: DataFrame, width: int) -> dict[int, bytes]:
    """The places of shingles that many documents have, as a bit map.

    Every document counts.  Shingles are counted as themselves: counted by place, different ones
    would add up there, and the more documents there are, the more places would look common.
    What is common decides how many candidates there are, never which documents link.
    """

    def emit(value: list[np.ndarray], rows: int) -> pa.RecordBatch:
        shingle, times = np.unique(np.concatenate(value), return_counts=True)
        many = times >= max(2, rows // COMMON_SHARE)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (shingle[many].view(np.int64), _place(shingle[many]), times[many])], names=["shingle", "place", "times"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, rows, held = [], 0, 0
        for batch in batches:
            for _, n, _, value in shingle_sets(batch.column(0), width):
                values.append(value)
                rows, held = rows + n, held + len(value)
                if held >= FLUSH:
                    yield emit(values, rows)
                    values, rows, held = [], 0, 0
        if held:
            yield emit(values, rows)

    counted = docs.select("text").mapInArrow(scan, "shingle long, place long, times long").groupBy("shingle", "place").agg(F.sum("times").alias("times"))
    many = cut(counted.where(F.col("times") >= COMMON_LEAST).select("place", "times"))
    # from the most frequent down, by powers of two of how many documents have them
    least, left = COMMON_LEAST, COMMON_MOST
    for r in many.groupBy(F.floor(F.log2("times")).alias("k")).count().orderBy(F.desc("k")).collect():
        left -= r["count"]
        if left < 0:
            least = 2 << r["k"]
            break
    return _bitmap(many.where(F.col("times") >= least))


def _groups(docs: DataFrame, least: DataFrame, width: int, percent: int, largest: int) -> DataFrame:
    """Distinct (member, leader) of all parts, as ids.

    ``least`` has the least ``id`` of each set: a set's other rows would say its parts again and
    lead none, so a filter of fixed size keeps most of them out.
    """
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(_id_filter(least))
    common = spark.sparkContext.broadcast(common_shingles(docs, width))
    # a pair is handed on once for each bucket that has a column of it, so buckets are no more than memory asks for
    n_buckets = max(64, shuffle_width(spark), 2 * docs.rdd.getNumPartitions())
    scheme = Scheme(percent, largest)

    def bucket_of(column: np.ndarray) -> np.ndarray:
        return ((column >> U64(40)) % U64(n_buckets)).astype(np.int64)

    def part_of(bucket: np.ndarray | int, column: np.ndarray) -> np.ndarray:
        """A part as its bucket knows it."""
        return (np.asarray(bucket).astype(U64) << U64(32)) | (column.astype(U64) & U64(0xFFFFFFFF))

    def emit(column: list, doc: list) -> pa.RecordBatch:
        column, leader, member, local, sizes, parts = _lead(np.concatenate(column), np.concatenate(doc))
        bucket, parts = bucket_of(column), part_of(bucket_of(parts), parts)
        # by leader, so that a leader's number is a small step from the last one's
        order = np.lexsort((leader, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        small, leader = (column & U64(0xFFFFFFFF)).astype(np.uint32)[order], leader[order]
        links, ends = np.linspace(0, len(member), n_buckets + 1).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])
        out = []
        for b in range(n_buckets):
            own, tied = slice(cuts[b], cuts[b + 1]), slice(links[b], links[b + 1])
            if own.start < own.stop or tied.start < tied.stop:
                theirs = parts[ends[tied.start] : ends[tied.stop]]
                out.append((b, small[own].tobytes(), pack_leaders(leader[own]), *(x.tobytes() for x in (member[tied], local[tied], sizes[tied], theirs))))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), *[pa.binary()] * 6), strict=True)], names=["bucket", "columns", "leaders", "member", "local", "sizes", "parts"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, kept, column, doc, held = _unpacked(common.value), _unpacked(wanted.value), [], [], 0
        for batch in batches:
            batch = batch.filter(pa.array(kept[batch.column("place").to_numpy()]))
            ids = batch.column(0).to_numpy()
            for first, n, row, value in shingle_sets(batch.column(1), width):
                row, found = scheme.columns(row, value, n, ~table[_place(value)])
                column.append(found)
                doc.append(ids[first + row])
                held += len(found)
                if held >= FLUSH:
                    yield emit(column, doc)
                    column, doc, held = [], [], 0
        if held:
            yield emit(column, doc)

    def gather(group: pa.Table) -> pa.Table:
        read = lambda name, kind: np.frombuffer(b"".join(group[name].to_pylist()), kind)
        _, _, member, leader, sizes, columns = _lead(read("columns", np.uint32), np.concatenate([unpack_leaders(x) for x in group["leaders"].to_pylist()]))
        parts = np.concatenate([part_of(group["bucket"][0].as_py(), columns), read("parts", U64)])
        near, local = read("member", np.int64), read("local", np.int64)
        packed = _packed(parts, np.concatenate([sizes, read("sizes", np.int64)]))
        return pa.table({"member": np.concatenate([member, near]), "leader": np.concatenate([leader, local]), "local": np.repeat([False, True], [len(member), len(near)]), "parts": packed})

    dealt = docs.select("id", "text", _id_place()).mapInArrow(scan, "bucket int, columns binary, leaders binary, member binary, local binary, sizes binary, parts binary")
    found = cut(dealt.groupBy("bucket").applyInArrow(gather, "member long, leader long, local boolean, parts binary"))
    let_go(spark)
    # a document leads others in its own task only, so none has more of them than a task holds entries
    by_mid = F.pmod(F.xxhash64("mid"), F.lit(n_buckets)).alias("bucket")
    near = found.where("local").select("member", F.col("leader").alias("mid"), "parts").select(by_mid, "member", "mid", "parts")
    far = found.where("not local").select(F.col("member").alias("mid"), "leader", "parts").select(by_mid, "mid", "leader", "parts")
    followed = near.groupBy("bucket").cogroup(far.groupBy("bucket")).applyInArrow(follow, "member long, leader long")
    return followed.union(far.select(F.col("mid").alias("member"), "leader")).distinct()


def _with_tokens(texts: DataFrame, placed: DataFrame, width: int) -> DataFrame:
    """``placed`` (low, key, key2 and more: where a set is wanted, and the least id that has it) with its tokens.

    Texts are read once more; a filter of fixed size keeps most of those that aren't
    wanted from being cut into words.  A row may come once for each task that read it.
    """
    spark = texts.sparkSession
    spread = spark.sparkContext.broadcast(_id_filter(placed.select(F.col("low").alias("id"))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = _unpacked(spread.value), set()
        for batch in batches:
            kept = batch.filter(pa.array(table[batch.column("place").to_numpy()]))
            if not kept.num_rows:
                continue
            ids = kept.column("id").to_numpy()
            for first, n, row, value in shingle_sets(kept.column("text"), width):
                size_of, key, key2 = _set_keys(row, value, n)
                offsets = np.concatenate([[0], np.cumsum(size_of)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(value.view(np.int64)))
                mine = ids[first : first + n]
                new = []
                for k, pair in enumerate(zip(mine.tolist(), key.tolist())):
                    if pair not in seen:  # a repeated row goes on once for each task
                        seen.add(pair)
                        new.append(k)
                columns = [pa.array(mine), pa.array(key.view(np.int64)), pa.array(key2.view(np.int64)), tokens]
                yield pa.RecordBatch.from_arrays(columns, names=["low", "key", "key2", "tokens"]).take(pa.array(new, pa.int64()))

    rows = texts.select("id", "text", _id_place()).mapInArrow(scan, "low long, key long, key2 long, tokens array<bigint>")
    return rows.join(placed, ["low", "key", "key2"]).drop("low", "key", "key2")


def _blocks_of(*keys: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of each different combination of keys."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return iter(np.split(order, np.flatnonzero(new))) if len(order) else iter(())


def _mark_able(out: np.ndarray, packed: list, words: np.ndarray, size: np.ndarray, comp: np.ndarray, queries: np.ndarray, members: np.ndarray, percent: int) -> None:
    """Set ``out`` for the queries and members that may link with one of the other, by their bit sets.

    First the union of the members' bits bounds each query's overlap with the block;
    only queries that pass it are held against the members one by one.  Where queries
    are members too, bits that only one member has don't count.
    """
    inside = np.isin(queries, members).any()
    for a in np.unique(words[queries]):
        for b in np.unique(words[members]):
            # sets that link differ in size by less than a factor of two, so their bit sets by one length at most
            if max(a, b) > 2 * min(a, b):
                continue
            q, m = queries[words[queries] == a], members[words[members] == b]
            mine, theirs = (_folded([packed[i] for i in rows], min(a, b)) for rows in (q, m))
            sums = np.bitwise_or.accumulate(theirs, axis=0)
            union = sums[-1]
            if inside and a == b:
                union = np.bitwise_or.reduce(sums[:-1] & theirs[1:], axis=0) if len(theirs) > 1 else np.zeros_like(union)
            passed = (size[q] - np.bitwise_count(mine & ~union).sum(1, dtype=np.int64)) * 100 >= percent * size[q]
            q, mine = q[passed], mine[passed]
            step = max(1, (1 << 22) // (len(m) * mine.shape[1])) if len(q) else 1
            for low in range(0, len(q), step):
                some = q[low : low + step]
                able = may_link(mine[low : low + step][:, None, :], size[some][:, None], theirs[None, :, :], size[m][None, :], percent)
                able &= comp[some][:, None] != comp[m][None, :]
                out[some[able.any(1)]] = True
                out[m[able.any(0)]] = True


def _within_union(packed: list, words: np.ndarray, size: np.ndarray, queries: np.ndarray, members: np.ndarray, percent: int) -> np.ndarray:
    """Whether each query, itself a member, can share enough with the union of the other members' bits."""
    out = np.zeros(len(queries), bool)
    for a in np.unique(words[queries]):
        m = members[(words[members] <= 2 * a) & (2 * words[members] >= a)]
        w = words[m].min()
        bits = _folded([packed[i] for i in m], w)
        # bits that two members have: a query's own don't count
        sums = np.bitwise_or.accumulate(bits, axis=0)
        union = np.bitwise_or.reduce(sums[:-1] & bits[1:], axis=0) if len(m) > 1 else np.zeros_like(sums[-1])
        mine = np.flatnonzero(words[queries] == a)
        alone = np.bitwise_count(_folded([packed[i] for i in queries[mine]], w) & ~union).sum(1, dtype=np.int64)
        out[mine] = (size[queries[mine]] - alone) * 100 >= percent * size[queries[mine]]
    return out


def bound_homes(percent: int):
    """Of the blocks' members those that may link with another of the block."""

    def bound(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        size, node, lead = (group[c].to_numpy() for c in ("n", "node", "lead"))
        packed = group["sketch"].to_pylist()
        words = np.array([len(p) // 8 for p in packed])
        out = np.zeros(len(words), bool)
        for rows in _blocks_of(group["i"].to_numpy(), group["grp"].to_numpy()):
            first, others = rows[lead[rows]][0], rows[~lead[rows]]
            others = others[_within_union(packed, words, size, others, rows, percent)]
            near = np.zeros(len(others), bool)
            for a in np.unique(words[others]):
                if max(a, words[first]) <= 2 * min(a, words[first]):
                    mine = np.flatnonzero(words[others] == a)
                    w = min(a, words[first])
                    near[mine] = may_link(_folded([packed[i] for i in others[mine]], w), size[others[mine]], _folded([packed[first]], w), size[first], percent)
            out[others[near]] = True
            out[first] |= near.any()
            rest = others[~near]
            if len(rest) and len(others) > 1:
                _mark_able(out, packed, words, size, node, rest, others, percent)
        return group.filter(pa.array(out)).select(["grp", "i", "node", "lead"])

    return bound


def bound_blocks(percent: int):
    """Of the blocks' queries and members those that may link with one of the other kind."""

    def bound(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        size, comp, is_query = (group[c].to_numpy() for c in ("n", "component", "query"))
        packed = group["sketch"].to_pylist()
        words = np.array([len(p) // 8 for p in packed])
        out = np.zeros(len(words), bool)
        for rows in _blocks_of(*(group[c].to_numpy() for c in ("j", "i", "grp"))):
            queries, members = rows[is_query[rows]], rows[~is_query[rows]]
            if len(queries) and len(members):
                _mark_able(out, packed, words, size, comp, queries, members, percent)
        return group.filter(pa.array(out)).select(["grp", "i", "j", "node", "component", "query"])

    return bound


def _forest(left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """Of the given links, those that join two trees."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out = []
    for a, b in zip(left, right, strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _lists(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    lists = group["tokens"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    # unsigned, they are in order as they were written
    return lists.flatten().to_numpy().view(U64), lists.offsets.to_numpy() - lists.offsets[0].as_py()


def _counted(flat: list[np.ndarray], size: np.ndarray, queries: np.ndarray, members: np.ndarray, percent: int, leader: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) pairs that link, by the block's union of shingles.

    A query's overlap with the union bounds what it shares with any member, and the
    block is opened only for those it lets through.  A shingle that a query alone
    brought into the union doesn't count for it.  In an opened block a query is counted
    against the ``leader``, if there is one, and against all members only if it doesn't
    link with that.
    """
    union, times = np.unique(np.concatenate([flat[m] for m in members]), return_counts=True)
    inside = np.isin(queries, members)
    opened = []
    for k, q in enumerate(queries):
        at = np.minimum(np.searchsorted(union, flat[q]), len(union) - 1)
        overlap = int(((union[at] == flat[q]) & (times[at] > int(inside[k]))).sum())
        if overlap * 100 >= percent * size[q]:
            opened.append(q)
    led = []
    if leader is not None and opened:
        top = flat[leader]
        shared = np.array([int((top[np.minimum(np.searchsorted(top, flat[q]), len(top) - 1)] == flat[q]).sum()) for q in opened])
        near = shared * 100 >= percent * (size[opened] + size[leader] - shared)
        led, opened = [q for q, x in zip(opened, near) if x], [q for q, x in zip(opened, near) if not x]
        members = members[members != leader]
    led = np.array(led, np.int64), np.full(len(led), -1 if leader is None else leader, np.int64)
    if not opened or len(members) < 2 - int(leader is None):
        return led
    if leader is not None:
        union = np.unique(np.concatenate([flat[m] for m in members]))
    queries = np.array(opened)
    shared = np.zeros((len(queries), len(members)), np.int64)
    rank = lambda rows: (np.repeat(np.arange(len(rows)), [len(flat[r]) for r in rows]), np.searchsorted(union, np.concatenate([flat[r] for r in rows])))
    (q_row, q_at), (m_row, m_at) = rank(queries), rank(members)
    known = (q_at < len(union)) & (union[np.minimum(q_at, len(union) - 1)] == np.concatenate([flat[r] for r in queries]))
    q_row, q_at = q_row[known], q_at[known]
    q_order, m_order = np.argsort(q_at, kind="stable"), np.argsort(m_at, kind="stable")
    q_row, q_at, m_row, m_at = q_row[q_order], q_at[q_order], m_row[m_order], m_at[m_order]
    # a slice of the matrix's tokens at a time keeps the two 0/1 tables small
    step = max(256, (1 << 22) // (len(members) + len(queries)))
    for low in range(0, len(union), step):
        q, m = np.zeros((len(queries), step), np.float32), np.zeros((len(members), step), np.float32)
        for table, row, at in ((q, q_row, q_at), (m, m_row, m_at)):
            a, b = np.searchsorted(at, [low, low + step])
            table[row[a:b], at[a:b] - low] = 1
        shared += np.rint(q @ m.T).astype(np.int64)
    both = size[queries][:, None] + size[members][None, :] - shared
    q, m = np.nonzero((shared * 100 >= percent * both) & (queries[:, None] != members[None, :]))
    return np.concatenate([led[0], queries[q]]), np.concatenate([led[1], members[m]])


def _edges(links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"src": pa.array([a for a, _ in links], pa.int64()), "dst": pa.array([b for _, b in links], pa.int64())})


def _first_rows(*keys: np.ndarray) -> np.ndarray:
    """One row of each different combination."""
    return np.array([rows[0] for rows in _blocks_of(*keys)], np.int64)


def open_homes(percent: int):
    """The links within blocks, as a forest: behind the union's bound, with the leader first and with the rest for what it doesn't link with."""

    def compare(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(_first_rows(*(group[c].to_numpy() for c in ("lead", "node", "i", "grp"))))).combine_chunks()
        node, size, lead = (group[c].to_numpy() for c in ("node", "n", "lead"))
        values, offsets = _lists(group)
        flat = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        links = []
        for rows in _blocks_of(group["i"].to_numpy(), group["grp"].to_numpy()):
            leader, others = rows[lead[rows]], rows[~lead[rows]]
            if len(others) and len(rows) > 1:
                q, m = _counted(flat, size, others, rows, percent, int(leader[0]) if len(leader) else None)
                links += _forest(node[q].tolist(), node[m].tolist())
        return _edges(links)

    return compare


def open_blocks(percent: int):
    """The links between the queries and members of blocks, as a forest of their components."""

    def compare(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(_first_rows(*(group[c].to_numpy() for c in ("query", "node", "j", "i", "grp"))))).combine_chunks()
        comp, size, is_query = (group[c].to_numpy() for c in ("component", "n", "query"))
        values, offsets = _lists(group)
        flat = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        links = []
        for rows in _blocks_of(*(group[c].to_numpy() for c in ("j", "i", "grp"))):
            queries, members = rows[is_query[rows]], rows[~is_query[rows]]
            for low in range(0, len(queries), COUNTED_ROWS):
                for start in range(0, len(members), COUNTED_ROWS):
                    q, m = _counted(flat, size, queries[low : low + COUNTED_ROWS], members[start : start + COUNTED_ROWS], percent)
                    apart = comp[q] != comp[m]
                    links += _forest(comp[q[apart]].tolist(), comp[m[apart]].tolist())
        return _edges(links)

    return compare


def set_components(docs: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, h, n, key, key2) of every row, h a hash of the text, and (n, key, key2, low, component) of every set with shingles.

    ``low`` is the least id that has the set; sets that links join share ``component``.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50, at most 100")
    spark = docs.sparkSession
    text = named(text_col).cast("string")
    texts = docs.select(named(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, row, value in shingle_sets(batch.column(1), width):
                size, a, b = _set_keys(row, value, n)
                columns = [batch.column(0).slice(first, n), batch.column(2).slice(first, n), *(pa.array(x.view(np.int64)) for x in (size.astype(np.int64), a, b)), _sketches(row, value, size)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "h", "n", "key", "key2", "sketch"])

    measured = cut(texts.mapInArrow(measure, "id long, h long, n long, key long, key2 long, sketch binary"))
    sets, full = measured.drop("sketch"), measured.where("n > 0 and id is not null")
    # numbered in the order of their least ids and written, so a set keeps its number
    nodes = cut(full.groupBy("n", "key", "key2").agg(F.min("id").alias("low")).orderBy("low", "key", "key2").withColumn("node", F.monotonically_increasing_id()))
    largest = nodes.agg(F.max("n")).first()[0] or 0
    if not largest:
        return sets, nodes.withColumnRenamed("node", "component")
    known = texts.where("id is not null")
    # an id with several texts stands for all their sets: more to compare, nothing lost
    of_id = cut(sets.where("n > 0 and id is not null").join(nodes, ["n", "key", "key2"]).select("id", "node").distinct())
    a, b = of_id.select(F.col("id").alias("member"), F.col("node").alias("a")), of_id.select(F.col("id").alias("leader"), F.col("node").alias("b"))
    led = _groups(known, nodes.select(F.col("low").alias("id")), width, percent, largest).join(a, "member").join(b, "leader").where("a <> b").select("a", "b").distinct()
    # every leader is in its own group too
    led = cut(led.union(led.select(F.col("b").alias("a"), "b").distinct()))
    homes = cut(led.groupBy("a").agg(F.min("b").alias("home")))
    within = led.join(homes, "a").select("b", "home").distinct()
    wanted = cut(homes.withColumnRenamed("a", "node").join(nodes, "node"))
    # of a set's rows, those of its least id are alike
    mine = full.join(wanted.select("n", "key", "key2", F.col("low").alias("id"), "node"), ["n", "key", "key2", "id"])
    bits = cut(mine.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    where_from = wanted.select("node", "low", "key", "key2", "n")
    width_of = shuffle_width(spark)

    def dealt(rows: DataFrame, sized: DataFrame, *keys: str) -> DataFrame:
        """Whole blocks in buckets of about one block's size (by the ``n`` of ``sized``), so that tiny ones don't each cost a call."""
        total = sized.agg(F.sum("n")).first()[0] or 0
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(max(width_of, -(-total // BLOCK)))))

    # each group by itself, in blocks that all have its leader
    parts = lambda tokens, rows, most, most_rows: F.greatest(F.ceil(tokens / most), F.ceil(rows / most_rows))
    cuts = cut(wanted.groupBy(F.col("home").alias("grp")).agg(parts(F.sum("n"), F.count("*"), BLOCK, BLOCK_ROWS).alias("nb")))
    several = cuts.where("nb > 1")  # at most all shingles over BLOCK, and all sets over BLOCK_ROWS
    count = F.coalesce("nb", F.lit(1).cast("long"))
    members = wanted.where("node <> home").select(F.col("home").alias("grp"), "node").join(several, "grp", "left")
    members = members.select("grp", F.pmod(F.xxhash64("node"), count).alias("i"), "node", F.lit(False).alias("lead"))
    leaders = cuts.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("i"), F.col("grp").alias("node"), F.lit(True).alias("lead"))
    able = dealt(members.union(leaders).join(bits, "node"), wanted, "grp", "i").groupBy("bucket").applyInArrow(bound_homes(percent), "grp long, i long, node long, lead boolean")
    placed = cut(able.join(where_from, "node"))
    found = dealt(_with_tokens(known, placed, width), placed, "grp", "i") if not placed.isEmpty() else None
    links = None if found is None else cut(found.groupBy("bucket").applyInArrow(open_homes(percent), "src long, dst long").distinct())
    where_of = wanted.select("node", "home", "n", F.col("node").alias("component"))
    if links is not None and not links.isEmpty():
        joined = components(links).withColumnsRenamed({"node": "v", "component": "c"})
        where_of = where_of.join(joined, F.col("node") == F.col("v"), "left").select("node", "home", "n", F.coalesce("c", "node").alias("component"))
    where_of = cut(where_of)
    # the other groups, and the other blocks of a group for those its leader doesn't link with
    lead = where_of.select(F.col("node").alias("grp"), F.col("component").alias("lead"))
    facts = where_of.groupBy(F.col("home").alias("grp")).agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum("n").alias("tokens"), F.count("*").alias("m"))
    per = facts.join(lead, "grp").join(cuts, "grp")
    # what is known of a group goes with it, so that only visits that may find something leave the join
    askers = led.join(where_of.select(F.col("node").alias("a"), F.col("home").alias("own"), "component", "n"), "a")
    hosts = within.withColumnRenamed("home", "grp").join(per, "grp").withColumnRenamed("b", "via")
    at_home = (F.col("own") == F.col("grp")) & ((F.col("component") == F.col("lead")) | (F.col("nb") == 1))
    settled = (F.col("low") == F.col("high")) & (F.col("low") == F.col("component"))
    met = (F.col("b") == F.col("via")) & (F.col("grp") <= F.col("own")) & ~at_home & ~settled
    asked = cut(askers.join(hosts, met).select("a", "component", "grp", "n", "tokens", "m").distinct())
    more = None
    if not asked.isEmpty():
        blocks = asked.groupBy("grp").agg(parts(F.first("tokens"), F.first("m"), ASKED, ASKED_ROWS).alias("mb"), parts(F.sum("n"), F.count("*"), ASKED, ASKED_ROWS).alias("qb"))
        block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        m = where_of.select("node", "component", "n", F.col("home").alias("grp")).join(blocks, "grp").select("grp", "node", "component", "n", F.lit(False).alias("query"), block("node", "mb").alias("i"), every("qb").alias("j"))
        q = asked.join(blocks, "grp").select("grp", F.col("a").alias("node"), "component", "n", F.lit(True).alias("query"), every("mb").alias("i"), block("a", "qb").alias("j"))
        both = m.union(q)
        able = dealt(both.drop("n").join(bits, "node"), both, "grp", "i", "j").groupBy("bucket").applyInArrow(bound_blocks(percent), "grp long, i long, j long, node long, component long, query boolean")
        placed = cut(able.join(where_from, "node"))
        if not placed.isEmpty():
            more = cut(dealt(_with_tokens(known, placed, width), placed, "grp", "i", "j").groupBy("bucket").applyInArrow(open_blocks(percent), "src long, dst long").distinct())
    if more is not None and not more.isEmpty():
        joined = components(more).withColumnsRenamed({"node": "v", "component": "c"})
        where_of = where_of.join(joined, F.col("component") == F.col("v"), "left").select("node", F.coalesce("c", "component").alias("component"))
    found = nodes.join(where_of.select("node", F.col("component").alias("found")), "node", "left").select("n", "key", "key2", "low", F.coalesce("found", "node").alias("component"))
    return sets, cut(found)


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of ``docs``."""
    sets, found = set_components(docs, width, percent, id_col, text_col)
    # an id with several texts joins their components
    of_id = sets.where("n > 0 and id is not null").join(found, ["n", "key", "key2"]).groupBy("id").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    shared = cut(of_id.where("least <> most").select("id", "least"))
    if not shared.isEmpty():
        ties = sets.where("n > 0").join(shared, "id").join(found, ["n", "key", "key2"]).select(F.col("component").alias("src"), F.col("least").alias("dst")).distinct()
        joined = components(ties).withColumnsRenamed({"node": "v", "component": "c"})
        found = found.join(joined, F.col("component") == F.col("v"), "left").select("n", "key", "key2", "low", F.coalesce("c", "component").alias("component"))
    least = found.groupBy("component").agg(F.min("low").alias("least"))
    final = found.join(least, "component").select("n", "key", "key2", "least")
    return sets.join(final, ["n", "key", "key2"], "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component_id")
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row, that of the smallest id, left of each component of linked texts.

    Rows with a null id, and those without shingles, stay.  It goes by rows: an id's
    other texts stay unless they have partners themselves.  Of rows that are equal
    in id and text, the one that sorts first by its other columns stays.
    """
    sets, found = set_components(docs, width, percent)
    rows = sets.where("n > 0 and id is not null").join(found, ["n", "key", "key2"]).select("id", "h", "component")
    first = rows.groupBy("component").agg(F.min(F.struct("id", "h")).alias("f")).select("component", F.col("f.id").alias("first_id"), F.col("f.h").alias("first_h"))
    judged = rows.join(first, "component").select("id", "h", ((F.col("id") == F.col("first_id")) & (F.col("h") == F.col("first_h"))).alias("stays"))
    judged = cut(judged.groupBy("id", "h").agg(F.first("stays").alias("stays"), F.count("*").alias("n")))
    beside = docs.select(whole_row(docs), named("doc_id").cast("long").alias("id"), F.xxhash64(named("text").cast("string")).alias("h"))
    # what stays and what goes is known by bit maps of a fixed size; only rows that both of them may mean are shuffled
    place = F.pmod(F.xxhash64("id", "h"), F.lit(FILTER_BITS)).alias("place")
    goes = judged.where("not stays").select("id", "h")
    stays = judged.where("stays").select("id", "h").union(sets.where("n = 0 or id is null").select("id", "h"))
    told = _with_presence(_with_presence(beside.withColumn("place", place), goes.select(place), "going"), stays.select(place), "staying")
    unclear = told.where("going and staying").select(*beside.columns).join(goes, ["id", "h"], "left_anti")
    kept = told.where("not going").select(*beside.columns).unionByName(unclear)
    repeated = cut(judged.where("stays and n > 1").select("id", "h"))
    if not repeated.isEmpty():
        one = kept.join(repeated, ["id", "h"], "left_semi").groupBy("id", "h").agg(F.min_by("row", F.to_json("row")).alias("row"))
        kept = kept.join(repeated, ["id", "h"], "left_anti").select("row").union(one.select("row"))
    return kept.select(*unwrapped(kept, docs.columns))
