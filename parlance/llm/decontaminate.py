"""Benchmark decontamination by 13-word windows, in DataFrame operations only.

Both sides are lower-cased (A-Z) and cut into words of letters, digits and
non-ASCII characters.  Every 13 consecutive words of a benchmark item are a
window (an item of fewer, but not none, is one window).  The windows are few, so
they are broadcast as a hash set, behind a check of their number.

A training text isn't turned into windows at every word.  Each benchmark window
has an anchor, its longest word; only where a text has an anchor are the windows
around it built, sent through a join with the window set, and so verified as
whole strings.  Words inside any occurrence are hit; a document is contaminated if
hits make up at least ``1 / ratio`` of its words.  Beyond ``MAX_WINDOWS`` the
window set is joined by shuffle instead of broadcast, and beyond ``MAX_ANCHORS``
anchors are known by a bit map instead of one by one; results are the same.

Null or empty text: no words, no hits, not contaminated.  Null items and null
item ids count for nothing.  Repeated rows each get their row.  An empty
benchmark hits nothing; an empty table gives no rows.  Other columns are kept by
``remove_documents`` and ``remove_spans``, whatever their names and types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.runtime import cut, named, unwrapped, whole_row

WINDOW = 13
RATIO = 20
# The word pattern and the letters to lower.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OTHER_UPPER = r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"
MAX_WINDOWS, MAX_ANCHORS = 200_000, 20_000
#: Bits of a bitmap's page, and of all of them at most.
PAGE, MAX_BITS = 1 << 15, 1 << 27


def lowered(text: Column) -> Column:
    """A-Z to a-z.  ``lower`` is faster and the same unless other letters are upper case."""
    plain = (F.octet_length(text) == F.length(text)) | ~text.rlike(OTHER_UPPER)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.regexp_extract_all(lowered(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item_id, len, window, anchor): the distinct windows of every item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where("item_id is not null and size(w) > 0")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1))))
    cut_out = items.select("item_id", "w", starts.alias("s")).select("item_id", F.slice("w", F.col("s"), width).alias("w"))
    anchor = F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("n"), x.alias("word"))))
    return cut_out.select("item_id", F.size("w").alias("len"), F.array_join("w", " ").alias("window"), anchor["word"].alias("anchor")).distinct()


def _quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def _is_anchor(anchors: DataFrame) -> str:
    """SQL that tells of a word ``x`` whether it may be an anchor: a set of them, or beyond ``MAX_ANCHORS`` a bit map.

    The map has 16 bits an anchor, at most ``MAX_BITS``; a word that it takes for an
    anchor by chance costs some windows that the join then turns away.
    """
    some = [r[0] for r in anchors.limit(MAX_ANCHORS + 1).collect()]
    if len(some) <= MAX_ANCHORS:
        return f"x in ({_quoted(some)})" if some else "false"
    size = PAGE
    while size < min(16 * anchors.count(), MAX_BITS):
        size *= 2
    bit = F.pmod(F.xxhash64("anchor"), F.lit(size)) + 1  # bitmaps count from 1
    pages = anchors.select(F.bitmap_bucket_number(bit).alias("b"), F.bitmap_bit_position(bit).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    held = {r["b"]: bytes(r["bits"]) for r in pages.collect()}  # at most MAX_BITS bits
    packed = b"".join(held.get(k + 1, bytes(PAGE // 8)) for k in range(size // PAGE))
    place = f"pmod(xxhash64(x), {size}L)"
    return f"(shiftright(cast(conv(hex(substring(X'{packed.hex()}', cast({place} div 8 as int) + 1, 1)), 16, 10) as int), cast({place} % 8 as int)) & 1) = 1"


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The measured documents (doc_id, h, n_words) and, for those with any, (doc_id, h, hits, items).

    ``h`` is a hash of the text; ``hits`` are sorted (start, len) in words.
    """
    windows = cut(benchmark_windows(benchmark, width))
    facts = windows.agg(F.count("*").alias("n"), F.collect_set("len").alias("lens")).first()
    text = named(text_col).cast("string")
    source = docs.select(named(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), words(text).alias("w"))
    at = F.expr(f"filter(transform(w, (x, i) -> if({_is_anchor(windows.select('anchor').distinct())}, i, null)), x -> x is not null)")

    def around(n: int) -> Column:
        """Places of the windows of ``n`` words over any anchor: start * 64 + n."""
        first, last = lambda p: F.greatest(p - n + 1, F.lit(0)), lambda p: F.least(p, F.size("w") - n)
        starts = lambda p: F.when(last(p) >= first(p), F.sequence(first(p), last(p))).otherwise(F.array().cast("array<int>"))
        return F.transform(F.array_distinct(F.flatten(F.transform("at", starts))), lambda s: s * 64 + n)

    places = [around(n) for n in sorted(facts["lens"])]
    tried = F.concat(*places) if places else F.array().cast("array<int>")
    built = F.transform(tried, lambda k: F.struct(F.floor(k / 64).cast("int").alias("s"), (k % 64).alias("n"), F.array_join(F.slice("w", F.floor(k / 64).cast("int") + 1, k % 64), " ").alias("window")))
    measured = cut(source.withColumn("at", at).select("doc_id", "h", F.size("w").cast("long").alias("n_words"), built.alias("built")))
    by_window = windows.groupBy("window").agg(F.collect_set("item_id").alias("ids"))
    if facts["n"] <= MAX_WINDOWS:
        by_window = F.broadcast(by_window)
    found = measured.select("doc_id", "h", F.explode("built").alias("b")).select("doc_id", "h", "b.s", "b.n", "b.window").join(by_window, "window")
    places = found.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("s", "n"))).alias("hits"))
    items = found.select("doc_id", "h", F.explode("ids").alias("item")).distinct().groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item")).alias("items"))
    same = F.col("doc_id").eqNullSafe(F.col("d2")) & F.col("h").eqNullSafe(F.col("h2"))
    items = items.select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), "items")
    return measured.select("doc_id", "h", "n_words"), cut(places.join(items, same).select("doc_id", "h", "hits", "items"))


def covered(hits: Column) -> Column:
    """Words inside any of the sorted (start, len) hits."""
    return F.aggregate(
        hits,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda s, h: F.struct(
            (s["n"] + F.greatest(h["s"] + h["n"] - F.greatest(s["end"], h["s"]), F.lit(0))).alias("n"), F.greatest(s["end"], h["s"] + h["n"]).alias("end")
        ),
        lambda s: s["n"],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, ratio: int = RATIO, width: int = WINDOW) -> DataFrame:
    """(doc_id, h, n_words, n_hit, items, contaminated) for each row."""
    measured, hits = find_hits(docs, benchmark, width)
    right = hits.select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), covered(F.col("hits")).alias("hit"), "items")
    joined = measured.join(right, F.col("doc_id").eqNullSafe(F.col("d2")) & F.col("h").eqNullSafe(F.col("h2")), "left")
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    return joined.select("doc_id", "h", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (n_hit * ratio >= F.col("n_words"))).alias("contaminated"))


def _beside(docs: DataFrame) -> DataFrame:
    """``docs`` as rows beside the id and text hash that hits are known by."""
    return docs.select(whole_row(docs), named("doc_id").alias("id"), F.xxhash64(named("text").cast("string")).alias("hash"))


def _same() -> Column:
    return F.col("id").eqNullSafe(F.col("doc_id")) & F.col("hash").eqNullSafe(F.col("h"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``docs`` without the contaminated ones."""
    bad = contamination(docs, benchmark, ratio).where("contaminated").select("doc_id", "h").distinct()
    kept = _beside(docs).join(bad, _same(), "left_anti")
    return kept.select(*unwrapped(kept, docs.columns))


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with the words of every occurrence taken out of ``text``, the rest as it was."""
    _, hits = find_hits(docs, benchmark)
    # the pattern for words of either case: what lies between words stays the same
    pattern = WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    inside = lambda i: F.exists("hits", lambda x: (x["s"] <= i) & (i < x["s"] + x["n"]))
    joined = _beside(docs).join(hits.select("doc_id", "h", "hits"), _same(), "left")
    text = joined["row"].getField("text").cast("string")
    kept = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x, i: F.when(inside(i), "").otherwise(x))
    gaps = F.split(text, pattern, -1)
    cleaned = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(kept, i), F.lit("")))), "")
    whole = F.when(F.col("hits").isNotNull(), cleaned).otherwise(text).alias("text")
    return joined.select(*[whole if c == "text" else unwrapped(joined, [c])[0] for c in docs.columns])


def decontamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = contamination(docs, benchmark)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
