"""Secrets in whole texts, in DataFrame operations only.

Base patterns (assign, access, hex) are matched leftmost and non-overlapping.
The added method slides a window over each candidate string (a long run of
base64 or hexadecimal characters), keeps the count of every character in the
window, and follows the window's Shannon entropy by taking away the terms of the
two counts that a step changes.  Each part covered by windows whose entropy
passes the bound of the candidate's character class is a span of kind
``entropy_hex`` or ``entropy_mixed``; windows that touch or overlap make one span.  Candidates that are words, dates or paths
from end to end (see ``ALLOWED``) are passed over.  A run of one character needs no
rule: its entropy is low, and what stands beside it is still looked at.

Spans are code points, end exclusive.  Positions come from splitting the text at
the matches, so one pass per pattern gives all of them.  A pattern runs only on
texts that hold its literal part.

Null text: read as empty, no spans.  Empty tables give no rows, equal rows equal
results, other columns are left out.  A span may overlap one of another kind.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.runtime import named, whole_row

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_ASSIGNED = 6

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: A word as it is written: one case, a capital first, or such words run together; a capital within stands before two small letters at least.
WORD = r"(?:[A-Z]?[a-z]++(?:[A-Z][a-z]{2,}+)*+|[A-Z]++)"
#: Candidates that are no secrets, as a whole: words with hyphens, underscores and slashes between (paths) and up to four digits after; dates, numbers and rulers.
ALLOWED = rf"^(?:[-_/=+]*+(?:{WORD}(?:[-_/=+]++{WORD})*+)?+[-_/=+]*+[0-9]{{0,4}}|[0-9=_/+-]*+)\z"
WINDOW = 20
#: Bits a character within a window: hexadecimal strings have 16 symbols, mixed ones 64.
HEX_BITS, MIXED_BITS = 3.0, 3.6
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

#: Matches, and characters of a candidate, that one fold goes over.
PIECE, STRETCH = 256, 2048
#: What the sum of n * log2(n) is counted in.
UNIT = 1 << 40

SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint>"
WITH_HIT = SPAN.replace(">", ",hit:string>")


def _bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``c``, which is worked out once however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _spans(text: Column, pattern: str, kind: str, rank: int, keep=None, shape: str = SPAN) -> Column:
    """Spans of a pattern's matches, by adding up what lies between and within them; ``shape`` may ask for the match itself too.

    A fold copies its state at every step, so sums are taken in two levels: of pieces
    of ``PIECE`` matches, and within each piece.
    """
    size = lambda g, h: F.struct(F.length(g).cast("long").alias("gap"), F.length(h).cast("long").alias("len"), (F.lit(True) if keep is None else keep(h)).alias("ok"), h.alias("hit"))
    matches = F.filter(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), size), lambda x: x["len"].isNotNull())
    zero = F.lit(0).cast("long")
    span = lambda at, x: F.struct((at + x["gap"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (at + x["gap"] + x["len"]).alias("end"), *([x["hit"].alias("hit")] if shape != SPAN else [])).cast(shape)

    def placed(xs: Column) -> Column:
        pieces = F.sequence(F.lit(0), F.floor(F.size(xs) / PIECE).cast("int"))
        piece = lambda j: F.slice(xs, j * PIECE + 1, F.lit(PIECE))
        sums = F.transform(pieces, lambda j: F.aggregate(piece(j), zero, lambda s, x: s + x["gap"] + x["len"]))

        def within(j: Column, base: Column) -> Column:
            start = F.struct(base.alias("at"), F.array().cast(f"array<{shape}>").alias("out"))
            step = lambda s, x: F.struct((s["at"] + x["gap"] + x["len"]).alias("at"), F.when(x["ok"], F.array_append(s["out"], span(s["at"], x))).otherwise(s["out"]).alias("out"))
            return F.aggregate(piece(j), start, step, lambda s: s["out"])

        return _bound(sums, lambda ss: F.flatten(F.transform(pieces, lambda j: within(j, F.aggregate(F.slice(ss, F.lit(1), j), zero, lambda s, x: s + x)))))

    return _bound(matches, placed)


def _shares(bits: float) -> int:
    """The largest sum of n * log2(n) over a window's characters, in ``UNIT``ths, at which its entropy is ``bits`` a character."""
    return math.floor((WINDOW * math.log2(WINDOW) - bits * WINDOW) * UNIT)


def high_entropy(c: Column, most: Column) -> Column:
    """The parts of a candidate that lie under windows whose sum of n * log2(n) is at most ``most``: array of (start, end).

    Twelve counts of five bits share a long, so a step changes two of six numbers.
    The sum is kept in whole ``UNIT``ths, so it doesn't drift.  A fold copies its
    state at every step, so a long candidate is folded in pieces that share a window's
    length, and what touches across pieces is joined after.
    """
    code = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.instr(F.lit(ALPHABET), x) - 1)
    nlogn = F.array(*[F.lit(round(n * math.log2(n) * UNIT) if n else 0).cast("long") for n in range(WINDOW + 1)])
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(k, F.lit(12)) * 5)
    of = lambda counts, k: F.call_function("shiftright", F.get(counts, F.floor(k / 12).cast("int")), F.pmod(k, F.lit(12)) * 5).bitwiseAND(31).cast("int")
    part = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    nothing = F.lit(0).cast("long")

    def step(s: Column, x: Column) -> Column:
        i, k, gone = s["i"], x["k"], x["gone"]
        full = gone >= 0
        n_out = F.when(full, of(s["counts"], gone)).otherwise(F.lit(1))
        n_in = of(s["counts"], k) - F.when(gone == k, 1).otherwise(0)
        counts = F.transform(s["counts"], lambda v, j: v + F.when(j == F.floor(k / 12), one(k)).otherwise(nothing) - F.when(full & (j == F.floor(gone / 12)), one(gone)).otherwise(nothing))
        total = s["total"] - F.get(nlogn, n_out) + F.get(nlogn, n_out - 1) + F.get(nlogn, n_in + 1) - F.get(nlogn, n_in)
        hot = (i + 1 - s["base"] >= WINDOW) & (total <= s["most"])
        apart = hot & (i + 1 - WINDOW > s["end"])
        return F.struct(
            (i + 1).alias("i"),
            s["base"].alias("base"),
            s["most"].alias("most"),
            counts.alias("counts"),
            total.alias("total"),
            F.when(apart & (s["end"] >= 0), F.array_append(s["out"], part(s["start"], s["end"]))).otherwise(s["out"]).alias("out"),
            F.when(apart, i + 1 - WINDOW).otherwise(s["start"]).alias("start"),
            F.when(hot, i + 1).otherwise(s["end"]).alias("end"),
        )

    def folded(codes: Column, j: Column) -> Column:
        base = F.greatest(j * STRETCH - (WINDOW - 1), F.lit(0))
        mine = F.slice(codes, base + 1, (j + 1) * STRETCH - base)
        left = F.concat(F.array_repeat(F.lit(-1), WINDOW), mine)
        pairs = F.filter(F.zip_with(mine, left, lambda k, gone: F.struct(k.alias("k"), gone.alias("gone"))), lambda x: x["k"].isNotNull())
        start = F.struct(
            base.alias("i"), base.alias("base"), most.cast("long").alias("most"), F.array_repeat(nothing, 6).alias("counts"), nothing.alias("total"),
            F.array().cast("array<struct<start:int,end:int>>").alias("out"), F.lit(-1).alias("start"), F.lit(-1).alias("end"),
        )
        return F.aggregate(pairs, start, step, lambda s: F.when(s["end"] >= 0, F.array_append(s["out"], part(s["start"], s["end"]))).otherwise(s["out"]))

    def joined(parts: Column) -> Column:
        begins = F.filter(parts, lambda x, i: (i == 0) | (F.get(parts, i - 1)["end"] < x["start"]))
        ends = F.filter(parts, lambda x, i: (i == F.size(parts) - 1) | (F.get(parts, i + 1)["start"] > x["end"]))
        return F.zip_with(begins, ends, lambda a, b: part(a["start"], b["end"]))

    stretches = lambda codes: F.sequence(F.lit(0), F.floor((F.size(codes) - 1) / STRETCH).cast("int"))
    return _bound(_bound(code, lambda codes: F.flatten(F.transform(stretches(codes), lambda j: folded(codes, j)))), joined)


def entropy_spans(text: Column) -> Column:
    """Spans of high entropy in a text's candidate strings."""
    raw = _spans(text, CANDIDATE, "candidate", 3, lambda hit: ~hit.rlike(ALLOWED), WITH_HIT)

    def scored(x: Column) -> Column:
        hexed = x["hit"].rlike("^[0-9a-fA-F_=/+-]+$")
        parts = high_entropy(x["hit"], F.when(hexed, F.lit(_shares(HEX_BITS))).otherwise(F.lit(_shares(MIXED_BITS))))
        shown = lambda rank, kind: F.transform(parts, lambda p: F.struct((x["start"] + p["start"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (x["start"] + p["end"]).alias("end")).cast(SPAN))
        return F.when(hexed, shown(3, "entropy_hex")).otherwise(shown(4, "entropy_mixed"))

    return F.flatten(F.transform(raw, scored))


def find_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row (id, assign, access, hex, entropy) of span arrays for each document; with ``keep`` also those columns and the text searched."""
    none = F.array().cast(f"array<{SPAN}>")
    text = F.col("__text")
    small = F.lower(text)
    keyword = None
    for word in KEYWORDS:
        has = F.contains(small, F.lit(word))
        keyword = has if keyword is None else keyword | has
    assigned = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= MIN_ASSIGNED
    also = ["__text", *keep] if keep else []
    return docs.select(named(id_col).alias("doc_id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("__text"), *map(named, keep)).select(
        "doc_id",
        *also,
        F.when(keyword, _spans(text, ASSIGN, "assign", 0, assigned)).otherwise(none).alias("assign"),
        F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, "access", 1)).otherwise(none).alias("access"),
        F.when(text.rlike(HEX), _spans(text, HEX, "hex", 2)).otherwise(none).alias("hex"),
        F.when(text.rlike(CANDIDATE), entropy_spans(text)).otherwise(none).alias("entropy"),
    )


def mask_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", mark: str = "[SECRET]") -> DataFrame:
    """The texts with every secret replaced by ``mark``: what is assigned, keys, hexadecimal runs and entropy spans.

    Spans that overlap or touch become one mark.  An assignment keeps its name, quotes and
    sign; all else around a secret stays as it is.  A null text stays null.
    """
    text = named(text_col).cast("string")
    found = find_secrets(docs.select(F.lit(0).alias("id"), text.alias("text"), whole_row(docs)), "text", "id", ("row",))
    said = lambda a, b: F.substr(F.col("__text"), (a + 1).cast("int"), (b - a).cast("int"))
    value = lambda x: F.length(F.regexp_extract(said(x["start"], x["end"]), ASSIGN, 2))
    own = F.transform("assign", lambda x: F.struct((x["end"] - value(x)).alias("start"), x["end"].alias("end")))
    rest = F.transform(F.concat("access", "hex", "entropy"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    # in order of place: text up to each secret that begins behind the last, and one mark for it
    folded = F.aggregate(
        F.array_sort(F.concat(own, rest)),
        F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"), F.lit(False).alias("any")),
        lambda s, x: F.struct(
            F.when(s["any"] & (x["start"] <= s["at"]), s["done"]).otherwise(F.concat(s["done"], said(s["at"], x["start"]), F.lit(mark))).alias("done"),
            F.greatest(s["at"], x["end"]).alias("at"),
            F.lit(True).alias("any"),
        ),
    )
    masked = found.select("row", F.col("__text"), folded.alias("f"))
    new = F.concat(F.col("f.done"), said(F.col("f.at"), F.col("f.at") + F.length("__text")))
    old = masked["row"].getField(text_col)
    return masked.select(*[F.when(old.isNotNull(), new).alias(c) if c == text_col else masked["row"].getField(c).alias(c) for c in docs.columns])


def secret_digest(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs)
    base = F.array_sort(F.concat("assign", "access", "hex"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"),
        shown(F.array_sort(F.concat(base, "entropy"))).alias("spans"),
    )
