"""Text columns: tagged transcripts, tokens, lexicon hits, times, markup.

All are Column expressions, so they stay in Catalyst and push down like any other.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The transcript tag, token classes, and the affirmation lexicon.
TAGGED = r"(?s)\[(\d+(?:\.\d+)?)\]\[(S\d+)\](.*?)\[(\d+(?:\.\d+)?)\]"
UNIT = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]|[A-Za-z0-9]+"
WORD_OR_HAN = r"[a-zA-Z0-9'-]+|[\x{4e00}-\x{9fff}]"
LEXICON = r"(?<![不相互絕反派配視針])對(?![於不起象應吧])|沒錯|確實"


def parse_tagged(raw: Column) -> Column:
    """array<struct<start, speaker, text, end>> of every ``[start][Sxx]text[end]``; the rest is dropped."""
    return F.transform(
        F.regexp_extract_all(raw, F.lit(TAGGED), F.lit(0)),
        lambda m: F.struct(
            F.regexp_extract(m, TAGGED, 1).cast("double").alias("start"),
            F.regexp_extract(m, TAGGED, 2).alias("speaker"),
            F.regexp_replace(F.regexp_extract(m, TAGGED, 3), r"^\s+|\s+\z", "").alias("text"),
            F.regexp_extract(m, TAGGED, 4).cast("double").alias("end"),
        ),
    )


def render_tagged(start: Column, speaker: Column, text: Column, end: Column) -> Column:
    return F.concat(F.lit("["), start.cast("string"), F.lit("]["), speaker, F.lit("]"), text, F.lit("["), end.cast("string"), F.lit("]"))


def escape_tags(text: Column) -> Column:
    """``text`` with a backslash after every ``[`` that a digit follows, so that no part of it reads as a time tag."""
    return F.regexp_replace(text, r"\[(\\*[0-9])", r"[\\$1")


def unescape_tags(text: Column) -> Column:
    """What ``escape_tags`` was given."""
    return F.regexp_replace(text, r"\[\\(\\*[0-9])", r"[$1")


def units(text: Column) -> Column:
    """Each Han character, and each run of ASCII letters and digits, is a unit."""
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def units_early(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_OR_HAN), F.lit(0))


def units_wide(text: Column) -> Column:
    """The aligner's own tokens: letters, numbers and apostrophes, Han characters singly, words cut at spaces."""
    kept = F.regexp_replace(text, r"[^\p{L}\p{N}'\s]", "")
    return F.regexp_extract_all(kept, F.lit(r"\p{IsHan}|[\p{L}\p{N}'&&[^\p{IsHan}]]+"), F.lit(0))


def unit_index(text: Column) -> Column:
    """For each character the number of its unit, from 0; null for separators."""
    pieces = F.zip_with(F.split(text, UNIT, -1), units(text), lambda gap, unit: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(unit), F.lit(0)).alias("unit")))
    return F.flatten(F.transform(pieces, lambda p, i: F.concat(F.array_repeat(F.lit(None).cast("int"), p["gap"]), F.array_repeat(i, p["unit"]))))


def spans_of(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of a pattern's matches, in characters."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    span = "array<struct<start:int,end:int,match:string>>"
    folded = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("out")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["gap"]) + F.coalesce(F.length(p["hit"]), F.lit(0))).alias("at"),
            F.when(
                p["hit"].isNotNull(),
                F.array_append(s["out"], F.struct((s["at"] + F.length(p["gap"])).alias("start"), (s["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("end"), p["hit"].alias("match"))),
            )
            .otherwise(s["out"])
            .alias("out"),
        ),
    )
    return folded["out"]


def lexicon_hit(text: Column, pattern: str = LEXICON) -> Column:
    return text.rlike(pattern)


def context(text: Column, start: Column, end: Column, width: int = 3) -> Column:
    """prev and next character and ``width`` characters around a hit."""
    sub = lambda a, n: F.substr(text, a.cast("int"), n.cast("int"))
    low = F.greatest(start - width, F.lit(0))
    return F.struct(
        F.when(start > 0, sub(start, F.lit(1))).otherwise("^").alias("prev"),
        F.when(end < F.length(text), sub(end + 1, F.lit(1))).otherwise("$").alias("next"),
        sub(low + 1, end - low + width).alias("around"),
    )


def timecode(seconds: Column, carry: bool = False) -> Column:
    """HH:MM:SS.mmm.  Rounded milliseconds carry into seconds only, unless ``carry``."""
    ms = F.bround(seconds * 1000).cast("long") if carry else None
    if carry:
        whole, milli = F.floor(ms / 1000), ms % 1000
        h, m, s = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    else:
        whole = F.floor(seconds)
        h, m, s0 = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
        milli0 = F.bround((seconds - whole) * 1000).cast("long")
        s, milli = s0 + F.when(milli0 >= 1000, 1).otherwise(0), F.when(milli0 >= 1000, 0).otherwise(milli0)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(two(h), F.lit(":"), two(m), F.lit(":"), two(s), F.lit("."), F.lpad(milli.cast("string"), 3, "0"))


def ass_time(seconds: Column) -> Column:
    """H:MM:SS.cc, below 0 as 0."""
    cs = F.bround(F.greatest(seconds, F.lit(0.0)) * 100).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(F.floor(cs / 360000).cast("string"), F.lit(":"), two(F.floor(cs % 360000 / 6000)), F.lit(":"), two(F.floor(cs % 6000 / 100)), F.lit("."), two(cs % 100))


def highlight(parts: Column, at: Column, on: str = r"{\c&H00FFFF&}", off: str = r"{\r}") -> Column:
    """The pieces joined, with piece ``at`` (from 0) coloured."""
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == at, F.concat(F.lit(on), p, F.lit(off))).otherwise(p)), "")


def suffix(filename: Column) -> Column:
    """A safe file suffix: lower case, letters, digits and dots, ten characters, ``.audio`` if none is left."""
    raw = F.when(F.instr(filename, ".") > 0, F.concat(F.lit("."), F.substring_index(filename, ".", -1))).otherwise("")
    clean = F.substring(F.regexp_replace(F.lower(raw), "[^a-z0-9.]", ""), 1, 10)
    return F.when(F.length(clean) > 1, clean).otherwise(".audio")


def hot_words(text: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(text, "[,，]"), lambda w: F.trim(w)), lambda w: w != ""), ", ")


def unfence(text: Column) -> Column:
    """The JSON inside a fenced block, or the text."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(inner != "", inner).otherwise(F.trim(text))


def json_or_raw(text: Column, schema: str) -> Column:
    """struct<value, raw_response>: what parses, else the text as it came."""
    value = F.from_json(unfence(text), schema)
    parsed = F.when(F.schema_of_json(F.lit("{}")).isNotNull() & F.get_json_object(unfence(text), "$").isNotNull(), value)
    return F.struct(parsed.alias("value"), F.when(parsed.isNull(), text).alias("raw_response"))


def triples(arguments: Column) -> Column:
    return F.from_json(arguments, "struct<triples:array<struct<subject:string,predicate:string,object:string>>>")["triples"]


def timestamp_prompt(parts: Column) -> Column:
    """Words with a pair of time marks after each, for the aligner."""
    return F.array_join(F.transform(parts, lambda w: F.concat(w, F.lit("<timestamp><timestamp>"))), "")


def argmax_bins(logits: Column, bins: int = 5000, step_ms: int = 80) -> Column:
    """Milliseconds of each row's first maximum in a flat (n x bins) array; null if it doesn't divide."""
    n = (F.size(logits) / bins).cast("int")
    row = lambda k: F.slice(logits, k * bins + 1, bins)
    found = F.transform(F.sequence(F.lit(0), n - 1), lambda k: (F.array_position(row(k), F.array_max(row(k))) - 1) * step_ms)
    return F.when((F.size(logits) > 0) & (F.size(logits) % bins == 0), found)


def paired(words: Column, ms: Column, base_s: Column | float = 0.0) -> Column:
    """Each unit with its start and end in seconds; null with fewer than two times a unit."""
    at = lambda k: F.bround(F.get(ms, k) / 1000 + base_s, 3)
    return F.when(F.size(ms) >= 2 * F.size(words), F.transform(words, lambda w, i: F.struct(w.alias("unit"), at(2 * i).alias("start_s"), at(2 * i + 1).alias("end_s"))))


def convert_phrases(text: Column, phrases: dict[str, str], simplified: str = "", traditional: str = "") -> Column:
    """Phrase-level conversion: the longest phrase of the dictionary at each place, else the character's own."""
    quoted = "|".join(re.escape(p) for p in sorted(phrases, key=lambda p: (-len(p), p)))
    known = F.create_map(*[F.lit(x) for pair in sorted(phrases.items()) for x in pair])
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(rf"(?s){quoted}|."), F.lit(0)), lambda p: F.coalesce(F.try_element_at(known, p), to_traditional(p, simplified, traditional))), "")


def to_traditional(text: Column, simplified: str, traditional: str) -> Column:
    """Character-level conversion by a given dictionary."""
    return F.translate(text, simplified, traditional)


def progress(end_cut: Column, total: Column) -> Column:
    return F.bround(F.least(F.max(end_cut) / F.max(total), F.lit(1.0)), 3)


def wrap_pad(n: Column, segment: int) -> Column:
    """Samples to add so that ``n`` becomes a multiple of ``segment``."""
    return F.ceil(n / segment) * segment - n


def named_speaker(speaker_global: Column, speaker: Column) -> Column:
    return F.coalesce(F.nullif(speaker_global, F.lit("")), F.nullif(speaker, F.lit("")), F.lit("UNKNOWN"))


def diarization_row(speakers: Column, confidence: Column) -> Column:
    """One shape for single and overlapped speech."""
    many = F.size(speakers) > 1
    return F.struct(
        F.when(many, "OVERLAP").otherwise("SPEAKER").alias("type"),
        F.when(many, "OVERLAP").otherwise(F.get(speakers, F.lit(0))).alias("speaker"),
        F.when(many, speakers).alias("speakers"),
        F.when(~many, F.bround(F.coalesce(confidence, F.lit(0.0)), 4)).alias("confidence"),
    )
