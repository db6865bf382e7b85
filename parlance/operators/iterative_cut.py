"""Iterative cutting of a long recording, as a fold over its planned parts.

Each part starts a little before the last cut; its transcript decides the next cut.
The state is (cut, part number), so recordings run side by side, but the parts of one
recording are a sequence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Fixed values, in milliseconds.
NOMINAL, MARGIN, GUARD, HEAD_TOLERANCE, DONE = 1_440_000, 2000, 300, 50, 1000

Segment = tuple[int, int, str, str]
OUT = "part int, start_abs_ms long, duration_ms long, status string, end_cut_abs_ms long, n_segments int, n_dropped_head int, n_dropped_tail int, kept array<struct<start_ms:long,end_ms:long,speaker:string,text:string>>"


def plan(total: int, transcribe: Callable[[int, int], list[Segment]], nominal: int = NOMINAL, cut: int = 0, part: int = 0) -> Iterator[dict]:
    """One row for each part until the recording ends.  ``transcribe`` gives part-relative segments."""
    while cut < total - DONE:
        start = max(cut - GUARD, 0) if part else cut
        nominal_end = min(cut + nominal, total)
        final, duration = nominal_end >= total - DONE, nominal_end - start
        segments = sorted(transcribe(start, nominal_end), key=lambda s: s[0])
        kept = [s for s in segments if not part or start + s[1] > cut + HEAD_TOLERANCE]
        head, tail, next_cut = len(segments) - len(kept), 0, nominal_end
        anchor = next((s for s in reversed(kept[:-1]) if s[1] <= duration - MARGIN), None)
        if not segments:
            status = "final-empty" if final else "empty-advance"
        elif not kept:
            status = "empty-advance"
        elif final:
            status = "final"
        elif anchor is not None:
            status, next_cut = "ok", start + anchor[1]
            stay = [s for s in kept if start + s[1] <= next_cut]
            tail, kept = len(kept) - len(stay), stay
        else:
            status = "fallback-blind-cut"
        yield {
            "part": part, "start_abs_ms": start, "duration_ms": duration, "status": status, "end_cut_abs_ms": next_cut, "n_segments": len(segments),
            "n_dropped_head": head, "n_dropped_tail": tail, "kept": [{"start_ms": start + a, "end_ms": start + b, "speaker": w, "text": t} for a, b, w, t in kept],
        }
        if status in ("final", "final-empty") or next_cut <= cut:
            return
        cut, part = next_cut, part + 1


def iterative_cut(speech: DataFrame, key: str, nominal: int = NOMINAL) -> DataFrame:
    """Cut recordings whose speech is known in absolute times (start_ms, end_ms, speaker, text, total_ms).

    Stands in for a recogniser: a part hears the segments that lie in it, the last one
    clipped at its end.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_ms", "end_ms", "text"])
        rows = list(zip(pdf["start_ms"].tolist(), pdf["end_ms"].tolist(), pdf["speaker"].tolist(), pdf["text"].tolist()))
        hear = lambda a, b: [(max(s, a) - a, min(e, b) - a, w, t) for s, e, w, t in rows if s < b and e > a]
        out = pd.DataFrame(plan(int(pdf["total_ms"].iloc[0]), hear, nominal))
        out.insert(0, key, pdf[key].iloc[0])
        return out

    return speech.groupBy(key).applyInPandas(fold, f"{key} {dict(speech.dtypes)[key]}, {OUT}")
