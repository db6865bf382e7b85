"""The boundary to speech and language models.

A backend is any object with the method named in ``METHODS``; it gets and gives whole
Arrow batches, and is made once for each worker process; a served model gets a row at a
time, and a bounded number of requests is open at once.  Models run in ``mapInPandas``,
which no filter is pushed below, so callers filter first.  The fakes are deterministic,
for tests and dry runs.
"""

from __future__ import annotations

import time
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

METHODS = {
    "transcribe": ("audio", "raw string"),
    "embed": ("audio", "embedding array<float>"),
    "align": ("text", "times array<long>"),
    "identify": ("audio", "speaker string, confidence double"),
    "separate": ("audio", "audio_out binary"),
    "extract": ("audio", "audio_out binary"),
    "describe": ("prompt", "response string"),
    "reason": ("prompt", "arguments string"),
}
UNKNOWN_BELOW = 0.5
#: Answers that a partition of requests hands on at a time.
HANDED_ON = 256


class Fake:
    """Answers that follow from the input's checksum."""

    def transcribe(self, audio: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"raw": [f"[0.00][S0{zlib.crc32(a) % 2 + 1}]heard {len(a)} bytes[1.00]" for a in audio]})

    def embed(self, audio: pd.Series, dim: int = 16) -> pd.DataFrame:
        v = [np.random.default_rng(zlib.crc32(a)).normal(size=dim) for a in audio]
        return pd.DataFrame({"embedding": [(x / np.linalg.norm(x)).astype(np.float32) for x in v]})

    def align(self, text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"times": [[80 * i for i in range(2 * len(t.split()))] for t in text]})

    def identify(self, audio: pd.Series) -> pd.DataFrame:
        sure = [zlib.crc32(a) % 100 / 100 for a in audio]
        return pd.DataFrame({"speaker": [f"P{zlib.crc32(a) % 3}" if c >= UNKNOWN_BELOW else "UNKNOWN" for a, c in zip(audio, sure)], "confidence": sure})

    def separate(self, audio: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"audio_out": audio})

    extract = separate

    def describe(self, prompt: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"response": ['```json\n{"visual": "seen %d"}\n```' % len(p) for p in prompt]})

    def reason(self, prompt: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"arguments": ['{"triples": [{"subject": "%s", "predicate": "has", "object": "length"}]}' % p.split()[0] if p.split() else '{"triples": []}' for p in prompt]})


def with_retries(call: Callable, tries: int = 3, wait_s: Callable[[int], float] = lambda n: 3.0 * n, sleep: Callable = time.sleep) -> Callable:
    """``call`` tried again after a failure, waiting longer each time; the last failure is raised."""

    def tried(*args):
        for n in range(1, tries + 1):
            try:
                return call(*args)
            except Exception:
                if n == tries:
                    raise
                sleep(wait_s(n))

    return tried


_made: dict = {}


def _model(backend: Callable, method: str, tries: int) -> Callable:
    return with_retries(getattr(_made.setdefault(backend, backend()), method), tries)


def apply(rows: DataFrame, method: str, backend: Callable = Fake, tries: int = 3) -> DataFrame:
    """``rows`` with a model's answer columns, a batch at a time: for models that run where the rows are."""
    column, answer = METHODS[method]
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = _model(backend, method, tries)
        for pdf in batches:
            out = ask(pdf[column]).reset_index(drop=True)
            yield pd.concat([pdf[names].reset_index(drop=True), out], axis=1)

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", " + answer
    return rows.mapInPandas(run, schema)


def in_order(items: Iterator, ask: Callable, at_once: int) -> Iterator[tuple]:
    """(item, answer) in the order of the items, with at most ``at_once`` calls open and answers waiting."""
    with ThreadPoolExecutor(at_once) as pool:
        waiting: deque = deque()
        for item in items:
            if len(waiting) == at_once:
                first, answer = waiting.popleft()
                yield first, answer.result()
            waiting.append((item, pool.submit(ask, item)))
        for first, answer in waiting:
            yield first, answer.result()


def requests(rows: DataFrame, method: str, backend: Callable = Fake, limit: int = 16, at_once: int = 4, tries: int = 3) -> DataFrame:
    """``rows`` with a served model's answers, a request for each row, of which at most ``limit`` are open in the whole cluster.

    Rows are dealt evenly to ``limit // at_once`` partitions, each of which keeps a sliding
    window of ``at_once`` requests and hands answers on some hundred at a time; whatever computes the rows runs as wide as before, as
    the dealing is a shuffle.  A limit of 1 is one request at a time.  Answers stay
    with their rows, in order.  A lost executor's
    partition is asked again; tasks must not run speculatively where the limit is strict.
    """
    if not 1 <= at_once <= limit:
        raise ValueError("at least one request at a time, and no more than the limit")
    column, answer = METHODS[method]
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = _model(backend, method, tries)
        parts = (pdf.iloc[low : low + HANDED_ON].reset_index(drop=True) for pdf in batches for low in range(0, len(pdf), HANDED_ON))
        each = ((part, i) for part in parts for i in range(len(part)))
        outs: list[pd.DataFrame] = []
        # the window goes on over the parts' ends
        for (part, i), out in in_order(each, lambda x: ask(x[0][column].iloc[x[1] : x[1] + 1].reset_index(drop=True)), at_once):
            outs.append(out)
            if i == len(part) - 1:
                yield pd.concat([part[names], pd.concat(outs, ignore_index=True)], axis=1)
                outs = []

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", " + answer
    return rows.repartition(limit // at_once).mapInPandas(run, schema)
