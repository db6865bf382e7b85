"""What the entropy window sees of a candidate."""

import math
import random
import re
from collections import Counter

import pytest

from parlance.llm import secrets

KEY = "kJ8sQ2vXz91LmPq7RtYw4Bn6"
HIDDEN = [KEY, "-" * 8 + KEY, "AWS_SECRET========" + KEY, "A" * 8 + KEY + "Zx0", "kJhsQgvXzyoLmPqbRtYwdBneUcHi", KEY * 40 + "A" * 12 + KEY]
HARMLESS = [
    "the-very-long-hyphenated-words", "DonaudampfschifffahrtsGesellschaft", "usr/local/share/documentation/index2024", "2024-01-02/2024-01-03-2024-01-04",
    "=" * 60, "A" * 40, "SOME_LONG_CONSTANT_NAME_HERE", "----see-the-appendix----", "word/" * 5000,
]


@pytest.mark.parametrize("texts, found", [(HIDDEN, True), (HARMLESS, False)])
def test_only_whole_candidates_are_passed_over(spark, texts, found):
    frame = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.entropy for r in secrets.find_secrets(frame).collect()}
    assert [t[:40] for i, t in enumerate(texts) if bool(got[i]) != found] == []
    if found:  # the last span reaches the key's end, whatever stands before it
        assert all(got[i][-1].end >= 4 + len(t) - 3 for i, t in enumerate(texts))


def parts_by_hand(candidate):
    """Each part under windows of at least the class's bits a character, every window's entropy from scratch."""
    bits = secrets.HEX_BITS if re.fullmatch("[0-9a-fA-F_=/+-]+", candidate) else secrets.MIXED_BITS
    out = []
    for i in range(len(candidate) - secrets.WINDOW + 1):
        counts = Counter(candidate[i : i + secrets.WINDOW]).values()
        if -sum(n / secrets.WINDOW * math.log2(n / secrets.WINDOW) for n in counts) >= bits:
            if out and i <= out[-1][1]:
                out[-1][1] = i + secrets.WINDOW
            else:
                out.append([i, i + secrets.WINDOW])
    return [tuple(x) for x in out]


def test_entropy_matches_every_window_by_hand(spark, monkeypatch):
    rng = random.Random(7)
    alphabets = ["0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-", "ab1", "AAAAAAAA7x"]
    texts = ["".join("".join(rng.choices(rng.choice(alphabets), k=rng.randint(1, 60))) for _ in range(rng.randint(1, 9))) for _ in range(150)]
    frame = spark.createDataFrame([(i, "é " + t + " .") for i, t in enumerate(texts)], "doc_id long, text string")
    want = {i: [(2 + a, 2 + b) for a, b in parts_by_hand(t)] if len(t) >= 20 and not re.match(secrets.ALLOWED.replace(r"\z", r"\Z"), t) else [] for i, t in enumerate(texts)}
    assert any(len(w) > 1 for w in want.values())
    for stretch in (2048, 7, 21):
        monkeypatch.setattr(secrets, "STRETCH", stretch)
        assert {r.doc_id: [(x.start, x.end) for x in r.entropy] for r in secrets.find_secrets(frame).collect()} == want


def test_very_long_candidates_and_many_matches(spark, monkeypatch):
    texts = [("a-" * 250_000) + "1234567", KEY * 8000, "z" * 1_000_000, "token=abcdef " * 3000]
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].entropy == [] and [(x.start, x.end) for x in got[1].entropy] == [(0, len(texts[1]))] and got[2].entropy == []
    assert [(x.start, x.end) for x in got[3].assign] == [(13 * i, 13 * i + 12) for i in range(3000)]
