"""The byte network: its arithmetic by hand, held-out accuracy, and texts without a language."""

import zlib

import numpy as np
import pytest

from parlance.llm import language as lg

SF = "/root/testdata/sf0.1"


def test_windows_hold_every_run_of_bytes():
    texts = [b"", b"a", b"B" * 128, bytes(range(97, 123)) * 30, b"x" * 129]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    codes, row, held = lg.windows(data, offsets)
    assert np.bincount(row, minlength=5).tolist() == [0, 1, 1, 7, 2]
    for k, text in enumerate(texts):
        mine = [bytes(c[c < lg.PAD].astype(np.uint8)) for c in codes[row == k]]
        assert [len(m) for m in mine] == held[row == k].tolist()
        runs = {text.lower()[i : i + max(lg.WIDTHS)] for i in range(len(text) - max(lg.WIDTHS) + 1)}
        assert runs == {m[i : i + max(lg.WIDTHS)] for m in mine for i in range(len(m) - max(lg.WIDTHS) + 1)}


def test_pooling_and_gradients_by_hand():
    rng = np.random.default_rng(1)
    net = lg.Network(["x", "y", "z"])
    codes, y = rng.integers(0, 257, (5, lg.WINDOW)).astype(np.int16), np.array([0, 1, 2, 1, 0])
    for b in net.bias:
        b += rng.normal(0, 0.1, b.shape).astype(np.float32)
    plain = [[max(0.0, max(float(net.embedding[c[i : i + w]].reshape(-1) @ f[:, j]) for i in range(lg.WINDOW - w + 1)) + float(b[j])) for w, f, b in zip(lg.WIDTHS, net.filters, net.bias) for j in range(lg.FILTERS)] for c in codes]
    assert np.allclose(net.pooled(codes), plain, atol=1e-4)
    loss = lambda: -np.log(net.probabilities(codes)[np.arange(5), y].astype(float)).mean()
    for p, g in zip(net.parameters(), net.gradients(codes, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, step = p[at], 2e-3
        p[at] = kept + step
        up = loss()
        p[at] = kept - step
        down = loss()
        p[at] = kept
        assert g[at] == pytest.approx((up - down) / (2 * step), rel=0.1, abs=2e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = lg.language_digest(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.99


def test_texts_without_a_language(spark):
    en, de = "the then there this other that and ", "der die das nicht über schön und "
    rows = [(i, (en if i % 2 else de) * (1 + i % 5), "en" if i % 2 else "de", "own") for i in range(120)] + [(5, en, None, "own"), (None, en, "en", "own")]
    odd = {1000: None, 1001: "", 1002: "123 -- 7!", 1003: en * 3000, 1004: (de * 40) + en, 1005: "É", 1006: en.upper()}
    frame = spark.createDataFrame([*rows, *((k, v, "zz", "own") for k, v in odd.items() if k < 1003), *((k, v, None, "own") for k, v in odd.items() if k >= 1003)], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in lg.language_digest(frame).collect()}
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and [got[k].score for k in (1000, 1001, 1002)] == [0.0] * 3
    assert [got[k].lang_pred for k in (1003, 1004, 1006)] == ["en", "de", "en"] and got[1005].lang_pred in ("en", "de") and got[None].lang_pred == "en"
    unlabelled = lg.language_digest(frame.where("lang is null")).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)} and lg.language_digest(frame.limit(0)).collect() == []


def test_a_sample_is_bounded_and_leaves_the_held_out_rows(spark):
    rows = [(i, f"words of document {i}", ["en", "de", "fr"][i % 3], i) for i in range(600)] * 2 + [(3, "another text", "en", 0)]
    got = lg.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string, h long"), per_language=40, languages=2).collect()
    assert len(got) == 80 and len({(r.lang, r.id) for r in got}) == 80 and {r.lang for r in got} <= {"en", "de", "fr"}
    assert all(zlib.crc32(str(r.id).encode()) % 4 != 2 for r in got)
