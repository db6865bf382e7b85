"""What the near-duplicate stage and the pipeline leave on disk."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parlance.llm import ngram_join, toxicity


@pytest.mark.parametrize("ids", [[], [7], [-(2**63), -3, -3, 0, 5, 5, 5, 70_000, 2**63 - 1], list(range(0, 3000, 7))])
def test_leaders_are_packed_exactly(ids):
    ids = np.array(ids, np.int64)
    packed = ngram_join.pack_leaders(ids)
    assert ngram_join.unpack_leaders(packed).tolist() == ids.tolist()
    assert len(ids) < 100 or len(packed) < 3 * len(ids)


def test_copies_deal_no_parts_and_rows_are_not_shuffled(spark, monkeypatch):
    texts = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(5)]
    rows = [(100 * c + k, t) for c in range(12) for k, t in enumerate(texts)] + [(None, texts[0]), (9000, ""), (9001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    dealt, real = [], ngram_join.cut

    def cut(df):
        out = real(df)
        if "parts" in out.columns:
            dealt.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "cut", cut)
    kept = ngram_join.keep_one(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, k) for k in (*range(5), 9000, 9001)] + [(True, 0)]
    assert dealt == [0]
    # the way without a join on whole rows: bit maps are broadcast
    assert plan.count("BroadcastExchange") >= 2


def test_rows_that_both_bit_maps_mean_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FILTER_BITS", 1 << 3)
    texts = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(20)]
    docs = spark.createDataFrame([(50 * c + k, t) for c in range(3) for k, t in enumerate(texts)] + [(None, texts[0]), (900, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs).where("doc_id is not null").collect()) == [*range(20), 900]
    assert docs.where("doc_id is null").count() == ngram_join.keep_one(docs).where("doc_id is null").count() == 1


def test_a_stage_leaves_only_its_table(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda s: real(s) and str(tmp_path))
    from parlance.llm.runtime import shared_dir as real

    def stage(s, docs, sf_dir):
        return docs.checkpoint().where(F.lit(True))

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage)])
    before = real(spark) and spark.sparkContext._jsc.sc().getCheckpointDir().get().rsplit("/", 1)[0]
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    assert got == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    (folder,) = tmp_path.iterdir()
    assert os.listdir(folder) == ["1-two"]
    assert spark.sparkContext._jsc.sc().getCheckpointDir().get().rsplit("/", 1)[0] == before


def test_kernels_are_written_out_in_bounded_slices(monkeypatch):
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(1, 27, n).tolist()) for n in [*rng.integers(1, 12, 60), 300, 400]]
    y = np.arange(len(words)) % 2 == 0
    want, sizes, real = toxicity._machine(words, y, words[:40]), [], np.add.at
    monkeypatch.setattr(toxicity, "ENTRIES", 500)

    class Add:
        @staticmethod
        def at(out, where, values):
            sizes.append(len(where))
            real(out, where, values)

    monkeypatch.setattr(toxicity.np, "add", Add)
    table, bias = toxicity._machine(words, y, words[:40])
    monkeypatch.undo()
    # the last one fills the table from the landmarks
    assert len(sizes) > 10 and max(sizes[:-1]) <= 500 + 40 * 40
    assert np.array_equal(table, want[0]) and bias == want[1]
