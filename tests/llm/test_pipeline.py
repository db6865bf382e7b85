"""The pipeline's stages on a small corpus with planted documents."""

import shutil

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{name}.parquet", folder / f"{name}.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = docs.where("length(text) between 1500 and 4000 and lang = 'en' and doc_id > 500").orderBy("doc_id").limit(3).collect()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    clean = " ".join(f"clean{i} words{i % 7}" for i in range(80))
    planted = [
        (90001, base[0].text + " extra", "en", "src0", 1),
        (90002, base[0].text, "en", "src0", 1),
        (90003, clean.replace("clean", "third") + " " + item, "en", "src1", 1),
        (90004, clean.replace("clean", "other") + " you pathetic worthless idiot moron", "en", "src1", 1),
        (90005, clean, None, None, None),
        (90006, None, "en", "src0", 0),
        (90007, "", "en", "src0", 0),
    ]
    spark.createDataFrame(planted, docs.schema).unionByName(docs).coalesce(4).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def test_stages_filter_what_they_should(spark, corpus):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing_sources", "sharding"]
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, kept = docs.columns, [set(r.doc_id for r in docs.select("doc_id").collect())]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, corpus).cache()
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert kept[-1] <= kept[-2]
        assert k == 4 or docs.columns == columns
    gone = [before - after for before, after in zip(kept, kept[1:])]
    assert 90004 in gone[0] and not {90003, 90005, 90006, 90007} & gone[0]
    assert {90001, 90002} & kept[2] == set()
    assert {90003, 90005, 90006, 90007} & gone[1] == set()
    assert 90003 in gone[2] and 90005 not in gone[2]
    assert not gone[4] and {"shard", "slot"} <= set(docs.columns)
    assert len(kept[3]) * 0.3 < len(kept[4]) < len(kept[3])


def test_run_gives_the_stages_result(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    rows = out.select("doc_id", "shard", "slot").collect()
    assert 0 < len(rows) and len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert {r.shard for r in rows} <= set(range(24))
