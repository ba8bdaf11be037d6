import pytest
from llm_helpers import prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture
def folder(spark, documents, tmp_path):
    from test_quality_classifier import corpus

    rows, labels = corpus(160)
    passage = prose(900, 100)
    rows += [(500, prose(1, 80)), (501, prose(1, 80)), (502, None), (503, prose(5000, 40) + " " + passage), (504, prose(5001, 50) + " " + passage), (505, prose(700, 30) + " " + prose(8000, 35)), (None, prose(6001, 60))]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(8000, 35)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, labels


def test_stages_take_effect(spark, folder):
    sf, rows, labels = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    after = {}
    for name, apply in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stage(apply(spark, docs, sf), name)
        after[name] = {r.doc_id: r for r in docs.collect()}
        if name != "pieces":
            assert docs.columns == before.columns
    bad = {i for i, q, t in labels if not q or t}
    assert not bad & after["quality_classifier"].keys() and {i for i, _ in rows} - bad - {502} <= after["quality_classifier"].keys()
    assert after["quality_classifier"].keys() - after["near_duplicates"].keys() == {501}
    texts = after["substring_dedup"]
    assert texts.keys() == after["near_duplicates"].keys()
    assert prose(900, 100) not in texts[503].text and texts[503].text.startswith(prose(5000, 40)[:100])
    assert texts.keys() - after["decontamination"].keys() == {505}
    last = after["pieces"]
    assert last.keys() == after["decontamination"].keys()
    assert all(r.decoded == after["decontamination"][i].text for i, r in last.items())


def test_run_equals_its_stages(spark, folder):
    sf, _, _ = folder
    from pathlib import Path

    staged = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), "forumlens")
    before = set(staged.iterdir())
    out = corpus_pipeline.run(spark, sf)
    assert set(out.columns) == {"doc_id", "ids", "decoded"} and out.count() > 40
    assert [p.name.split("-")[0] for p in staged.iterdir() if p not in before] == ["pieces"], "all else is deleted"


def test_empty_documents(spark, folder, documents, tmp_path):
    sf, _, _ = folder
    docs = documents([])
    for _, apply in corpus_pipeline.STAGES:
        docs = apply(spark, docs, sf)
    assert docs.collect() == []
