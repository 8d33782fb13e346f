"""The corpus pipeline: columns, effects of each stage, and the whole run."""

import re

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = {r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert len(seen["language"]) == 200
    texts = [r.text for r in seen["near_dedup"]]
    assert len(texts) == len(set(texts)) and set(texts) == {r.text for r in seen["language"]} - ({r.text for r in seen["language"]} - set(texts))
    clean = {r.doc_id for r in seen["decontaminate"]}
    assert clean == {r.doc_id for r in seen["near_dedup"] if not any(i in r.text for i in items)}
    secret = re.compile(r'token = "[0-9a-f]{40}"', re.I)
    before = {r.doc_id: r.text for r in seen["decontaminate"]}
    for r in seen["secrets"]:
        assert not secret.search(r.text) and r.n_chars == len(r.text)
        assert r.text == before[r.doc_id] or "[SECRET]" in r.text
    assert {p.doc_id for p in seen["pack"]} == clean
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.start, r.length) for r in got.collect())[:1] and {r.doc_id for r in got.select("doc_id").collect()} == clean
