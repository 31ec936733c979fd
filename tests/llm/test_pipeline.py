import brute
import corpus_pipeline
from starweave.llm.shared import materialize


def test_stages_keep_what_they_should(spark, sf_dir, docs_rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        got[name] = docs
        if name != "packing":
            assert docs.columns == columns
    at = lambda name: [(r.doc_id, r.text) for r in got[name].select("doc_id", "text").collect()]
    clean = at("toxicity")
    keep = {k[4]: k[0] for k in brute.keepers(clean) if k[3]}  # one row for each text, rows that repeat their doc_id too
    assert sorted(i for i, _ in at("exact_dedup")) == sorted(keep.values()) and len(keep) < len(clean)
    distinct = at("exact_dedup")
    assert sorted(i for i, _ in at("jaccard_join")) == sorted(i for i, _, c in brute.links(distinct) if i == c)
    for i, t in at("pii"):
        assert brute.personal(t)[2] == "" or "[" in t
    assert {i for i, _ in at("pii")} == {r.doc_id for r in got["packing"].collect()}
    assert corpus_pipeline.run(spark, sf_dir).count() == got["packing"].count()


def test_empty(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
