import pytest

from .helpers import SCHEMA, documents
from .test_classifiers import toxic_rows

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_each_stage_takes_effect(spark, tmp_path):
    rows, labels = toxic_rows(400)
    clean = [k for k, _, t in labels if not t][:6]
    by = dict(rows)
    item = " ".join(f"bench{k}" for k in range(20))
    extra = [(900, by[clean[0]]), (901, by[clean[1]] + " " + item), (902, "mail me at some.one@mail.example please " + " ".join(f"solo{k}" for k in range(30)))]
    sf = documents(spark, rows + extra, tmp_path)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    toxic = {k for k, _, t in labels if t}
    assert len(toxic & set(seen["toxicity"])) <= 0.1 * len(toxic)
    assert not set(clean) - set(seen["toxicity"])
    assert 900 in seen["toxicity"] and 900 not in seen["jaccard"] and clean[0] in seen["jaccard"]
    assert 901 in seen["jaccard"] and 901 not in seen["decontamination"]
    assert "<EMAIL>" in seen["pii"][902].text and seen["pii"][902].n_chars == len(seen["pii"][902].text)
    assert set(seen["tokens"]) == set(seen["pii"]) == set(seen["decontamination"])
    assert all(r.n_tokens == len(r.ids) for r in seen["tokens"].values())


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() == 0
