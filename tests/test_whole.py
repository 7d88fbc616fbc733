"""Queries over whole tables: rows that a filter or a smaller count would lose."""

import hashlib

import numpy as np

from inkwell.plans import registry

from .llm.helpers import documents


def test_first_difference_of_long_documents(spark, tmp_path):
    long = "word " * 3000
    texts = ["a b c", long + "end", long + "stop", long, "x", "x", "", None, "y"]
    sf = documents(spark, list(enumerate(texts)), tmp_path)
    path = f"{sf}/documents.parquet"
    spark.read.parquet(path).selectExpr("doc_id", "text", "lang", "source", "CASE WHEN doc_id <> 4 THEN n_chars END AS n_chars", "extra").write.parquet(f"{tmp_path}/whole/documents.parquet")
    want = {}
    for k, (a, b) in enumerate(zip(texts, texts[1:])):
        if a is not None and b is not None:
            a, b = a.split(" "), b.split(" ")
            want[k] = next((at for at, (x, y) in enumerate(zip(a, b)) if x != y), None if len(a) == len(b) else min(len(a), len(b)))
    got = {r.doc_id: r.first_difference for r in registry.QUERIES["first_difference"](spark, f"{tmp_path}/whole").collect()}
    assert got == want and got[1] == 3000


def test_hash_bootstrap_draws_as_often_as_the_reference(spark, tmp_path):
    rows = [(paper, line, float(1000 * (7 * paper % 11 + 1) + 137 * line * paper), 2.0, "N") for paper in range(1, 31) for line in range(1, 5)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_extendedprice double, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.batch: r for r in registry.QUERIES["hash_bootstrap"](spark, str(tmp_path)).collect()}
    assert {r.replicates for r in got.values()} == {20000}
    price = {(paper, line): x / 2000 for paper, line, x, _, _ in rows}
    for batch in ("pilot", "holdout"):
        values = np.array([price[p, 2] - price[p, 3] for p in range(1, 31) if (p % 5 == 0) == (batch == "pilot")])
        picks = [[int(hashlib.sha256(f"r{k}:{place}".encode()).hexdigest()[:8], 16) % len(values) for place in range(1, len(values) + 1)] for k in range(1, 20001)]
        low, high = np.percentile(values[np.array(picks)].mean(1), (2.5, 97.5))
        assert abs(got[batch].low - low) < 2e-6 and abs(got[batch].high - high) < 2e-6


def test_malformed_rules_are_found_without_comparing_all_pairs(spark, tmp_path):
    sf = documents(spark, [(k, "alpha beta") for k in range(30)], tmp_path)
    got = registry.QUERIES["merge_parse"](spark, sf)
    assert got.count() > 0 and not got.where("malformed").count()
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_sentences_are_handed_on_by_few_documents(spark, tmp_path, monkeypatch):
    kind = type(spark.range(1))
    sf, seen, run = documents(spark, [(k, "One is here. Two is.") for k in range(500)], tmp_path), [], kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, f, schema: seen.append((df, f)) or run(df, f, schema))
    assert registry.QUERIES["sentence_split_v2"](spark, sf).count() == 1000
    (df, split), = seen
    assert [b.num_rows for b in split(iter(df.coalesce(1).toArrow().combine_chunks().to_batches()))] == [128] * 7 + [104]
