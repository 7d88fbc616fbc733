import json

import pytest
from pyspark.sql import functions as F

from inkwell.operators import scoring
from inkwell.sources import files, sinks
from inkwell.streaming import runs


def test_json_csv_and_raw_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"status": "complete", "rows": [{"pmcid": "P1", "n": 2}, {"pmcid": "P2", "n": 3}]}))
    assert [tuple(r) for r in files.json_rows(spark, str(tmp_path / "a.json"), "rows", "pmcid string, n int").collect()] == [("P1", 2), ("P2", 3)]
    (tmp_path / "t.csv").write_text("k,x\na,1.5\n")
    assert files.csv_table(spark, str(tmp_path / "t.csv"), "k string, x double").first().x == 1.5
    row = files.raw_files(spark, str(tmp_path), ".csv").first()
    assert row.stem == "t" and row.length == 10
    manifest = spark.createDataFrame([("t", 10, row.sha256), ("gone", 1, "x")], "file string, size_bytes long, sha256 string")
    assert [r.file for r in sinks.verify_files(manifest, files.raw_files(spark, str(tmp_path), ".csv")).collect()] == ["gone"]


def test_tokenizer_file(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}}))
    vocab, merges = files.tokenizer_file(spark, str(tmp_path / "t.json"))
    assert vocab.count() == 3 and tuple(merges.first()) == (0, "a", "b")


def test_cursor_search_stops_at_a_repeated_cursor(spark):
    class Pages(files.CursorSearch):
        @staticmethod
        def fetch(cursor):
            return [(f"P{cursor}", "t")], "c1"

        @classmethod
        def name(cls):
            return "two_pages"

    spark.dataSource.register(Pages)
    assert spark.read.format("two_pages").load().count() == 2


def test_retries():
    waits, calls = [], []

    def get():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return b"ok"

    assert files.retried(get, waits.append, lambda e: True, 10) == b"ok" and waits == [1, 2]
    with pytest.raises(ValueError):
        files.retried(lambda: b"long", waits.append, lambda e: True, 3)


def test_write_once_verify_and_resume(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    out = f"file://{tmp_path}/t"
    assert sinks.write_or_verify(df, out) and not sinks.write_or_verify(df.orderBy(F.desc("k")), out)
    with pytest.raises(ValueError):
        sinks.write_or_verify(df.limit(1), out)
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_once(df, out)
    assert [r.k for r in sinks.pending(df, df.where("k = 1"), ["k"]).collect()] == [2]
    assert sinks.lineage(spark, "r", {"t": df}, "complete").first().status == "complete"


def test_scoring(spark):
    rows = spark.createDataFrame([("p1", [1], [1, 2]), ("p2", [1], [3])], "paper string, prompt_ids array<int>, target_ids array<int>")
    scored = scoring.score(rows, scoring.unigram({1: 3, 2: 1}), ["paper"])
    checked = scored.withColumn("target_token_count", F.when(F.col("paper") == "p1", 2).otherwise(5)).select("paper", scoring.valid_score().alias("ok")).collect()
    assert {r.paper: r.ok for r in checked} == {"p1": True, "p2": False}
    assert scoring.score(rows, scoring.unigram({1: 3}), ["paper"], scored.where("paper = 'p1'")).count() == 1
    assert scoring.reusable(scored, scored.limit(1), ["paper"])
    flags = spark.createDataFrame([([1, 9],), ([1, 2, 3],)], "ids array<int>").select(*scoring.generation_flags("ids", [9], 3)).collect()
    assert [r.stop_reason for r in flags] == ["eos", "max_new_tokens"] and flags[1].possibly_truncated


def test_stream_resumes(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    first = events.orderBy("ts").limit(500)
    first.write.parquet(f"{tmp_path}/in")
    counts = lambda: runs.hourly_counts(runs.read_events(spark, f"{tmp_path}/in"))
    runs.run_once(counts(), f"{tmp_path}/out", f"{tmp_path}/state")
    before = spark.read.parquet(f"{tmp_path}/out").count()
    runs.run_once(counts(), f"{tmp_path}/out", f"{tmp_path}/state")
    assert spark.read.parquet(f"{tmp_path}/out").count() >= before
