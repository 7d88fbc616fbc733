"""Sentences within a row: the same rows as the statements, and no shuffle; repeated keys keep the statements' windows."""

import random

import duckdb
import pytest

from inkwell.operators.text import kept_arrays
from inkwell.plans import registry
from inkwell.plans.dialect import SparkDialect

from .llm.helpers import documents

LONG = " ".join(f"Sentence {k} has some words, e.g. Fig. {k} of them." for k in range(300))
TEXTS = ["", None, "No end", "One. Two! Three? Four. Five. Six. Seven.", LONG, "Method name: x is here. Prose follows. Subject area: y. " + LONG, "  Odd\tspace . And vs. Others i.e. These. A (b). " * 9, "lower. case. only."]
NAMES = ["sentence_split", "first_six_sentences", "english_admission", "nonprose_prefix", "sentence_offsets", "boundary_context", "short_included", "old_new_change_flags", "leakage_check", "suspicion_flags", "flag_counts", "first_selected", "exclusion_cascade"]


def rows(spark, name, sf):
    got = registry.QUERIES[name](spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    columns = ", ".join(sorted(got.columns))
    want = con.sql(f"SELECT {columns} FROM ({registry.SQL[name]})").fetchall()
    return sorted(map(tuple, got.select(*sorted(got.columns)).collect()), key=repr), sorted(want, key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_odd_texts(spark, tmp_path, name):
    sf = documents(spark, list(enumerate(TEXTS)), tmp_path)
    mine, sql = rows(spark, name, sf)
    assert mine == sql
    if name not in ("flag_counts", "first_selected", "exclusion_cascade"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "SortMergeJoin" not in plan


def test_repeated_keys_take_the_windows(spark, tmp_path):
    sf = documents(spark, [(1, "A one. B two."), (1, "C three. D four. E five. F six."), (2, None)], tmp_path)
    assert not SparkDialect(sf, spark).by_row("documents", "doc_id")
    mine, sql = rows(spark, "short_included", sf)
    assert mine == sql and len(mine) == 1


def test_beginnings_of_texts_give_the_whole_texts_first_sentences(spark, tmp_path, monkeypatch):
    """Cut anywhere, also within blanks, abbreviations and boundaries."""
    rnd = random.Random(5)
    bits = ["a word", "U.S.", "u.k.", "i.e.g.", "E.G.", "e.g.", "et al.", "No.", "Figs.", "Refs. (", ". ", "! ", "? ", ".\u201d ", ".) ", "A", "B end", "\u201cC", "  ", "\t", "\u00a0", " \u00a0", "\n ", " ,", " .", ": ", "\u00e9\u00df", "\ue000", "\ue001", "\U0001f600", "Method name : x. "]
    texts = ["".join(rnd.choice(bits) + rnd.choice(["", " "]) for _ in range(rnd.randrange(1, 120))) for _ in range(400)]
    sf = documents(spark, list(enumerate(texts)), tmp_path)
    for head in (7, 40, 90):
        monkeypatch.setattr("inkwell.operators.text.HEAD", head)
        for name in ("short_included", "english_admission", "leakage_check"):
            mine, sql = rows(spark, name, sf)
            assert mine == sql and len(mine) > 20
    for name in ("sentence_split", "nonprose_prefix", "sentence_offsets", "clean_text"):
        mine, sql = rows(spark, name, sf)
        assert mine == sql and len(mine) > 5


def test_first_sentences_are_not_sought_in_whole_texts(spark, tmp_path):
    """Six sentences lie at the beginning: what follows costs no more than to be read."""
    d = SparkDialect(documents(spark, [(k, LONG) for k in range(20)], tmp_path), spark)
    kept = spark.sql(f"WITH {kept_arrays(d, first=6)} SELECT doc_id, size(kept) AS n FROM kept").collect()
    assert all(6 <= r.n < 40 for r in kept) and len(kept) == 20
