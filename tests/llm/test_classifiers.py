import random
import zlib

from inkwell.llm import language, toxicity

from .helpers import EDGES, documents


def fold(key, mod):
    return zlib.crc32(str(key).encode()) % mod


def test_language_of_held_out_documents(spark, tmp_path):
    rnd = random.Random(1)
    parts = {"en": "the and ing er th on".split(), "de": "sch ein ung ich keit ü".split(), "es": "ción ado que ñ la os".split()}
    rows = [(k, t, None) for k, t in EDGES]
    for k in range(100, 700):
        lang = rnd.choice(sorted(parts))
        rows.append((k, " ".join("".join(rnd.choice(parts[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(30)), lang))
    got = {r.doc_id: r for r in language.op9_language(spark, documents(spark, rows, tmp_path)).collect()}
    assert len(got) == len(rows) and all(r.held_out == (fold(k, 4) == 2) and 0 <= r.score <= 1 for k, r in got.items())
    held = [(k, lang) for k, _, lang in rows if lang and fold(k, 4) == 2]
    assert sum(got[k].lang_pred == lang for k, lang in held) >= 0.97 * len(held)
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3
    none = documents(spark, [(k, t, None) for k, t in EDGES], tmp_path / "none")
    assert {r.lang_pred for r in language.op9_language(spark, none).collect()} == {"und"}


def toxic_rows(n=700):
    rnd = random.Random(2)
    words = ["".join(rnd.choice(["an", "re", "ti", "on", "sh", "le"]) for _ in range(rnd.randrange(1, 4))) for _ in range(150)]
    rows, labels = list(EDGES), []
    for k in range(100, 100 + n):
        w = [rnd.choice(words) for _ in range(60)]
        toxic = rnd.random() < 0.25
        if toxic:
            for _ in range(rnd.randrange(1, 4)):
                w.insert(rnd.randrange(60), rnd.choice(["gromple", "zulk", "snarvid" + rnd.choice(["a", "en", "os"])]))
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxicity_of_held_out_documents(spark, tmp_path):
    rows, labels = toxic_rows()
    sf = documents(spark, rows, tmp_path)
    spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.op6_toxicity(spark, sf).collect()}
    assert len(got) == len(rows) and all(r.held_out == (fold(k, 5) == 0) and r.predicted == int(r.score >= 0.5) for k, r in got.items())
    held = [(k, t) for k, _, t in labels if fold(k, 5) == 0]
    assert sum(got[k].predicted == t for k, t in held) >= 0.95 * len(held)
    docs, table = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    kept = toxicity.reject(docs, table)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got.values())
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, table.limit(0)), "score").collect()} == {0.0}


def test_grammar_weighs_clauses():
    s = toxicity.Scorer({"zulk": "H", "snarv-": "M"}, (0.0, 1.0, 1.0))
    plain, targeted = s.matches("it was a zulk thing"), s.matches("you zulk")
    muted, said, threat = s.matches("not a zulk"), s.matches("he said zulk zulk"), s.matches("i will kill you")
    assert targeted[0] > plain[0] > muted[0] and said[0] < plain[0] and threat[0] > plain[0]
    assert s.matches("not. zulk") == plain and s.matches("snarven") and not s.matches("snarv") and s.matches("") == []


def test_every_language_is_learned(spark):
    names = [f"l{k:02}" for k in range(80)] + ["zz"]
    rows = [(1000 + 8 * n + k, f"{chr(0x4E00 + 5 * n) * 6} {chr(0x4E01 + 5 * n) * (k + 1)}", lang) for n, lang in enumerate(names) for k in range(4)]
    rows += [(7, f"{chr(0x4E00) * 5} {chr(0x4E01) * (k % 50 + 1)}", "l00") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.train(docs)
    assert model.languages == names and len(model.landmarks) >= 2 * len(names)
    got = [names[k] for k in model.margins([f"{chr(0x4E00 + 5 * n) * 6}" for n in range(len(names))]).argmax(1)]
    assert sum(a == b for a, b in zip(got, names, strict=True)) >= 0.95 * len(names)
    chosen = language.sample(docs.selectExpr("lang", "xxhash64(doc_id) AS key", "xxhash64(text) AS tie")).groupBy("lang").sum("copies").collect()
    assert {r[0]: r[1] for r in chosen} == {x: 400 if x == "l00" else 4 for x in names}


def test_toxicity_model_does_not_depend_on_the_dealing(spark):
    rows, labels = toxic_rows(300)
    rows += [(k + 5000, t) for k, t in rows[:60]]
    labels = labels + [(k + 5000, q, t) for k, q, t in labels[:60]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one, other = (toxicity.train(docs.repartition(n), marks.repartition(n + 1)) for n in (1, 5))
    assert one == other and one[0]
    assert toxicity.reject(docs.limit(0), marks.limit(0)).count() == 0


def test_reject_keeps_columns_of_any_name(spark):
    rows, labels = toxic_rows(120)
    docs = spark.createDataFrame([(k, t, k * 2.0) for k, t in rows], "doc_id long, text string, _toxicity double")
    kept = toxicity.reject(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns and all(r["_toxicity"] == r.doc_id * 2 for r in kept.collect())
