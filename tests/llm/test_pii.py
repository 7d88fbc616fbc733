import hashlib
import random
import re

from inkwell.llm import pii

from .helpers import EDGES, documents


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def digest(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


rnd = random.Random(5)
NOISE = [(100 + k, "".join(rnd.choice(["a@b.c", "@", ".", "1", "25", "255", "256", "001", "-", " ", "+", "4111 1111 1111 1111", "é", "😀", "x_%", "(", ")", "\n", "0", "9", "b", "+1 (212) 555-0100", "10.0.0.1"]) for _ in range(rnd.randrange(1, 40)))) for k in range(400)]
FIXED = [
    (50, "a@b.c_foo@bar.com,x@y.z@q.r"),
    (51, "1.2.3.4.5.6.7.8 300.1.1.1 0000255.01.2.3"),
    (52, "4111111111111111 4111-1111-1111-1112 41111111111111111111111 +4111111111111111"),
    (53, "+1 (212) 555-0100 +1((((((( +12345678901234567890 ++49 30 123456"),
    (54, "a" * 60000 + "@" + "b" * 20000), (55, "7" * 40000), (56, "1." * 30000), (57, ("u@" + "d." * 4000)),
]
CONTEXT = [(900 + k, f"contact ref: user{k}@mail.example and more") for k in range(6)] + [(950, "contact ref: zz-77-secret, then"), (951, "note: plain words note: 12 note: 13"), (952, "ref: 10.1.1.1 x")]


def test_base_spans_equal_the_patterns(spark, tmp_path):
    rows = [*EDGES, *FIXED, *NOISE, *CONTEXT]
    got = {r.doc_id: r for r in pii.op8_pii(spark, documents(spark, rows, tmp_path)).collect()}
    assert len(got) == len(rows)
    for key, text in rows:
        want = brute(text or "")
        assert got[key].base_sha256 == hashlib.sha256(digest(want).encode()).hexdigest(), (key, text[:200] if text else text, digest(want), got[key].spans)
        assert [got[key][f"n_{k}"] for k in pii.BASE] == [sum(s[1] == n for s in want) for n in range(4)]
    assert got[950].spans == "context:13:25"
    assert got[951].spans == ""


def test_redact_keeps_rows_and_columns(spark, tmp_path):
    sf = documents(spark, [(1, "é mail a@b.co now 10.0.0.1"), (1, None), (2, "clean"), (3, "")], tmp_path)
    df = spark.read.parquet(f"{sf}/documents.parquet")
    out = pii.redact(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.text is not None) == [(1, "é mail <EMAIL> now <IP>"), (2, "clean"), (3, "")]
    assert out.count() == 4 and pii.redact(df.limit(0)).count() == 0


def test_whole_tokens_after_labels_of_any_length_and_spacing(spark, tmp_path):
    long, label = "zz-77-" + "k9" * 200, "kundenidentifikationsnummerfeld"
    rows = [(k, f"ref: user{k}@mail.example {label}: owner{k}@mail.example") for k in range(9)]
    rows += [(10, f"ref: {long}, then"), (11, f"{label}: aa-11 x"), (12, "ref:" + " " * 9 + "\n\tbb-22 x"), (13, "ref   = cc-33\u2028d x")]
    sf = documents(spark, rows, tmp_path)
    got = {r.doc_id: r.spans for r in pii.op8_pii(spark, sf).collect()}
    assert got[10] == f"context:5:{5 + len(long)}" and got[11] == f"context:{len(label) + 2}:{len(label) + 7}"
    assert got[12] == "context:15:20" and got[13] == "context:8:15"
    out = {r.doc_id: r.text for r in pii.redact(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert out[10] == "ref: <CONTEXT>, then"


def test_tokens_that_differ_late_are_instances_of_their_own(spark, tmp_path):
    head = "q" * 64
    rows = [(k, f"code: user{k}@mail.example") for k in range(6)] + [(10 + k, f"code: {head}{k}") for k in range(6)]
    got = {r.doc_id: r.spans for r in pii.op8_pii(spark, documents(spark, rows, tmp_path)).collect()}
    assert [got[10 + k] for k in range(6)] == [""] * 6


def test_discovered_tokens_make_patterns_known_that_no_seed_has(spark, tmp_path):
    """'reachme' has seeds; the tokens it finds stand after 'badge' too, which then finds one that stands nowhere else."""
    rows = [(k, f"xx reachme user{k}@mail.example yy") for k in range(9)]
    rows += [(20 + k, f"xx reachme id-{k}77 yy") for k in range(3)]
    rows += [(30 + k, f"zz badge id-{k}77 ww") for k in range(3)]
    rows += [(40, "zz badge id-999 ww"), (41, "plain 77-a words"), (42, "plain words"), (43, "plain 77-b words")]
    got = {r.doc_id: r.spans for r in pii.op8_pii(spark, documents(spark, rows, tmp_path)).collect()}
    assert all(got[20 + k] == "context:11:17" and got[30 + k] == "context:9:15" for k in range(3))
    assert got[40] == "context:9:15"
    assert got[41] == got[42] == got[43] == ""


def test_ordinary_words_before_seeds_find_nothing(spark, tmp_path):
    rows = [(k, f"see the user{k}@mail.example and the house, the tree, the {k} birds") for k in range(9)]
    got = [r.spans for r in pii.op8_pii(spark, documents(spark, rows, tmp_path)).collect()]
    assert not any("context" in s for s in got)


def test_redact_keeps_columns_of_any_name(spark):
    rows = [(1, "mail a@b.co " + "x" * 5000 + " 10.0.0.1 end", 1, "u"), (2, None, 2, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _pii_row long, _PII_BASE string")
    out = pii.redact(df)
    assert out.columns == df.columns
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, "mail <EMAIL> " + "x" * 5000 + " <IP> end", 1, "u"), rows[1]]


def test_many_matches_in_one_text(spark):
    n = 20000
    df = spark.createDataFrame([(1, "ref: a1@b.co " * n)], "doc_id long, text string")
    out = pii.redact(df).first().text
    assert out == "ref: <EMAIL> " * n
