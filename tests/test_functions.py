import copy
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from inkwell.functions.blocks import Walker
from inkwell.functions.segment import REF_CLOSE, REF_OPEN, plain, segment
from inkwell.functions.statistics import bounded_stream, limbs, resampled_means, seeded_permutation
from inkwell.operators.documents import Rules, encode_word
from inkwell.operators.records import tokenizer_invariants
from inkwell.operators.text import nonprose_prefix
from inkwell.plans.dialect import SparkDialect


def split(text):
    return [plain(text[a:b]) for a, b in segment(text).spans]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("As F. Krammer said. Next one.", ["As F. Krammer said.", "Next one."]),
        ("In St. Louis it rained. Then p. 12 says 3.14 is fine.", ["In St. Louis it rained.", "Then p. 12 says 3.14 is fine."]),
        ("It ended.[1–3] Next began.", ["It ended.[1–3]", "Next began."]),
        ("It ended.1–3 Next began.", ["It ended.1–3", "Next began."]),
        ("We used it. fNIRS is good.", ["We used it.", "fNIRS is good."]),
        ("Smith et al. found it. Good.", ["Smith et al. found it.", "Good."]),
        (f"Done.{REF_OPEN}4{REF_CLOSE} More.", ["Done.4", "More."]),
        ("", []),
    ],
)
def test_segments(text, want):
    assert split(text) == want


def test_segment_flags():
    assert segment("It went on. but lower case.").flags == ["possible_lowercase_sentence_start"]


def test_blocks_leave_out_containers():
    html = "<html><body><nav><p>no</p></nav><p>one <sup>2</sup> two</p><div class='x ad'><p>no</p></div><p>three<p>four</body>"
    assert [b["text"] for b in Walker(1).blocks(html)] == ["one 2 two", "three", "four"]
    assert [b["xpath"] for b in Walker(1).blocks(html)] == ["/html[1]/body[1]/p[1]", "/html[1]/body[1]/p[2]", "/html[1]/body[1]/p[2]/p[1]"]


def test_encode_word():
    ranks = {("a", "a"): 0, ("aa", "a"): 1, ("b", "c"): 2}
    assert encode_word("aaaa", ranks) == ["aa", "aa"]
    assert encode_word("aaabcx", ranks) == ["aaa", "bc", "x"]
    assert encode_word("a", ranks) == ["a"]


@pytest.mark.parametrize("n", [1, 2, 3, 12, 120, 65537])
def test_bounded_stream_is_pythons(n):
    ours, theirs = bounded_stream(7, n), random.Random(7)
    got = np.concatenate([next(ours), next(ours)])[:3000].tolist()
    assert got == [theirs.randrange(n) for _ in got]


def test_resampled_means_follow_the_stream():
    draw, stream = random.Random(3), random.Random(5)
    values = [draw.gauss(0, 1) for _ in range(50)]
    want = [math.fsum(values[stream.randrange(50)] for _ in range(50)) / 50 for _ in range(200)]
    assert resampled_means(np.array(values), 5, 200).tolist() == want
    assert sorted(seeded_permutation(10, 42)) == list(range(10)) and seeded_permutation(10, 42) == seeded_permutation(10, 42)


def test_tokenizers_that_differ_in_merges_only():
    left = {"added_tokens": [], "decoder": {"type": "x"}, "model": {"vocab": {"a": 0}, "merges": [["a", "b"]]}}
    right = copy.deepcopy(left)
    right["model"]["merges"] = []
    assert all(tokenizer_invariants(left, right).values())
    right["decoder"]["type"] = "y"
    assert [k for k, ok in tokenizer_invariants(left, right).items() if not ok] == ["decoder", "all_but_merges"]


def test_metadata_before_and_after_prose(spark, tmp_path):
    text = "Specifications Table of it all is here. Graphical abstract follows now. This is prose. Method name: other words. More prose."
    spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "In all. The end.", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in spark.sql(nonprose_prefix(SparkDialect(str(tmp_path), spark))).collect()}
    assert got == {(1, 1, "omitted_before_narrative"), (1, 2, "omitted_before_narrative"), (1, 4, "metadata_after_narrative_start")}


@pytest.mark.parametrize("n", [1, 2, 7, 3000])
def test_resampled_means_are_correctly_rounded(n):
    draw, stream = random.Random(n), random.Random(11)
    values = [draw.choice([0.0, 1e-17, -1.5, 3e5, draw.gauss(0, 1), draw.gauss(0, 1e-12)]) for _ in range(n)]
    times = 2 + 600_000 // n % 400
    want = [math.fsum(values[stream.randrange(n)] for _ in range(n)) / n for _ in range(times)]
    assert resampled_means(np.array(values), 11, times).tolist() == want


def test_limbs_add_up_exactly():
    values = np.array([random.Random(k).gauss(0, 10.0 ** (k % 7 - 3)) for k in range(2000)])
    parts = limbs(values, 2000)
    assert (sum(parts[::-1]) == values).all() and math.fsum(p.sum() for p in parts) == math.fsum(values)


def test_rules_as_arrays_rank_like_dicts():
    rows = [("a", "b", 5, 2, False), ("ab", "c", 1, 4, True), ("b", "c", 0, 0, False), ("zz", "zzzzz", 2, 1, False)]
    made = Rules.of(pa.table({"rule": [f"{l} {r}" for l, r, *_ in rows], "rank_c": [x[2] for x in rows], "rank_d": [x[3] for x in rows], "is_added": [x[4] for x in rows]}))
    for arm, at, whole in (("A", 2, False), ("C", 2, True), ("D", 3, True), ("E", 3, False)):
        plain = {(x[0], x[1]): x[at] for x in rows if whole or not x[4]}
        for word in ("abc", "bcab", "zzzzzzz", "q", "abcabcabcabcabcabc"):
            assert encode_word(word, made.arm(arm)) == encode_word(word, plain)
    assert not hasattr(made, "__dict__") or sum(x.nbytes for x in vars(made).values()) == 17 * len(rows)
