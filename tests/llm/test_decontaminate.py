import random
import time
from itertools import combinations

import numpy as np

from inkwell.llm import decontaminate as d

from .helpers import EDGES, documents


def test_longest_stretch_equals_brute_force():
    rnd = random.Random(2)
    for _ in range(300):
        same = np.array([rnd.random() < 0.75 for _ in range(rnd.randrange(1, 30))])
        best = max((e - s for s in range(len(same)) for e in range(s + 1, len(same) + 1) if same[s:e].mean() >= 0.8 - 1e-12), default=0)
        start, size = d.longest_stretch(same)
        assert size == best and (size == 0 or same[start : start + size].mean() >= 0.8 - 1e-12)


def test_leaks_are_found_and_clean_documents_left_alone(spark, tmp_path):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    item = [word() for _ in range(24)]
    other = [word() for _ in range(400)]
    changed = list(item)
    for k in (3, 9, 15, 20):
        changed[k] = "zzz"
    rows = [
        *EDGES,
        (20, " ".join(other[:50] + item + other[50:90])),
        (21, " ".join(other[100:150]) + " " + ", ".join(changed).upper()),
        (22, " ".join(other[:30] + item[:8] + other[200:230])),
        (23, " ".join(other[:60])),
        (24, "seven short words make this one item"),
        (25, " ".join(other[:50] + item + other[50:90])),
    ]
    sf = documents(spark, rows, tmp_path)
    bench = [(1, " ".join(item)), (2, " ".join(item)), (3, None), (4, ""), (5, "Seven short words make this one item."), (6, "too few"), (None, "x")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r for r in d.op1_decontamination(spark, sf).collect()}
    assert set(got) == {(20, 1), (21, 1), (25, 1), (24, 5)}
    assert got[20, 1].start == 50 and got[20, 1].length == 24 and got[20, 1].copies == 2 and got[21, 1].matched == 20
    docs, benchmark = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    kept = d.clean(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, _ in rows} - {20, 21, 24, 25}
    assert d.overlaps(docs, benchmark.limit(0)).count() == 0 and d.overlaps(docs.limit(0), benchmark).count() == 0


def test_every_accepted_placement_has_a_seed():
    for n, free in [*((n, n // 5) for n in range(d.LEAST, d.OVERLAP)), (13, 2), (15, 3), (20, 4), (25, 5)]:
        masks = [m for length, m in d.masks_for([n]) if length == (n if n < d.OVERLAP else 0)]
        shifts = [0] if n < d.OVERLAP else range(n)
        windows = [sum(1 << at + s for at in m) for m in masks for s in shifts if m[-1] + s < n]
        placed = [sum(1 << at for at in left) for left in combinations(range(n), free)]
        assert not [x for x in placed if all(x & w for w in windows)], n


def test_short_items_with_a_substitution_are_found(spark, tmp_path):
    rows, bench = [], []
    for n in range(d.LEAST, 26):
        item = [f"item{n}word{k}" for k in range(n)]
        bench.append((n, " ".join(item)))
        spots = {15: [(3, 8, 11)], 20: [(8, 9, 10, 11), (8, 9, 10, 13)]}.get(n, list(combinations(range(n), n // 5)) if n < d.OVERLAP else [(0, n - 1)])
        rows += [(100 * n + k, "before " + " ".join("other" if at in spot else w for at, w in enumerate(item)) + " after") for k, spot in enumerate(spots)]
    rows.append((99, "item7word0 other other item7word3 item7word4 item7word5 item7word6"))
    sf = documents(spark, rows, tmp_path)
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert {(r.doc_id, r.item_id) for r in d.op1_decontamination(spark, sf).collect()} == {(k, k // 100) for k, _ in rows if k != 99}


def spelled(text):
    return [w for piece in text.split() if (w := "".join(filter(str.isalnum, piece.lower())))]


def test_words_equal_their_definition():
    rnd = random.Random(6)
    pool = "abcXYZ019.,-_'\x00\x1c \t\n\x85\xa0\u2003\u3000Σσςİıéß«»日😀\u0301\u0307٣²½" + " " * 12
    texts = ["", "  ", "._.", *("".join(rnd.choices(pool, k=rnd.randrange(120))) for _ in range(2000)), *("é" * n + " " + "a" * n for n in range(1, 100)), *(f"x{chr(c)}y" for c in range(0x3100))]
    found, ends = d.word_hashes(texts)
    want = [spelled(t) for t in texts]
    assert np.diff(np.append(0, ends)).tolist() == [len(w) for w in want]
    pairs = set(zip([w for words in want for w in words], found.tolist(), strict=True))
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})
    assert len(d.word_hashes([])[0]) == 0 and sum(([*range(99)][p] for p in d.slices(["x" * d.SLICE, "", "y"] * 33)), []) == [*range(99)]


def test_a_word_is_the_same_with_and_without_punctuation(spark, tmp_path):
    sf = documents(spark, [(1, "one (İzmir) two «İstanbul» three"), (2, "one izmir two three")], tmp_path)
    spark.createDataFrame([(1, "one İzmir two İstanbul three")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert [(r.doc_id, r.matched) for r in d.op1_decontamination(spark, sf).collect()] == [(1, 5)]


def test_hits_are_those_of_each_window_by_itself():
    rnd = random.Random(8)
    texts = [" ".join(rnd.choices("abcdef", k=rnd.choice([0, 3, 9, 12, 40, d.PART + 20]))) for _ in range(30)]
    words, ends = d.word_hashes(texts)
    bitmap = np.zeros(1 << 11, np.uint32)
    held = {k: np.unique(d.seeds(d.ranked(words[:3000], d.MASKS), mask, k))[::9] for k, mask in enumerate(d.MASKS)}
    for h in held.values():
        for k in range(d.PLACES):
            at = d.place(h, 1 << 16, k)
            np.bitwise_or.at(bitmap, at >> 5, np.uint32(1) << (at & 31).astype(np.uint32))
    want = []
    for text, (first, end) in enumerate(zip([0, *ends], ends)):
        for k, mask in enumerate(d.MASKS):
            h = d.seeds([w[first:end] for w in d.ranked(words, d.MASKS)], mask, k)
            assert np.isin(h, held[k]).sum() <= len(passed := d.passing(h, bitmap))
            want += [(text, int(h[at]), int(at)) for at in passed]
    got = [(int(t), int(h), int(at)) for t, h, at in zip(*d.window_hits(words, ends, list(d.MASKS), bitmap))]
    assert len(got) > 1000 and sorted(got) == sorted(want)


def test_a_scan_costs_a_small_multiple_of_splitting():
    rnd = random.Random(7)
    known = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyzäé", k=rnd.randrange(2, 10))) for _ in range(150_000)]
    texts = [" ".join(rnd.choices(known, k=500)) + "." for _ in range(600)]
    bitmap = np.zeros(1 << 16, np.uint32)

    def seconds(work):
        began = time.thread_time()
        work()
        return time.thread_time() - began

    def scan():
        for part in d.slices(texts):
            d.window_hits(*d.word_hashes(texts[part]), list(d.MASKS), bitmap)

    ratio = min(seconds(scan) for _ in range(3)) / min(seconds(lambda: [t.split() for t in texts]) for _ in range(3))
    assert ratio < 7, ratio  # with a dictionary of words and a multiplication for each word of each window: 14 to 18
