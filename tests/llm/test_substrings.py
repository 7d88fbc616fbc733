import hashlib
import random

import numpy as np

from inkwell.llm import substrings as s

from .helpers import EDGES, documents


def brute(rows):
    first = {}
    raws = [(k, (t or "").encode()) for k, t in rows]
    for k, raw in raws:
        for p in range(len(raw) - 49):
            w = raw[p : p + 50]
            first[w] = min(first.get(w, k), k)
    out = {}
    for k, raw in raws:
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < k:
                gone[p : p + 50] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if len(raw) else 0
        out[k] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_anchors_agree_with_a_plain_search():
    rng = np.random.default_rng(1)
    for raw in (rng.integers(97, 101, 400).astype(np.uint8), np.full(120, 97, np.uint8), rng.integers(0, 255, 49).astype(np.uint8)):
        at, h = s.anchors(raw)
        full = s.mix64(s.rolling(raw, s.KEY)) if len(raw) >= s.KEY else np.zeros(0)
        want = set()
        for p in range(len(raw) - s.LENGTH + 1):
            part = full[p : p + s.STARTS]
            want |= set((np.flatnonzero(part == part.min()) + p).tolist())
        assert set(at.tolist()) == want


def test_removal_equals_brute_force(spark, tmp_path):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9))) for _ in range(60)]
    passages = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(5, 40))) for _ in range(12)]
    rows = [(k, t) for k, t in EDGES]
    for k in range(60, 130):
        rows.append((k, " ".join(rnd.choice(passages)[rnd.randrange(0, 12) : rnd.randrange(30, 200)] if rnd.random() < 0.5 else " ".join(rnd.choice(words) for _ in range(12)) for _ in range(6))))
    rows += [(200 + k, rows[-1 - k][1]) for k in range(5)] + [(300, "ab" * 400), (301, "x" + "ab" * 100), (302, "a" * 49), (303, "a" * 50), (304, "a" * 51)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.op4_substrings(spark, documents(spark, rows, tmp_path)).collect()}
    want = brute(rows)
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in want.items()}
    assert got == want


def test_no_rows(spark, tmp_path):
    sf = documents(spark, [(1, "x")], tmp_path)
    assert s.remove_repeats(spark.read.parquet(f"{sf}/documents.parquet").limit(0)).count() == 0


def test_string_minima_equal_brute_force_in_little_memory():
    import tracemalloc

    from inkwell.llm.induced import string_minima

    rng = np.random.default_rng(3)
    n = 20_000
    contexts = np.repeat(rng.integers(97, 99, (40, s.CONTEXT)).astype(np.uint8), n // 40, axis=0)
    contexts[:, s.STARTS - 1 : s.LENGTH] = contexts[0, s.STARTS - 1 : s.LENGTH]  # one anchor with many contexts
    hit = rng.random(contexts.shape) < 0.02
    hit[:, s.STARTS - 1 : s.LENGTH] = False
    contexts[hit] = 122
    owners = rng.permutation(n).astype(np.int64)
    tracemalloc.start()
    got = string_minima(contexts, owners, s.LENGTH)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    least = {}
    for k in np.argsort(owners):
        for start in range(s.STARTS):
            least.setdefault((start, contexts[k, start : start + s.LENGTH].tobytes()), owners[k])
    for k in range(0, n, 97):
        assert got[k].tolist() == [least[start, contexts[k, start : start + s.LENGTH].tobytes()] for start in range(s.STARTS)]
    assert peak < 800 * n


def test_packets_are_told_only_what_they_do_not_hold(spark, monkeypatch):
    made = {}
    keep = s.materialise
    monkeypatch.setattr(s, "materialise", lambda df, label: made.setdefault(label, keep(df, label)))
    text = " ".join(f"w{k * 7919 % 1000}" for k in range(1000))
    docs = spark.range(1, 3, 1, 2).selectExpr("id AS doc_id", f"'{text}' AS text")  # two tasks, so two packets
    got = {r.doc_id: r.n_removed for r in s.remove_repeats(docs).collect()}
    assert got == {1: 0, 2: len(text)}
    told = sum(len(r.pairs) // 4 for r in made["substring-answers"].collect())
    assert told == len(s.anchors(np.frombuffer(text.encode(), np.uint8))[0])
