import numpy as np
from pyspark.sql import functions as F

from inkwell.llm import neighbours


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16)) * rng.uniform(0.5, 2, (900, 1))
    x[300:420] = x[300]
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [float("inf")] * 16), (2004, [None] + [1.0] * 15), (None, [1.0] * 16), (2020, [1.0, 2.0]), (2021, [2.0, 1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {*range(0, 900, 20), 2020}
    assert got[2020] == [(1, 2021, 4.0)]
    hit = 0
    for q in range(0, 900, 20):
        s = x @ x[q]
        want = sorted((-s[k], k) for k in range(900) if k != q)[:20]
        assert [r for r, _, _ in got[q]] == list(range(1, 21))
        assert all(abs(score - s[v]) < 1e-9 for _, v, score in got[q])
        assert [(-b, v) for _, v, b in got[q]] == sorted((-b, v) for _, v, b in got[q])
        hit += len({v for _, v, _ in got[q]} & {k for _, k in want})
    assert hit >= 0.95 * 45 * 20
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_ties_between_different_vectors_go_by_vec_id(spark):
    rows = [(0, [1.0] * 8)] + [(k, [1.0 if at in (k % 8, (k % 8 + k // 8 + 1) % 8) else 0.0 for at in range(8)]) for k in range(1, 49)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r.vec_id for r in neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    score = {k: sum(v) for k, v in rows}
    assert got == sorted(range(1, 49), key=lambda k: (-score[k], k))[:20]


def test_recall_on_isotropic_vectors_of_unequal_norms(monkeypatch, spark):
    monkeypatch.setattr(neighbours, "SHARD", 1000)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2700, 64)) * rng.uniform(0.5, 2, (2700, 1))
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<double>")
    found = {(r.query_id, r.vec_id) for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()}
    score = x[::20] @ x.T
    score[np.arange(135), np.arange(0, 2700, 20)] = -np.inf
    want = {(20 * q, int(v)) for q, row in enumerate(np.argsort(-score, 1)[:, :20]) for v in row}
    assert len(found & want) >= 0.95 * len(want)
