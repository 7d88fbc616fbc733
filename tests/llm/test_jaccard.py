import random
import re

import numpy as np

from inkwell.llm import common, jaccard

from .helpers import EDGES, documents


def shingle_set(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if len(w) >= words else {tuple(w)}


def brute(rows, words, percent):
    sets = [(k, shingle_set(t, words)) for k, t in rows]
    root = {k: k for k, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: (len(s), find(k)) for k, s in sets}


def rows_of(seed):
    rnd = random.Random(seed)
    pool = [f"w{k}" for k in range(400)]
    bases = [[rnd.choice(pool) for _ in range(rnd.randrange(20, 120))] for _ in range(8)]
    rows = list(EDGES)
    for k in range(100, 260):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
            at = rnd.randrange(len(w))
            w[at : at + 1] = rnd.choice([[], ["zz%d" % rnd.randrange(9)], [w[at], "extra"]])
        rows.append((k, " ".join(w) + rnd.choice(["", " ", "\n"])))
    return [*rows, (300, "one two"), (301, "ONE  two"), (302, "one two three"), (303, "two one")]


def test_components_equal_brute_force(spark, tmp_path):
    rows = rows_of(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op7_jaccard(spark, documents(spark, rows, tmp_path)).collect()}
    assert got == brute(rows, 4, 85)


def test_keep_one_and_no_rows(spark, tmp_path):
    rows = rows_of(2)[:90]
    docs = spark.read.parquet(f"{documents(spark, rows, tmp_path)}/documents.parquet")
    kept = jaccard.keep_one(docs)
    want = brute(rows, 5, 80)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, (_, c) in want.items() if k == c)
    assert jaccard.join(docs.limit(0)).count() == 0


def test_sketches_lose_no_pair_that_is_alike(spark):
    rng = np.random.default_rng(5)
    rows, want = [], []
    for k in range(300):
        n = int(rng.integers(1, 700))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        cut = int(rng.integers(0, max(1, len(a) // 4) + 1))
        b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 6) + 1)), dtype=np.uint64)]))
        if not len(b):
            continue
        same, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        rows.append((k, jaccard.sketch(a).tolist(), len(a), jaccard.sketch(b).tolist(), len(b)))
        want.append(100 * same >= 85 * union)
    df = spark.createDataFrame(rows, "k long, x array<long>, nx long, y array<long>, ny long")
    got = {r.k: r.ok for r in df.select("k", jaccard.close("x", "nx", "y", "ny", 85).alias("ok")).collect()}
    assert all(got[r[0]] for r, w in zip(rows, want, strict=True) if w) and sum(want) > 50
    assert sum(not ok for ok in got.values()) > 50


def test_hot_group_of_near_copies(spark, tmp_path):
    """Many variants of one text, most of them linked, some only among themselves."""
    rnd = random.Random(9)
    base = [f"b{k}" for k in range(90)]
    rows = []
    for k in range(160):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 4])):
            w[rnd.randrange(len(w))] = f"v{rnd.randrange(12)}"
        rows.append((k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op7_jaccard(spark, documents(spark, rows, tmp_path)).collect()}
    assert got == brute(rows, 4, 85)


def test_keep_one_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e f g", 1, 2, 3, "x"), (2, "a b c d e f g", 4, 5, 6, "y"), (3, "z", 7, 8, 9, "w"), (None, "a b c d e f g", 0, 0, 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long, _h long, _hash long, _node string")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.where("doc_id is not null").collect()) == [rows[0], rows[2]]
    assert kept.where("doc_id is null").count() == 1


def jobs_of(spark, call):
    """How many Spark jobs a call takes where a shuffle has 40 partitions that aren't coalesced, and its result."""
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        before = scheduler.numTotalJobs()
        return call(), scheduler.numTotalJobs() - before
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_bitmaps_take_no_job_for_each_partition(spark):
    rows = [(k, "the same four words again " + " ".join(f"w{k}x{j}" for j in range(9))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    (buckets, counts), jobs = jobs_of(spark, lambda: jaccard.common_buckets(docs, 4))
    assert len(set(buckets.tolist())) == len(buckets) > 0 and 200 in counts.tolist() and jobs < 20
    ids = spark.range(0, 5000, 7).withColumnRenamed("id", "node")
    (bitmap, bits), jobs = jobs_of(spark, lambda: jaccard.id_filter(ids.union(ids)))
    h = spark.range(0, 5000, 7).selectExpr(f"pmod(xxhash64(id), {bits}) AS h").toArrow()["h"].to_numpy()
    assert ((bitmap[h >> 5] >> (h & 31).astype("uint32")) & 1).all() and jobs < 20
    hashes = lambda batch: [np.array([1 << k, 7919 * k + 5], np.uint64) for k in (batch.column("id").to_numpy() % 5).tolist()]
    repeated, jobs = jobs_of(spark, lambda: common.repeated_filter(spark.range(10), hashes, 40, 1 << 16))
    assert common.in_bitmap(repeated, np.array([x for k in range(5) for x in (1 << k, 7919 * k + 5)], np.uint64)).all() and jobs < 20


def test_small_graphs_need_no_rounds_and_both_ways_agree(spark, monkeypatch):
    rnd = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(-5, 900), (900, 7), (3, 3)] + [(rnd.randrange(1000, 1300), rnd.randrange(1000, 1300)) for _ in range(160)] + [(5000, k) for k in range(4000, 4060)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    small, jobs = jobs_of(spark, lambda: sorted(map(tuple, common.components(df, "test").collect())))
    assert jobs < 15
    monkeypatch.setattr(common, "EDGES_AT_ONCE", 0)
    assert small == sorted(map(tuple, common.components(df, "test").collect()))
    low = dict(small)  # a component's smallest node has no row
    assert not {3, -5, 100, 4000} & low.keys() and low[900] == low[7] == -5 and low[160] == 100 and low[5000] == low[4059] == 4000
    assert all(low.get(a, a) == low.get(b, b) <= min(a, b) for a, b in edges if a != b)
    assert common.components(df.limit(0), "test").count() == 0
    monkeypatch.undo()
    assert common.components(df.limit(0), "test").count() == 0
