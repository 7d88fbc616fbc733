from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from inkwell.llm import common, jaccard, substrings

from .helpers import documents


def resident_mb(pid):
    return int(Path(f"/proc/{pid}/statm").read_text().split()[1]) * 4096 / 1e6


def test_release_hands_back_what_the_drivers_jvm_has_freed(spark):
    jvm = spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    native = jvm.io.netty.util.internal.PlatformDependent
    common.release(spark)
    at = [native.allocateMemory(100_000) for _ in range(1500)]
    for a in at:
        native.setMemory(a, 100_000, 1)
    for a in at[:-1]:  # the last one keeps the C library from trimming by itself
        native.freeMemory(a)
    held = resident_mb(pid)
    common.release(spark)
    native.freeMemory(at[-1])
    assert held - resident_mb(pid) > 100


def test_common_buckets_and_id_filters_reach_the_driver_as_packed_rows(spark, tmp_path, monkeypatch):
    """Neither goes through pandas, which costs the driver a copy for each column and its own import."""
    rows = [(k, "the same four words again " + f"w{k} x{k}") for k in range(60)]
    docs = spark.read.parquet(f"{documents(spark, rows, tmp_path)}/documents.parquet")
    monkeypatch.setattr(type(docs), "toPandas", lambda self: 1 / 0)
    buckets, counts = jaccard.common_buckets(docs.coalesce(1), 4)
    assert (buckets.dtype, counts.dtype) == ("int32", "int32") and len(set(buckets.tolist())) == len(buckets) and 60 in counts.tolist()
    bitmap, bits = jaccard.id_filter(spark.range(0, 500, 7).withColumnRenamed("id", "node"))
    h = spark.range(0, 500, 7).selectExpr(f"pmod(xxhash64(id), {bits}) AS h").toArrow()["h"].to_numpy()
    assert ((bitmap[h >> 5] >> (h & 31).astype("uint32")) & 1).all() and sum(int(x).bit_count() for x in bitmap) <= len(h)


def test_release_frees_the_shuffle_files_of_what_is_gone_at_once(spark):
    import time

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: sum("shuffle_" in str(f) for f in disk.getAllFiles().mkString("\n").split("\n"))
    common.release(spark)
    time.sleep(2)
    common.release(spark)
    time.sleep(1)
    before = files()
    for _ in range(3):
        spark.range(1000).repartition(5, "id").groupBy("id").count().collect()
        assert files() > before
        common.release(spark)
        time.sleep(0.5)
        assert files() == before


def test_the_pipeline_lets_go_of_a_stage_before_the_next(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    said = []
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(x, lambda spark, docs, sf, x=x: said.append(x) or docs) for x in "abc"])
    monkeypatch.setattr(corpus_pipeline, "release", lambda spark: said.append("release"), raising=False)
    assert corpus_pipeline.run(spark, documents(spark, [(1, "x")], tmp_path)).count() == 1
    assert said == ["a", "release", "b", "release", "c"]


def test_large_rows_lie_in_small_row_groups_and_batches(spark, tmp_path):
    """A writer, a reader and a worker hold some megabytes of them, however many a task has."""
    df = spark.range(0, 60, 1, 1).selectExpr("id", "array_join(transform(sequence(1, 8192), k -> sha2(concat(id, '-', k), 512)), '') AS body")
    out = common.materialise(df, "large", large_rows=True)
    groups = [g.row_group(k).total_byte_size for f in Path(out._inkwell_path.removeprefix("file:")).glob("*.parquet") for g in [pq.ParquetFile(f).metadata] for k in range(g.num_row_groups)]
    assert len(groups) >= 3 and max(groups) < 3 * common.GROUP_BYTES  # of raw bytes
    sizes = common.arrow_pass(out, lambda: lambda batch: [pa.record_batch({"n": pa.array([batch.nbytes], pa.int64())})], "n long")
    assert max(r.n for r in sizes.collect()) < 1.5 * common.ARROW_BYTES


def test_a_bucket_is_sorted_in_slices(monkeypatch):
    rng = np.random.default_rng(3)
    h, c, least = rng.integers(0, 40, 5000).astype(np.uint64), rng.integers(0, 3, 5000).astype(np.uint64), rng.integers(0, 10**6, 5000)
    c[h < 9] = 1
    sizes, sort = [], np.lexsort
    monkeypatch.setattr(substrings, "SLICE", 600)
    monkeypatch.setattr(substrings.np, "lexsort", lambda keys: sizes.append(len(keys[0])) or sort(keys))
    low, several = substrings.known(h, c, least)
    for k in range(40):
        for x in range(3):
            mine = (h == k) & (c == x)
            if mine.any():
                assert (low[mine] == least[mine].min()).all() and (several[mine] == (k >= 9)).all()
    assert max(sizes) < 1200
