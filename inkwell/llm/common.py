"""What the operators of this subpackage share: inputs, the shared work folder, Arrow passes, components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that one Arrow batch holds at most, and bytes at which it ends; texts are long, so batches are short.
ARROW_ROWS, ARROW_BYTES = 256, 8 << 20
#: A row group of large rows: compressed bytes at which it ends, and rows at most.
GROUP_BYTES, GROUP_ROWS = 8 << 20, 64
#: Edges up to which one task finds the components of a graph (16 bytes each); larger graphs go through rounds of joins.
EDGES_AT_ONCE = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Only a session whose one machine is the driver's may leave it unset: it then works under the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def unused(columns: Iterable[str], name: str) -> str:
    """A column name like this one that none of the columns has, in either case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialise(df: DataFrame, label: str, large_rows: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there, and a lost executor costs no recomputation.

    Large rows: of megabytes each. Parquet would look at the size of a row group after 100 rows only, and hold that many of
    them at a time in its writer and in its reader; it looks after each row then, and groups are small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkwell/{label}-{uuid.uuid4().hex}"
    groups = {"parquet.block.size": str(GROUP_BYTES), "parquet.block.row.count.limit": str(GROUP_ROWS), "parquet.page.size.row.check.min": "1"} if large_rows else {}
    df.write.option("compression", "zstd").options(**groups).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._inkwell_path = path
    return out


def materialise_large(df: DataFrame, label: str) -> DataFrame:
    """materialise() of large rows."""
    return materialise(df, label, large_rows=True)


def discard(df: DataFrame) -> None:
    """Deletes what materialise() wrote, once nothing lazy reads it any more."""
    path = getattr(df, "_inkwell_path", None)
    if path:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that nothing refers to any more, which it does when the driver collects its garbage; then the driver hands freed memory back to the system."""
    for _ in range(2):  # the files of the last query go with the second collection
        gc.collect()
        detach(spark)
        spark._jvm.System.gc()
    trim_native(spark)
    give_back()


def detach(spark: SparkSession) -> None:
    """Lets go of the JVM objects whose Python ones are gone. Py4J does so in a thread that looks once a second, too late for the garbage collection that follows."""
    queue = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    while queue:
        try:
            task = queue.pop()
        except IndexError:
            break
        if not isinstance(task, tuple):  # the thread's order to end
            queue.append(task)
            break
        client, target = task
        client.garbage_collect_object(target, False)


def trim_native(spark: SparkSession) -> str | None:
    """malloc_trim in the driver's JVM, as the diagnostic command System.trim_native_heap: planning and compiling hundreds of stages frees memory that the C library keeps otherwise. None where the JVM has no such command."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    of, text = jvm.java.lang.Class.forName, jvm.java.lang.String
    try:
        types, given = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
        for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[k] = of(name)
        for k, value in enumerate((jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", new(jvm.java.lang.Object, 0), new(text, 0))):
            given[k] = value
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return of("javax.management.MBeanServerConnection").getMethod("invoke", types).invoke(server, given)
    except Py4JError:
        return None


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of ARROW_ROWS rows at most, which end at ARROW_BYTES, so that long texts fit in a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


#: What a worker process remembers from task to task, and the keys of it that its present task has asked for.
_REMEMBERED: dict[Hashable, Any] = {}
_ASKED: set[Hashable] = set()


def remembered(key: Hashable, make: Callable[[], Any]) -> Any:
    """make()'s result, made once for each worker process; to be asked for in an arrow_pass's make. It lasts until a task doesn't ask for it."""
    _ASKED.add(key)
    if key not in _REMEMBERED:
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


def begin(make: Callable[[], Any]) -> Any:
    """make()'s result; what it didn't ask for isn't remembered any longer. A function of the module, so that workers use their own memory and no copy of the driver's."""
    _ASKED.clear()
    one = make()
    for key in _REMEMBERED.keys() - _ASKED:
        del _REMEMBERED[key]
    return one


def give_back() -> None:
    """Hands memory that this process has freed back to the system, where the C library can: a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_pass(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with state made once for each task: make() returns the function of one batch, which may have a finish() of its own.

    Workers serve the tasks of many operators: what earlier ones remembered goes when a task begins that doesn't ask for
    it, and a task's own memory is handed back when it ends.
    """
    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = begin(make)
        for batch in batches:
            if batch.num_rows:
                yield from one(batch)
        finish = getattr(one, "finish", None)
        if finish is not None:
            yield from finish()
        del one, finish
        give_back()

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings; null is empty."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values, the same on every machine."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ordered(spans: F.Column) -> F.Column:
    """Spans (start, stop, kind) by start, then by kind as listed."""
    way = lambda x, y: F.when(x < y, -1).when(x > y, 1)
    return F.array_sort(spans, lambda a, b: F.coalesce(way(a.start, b.start), way(a.kind, b.kind), way(a.stop, b.stop), F.lit(0)))


def written(spans: F.Column | str, kinds: tuple[str, ...]) -> F.Column:
    """kind:start:stop of each span, joined by commas."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.stop.cast("string"))), ",")


def components(edges: DataFrame, label: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of the edges (a, b) but a component's smallest: component is the smallest node that links reach.

    Alternating large-star and small-star rounds. Each round reads and writes the edge list once, in the shared
    folder; a node's partners are only ever reduced to their minimum, so a hot node needs no list in one task. A graph of
    EDGES_AT_ONCE edges at most needs no rounds, whose many short tasks cost more than its work.
    """
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    cur = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-edges")
    before = mark(cur)
    if before[0] <= EDGES_AT_ONCE:
        out = materialise(arrow_pass(cur.coalesce(1), at_once, "node long, component long"), f"{label}-solved")
        discard(cur)
        return out
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cur.join(least.select(F.col("a").alias("b"), F.col("m").alias("mb")), "b").select("a", F.col("mb").alias("b"))
        # each edge (a > b) becomes (a, min around b); then each node points at the least of all it knows
        known = large.where("a <> b").union(least.where("a <> m").select("a", F.col("m").alias("b")))
        low = known.groupBy("a").agg(F.min("b").alias("m"))
        small = known.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        nxt = materialise(small, f"{label}-edges")
        after = mark(nxt)
        discard(cur)
        cur = nxt
        if before == after:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return cur.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")


def at_once():
    """The make of an arrow_pass over all edges (a, b) of a graph in one task: node and component of each node but the smallest of its component."""
    schema = pa.schema([("node", pa.int64()), ("component", pa.int64())])
    held: list[np.ndarray] = []

    def one(batch):
        held.append(np.stack([batch.column("a").to_numpy(), batch.column("b").to_numpy()]))
        return ()

    def finish():
        if held:
            nodes, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
            x, y = at.reshape(2, -1)
            root = np.arange(len(nodes))
            while (differ := root[x] != root[y]).any():
                p, q = root[x[differ]], root[y[differ]]
                np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
                while ((up := root[root]) != root).any():
                    root = up
            low = np.flatnonzero(root != np.arange(len(nodes)))
            yield record(schema, node=nodes[low], component=nodes[root[low]])

    one.finish = finish
    return one


def by_bucket(h: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """The buckets that hashes fall into, each with their places."""
    b = ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    found, first = np.unique(b[order], return_index=True)
    return [(int(k), part) for k, part in zip(found, np.split(order, first[1:]), strict=True)] if len(h) else []


def in_bitmap(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & np.uint64(len(bitmap) * 32 - 1)).astype(np.int64)
    return ((bitmap[at >> 5] >> (at & 31).astype(np.uint32)) & 1).astype(bool)


def repeated_filter(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterable[np.ndarray]], buckets: int, n_bits: int) -> np.ndarray:
    """A bitmap of n_bits (a power of two) of the hashes that several rows hold; hashes() gives each row's, once each.

    A task sends each hash once with a mark whether several of its rows hold it, so a hot hash costs an entry a task.
    """
    sent = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("several", pa.binary())])

    def make():
        held: list[np.ndarray] = []
        size = [0]

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            size[0] = 0
            for b, part in by_bucket(h, buckets):
                yield record(sent, bucket=[b], hashes=[h[part].tobytes()], several=[np.packbits(n[part] > 1).tobytes()])

        def one(batch):
            for h in hashes(batch):
                held.append(h)
                size[0] += len(h)
            if size[0] >= 2_000_000:
                yield from flush()

        def finish():
            if size[0]:
                yield from flush()

        one.finish = finish
        return one

    marked = pa.schema([("word", pa.int32()), ("bits", pa.int64())])
    parts = arrow_pass(df, make, "bucket int, hashes binary, several binary")

    def reduce(group: pa.Table) -> pa.Table:
        cols = group.to_pydict()
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in cols["hashes"]])
        s = np.concatenate([np.unpackbits(np.frombuffer(y, np.uint8), count=len(x) // 8) for x, y in zip(cols["hashes"], cols["several"], strict=True)])
        order = np.argsort(h, kind="stable")
        h, s = h[order], s[order].astype(bool)
        same = np.concatenate([h[1:] == h[:-1], [False]])
        at = (np.unique(h[s | same]) & np.uint64(n_bits - 1)).astype(np.int64)
        words, where = np.unique(at >> 5, return_inverse=True)
        bits = np.zeros(len(words), np.uint32)
        np.bitwise_or.at(bits, where, np.uint32(1) << (at & 31).astype(np.uint32))
        return pa.Table.from_batches([record(marked, word=words.astype(np.int32), bits=bits.astype(np.int64))])

    words = parts.groupBy("bucket").applyInArrow(reduce, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return bitmap_of(words, n_bits)


def bitmap_of(words: DataFrame, n_bits: int) -> np.ndarray:
    """The bitmap of n_bits whose words (word, bits) are these, once each; 0 elsewhere."""
    out = np.zeros(n_bits // 32, np.uint32)
    for word, bits in packed_words(words):
        out[word] = bits.view(np.uint32)
    return out


def packed_words(words: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word, bits), 32-bit integers, in the driver; as one packed row for each partition, all of them by one job. A job for each partition in turn would cost a fixed time each, which more machines do not shorten."""
    schema = pa.schema([("words", pa.binary()), ("bits", pa.binary())])

    def make():
        w, b = [], []

        def one(batch):
            w.append(batch.column("word").to_numpy().astype(np.int32))
            b.append(batch.column("bits").to_numpy().astype(np.uint32))
            return ()

        def finish():
            if w:
                yield record(schema, words=[np.concatenate(w).tobytes()], bits=[np.concatenate(b).tobytes()])

        one.finish = finish
        return one

    rows = arrow_pass(words, make, "words binary, bits binary").collect()  # no more entries in all than the bitmap has words
    return [(np.frombuffer(r.words, np.int32), np.frombuffer(r.bits, np.int32)) for r in rows]
