"""Token ids in binary shards: canonical Huffman codes of limited length, from the counts of all ids.

A file set at ``path`` holds ``codebook`` (id, length: the canonical codes follow from these) and ``blocks``. Shards
are ranges of doc_id in ascending order; a shard is a run of blocks; a block holds whole documents, is coded on its
own, and carries the bit offset of every CHECKPOINT_IDS-th id, so that a reader decodes all stretches between
checkpoints in step, by table. All data go through Spark's own writers and readers, hence to any store that Spark
knows, and a lost task is written again by Spark's commit protocol.

Null text counts as empty and keeps the end id; documents of equal doc_id follow each other in order of their ids'
checksum; a null doc_id comes first; an empty table makes an empty file set.
"""

from __future__ import annotations

import uuid
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import arrow_pass, discard, materialise, record, remembered, shared_dir, table, texts

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Longest code in bits; a decoding table has two to this power entries.
LONGEST = 20
SHARD_IDS = 4_000_000
BLOCK_IDS = 256_000
CHECKPOINT_IDS = 64
#: Entries that a worker's memories of chunks and of words hold at most; then the older half goes.
CHUNKS, WORDS = 250_000, 400_000
#: A text of these characters only is lower-cased and split here as the tokenizer would; others go through the whole of it.
END_MARKS = (".", ",")
PLAIN = "\t\n\r\x20-\x7e\xa1-\xac\xae-\xffŒœ"


def forget(memory: dict) -> None:
    """The older half of the entries; common ones soon are there again."""
    for key in list(islice(memory, (len(memory) + 1) // 2)):
        del memory[key]


class Encoder:
    """The tokenizers library's ids of texts, as little-endian unsigned integers of 16 bits where all ids fit, else of 32.

    No token crosses white space in this tokenizer, so chunks between spaces are encoded once and remembered; the
    words of a new plain chunk go straight to the library's model. Texts with the literal of an added token go through
    the library whole.
    """

    def __init__(self, path: str | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json
        import re

        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        from inkwell.llm.bpe import byte_letters

        path = path or public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            settings = json.load(f)
        self.added = [t["content"] for t in settings["added_tokens"]]
        steps = settings["pre_tokenizer"]["pretokenizers"]
        self.words_of = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self.odd = re.compile(f"[^{PLAIN}]").search
        self.letters = dict(enumerate(byte_letters()))
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, f"<u{self.width}").tobytes()

    def word(self, w: str) -> bytes:
        found = self.words.get(w)
        if found is None:
            if len(self.words) >= WORDS:
                forget(self.words)
            mapped = w if w.isascii() else w.encode().decode("latin-1").translate(self.letters)
            found = self.words[w] = array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return found

    def chunk(self, c: str, plain: bool) -> bytes:
        if c.isascii():
            if c.isalpha():
                return self.word(c.lower())
            if c[-1:] in END_MARKS and c[:-1].isalpha():
                return self.word(c[:-1].lower()) + self.word(c[-1])
        elif plain and c.isalpha():
            return self.word(c.lower())
        return b"".join(map(self.word, self.words_of(c.lower()))) if plain or not self.odd(c) else self.whole(c)

    def encode(self, text: str) -> bytes:
        if any(literal in text for literal in self.added):
            return self.whole(text)
        chunks = self.chunks
        parts = text.replace("\n", " ").split(" ")
        new = set(parts).difference(chunks)
        if new:
            if len(chunks) + len(new) > CHUNKS:
                while chunks and len(chunks) + len(new) > CHUNKS:
                    forget(chunks)
                new = set(parts).difference(chunks)
            of, plain = self.chunk, not self.odd(text)
            for c in new:
                chunks[c] = of(c, plain)
        return b"".join(map(chunks.__getitem__, parts))


def encoder(path: str | None) -> Encoder:
    """One for each worker process: what it remembers serves its later tasks of this kind."""
    return remembered(("token file", path), lambda: Encoder(path))


def tokenise(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """doc_id and ids (little-endian unsigned integers of ``width`` bytes), the end id included unless it is None."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("width", pa.int32())])

    def make():
        coder = encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], f"<u{coder.width}").tobytes()

        def one(batch):
            yield record(schema, doc_id=batch.column("doc_id"), ids=[coder.encode(t) + end for t in texts(batch)], width=[coder.width] * batch.num_rows)

        return one

    return arrow_pass(docs.select("doc_id", "text"), make, "doc_id long, ids binary, width int")


def count_ids(coded: DataFrame) -> DataFrame:
    """(id, n) over all rows; each task sums up first."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def make():
        total = [np.zeros(0, np.int64)]

        def one(batch):
            width = batch.column("width")[0].as_py()
            c = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), f"<u{width}"), minlength=len(total[0]))
            c[: len(total[0])] += total[0]
            total[0] = c
            return ()

        def finish():
            ids = np.flatnonzero(total[0])
            yield record(schema, id=ids, n=total[0][ids])

        one.finish = finish
        return one

    return arrow_pass(coded.select("ids", "width"), make, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def limited_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n == 0:
        return out
    if n == 1:
        out[used] = 1
        return out
    if n > 1 << longest:
        raise ValueError(f"{n} ids don't fit in codes of {longest} bits")
    order = used[np.lexsort((used, counts[used]))]
    leaves = counts[order].astype(np.float64)
    level, kinds = leaves, [np.ones(n, bool)]
    for _ in range(longest - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([leaves, pairs])
        place = np.argsort(merged, kind="stable")
        level = merged[place]
        kinds.append(place < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(kinds):
        own = int(leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each the next free one of its length."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    if len(order):
        longest = int(lengths.max())
        steps = np.uint64(1) << (np.uint64(longest) - lengths[order].astype(np.uint64))
        first = np.concatenate([[np.uint64(0)], np.cumsum(steps)[:-1]]).astype(np.uint64)
        codes[order] = first >> (np.uint64(longest) - lengths[order].astype(np.uint64))
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids' codes one after another, and the bit offset of every CHECKPOINT_IDS-th."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    total = int(end[-1]) if len(ids) else 0
    place = codes[ids] << (64 - (start & 31) - size).astype(np.uint64)
    word, n = start >> 5, (total + 31) // 32 + 1
    out = np.bincount(word, (place >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (place & np.uint64(0xFFFFFFFF)).astype(np.float64), n)[:n]
    return out.astype(np.uint32).astype(">u4").tobytes()[: (total + 7) // 8], start[::CHECKPOINT_IDS].astype(np.uint64)


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each value of the next bits: the id whose code they begin with, and its length."""
    longest = max(1, int(lengths.max(initial=0)))
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    width = 1 << (longest - lengths[order].astype(np.int64))
    ids, size = np.zeros(1 << longest, np.uint32), np.ones(1 << longest, np.int64)
    filled = int(width.sum())
    ids[:filled], size[:filled] = np.repeat(order, width), np.repeat(lengths[order], width)
    return ids, size, longest


def unpack(payload: bytes, checkpoints: np.ndarray, n: int, decoding: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The n ids of a block; all stretches between checkpoints advance together, an id at a time."""
    ids_of, size_of, longest = decoding
    if not n:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    windows = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at, mask = checkpoints.astype(np.int64), (1 << longest) - 1
    out = np.zeros((len(at), CHECKPOINT_IDS), np.uint32)
    last = len(windows) - 1
    for k in range(CHECKPOINT_IDS):
        bits = (windows[np.minimum(at >> 3, last)] >> (32 - longest - (at & 7)).astype(np.uint32)) & mask
        out[:, k] = ids_of[bits]
        at += size_of[bits]
    return out.ravel()[:n]


BLOCK = "shard int, block int, start long, n_ids long, doc_ids array<long>, sizes array<long>, checkpoints binary, payload binary"


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = END_ID) -> None:
    """Encodes every text of docs and writes the file set."""
    spark = docs.sparkSession
    coded = materialise(tokenise(docs, tokenizer, end_id), "token-ids")
    counted = {r.id: r.n for r in count_ids(coded).collect()}  # no more rows than the vocabulary has ids
    counts = np.zeros(max(counted, default=-1) + 1, np.int64)
    for k, n in counted.items():
        counts[k] = n
    lengths = limited_lengths(counts)
    codes = canonical_codes(lengths)
    spark.createDataFrame([(int(k), int(lengths[k])) for k in np.flatnonzero(lengths)], "id long, length int").coalesce(1).write.parquet(f"{path}/codebook")
    shards = max(1, -(-int(counts.sum()) // SHARD_IDS))
    ordered = coded.withColumn("tie", F.xxhash64("ids")).repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids", "width")
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("checkpoints", pa.binary()), ("payload", pa.binary())])

    def make():
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        state = {"block": 0, "start": 0, "width": 4}
        keys, raws, held = [], [], [0]

        def emit():
            ids = np.frombuffer(b"".join(raws), f"<u{state['width']}")
            payload, checkpoints = pack(ids, lengths, codes)
            yield record(schema, shard=[shard], block=[state["block"]], start=[state["start"]], n_ids=[len(ids)], doc_ids=[keys[:]], sizes=[[len(r) // state["width"] for r in raws]], checkpoints=[checkpoints.astype("<u8").tobytes()], payload=[payload])
            state["block"] += 1
            state["start"] += len(ids)
            keys.clear()
            raws.clear()
            held[0] = 0

        def one(batch):
            state["width"] = batch.column("width")[0].as_py()
            for key, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                keys.append(key)
                raws.append(raw)
                held[0] += len(raw) // state["width"]
                if held[0] >= BLOCK_IDS:
                    yield from emit()

        def finish():
            if keys:
                yield from emit()

        one.finish = finish
        return one

    arrow_pass(ordered, make, BLOCK).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    discard(coded)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit integers) of each document."""
    book = spark.read.parquet(f"{path}/codebook").collect()  # no more rows than the vocabulary has ids
    lengths = np.zeros(max((r.id for r in book), default=-1) + 1, np.uint8)
    for r in book:
        lengths[r.id] = r.length
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def make():
        decoding = decoding_table(lengths)

        def one(batch):
            for r in batch.to_pylist():
                ids = unpack(r["payload"], np.frombuffer(r["checkpoints"], "<u8"), r["n_ids"], decoding)
                ends = np.cumsum(r["sizes"])
                starts = ends - r["sizes"]
                yield record(schema, doc_id=r["doc_ids"], shard=[r["shard"]] * len(ends), within=starts + r["start"], n_tokens=r["sizes"], ids=[ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)])

        return one

    before, offsets = 0, []
    for shard, n in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect():  # a row for each shard
        offsets.append((shard, before))
        before += n
    decoded = arrow_pass(blocks, make, "doc_id long, shard int, within long, n_tokens long, ids binary")
    placed = decoded.join(F.broadcast(spark.createDataFrame(offsets, "shard int, before long")), "shard")
    return placed.select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids")


def op10_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/inkwell/token-file-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op10_huffman_tokens": op10_huffman_tokens}
