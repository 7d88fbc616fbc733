"""Removal of repeated byte strings: each byte covered by a LENGTH-byte string that also starts in a document of a smaller doc_id.

Where two documents share a LENGTH-byte string, they share its anchor: the KEY bytes in it whose hash is least. So
only anchors that several documents hold matter, and each anchor's context (all bytes that a string with this anchor
can cover) is enough to compare the strings around it:

1. every document's anchor hashes are dealt into buckets, which tell the repeated ones; a bitmap of fixed size lets
   them pass (and a few others: it prunes, it never decides);
2. documents with a repeated anchor are kept in packets of about PACKET bytes; of each packet, one entry for each
   anchor and context hash goes to the anchor's bucket, however many documents of the packet hold it. A bucket answers
   with the smallest doc_id of each context where the packet doesn't hold it itself, and tells anchors that have several
   contexts;
3. only the contexts of the latter are sent as bytes, to as many buckets as their number asks for. A bucket sorts the
   LENGTH-byte strings of its contexts in memory (``induced``), one start at a time: documents that share a string hold
   each of its anchors at the same place in it. Equal ones give the smallest doc_id of each string. This takes the place
   of external induced sorting, which the README gives figures for; a bucket holds all contexts of its anchors, so an
   anchor with very many contexts needs as much memory in one task;
4. a packet gathers the answers, and removes.

A hot passage costs one entry for each packet, not one for each document. Null text counts as empty. A null doc_id is
larger than any other. Rows of equal doc_id never remove from each other. An empty table gives no rows. A document is
held whole in a task, with some 30 times its bytes in arrays. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import arrow_pass, by_bucket, in_bitmap, materialise, materialise_large, mix64, record, release, repeated_filter, table, texts

LENGTH, KEY = 50, 26
#: Starts of strings around one anchor, and bytes of its context.
STARTS = LENGTH - KEY + 1
CONTEXT = LENGTH + STARTS - 1
PACKET, BUCKET_ENTRIES = 2 << 20, 1 << 20
FILTER_BITS = 1 << 27
#: A byte that UTF-8 never has.
OUTSIDE = 0xFF
#: Contexts of one bucket, and anchors that a packet looks at in one step.
BUCKET_CONTEXTS, STEP = 1 << 16, 20_000
#: Entries of a bucket that are sorted at a time.
SLICE = 1 << 17
NOBODY = np.iinfo(np.int64).max
POWER = np.uint64(0x9E3779B97F4A7C15)


def power(n: int) -> np.uint64:
    return np.uint64(pow(int(POWER), n, 1 << 64))


def joined(a: np.ndarray, b: np.ndarray, at: int) -> np.ndarray:
    """Hashes of strings that begin with a's (of length at) and go on with b's."""
    n = len(b) - at
    return a[:n] * power(at) + b[at : at + n] if n > 0 else np.zeros(0, np.uint64)


def rolling(raw: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n bytes from each position on."""
    h = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    out, have, size = None, 0, 1
    while True:
        if n & size:
            out, have = (h, size) if out is None else (h[: max(0, len(out) - size)] * power(have) + out[size:][: max(0, len(h))], have + size)
        if size * 2 > n:
            break
        h, size = joined(h, h, size), size * 2
    return out[: max(0, len(raw) - n + 1)]


def slide(x: np.ndarray, n: int, best) -> np.ndarray:
    """best of each n consecutive values."""
    size = 1
    while size * 2 <= n:
        x, size = best(x[: len(x) - size], x[size:]), size * 2
    return best(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all strings of a document."""
    if len(raw) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = mix64(rolling(raw, KEY))
    least = slide(h, STARTS, np.minimum)
    padded = np.concatenate([np.zeros(STARTS - 1, np.uint64), least, np.zeros(STARTS - 1, np.uint64)])
    at = np.flatnonzero(slide(padded, STARTS, np.maximum) == h)
    return at, h[at]


def context_hashes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each context, from a rolling one."""
    framed = np.full(len(raw) + 2 * CONTEXT, OUTSIDE, np.uint8)
    framed[CONTEXT : CONTEXT + len(raw)] = raw
    return mix64(rolling(framed, CONTEXT)[at + CONTEXT - (STARTS - 1)] ^ np.uint64(0x5851F42D4C957F2D))


def raw_texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts(batch)]


def one_table(parts) -> dict[str, list]:
    return parts.to_pydict()


def one_by_one(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """The rows, of which a packet's is megabytes, without a second copy of all."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def flat(parts: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The values in a column of packed arrays, one after another, copied once."""
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in parts])


def known(h: np.ndarray, c: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry (anchor, context, doc_id): the smallest doc_id of its context, and whether its anchor has several contexts. Sorted SLICE entries at a time, an anchor's all at once."""
    out_least, out_several = np.empty(len(h), np.int64), np.empty(len(h), np.uint8)
    slices = np.uint64(-(-len(h) // SLICE))
    for k in range(int(slices)):
        at = np.flatnonzero(h % slices == np.uint64(k))
        if not len(at):
            continue
        order = at[np.lexsort((c[at], h[at]))]
        hs, cs = h[order], c[order]
        new_h = np.concatenate([[True], hs[1:] != hs[:-1]])
        new = new_h | np.concatenate([[True], cs[1:] != cs[:-1]])
        h_of = np.cumsum(new_h) - 1
        out_least[order] = np.minimum.reduceat(least[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        out_several[order] = np.bincount(h_of[new])[h_of] > 1
    return out_least, out_several


def repeated_anchors(docs: DataFrame, buckets: int) -> np.ndarray:
    """A bitmap of the anchor hashes that several rows hold."""
    return repeated_filter(docs.select("text"), lambda batch: (np.unique(anchors(np.frombuffer(raw, np.uint8))[1]) for raw in raw_texts(batch)), buckets, FILTER_BITS)


PACKED = "packet long, doc_ids binary, sizes binary, body binary, n_anchors binary, at binary, done_id long, done_bytes long, done_sha string"


def packets(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """Rows of two kinds: a packet of documents with repeated anchors (and these anchors), or a document that is done since it has none."""
    schema = pa.schema([("packet", pa.int64()), ("doc_ids", pa.binary()), ("sizes", pa.binary()), ("body", pa.binary()), ("n_anchors", pa.binary()), ("at", pa.binary()), ("done_id", pa.int64()), ("done_bytes", pa.int64()), ("done_sha", pa.string())])

    def make():
        from pyspark import TaskContext

        state = {"packet": TaskContext.get().partitionId() << 32, "size": 0}
        held: list[tuple[int, bytes, np.ndarray]] = []

        def flush():
            ids = np.array([NOBODY if k is None else k for k, *_ in held], np.int64)
            pack = lambda f, t: np.array([f(x) for x in held], t).tobytes()
            yield record(schema, packet=[state["packet"]], doc_ids=[ids.tobytes()], sizes=[pack(lambda x: len(x[1]), np.int64)], body=[b"".join(x[1] for x in held)], n_anchors=[pack(lambda x: len(x[2]), np.int64)], at=[np.concatenate([x[2] for x in held]).astype(np.int32).tobytes()], done_id=[None], done_bytes=[None], done_sha=[None])
            state["packet"] += 1
            state["size"] = 0
            held.clear()

        def one(batch):
            done = []
            for key, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch), strict=True):
                at, h = anchors(np.frombuffer(raw, np.uint8))
                keep = in_bitmap(bitmap, h)
                if keep.any():
                    held.append((key, raw, at[keep]))
                    state["size"] += len(raw)
                    if state["size"] >= PACKET:
                        yield from flush()
                else:
                    done.append((key, len(raw), hashlib.sha256(raw).hexdigest()))
            if done:
                n = len(done)
                none = [None] * n
                yield record(schema, packet=none, doc_ids=none, sizes=none, body=none, n_anchors=none, at=none, done_id=[x[0] for x in done], done_bytes=[x[1] for x in done], done_sha=[x[2] for x in done])

        def finish():
            if held:
                yield from flush()

        one.finish = finish
        return one

    return materialise_large(arrow_pass(docs.select("doc_id", "text"), make, PACKED), "substring-packets")


class Packet:
    """A packet's documents with their anchors; pairs are its distinct (anchor, context), each with its smallest doc_id."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.body = np.frombuffer(row["body"], np.uint8)
        self.counts = np.frombuffer(row["n_anchors"], np.int64)
        self.at = np.frombuffer(row["at"], np.int32).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(self.ids)), self.counts)
        first = np.cumsum(self.counts) - self.counts
        h, c = [], []
        for k in range(len(self.ids)):
            raw, at = self.raw(k), self.at[first[k] : first[k] + self.counts[k]]
            h.append(mix64(rolling(raw, KEY))[at])
            c.append(context_hashes(raw, at))
        self.h, self.c = np.concatenate(h), np.concatenate(c)
        order = np.lexsort((self.c, self.h))
        h, c = self.h[order], self.c[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
        number = np.cumsum(new) - 1
        self.pair = np.empty(len(order), np.int64)
        self.pair[order] = number
        self.pair_h, self.pair_c = h[new], c[new]
        self.least = np.minimum.reduceat(self.ids[self.doc[order]], np.flatnonzero(new)) if len(order) else np.zeros(0, np.int64)
        self.sample = order[new]

    def raw(self, k: int) -> np.ndarray:
        return self.body[self.starts[k] : self.starts[k] + self.sizes[k]]

    def bytes_of(self, pairs: np.ndarray) -> np.ndarray:
        """The contexts of these pairs."""
        out = np.full((len(pairs), CONTEXT), OUTSIDE, np.uint8)
        for part in range(0, len(pairs), STEP):
            occurrence = self.sample[pairs[part : part + STEP]]
            d = self.doc[occurrence]
            place = (self.at[occurrence] - (STARTS - 1))[:, None] + np.arange(CONTEXT)
            inside = (place >= 0) & (place < self.sizes[d][:, None])
            rows = out[part : part + STEP]
            rows[inside] = self.body[(place + self.starts[d][:, None])[inside]]
        return out


def first_answers(found: DataFrame, buckets: int) -> DataFrame:
    """packet, pairs, least (smallest doc_id of each pair's context anywhere), several (whether its anchor has more contexts) and n_several; only pairs of which the packet doesn't know all itself."""
    sent = pa.schema([("bucket", pa.int32()), ("packet", pa.int64()), ("pairs", pa.binary()), ("h", pa.binary()), ("c", pa.binary()), ("least", pa.binary())])

    def make():
        def one(batch):
            for row in one_by_one(batch):
                p = Packet(row)
                dealt = by_bucket(p.pair_h, buckets)
                cut = lambda x: [x[part].tobytes() for _, part in dealt]  # noqa: E731, B023
                yield record(sent, bucket=[b for b, _ in dealt], packet=[row["packet"]] * len(dealt), pairs=[part.astype(np.int32).tobytes() for _, part in dealt], h=cut(p.pair_h), c=cut(p.pair_c), least=cut(p.least))

        return one

    entries = arrow_pass(found.where("packet is not null"), make, "bucket int, packet long, pairs binary, h binary, c binary, least binary")
    answer = pa.schema([("packet", pa.int64()), ("pairs", pa.binary()), ("least", pa.binary()), ("several", pa.binary()), ("n_several", pa.int64())])

    def reduce(group: pa.Table) -> pa.Table:
        size = [len(x.as_buffer()) // 8 for x in group["h"]]
        least = flat(group["least"], np.int64)
        out_least, out_several = known(flat(group["h"], np.uint64), flat(group["c"], np.uint64), least)
        keep = (out_least < least) | (out_several > 0)
        pairs = flat(group["pairs"], np.int32)
        ends = np.cumsum(size)
        cut = lambda x: [x[e - n : e][keep[e - n : e]] for e, n in zip(ends, size, strict=True)]
        several = cut(out_several)
        return pa.Table.from_batches([record(answer, packet=group["packet"].to_pylist(), pairs=[x.tobytes() for x in cut(pairs)], least=[x.tobytes() for x in cut(out_least)], several=[x.tobytes() for x in several], n_several=[int(x.sum()) for x in several])])

    return materialise(entries.groupBy("bucket").applyInArrow(reduce, "packet long, pairs binary, least binary, several binary, n_several long"), "substring-answers")


def gathered(rows: dict[str, list], name: str, out: np.ndarray) -> np.ndarray:
    """out, an array over the packet's pairs, with the buckets' answers in their places."""
    for pairs, values in zip(rows["pairs"], rows[name], strict=True):
        out[np.frombuffer(pairs, np.int32)] = np.frombuffer(values, out.dtype)
    return out


def second_answers(found: DataFrame, answers: DataFrame) -> DataFrame:
    """packet, pairs and strings (STARTS smallest doc_ids for the strings of each pair) of the anchors with several contexts; only pairs of which a string is held by a smaller doc_id than the packet's."""
    buckets = max(4, -(-(answers.agg(F.sum("n_several")).first()[0] or 0) // BUCKET_CONTEXTS))
    sent = pa.schema([("bucket", pa.int32()), ("packet", pa.int64()), ("pairs", pa.binary()), ("context", pa.binary()), ("least", pa.binary())])

    def ask(packet: pa.Table, answered: pa.Table) -> pa.Table:
        out = []
        for row in one_by_one(packet):
            p = Packet(row)
            got = one_table(answered)
            several = np.flatnonzero(gathered(got, "several", np.zeros(len(p.pair_h), np.uint8)))
            dealt = by_bucket(p.pair_h[several], buckets)
            cut = lambda x: [x[part].tobytes() for _, part in dealt]  # noqa: E731, B023
            out.append(record(sent, bucket=[b for b, _ in dealt], packet=[row["packet"]] * len(dealt), pairs=cut(several.astype(np.int32)), context=cut(p.bytes_of(several)), least=cut(p.least[several])))
        return pa.Table.from_batches(out, sent)

    entries = found.where("packet is not null").groupBy("packet").cogroup(answers.drop("n_several").groupBy("packet")).applyInArrow(ask, "bucket int, packet long, pairs binary, context binary, least binary")
    answer = pa.schema([("packet", pa.int64()), ("pairs", pa.binary()), ("strings", pa.binary())])

    def reduce(group: pa.Table) -> pa.Table:
        from inkwell.llm.induced import string_minima

        cols = one_table(group.select(["packet", "pairs"]))
        size = [len(x.as_buffer()) // 8 for x in group["least"]]
        bytes_ = flat(group["context"], np.uint8).reshape(-1, CONTEXT)
        least = flat(group["least"], np.int64)
        key = np.ascontiguousarray(bytes_).view(f"V{CONTEXT}").ravel()
        _, one, same = np.unique(key, return_index=True, return_inverse=True)
        owner = np.full(len(one), NOBODY)
        np.minimum.at(owner, same, least)
        low = string_minima(bytes_[one], owner, LENGTH)
        best, ends = low.min(axis=1), np.cumsum(size)
        told = {"packet": [], "pairs": [], "strings": []}
        for packet, pairs, e, n in zip(cols["packet"], cols["pairs"], ends, size, strict=True):
            mine = same[e - n : e]
            keep = best[mine] < least[e - n : e]
            if keep.any():
                told["packet"].append(packet)
                told["pairs"].append(np.frombuffer(pairs, np.int32)[keep].tobytes())
                told["strings"].append(low[mine[keep]].tobytes())
        return pa.Table.from_batches([record(answer, **told)])

    return materialise(entries.groupBy("bucket").applyInArrow(reduce, "packet long, pairs binary, strings binary"), "substring-strings")


def removed(found: DataFrame, answers: DataFrame, strings: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every row in packets."""
    tagged = answers.select("packet", "pairs", "least", F.lit(None).cast("binary").alias("strings")).union(strings.select("packet", "pairs", F.lit(None).cast("binary"), "strings"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def finish(packet: pa.Table, answered: pa.Table) -> pa.Table:
        out = []
        for row in one_by_one(packet):
            p = Packet(row)
            got = one_table(answered)
            plain = {k: [v for v, keep in zip(got[k], got["least"], strict=True) if keep is not None] for k in ("pairs", "least")}
            fine = {k: [v for v, keep in zip(got[k], got["strings"], strict=True) if keep is not None] for k in ("pairs", "strings")}
            whole = gathered(plain, "least", p.least.copy())  # what isn't told, the packet holds itself
            each = np.frombuffer(b"".join(fine["strings"]), np.int64).reshape(-1, STARTS)
            place = np.full(len(whole), -1)
            place[np.frombuffer(b"".join(fine["pairs"]), np.int32)] = np.arange(len(each))
            edge = np.zeros(len(p.body) + 1, np.int32)
            for k in range(0, len(p.pair), STEP):
                pair, doc = p.pair[k : k + STEP], p.doc[k : k + STEP]
                low = np.repeat(whole[pair][:, None], STARTS, axis=1)  # for each anchor, its STARTS strings
                told = np.flatnonzero(place[pair] >= 0)
                low[told] = np.minimum(low[told], each[place[pair[told]]])
                begin = p.at[k : k + STEP, None] - (STARTS - 1) + np.arange(STARTS)
                hit = (low < p.ids[doc][:, None]) & (begin >= 0) & (begin + LENGTH <= p.sizes[doc][:, None])
                at = (begin + p.starts[doc][:, None])[hit]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + LENGTH, -1)
            gone = np.cumsum(edge)[:-1] > 0
            cols = {f.name: [] for f in schema}
            for k in range(len(p.ids)):
                own = gone[p.starts[k] : p.starts[k] + p.sizes[k]]
                cols["doc_id"].append(None if p.ids[k] == NOBODY else int(p.ids[k]))
                cols["n_bytes"].append(len(own))
                cols["n_removed"].append(int(own.sum()))
                cols["n_spans"].append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()))
                cols["kept"].append(p.raw(k)[~own].tobytes())
            out.append(record(schema, **cols))
        return pa.Table.from_batches(out, schema)

    return found.where("packet is not null").groupBy("packet").cogroup(tagged.groupBy("packet")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; kept bytes of rows that lose some."""
    size = docs.select(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    buckets = max(4, -(-size // (13 * BUCKET_ENTRIES)))
    spark = docs.sparkSession
    bitmap = repeated_anchors(docs, buckets)
    release(spark)  # no step reads the shuffle files of the one before
    found = packets(docs, bitmap)
    answers = first_answers(found, buckets)
    release(spark)
    strings = second_answers(found, answers)
    release(spark)
    changed = removed(found, answers, strings).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "kept")
    same = found.where("packet is null").select(F.col("done_id").alias("doc_id"), F.col("done_bytes").alias("n_bytes"), F.lit(0).cast("long"), F.lit(0).cast("long"), "done_sha", F.lit(None).cast("binary"))
    return changed.union(same)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op4_substrings": op4_substrings}
