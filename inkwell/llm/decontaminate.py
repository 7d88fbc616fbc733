"""Benchmark decontamination with spaced seeds.

Words are the pieces between white space, lower-cased, without anything but letters and digits. A mask is a set of
positions in a window of words; the words at the others are ignored, so that a window still matches after words at
ignored positions were substituted. Every window of every test item and of every document is hashed under each MASK;
hashes of both sides are joined, and each hit is verified on its diagonal (document position minus item position):
the longest stretch in which at least IDENTITY percent of the words agree must span OVERLAP words, or the whole item
if that is shorter. Items shorter than OVERLAP have masks of their own, each of which leaves out as many groups of
words as may be substituted; items of fewer than LEAST words aren't searched. No overlap that would be verified lacks a
hit: a longer stretch holds one of 13 to 25 words that suffices, and the tests go through all substitutions in those.

Only hashes that a fixed-size bitmap of the test hashes lets pass leave the scan of the documents; the join decides.
Equal items are one class, whose smallest item_id stands for all (``copies`` tells how many). Null and empty texts have
no words. Repeated documents and equal doc_ids are each searched. ``clean`` keeps all columns of its input.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import arrow_pass, materialise, mix64, record, table, texts

#: These hit every stretch of 13 words with 2 substitutions, of 15 with 3, of 20 with 4 and of 25 with 5.
MASKS = ((0, 1, 2, 4, 5, 6, 8), (0, 2, 3, 6, 7, 8), (0, 1, 2, 3, 7, 9), (0, 3, 7, 8, 9, 10), (0, 1, 3, 4, 5, 6, 11))
OVERLAP, IDENTITY, LEAST = 13, 80, 5
#: Words that a mask of a short item keeps, where its length and substitutions allow.
KEPT = 6
#: Most bits of the bitmap of test hashes, and the places in it that each hash sets.
FILTER_BITS, PLACES = 1 << 26, 6
#: Characters of texts whose words are hashed at once, and windows; arrays of so many words stay in a core's cache.
SLICE, PART = 1 << 18, 1 << 15
#: Bytes of a word up to which it is hashed along with the others.
LONG = 64
#: In prepared texts: a byte between words, and one after each text. UTF-8 has neither.
BETWEEN, AFTER = 0xFE, 0xFF
#: What becomes of each byte; ASCII ones that are neither of a word nor white space go.
BYTES = bytes(b if b > 127 else BETWEEN if chr(b).isspace() else ord(chr(b).lower()) for b in range(256))
DROPPED = bytes(b for b in range(128) if not (chr(b).isspace() or chr(b).isalnum()))
#: Of each code point from 128 on that a process has met: OF_WORDS if words keep it, else the ASCII character that stands for it.
KINDS, OF_WORDS = np.zeros(0x110000, np.uint8), 1
#: Of the first 0 to 8 bytes in an integer.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: A word's factor by its rank in a mask, which tells orders of words apart.
FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(OVERLAP)], np.uint64)


def settle(raw: bytearray) -> None:
    """Writes an ASCII character over each other one that isn't of a word: a space over white space, a full stop over the rest."""
    found = np.frombuffer(raw, np.uint8)
    lead = np.flatnonzero(found >= 0xC0)
    first = found[lead]
    for size, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
        at = lead[(first >= low) & (first < high)]
        code = found[at].astype(np.int64) & (0x7F >> size)
        for k in range(1, size):
            code = code << 6 | found[at + k] & 0x3F
        for c in set(code[KINDS[code] == 0].tolist()):
            KINDS[c] = OF_WORDS if chr(c).isalnum() else ord(" " if chr(c).isspace() else ".")
        kinds = KINDS[code]
        other = np.flatnonzero(kinds != OF_WORDS)
        for k in range(size if len(other) else 0):
            found[at[other] + k] = kinds[other]


def word_hashes(docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one text after the other, and for each text how many there are up to its end.

    Words are read from the bytes of the texts, eight at a time: no dictionary, whose lookups miss the cache.
    """
    raw = bytearray(b"".join(part for t in docs for part in (t.encode() if t.isascii() else t.lower().encode("utf-8", "surrogatepass"), b"\xff")))
    if len(raw) > sum(map(len, docs)) + len(docs):
        settle(raw)
    kept = raw.translate(BYTES, DROPPED) + bytes(8)
    found = np.frombuffer(kept, np.uint8)
    stop = np.flatnonzero(found >= BETWEEN)
    start = np.concatenate([np.zeros(min(1, len(stop)), np.int64), stop[:-1] + 1])
    size = stop - start
    real = size > 0
    ends = np.cumsum(real)[found[stop] == AFTER]
    start, size = start[real], size[real]
    eight = np.ndarray(len(kept) - 7, "<u8", kept, strides=(1,))
    h = eight[start] & FIRST[np.minimum(size, 8)]
    more, done = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(more):
        h[more] = mix64(h[more]) + (eight[start[more] + done] & FIRST[np.minimum(size[more] - done, 8)])
        done += 8
        more = more[size[more] > done]
    h = mix64(h)
    for k in np.flatnonzero(size > LONG).tolist():
        import xxhash

        h[k] = xxhash.xxh3_64_intdigest(kept[start[k] : start[k] + size[k]])
    return h, ends


def slices(docs: list[str]) -> Iterator[slice]:
    """Texts that follow each other, of SLICE characters in all or one."""
    first, held = 0, 0
    for k, t in enumerate(docs):
        if k > first and held + len(t) > SLICE:
            yield slice(first, k)
            first, held = k, 0
        held += len(t)
    yield slice(first, len(docs))


def ranked(words: np.ndarray, masks: list[tuple[int, ...]]) -> list[np.ndarray]:
    """The words times the factor of each rank."""
    return [words * FACTORS[k] for k in range(max(map(len, masks)))]


def seeds(by_rank: list[np.ndarray], mask: tuple[int, ...], number: int) -> np.ndarray:
    """The hash of each window under the mask."""
    n = len(by_rank[0]) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, number + 1, np.uint64)
    for words, at in zip(by_rank, mask, strict=False):
        h += words[at : at + n]
    return h


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks of an item of n words: whichever words are substituted, as many as IDENTITY allows, one mask has none of them."""
    free = n * (100 - IDENTITY) // 100
    size = max(1, (n - KEPT) // free)
    groups = [range(at, min(at + size, n)) for at in range(0, n, size)]
    return [tuple(sorted(set(range(n)).difference(*left))) for left in combinations(groups, free)]


def masks_for(lengths: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """MASKS, for items of any length from OVERLAP on (0), and the masks of each length of shorter items, with that length."""
    return [*((0, m) for m in MASKS), *((n, m) for n in sorted({n for n in lengths if LEAST <= n < OVERLAP}) for m in short_masks(n))]


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id (the smallest of its class), copies, words (64-bit hashes) and length of each class of equal items."""
    schema = pa.schema([("item_id", pa.int64()), ("words", pa.binary()), ("length", pa.int32())])

    def make():
        def one(batch):
            h, ends = word_hashes(texts(batch))
            found = np.split(h, ends[:-1])
            yield record(schema, item_id=batch.column("item_id"), words=[w.astype("<u8").tobytes() for w in found], length=[len(w) for w in found])

        return one

    each = arrow_pass(benchmark.select("item_id", "text"), make, "item_id long, words binary, length int").where(F.col("length") >= LEAST)
    return materialise(each.groupBy("words", "length").agg(F.min("item_id").alias("item_id"), F.count("*").alias("copies")), "benchmark-items")


def item_seeds(items: DataFrame, masks: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """seed, item_id and at (word position) of every window of every item."""
    schema = pa.schema([("seed", pa.int64()), ("item_id", pa.int64()), ("at", pa.int32())])

    def make():
        def one(batch):
            for key, raw in zip(batch.column("item_id").to_pylist(), batch.column("words").to_pylist(), strict=True):
                words = np.frombuffer(raw, "<u8")
                by_rank = ranked(words, [mask for _, mask in masks])
                for k, (length, mask) in enumerate(masks):
                    if length != (len(words) if len(words) < OVERLAP else 0):
                        continue
                    h = seeds(by_rank, mask, k)[: 1 if length else None]
                    yield record(schema, seed=h.view(np.int64), item_id=[key] * len(h), at=np.arange(len(h), dtype=np.int32))

        return one

    return materialise(arrow_pass(items.select("item_id", "words"), make, "seed long, item_id long, at int"), "benchmark-seeds")


def place(h: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The k-th place of each hash in a bitmap. Its first bits are the first, since only hashes that pass there need another."""
    return ((mix64(h + np.uint64(k)) if k else h) >> np.uint64(65 - bits.bit_length())).view(np.int64)


def passing(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which hashes have all their places set."""
    kept = np.arange(0)
    for k in range(PLACES):
        at = place(h[kept] if k else h, len(bitmap) * 32, k)
        there = np.flatnonzero(bitmap[at >> 5] >> (at & 31) & 1)
        kept = kept[there] if k else there
    return kept


def seed_filter(found: DataFrame) -> np.ndarray:
    """A bitmap with PLACES bits of each test hash set, FILTER_BITS long at most; tasks make parts that the driver joins."""
    n = found.select("seed").distinct().count()
    bits = min(FILTER_BITS, 1 << max(16, (64 * max(1, n) - 1).bit_length()))
    schema = pa.schema([("word", pa.int32()), ("bits", pa.int64())])

    def make():
        held = np.zeros(bits // 32, np.uint32)

        def one(batch):
            for k in range(PLACES):
                at = place(batch.column("seed").to_numpy().view(np.uint64), bits, k)
                np.bitwise_or.at(held, at >> 5, np.uint32(1) << (at & 31).astype(np.uint32))
            return ()

        def finish():
            where = np.flatnonzero(held)
            yield record(schema, word=where.astype(np.int32), bits=held[where].astype(np.int64))

        one.finish = finish
        return one

    rows = arrow_pass(found.select("seed"), make, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(bits // 32, np.uint32)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out


def window_hits(words: np.ndarray, ends: np.ndarray, masks: list[tuple[int, ...]], bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, seed and place in the text of each window of the texts' words whose hash the bitmap lets pass."""
    text, seed, where = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    begin = np.concatenate([[0], ends[:-1]])
    reach = max(mask[-1] for mask in masks)
    for part in range(0, len(words), PART):
        by_rank = ranked(words[part : part + PART + reach], masks)
        for k, mask in enumerate(masks):
            h = seeds(by_rank, mask, k)[:PART]
            kept = passing(h, bitmap)
            at = kept + part
            of = np.searchsorted(ends, at, "right")
            within = at + mask[-1] < ends[of]
            text.append(of[within])
            seed.append(h[kept[within]])
            where.append((at - begin[of])[within])
    return np.concatenate(text), np.concatenate(seed), np.concatenate(where)


def scan(docs: DataFrame, masks: list[tuple[int, tuple[int, ...]]], bitmap: np.ndarray) -> DataFrame:
    """_row, doc_id, words and the hits (seed, at) of each document that holds a hash which the bitmap lets pass."""
    hit = pa.struct([("seed", pa.int64()), ("at", pa.int32())])
    schema = pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("words", pa.binary()), ("hits", pa.list_(hit))])
    shapes = [mask for _, mask in masks]

    def make():
        def one(batch):
            all_texts = texts(batch)
            for part in slices(all_texts):
                words, ends = word_hashes(all_texts[part])
                text, seed, at = window_hits(words, ends, shapes, bitmap)
                if not len(text):
                    continue
                order = np.argsort(text, kind="stable")
                which, first = np.unique(text[order], return_index=True)
                rows = pa.array(which + part.start)
                held = pa.StructArray.from_arrays([pa.array(seed[order].view(np.int64)), pa.array(at[order].astype(np.int32))], fields=list(hit))
                found = [words[(ends[k - 1] if k else 0) : ends[k]].astype("<u8").tobytes() for k in which.tolist()]
                hits = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), held, type=pa.list_(hit))
                yield pa.RecordBatch.from_arrays([batch.column("_row").take(rows), batch.column("doc_id").take(rows), pa.array(found, pa.binary()), hits], schema=schema)

        return one

    keyed = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    return materialise(arrow_pass(keyed, make, "_row long, doc_id long, words binary, hits array<struct<seed:long,at:int>>"), "decontamination-hits")


def longest_stretch(same: np.ndarray, identity: int = IDENTITY) -> tuple[int, int]:
    """Start and length of the longest stretch with at least identity percent of True."""
    score = np.concatenate([[0], np.cumsum(np.where(same, 100 - identity, -identity))])
    least = np.minimum.accumulate(score)
    first = np.searchsorted(-least, -score)
    size = np.arange(len(score)) - first
    end = int(size.argmax())
    return int(first[end]), int(size[end])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, copies, start and length (in words of the document) and matched words of each verified overlap, the best for each document and item."""
    items = items_of(benchmark)
    masks = masks_for([r.length for r in items.select("length").where(F.col("length") < OVERLAP).distinct().collect()])
    known = item_seeds(items, masks)
    found = scan(docs, masks, seed_filter(known))
    hits = found.select("_row", F.explode("hits").alias("h")).select("_row", "h.seed", "h.at")
    diagonals = hits.alias("d").join(known.alias("i"), "seed").select("_row", "item_id", (F.col("d.at") - F.col("i.at")).alias("diagonal")).distinct()
    pairs = diagonals.join(items.select("item_id", F.col("words").alias("item"), "copies"), "item_id").join(found.select("_row", "doc_id", "words"), "_row")
    schema = pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("copies", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("matched", pa.int64())])

    def make():
        def one(batch):
            out = {f.name: [] for f in schema}
            for r in batch.to_pylist():
                doc, item, d = np.frombuffer(r["words"], "<u8"), np.frombuffer(r["item"], "<u8"), r["diagonal"]
                low, high = max(0, -d), min(len(item), len(doc) - d)
                same = item[low:high] == doc[low + d : high + d]
                first, size = longest_stretch(same)
                if size >= min(OVERLAP, len(item)):
                    for name in ("_row", "doc_id", "item_id", "copies"):
                        out[name].append(r[name])
                    out["start"].append(low + d + first)
                    out["length"].append(size)
                    out["matched"].append(int(same[first : first + size].sum()))
            yield record(schema, **out)

        return one

    good = arrow_pass(pairs.select("_row", "doc_id", "item_id", "copies", "words", "item", "diagonal"), make, "_row long, doc_id long, item_id long, copies long, start long, length long, matched long")
    best = good.groupBy("_row", "doc_id", "item_id").agg(F.max(F.struct("matched", "length", -F.col("start"), "copies")).alias("b"))
    return best.select("doc_id", "item_id", "b.copies", (-F.col("b.col3")).alias("start"), "b.length", "b.matched")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that a verified overlap was found in; of rows with a null doc_id all stay."""
    bad = materialise(overlaps(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontamination": op1_decontamination}
