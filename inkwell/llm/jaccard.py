"""N-gram Jaccard join: links between documents whose sets of word shingles are alike, by grouped prefixes.

A document's set is its distinct shingles of WORDS lower-cased words, as 64-bit hashes. Documents of equal sets form a
class with one representative. Shingles are ordered by how common they are (an estimate from heavy ones, which any
order may use without changing results) and then by hash. Two sets of a similarity of at least t share a shingle in
the first n - ceil(t n) + 1 of each; so representatives with the same prefix and size make a group, groups are joined
on prefix shingles with sizes within t of each other, and group pairs that survive are expanded to members, whose
sets are verified.

Links are wanted up to connected components, and that is what keeps hot groups linear:

* in a hub round each prefix shingle pairs all of its groups with one of them, its hub, and pairs inside a component
  are left out. A hub that stands for one class has then met every group of the shingle, and leaves it; shingles whose
  groups all lie in one component, or that have one group left, leave too. So a shingle of two groups takes one round;
* after HUB_ROUNDS rounds, and as long as rounds still add links, what is left is joined: of each shingle, the groups
  outside its largest component with all groups;
* every pair passes a sketch first: the parities of how many of a set's shingles fall into each of 2n to 4n buckets.
  Two sketches differ in no more places than the sets do, so the test loses no link, and a join of hot shingles
  brings forth few pairs that are not alike.

Null and empty texts have no words and link with nothing; with fewer than WORDS words the whole sequence is the one
shingle. Very long texts are one set each. Repeated rows and equal doc_ids: all rows of a doc_id share its component.
An empty table gives no rows. Other columns, whatever their names, are not read by ``join`` and kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import arrow_pass, bitmap_of, components, discard, in_bitmap, materialise, mix64, packed_words, record, release, repeated_filter, table, texts, unused

WORDS, PERCENT = 4, 85
#: Buckets of the estimate of common shingles; rows of one task that make a bucket common; both bound what is sent out.
BUCKET_BITS, COMMON = 22, 8
#: Hub rounds at least, before the rest is joined in full.
HUB_ROUNDS = 3
#: Most bits of the bitmap that spares reading texts which no candidate needs, and of the one of shared prefix shingles.
FILTER_BITS, SHARED_BITS = 1 << 26, 1 << 27
#: Prefix shingles of one bucket when shared ones are looked for.
BUCKET_ROWS = 1 << 20
#: Most bits of a sketch; longer sets fold onto them.
SKETCH_BITS = 1 << 16


#: Bytes that are hashed in one step, which bounds memory for very long texts.
SLAB = 1 << 20
FACTOR = 0x9E3779B97F4A7C15
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LETTERS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def powers(base: int, n: int = SLAB) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """64-bit hashes of the words of many texts at once: sums of letters' values times powers of FACTOR, by prefix sums."""

    def __init__(self):
        self.up, self.down = powers(FACTOR), powers(pow(FACTOR, -1, 1 << 64))

    def of(self, many: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts one after another, and where each text's begin (and the last one's end). Only A-Z are lower-cased."""
        raws = [t.encode("utf-8", "surrogatepass").lower() for t in many]
        raw = np.frombuffer(b" ".join(raws), np.uint8)
        inside = ~WHITE[raw]
        start = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
        end = np.flatnonzero(inside & np.concatenate([~inside[1:], [True]])) + 1
        h = np.zeros(len(start), np.uint64)
        for low in range(0, len(raw), SLAB):
            part = raw[low : low + SLAB]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(LETTERS[part] * self.up[: len(part)], out=total[1:])
            a, b = np.searchsorted(end, low, "right"), np.searchsorted(start, low + len(part))
            if a < b:
                first, last = np.maximum(start[a:b] - low, 0), np.minimum(end[a:b] - low, len(part))
                found = (total[last] - total[first]) * self.down[np.minimum(first, SLAB - 1)]
                if start[a] < low:  # a word that goes on from the step before
                    found[:1] *= np.uint64(pow(FACTOR, int(low - start[a]), 1 << 64))
                h[a:b] += found
        begin = np.cumsum([0, *(len(r) + 1 for r in raws)])
        return mix64(h + (end - start).astype(np.uint64)), np.searchsorted(start, begin)


def shingles(many: list[str], words_of: Words, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, ends = words_of.of(many)

    def runs(x: np.ndarray, k: int) -> np.ndarray:
        out = np.full(max(0, len(x) - k + 1), 0x51ED270B + k, np.uint64)
        for at in range(k):
            out = out * np.uint64(FACTOR) + x[at : at + len(out)]
        return mix64(out)

    every, found = runs(h, words), []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        x = np.sort(every[a : b - words + 1]) if b - a >= words else runs(h[a:b], b - a) if b > a else h[:0]
        found.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x)
    return found


def required(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def sketch(h: np.ndarray) -> np.ndarray:
    """Parities of the numbers of hashes that fall into each of 2n to 4n buckets (SKETCH_BITS at most), as 64-bit words. XOR of its halves is the sketch of half the buckets."""
    bits = min(SKETCH_BITS, 2 << max(6, (len(h) - 1).bit_length())) if len(h) else 64
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def close(x: str, nx: str, y: str, ny: str, percent: int) -> F.Column:
    """Whether sketches x and y leave room for a similarity of percent of sets of nx and ny shingles; true where one is null."""
    half = lambda a: f"zip_with(slice({a}, 1, size({a}) div 2), slice({a}, size({a}) div 2 + 1, size({a}) div 2), (p, q) -> p ^ q)"
    differ = lambda a, b: f"aggregate(zip_with({a}, {b}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"
    least = f"CASE WHEN size({x}) = size({y}) THEN {differ(x, y)} WHEN size({x}) = 2 * size({y}) THEN {differ(half(x), y)} WHEN size({y}) = 2 * size({x}) THEN {differ(x, half(y))} ELSE 0 END"
    return F.expr(f"coalesce(({least}) * {100 + percent} <= ({nx} + {ny}) * {100 - percent}, true)")


def common_buckets(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of shingles that many rows hold, and how many: an estimate for ordering only, at most 2**BUCKET_BITS entries."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def make():
        words_of, counts, held, size = Words(), np.zeros(1 << BUCKET_BITS, np.int32), [], [0]

        def add():
            if held:
                counts[:] += np.bincount(np.concatenate(held), minlength=1 << BUCKET_BITS).astype(np.int32)
            held.clear()
            size[0] = 0

        def one(batch):
            for h in shingles(texts(batch), words_of, words):
                held.append((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
                size[0] += len(h)
            if size[0] >= 1 << BUCKET_BITS:
                add()
            return ()

        def finish():
            add()
            hot = np.flatnonzero(counts >= COMMON)
            yield record(schema, bucket=hot.astype(np.int32), n=counts[hot].astype(np.int64))

        one.finish = finish
        return one

    rows = arrow_pass(docs.select("text"), make, "bucket int, n long").groupBy("bucket").agg(F.least(F.sum("n"), F.lit(2**31 - 1)).alias("n"))
    parts = packed_words(rows.select(F.col("bucket").alias("word"), F.col("n").alias("bits")))
    none = np.zeros(0, np.int32)
    return np.concatenate([none, *(p[0] for p in parts)]), np.concatenate([none, *(p[1] for p in parts)])


def signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n (set size), two hashes of the set, its prefix (64-bit shingles, rare ones first) and its sketch."""
    buckets, counts = common_buckets(docs, words)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("prefix", pa.binary()), ("sketch", pa.list_(pa.int64()))])

    def make():
        words_of = Words()
        often = np.zeros(1 << BUCKET_BITS, np.int32)
        often[buckets] = counts

        def one(batch):
            n, s1, s2, prefixes, sketches = [], [], [], [], []
            for h in shingles(texts(batch), words_of, words):
                rank = often[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                n.append(len(h))
                s1.append(int(signed(mix64(h + np.uint64(1)).sum(dtype=np.uint64).reshape(1))[0]) if len(h) else 0)
                s2.append(int(signed(mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).reshape(1))[0]) if len(h) else 0)
                size = len(h) - required(len(h), percent) + 1 if len(h) else 0
                prefixes.append(h[np.lexsort((h, rank))[:size]].astype("<u8").tobytes())
                sketches.append(sketch(h))
            ends = np.cumsum([0, *map(len, sketches)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sketches), pa.int64()))
            yield record(schema, doc_id=batch.column("doc_id"), n=n, s1=s1, s2=s2, prefix=prefixes, sketch=lists)

        return one

    return materialise(arrow_pass(docs.select("doc_id", "text"), make, "doc_id long, n long, s1 long, s2 long, prefix binary, sketch array<long>"), "jaccard-signatures")


def prefix_rows(groups: DataFrame, percent: int) -> DataFrame:
    """token, gid, n and pos: a row for each prefix shingle of each group that another group shares and may be alike. A bitmap holds back most others before the shuffle; counts decide."""
    total = groups.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    of = lambda batch: (np.frombuffer(p, "<u8") for p in batch.column("prefix").to_pylist())
    bitmap = repeated_filter(groups.select("prefix"), of, max(4, -(-total // (8 * BUCKET_ROWS))), SHARED_BITS)
    schema = pa.schema([("token", pa.int64()), ("gid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def make():
        def one(batch):
            raw = batch.column("prefix").to_pylist()
            size = np.array([len(r) // 8 for r in raw])
            first = np.repeat(np.cumsum(size) - size, size)
            token = np.frombuffer(b"".join(raw), "<u8")
            keep = np.flatnonzero(in_bitmap(bitmap, token))
            yield record(
                schema,
                token=signed(token[keep]),
                gid=np.repeat(batch.column("gid").to_numpy(), size)[keep],
                n=np.repeat(batch.column("n").to_numpy(), size)[keep].astype(np.int32),
                pos=(np.arange(size.sum()) - first)[keep].astype(np.int32),
            )

        return one

    rows = materialise(arrow_pass(groups.select("gid", "n", "prefix"), make, "token long, gid long, n int, pos int"), "jaccard-prefixes")
    # of two groups it is plain at once whether they may be alike; of more, a row needs room beside the smallest size that may go with it
    several = rows.groupBy("token").agg(F.count("*").alias("sharers"), F.min("n").alias("least"), F.max("n").alias("most"), F.min(F.col("n") - F.col("pos")).alias("left"))
    fits = f"CAST(least AS long) * 100 >= CAST(most AS long) * {percent} AND CAST(left AS long) * {100 + percent} >= (CAST(least AS long) + most) * {percent}"
    several = several.where(f"sharers > 2 OR (sharers = 2 AND {fits})").select("token", "least")
    room = f"CAST(n - pos AS long) * {100 + percent} >= (n + GREATEST(CAST(least AS long), CEIL(n * {percent} / 100.0))) * {percent}"
    shared = materialise(rows.join(several, "token").where(room).drop("least"), "jaccard-shared")
    discard(rows)
    return shared


def alike(na: str, pa_: str, nb: str, pb: str, percent: int) -> F.Column:
    """Whether sizes (columns na, nb) and places (pa_, pb) of a shared shingle leave room for a similarity of percent."""
    a, b = F.col(na).cast("long"), F.col(nb).cast("long")
    left = F.least(a - F.col(pa_), b - F.col(pb))
    return (a * 100 >= b * percent) & (b * 100 >= a * percent) & (left * (100 + percent) >= (a + b) * percent)


def id_filter(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of hashed ids (node, which may repeat), of FILTER_BITS bits at most, whatever the number of ids. An estimate of their number sets its size."""
    n = ids.agg(F.approx_count_distinct("node")).first()[0]
    bits = min(FILTER_BITS, 1 << max(12, (16 * max(1, n) - 1).bit_length()))
    h = ids.select(F.pmod(F.xxhash64("node"), F.lit(bits)).alias("h"))
    words = h.groupBy(F.shiftright("h", 5).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 32 as int))")).alias("bits"))
    return bitmap_of(words, bits), bits


def packed(h: np.ndarray) -> bytes:
    """The upper 48 bits of each hash, 6 bytes each: sets of one pair hold no two alike but by a chance of 1e-9."""
    return np.ascontiguousarray((h >> np.uint64(16)).astype("<u8").view("<u2").reshape(-1, 4)[:, :3]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 4), "<u2")
    out[:, :3] = np.frombuffer(raw, "<u2").reshape(-1, 3)
    return out.view("<u8").ravel()


def sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """node and its sorted shingles, of all ids (and of a few more, which the bitmap lets pass)."""
    bitmap, bits = id_filter(ids)
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def make():
        words_of = Words()

        def one(batch):
            h = batch.column("h").to_numpy(zero_copy_only=False)
            keep = np.flatnonzero((bitmap[h >> 5] >> (h & 31).astype(np.uint32)) & 1)
            if len(keep):
                picked = batch.take(pa.array(keep))
                yield record(schema, node=picked.column("doc_id"), shingles=[*map(packed, shingles(texts(picked), words_of, words))])

        return one

    keyed = docs.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("h"))
    return materialise(arrow_pass(keyed, make, "node long, shingles binary"), "jaccard-sets")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike. pairs: distinct, and materialised."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def make():
        def one(batch):
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                u, v = unpacked(x), unpacked(y)
                both_ = np.sort(np.concatenate([u, v]))  # each side's are distinct
                inter = int((both_[1:] == both_[:-1]).sum())
                keep.append(100 * inter >= percent * (len(u) + len(v) - inter) and inter > 0)
            chosen = np.flatnonzero(keep)
            yield record(schema, a=batch.column("a").take(pa.array(chosen)), b=batch.column("b").take(pa.array(chosen)))

        return one

    return arrow_pass(both.select("a", "b", "sa", "sb"), make, "a long, b long")


def oriented(x: F.Column, y: F.Column) -> list[F.Column]:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps (node, component) after more links (a, b): only components that a link touches are gone through."""
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(comps, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    nodes = materialise(nodes, "jaccard-nodes")
    end = lambda x: nodes.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    moved = components(links.join(end("a"), "a").join(end("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")), "jaccard")
    every = comps.join(nodes, "node", "left_anti").union(nodes)
    out = every.join(moved.select(F.col("node").alias("component"), F.col("component").alias("low")), "component", "left").select("node", F.coalesce("low", "component").alias("component"))
    return materialise(out, "jaccard-components")


def settled(x: str, y: str) -> F.Column:
    """Whether groups x and y lie in one component as a whole."""
    return F.expr(f"{x}low = {x}high AND {y}low = {y}high AND {x}low = {y}low")


def hub_round(live: DataFrame, state: DataFrame, turn: int, percent: int, known: DataFrame) -> DataFrame:
    """The rows of shingles that still join components, each with its shingle's hub: hub, meets (whether the two may be alike and aren't in one component) and stays (whether the row is needed after this round)."""
    spread = live.join(state, "gid")
    weigh = F.struct("known", -F.col("gid")) if turn == 0 else F.struct((F.col("classes") == 1).cast("int").alias("one"), F.xxhash64("gid", F.lit(turn)))
    if turn == 0:
        spread = spread.join(known, "gid")
    hubs = spread.groupBy("token").agg(F.max(F.struct(weigh.alias("w"), "gid", "n", "pos", "low", "high", "classes")).alias("h"), F.min("low").alias("l"), F.max("high").alias("u"), F.count("*").alias("k"))
    hubs = hubs.where("l <> u").select("token", F.col("h.gid").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.pos").alias("hub_pos"), F.col("h.low").alias("hub_low"), F.col("h.high").alias("hub_high"), F.col("h.classes").alias("hub_classes"), "k")
    met = spread.join(hubs, "token")
    meets = (F.col("gid") != F.col("hub")) & alike("n", "pos", "hub_n", "hub_pos", percent) & ~settled("", "hub_")
    # a hub of one class has met all; with two groups left nothing stays
    stays = ~((F.col("gid") == F.col("hub")) & (F.col("hub_classes") == 1)) & (F.col("k") - (F.col("hub_classes") == 1).cast("int") > 1)
    return met.select("token", "gid", "n", "pos", "hub", meets.alias("meets"), stays.alias("stays")).where("meets or stays")


def nodes_in(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose node a bitmap of the ids (node) lets pass: all of the ids', and a few others."""
    bitmap, bits = id_filter(ids)
    columns = rows.columns

    def make():
        def one(batch):
            h = batch.column("_h").to_numpy(zero_copy_only=False)
            keep = np.flatnonzero((bitmap[h >> 5] >> (h & 31).astype(np.uint32)) & 1)
            if len(keep):
                yield batch.take(pa.array(keep)).select(columns)

        return one

    return arrow_pass(rows.withColumn("_h", F.pmod(F.xxhash64("node"), F.lit(bits))), make, rows.schema)


def sketched(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sketches leave room for, materialised."""
    wide = materialise(pairs, "jaccard-proposed")
    needed = materialise(nodes_in(sketches, wide.select(F.explode(F.array("a", "b")).alias("node"))), "jaccard-sketches")
    end = lambda x: needed.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    near = wide.join(end("b"), "b").join(end("a"), "a").where(close("sa", "na", "sb", "nb", percent)).select("a", "b").distinct()
    out = materialise(near, "jaccard-pairs")
    discard(needed)
    discard(wide)
    return out


def rest_pairs(live: DataFrame, state: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups (left, right) that share a shingle, don't lie in one component and may be alike.

    Of each shingle the groups outside its largest component meet all groups; those inside it needn't meet each other.
    """
    # a group of several classes has as many sketches, and is let pass
    own = nodes_in(sketches.select("node", "sketch"), live.select(F.col("gid").alias("node"))).withColumnRenamed("node", "gid")
    spread = materialise(live.join(state, "gid").join(own.groupBy("gid").agg(F.min("sketch").alias("sketch")), "gid", "left").withColumn("sketch", F.when(F.col("classes") == 1, F.col("sketch"))), "jaccard-rest")
    sizes = spread.groupBy("token", "low").agg(F.count("*").alias("k"))
    major = sizes.groupBy("token").agg(F.max(F.struct("k", "low")).alias("m")).select("token", F.col("m.low").alias("major"))
    placed = spread.join(major, "token").withColumn("minor", ~F.expr("low = high AND low = major")).drop("major")
    x, y = placed.where("minor").alias("x"), placed.alias("y")
    near = x.join(y, "token").where("x.gid < y.gid OR (NOT y.minor AND x.gid <> y.gid)").where(~settled("x.", "y.")).where(alike("x.n", "x.pos", "y.n", "y.pos", percent)).where(close("x.sketch", "x.n", "y.sketch", "y.n", percent))
    return near.select(F.least("x.gid", "y.gid").alias("left"), F.greatest("x.gid", "y.gid").alias("right")).distinct()


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n (set size) and component (smallest doc_id that links reach) of every row; a null doc_id has no component."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    full = signatures(docs, words, percent)
    signed_rows = materialise(full.drop("prefix", "sketch"), "jaccard-rows")
    whole = signed_rows.where("n > 0 and doc_id is not null")
    least = F.min(F.struct("doc_id", "prefix", "sketch")).alias("m")
    classes_full = materialise(full.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(least).select("n", "s1", "s2", F.col("m.doc_id").alias("rep"), "m.prefix", "m.sketch", F.md5("m.prefix").alias("key")), "jaccard-classes")
    discard(full)
    release(spark)
    classes = classes_full.drop("prefix", "sketch")
    heads = classes.groupBy("n", "key").agg(F.min("rep").alias("gid"))
    members = materialise(classes_full.drop("prefix").join(heads, ["n", "key"]).select("n", "s1", "s2", "rep", "gid", "sketch"), "jaccard-members")
    # a group's representative carries the prefix for all; classes that don't are few, as a rule
    carried = materialise(members.where("rep <> gid").select("n", "s1", "s2"), "jaccard-carried")
    shared = prefix_rows(classes_full.join(carried, ["n", "s1", "s2"], "left_anti").select(F.col("rep").alias("gid"), "n", "prefix"), percent)
    discard(classes_full)
    release(spark)
    known = shared.groupBy("gid").agg(F.count("*").alias("known"))
    sizes = members.groupBy("gid").agg(F.count("*").alias("classes"))
    several = sizes.where("classes > 1").select("gid")
    # classes that share nothing with another, in a group of their own, have no links
    active = materialise(members.join(known.select("gid").union(several).distinct(), "gid", "left_semi").select("rep", "gid"), "jaccard-active")
    sketches = members.select(F.col("rep").alias("node"), "n", "sketch")

    # rows of one doc_id with different texts belong together
    repeated = whole.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    same = whole.join(repeated, "doc_id").join(members.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"]).select(*oriented(F.col("doc_id"), F.col("rep"))).where("a <> b").distinct()
    comps = components(same, "jaccard")

    live, turn, links = shared, 0, 0
    while True:
        at = materialise(active.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "gid", F.coalesce("component", "rep").alias("comp")), "jaccard-state")
        state = at.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("classes"))
        last = turn >= HUB_ROUNDS or turn > 0 and not links
        if last:
            pairs = rest_pairs(live, state, sketches, percent).union(state.where("low <> high").select(F.col("gid").alias("left"), F.col("gid").alias("right")))
            one = lambda side, k: at.select(F.col("gid").alias(side), F.col("rep").alias(f"r{k}"), F.col("comp").alias(f"c{k}"))
            both = pairs.join(one("left", 1), "left").join(one("right", 2), "right")
        else:
            met = materialise(hub_round(live, state, turn, percent, known), "jaccard-met")
            if live is not shared:
                discard(live)
            pairs = met.where("meets").select("hub", "gid")
            if turn == 0:
                pairs = pairs.union(several.select(F.col("gid").alias("hub"), "gid"))
            hubs = at.where("rep = gid").select(F.col("gid").alias("hub"), F.col("rep").alias("r1"), F.col("comp").alias("c1")).distinct()
            both = pairs.distinct().join(at.select("gid", F.col("rep").alias("r2"), F.col("comp").alias("c2")), "gid").join(hubs, "hub")
        proposed = sketched(both.where("c1 <> c2").select(*oriented(F.col("r1"), F.col("r2"))).distinct(), sketches, percent)
        if not last:
            live = materialise(met.where("stays").select("token", "gid", "n", "pos"), "jaccard-live")
            discard(met)
        links = 0
        if not proposed.isEmpty():
            sets = sets_of(docs, proposed.select(F.explode(F.array("a", "b")).alias("node")), words)
            release(spark)
            found = materialise(verify(proposed, sets, percent), "jaccard-links")
            discard(sets)
            links = found.count()
            if links:
                comps = merged(comps, found)
            discard(found)
        discard(proposed)
        discard(at)
        release(spark)
        if last:
            break
        turn += 1
    keyed = signed_rows.join(members.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"], "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return keyed.select("doc_id", F.col("n"), alone.alias("component"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without those of a component that are not its smallest doc_id; rows with a null doc_id stay.

    A bitmap of the ids to drop lets most texts stay where they are; only rows that it can't clear go through the join.
    """
    release(docs.sparkSession)  # of whatever ran before
    node, hashed = unused(docs.columns, "_node"), unused(docs.columns, "_hash")
    drop = materialise(join(docs, words, percent).where("component <> doc_id").select(F.col("doc_id").alias("node")).distinct(), "jaccard-dropped")
    release(docs.sparkSession)
    bitmap, bits = id_filter(drop)
    columns = docs.columns
    keyed = docs.withColumn(hashed, F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(bits)), F.lit(0)))

    def part(hit: bool) -> DataFrame:
        def make():
            def one(batch):
                h = batch.column(hashed).to_numpy(zero_copy_only=False)
                keep = np.flatnonzero(((bitmap[h >> 5] >> (h & 31).astype(np.uint32)) & 1) == int(hit))
                if len(keep):
                    yield batch.take(pa.array(keep)).select(columns)

            return one

        return arrow_pass(keyed, make, docs.schema)

    gone = drop.withColumnRenamed("node", node)
    return part(False).union(part(True).join(gone, F.col("doc_id") == F.col(node), "left_anti").select(*columns))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = join(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


QUERIES = {"op7_jaccard": op7_jaccard}
