"""Operators that need a walk over a tree, a scanner or an iterative encoder: Arrow-fed Python, a batch at a time."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.blocks import Walker
from inkwell.functions.segment import plain, segment
from inkwell.operators.tokens import LONGEST, merged
from inkwell.plans.dialect import SparkDialect

BLOCK = "page_id long, block_no int, xpath string, kind string, tag string, text string, flags array<string>"
#: Rank arms: merge lists A (original), C (completed), D (C in seeded order), E (D without the added rules).
ARMS = ("A", "C", "D", "E")
#: Documents that are split at a time.
DOCUMENTS = 64
#: Pairs that a worker remembers the ranks of, for each arm.
RECENT = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(pages: DataFrame, version: int) -> DataFrame:
    """A row for each block of prose or title of each page."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, html in zip(batch["page_id"], batch["html"], strict=True):
                for k, b in enumerate(Walker(version).blocks(html or "")):
                    rows.append((key, k + 1, b["xpath"], b["kind"], b["tag"], b["text"], b["flags"]))
            yield pd.DataFrame(rows, columns=["page_id", "block_no", "xpath", "kind", "tag", "text", "flags"])

    return pages.select("page_id", "html").mapInPandas(walk, BLOCK)


def doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(table(spark, sf_dir, "pages"), 1).where("text <> ''")


def doc_blocks_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(table(spark, sf_dir, "pages"), 2).where("text <> ''").withColumn("text", F.translate("text", "", ""))


def sentence_split_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by the second rule set, with places in the text, and each document's distinct flags."""

    kinds = pa.list_(pa.string())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENTS):
                rows = []
                part = batch.slice(at, DOCUMENTS)
                for key, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    t = t or ""
                    found = segment(t)
                    flags = sorted(set(found.flags))
                    rows += [(key, k, plain(t[a:b]), a, b, flags) for k, (a, b) in enumerate(found.spans, 1)]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                types = (batch.schema.field("doc_id").type, pa.int32(), pa.string(), pa.int32(), pa.int32(), kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "sentence_no", "text", "start", "stop", "flags"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(split, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, sentence_no int, text string, start int, stop int, flags array<string>")


def journal_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by NFKC, outer and repeated white space, and case folding: ASCII ones by expressions, the rest in Python."""

    @F.pandas_udf("string")
    def fold(names: pd.Series) -> pd.Series:
        return names.map(lambda n: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", n).strip()).casefold(), na_action="ignore")

    names = table(spark, sf_dir, "documents").select(F.concat("source", F.lit(" "), F.substring("text", 1, 24)).alias("name")).distinct()
    ascii_ = F.col("name").rlike(r"^[\x00-\x7F]*$")
    quick = names.where(ascii_).select("name", F.lower(F.trim(F.regexp_replace("name", r"[ \t-\r]+", " "))).alias("journal_key"))
    return quick.union(names.where(~ascii_).select("name", fold("name")))


class Rules:
    """Merge rules as arrays: sorted keys, and each key's ranks and whether it was added; 17 bytes a rule, where dicts of pairs take hundreds for each arm.

    A key has 5 bits for each letter a-z of both parts and 4 bits for the length of the left one.
    """

    def __init__(self, keys: np.ndarray, rank_c: np.ndarray, rank_d: np.ndarray, added: np.ndarray):
        self.keys, self.rank_c, self.rank_d, self.added = keys, rank_c, rank_d, added

    @classmethod
    def of(cls, rules: pa.Table) -> Rules:
        keys = np.empty(rules.num_rows, np.int64)
        at = 0
        for part in rules.column("rule").chunks:
            keys[at : at + len(part)] = [pair_key(*x.split(" ")) for x in part.to_pylist()]
            at += len(part)
        order = np.argsort(keys)
        column = lambda name, kind: rules.column(name).to_numpy().astype(kind)[order]
        return cls(keys[order], column("rank_c", np.int32), column("rank_d", np.int32), column("is_added", bool))

    def arm(self, name: str) -> Arm:
        return Arm(self, self.rank_c if name in "AC" else self.rank_d, name in "CD")


class Arm:
    """The ranks of one merge list, looked up like a dict of pairs. Its length is above every rank."""

    def __init__(self, rules: Rules, ranks: np.ndarray, whole: bool):
        self.keys, self.ranks, self.added, self.whole = memoryview(rules.keys), memoryview(ranks), rules.added, whole
        self.recent: dict[tuple[str, str], int] = {}

    def __len__(self) -> int:
        return len(self.keys)

    def get(self, pair: tuple[str, str], default: int) -> int:
        rank = self.recent.get(pair)
        if rank is None:
            if len(self.recent) == RECENT:
                self.recent.clear()
            key = pair_key(*pair)
            at = bisect_left(self.keys, key)
            absent = at == len(self.keys) or self.keys[at] != key or not self.whole and self.added[at]
            rank = self.recent[pair] = -1 if absent else self.ranks[at]
        return default if rank < 0 else rank

    def __contains__(self, pair: tuple[str, str]) -> bool:
        return self.get(pair, len(self)) < len(self)


def pair_key(l: str, r: str) -> int:
    """A number for a pair of lower-case ASCII parts; 0, which no rule has, for pairs longer than a token."""
    if len(l) + len(r) > LONGEST:
        return 0
    key = 0
    for byte in (l + r).encode():
        key = key << 5 | byte - 96
    return key << 4 | len(l)


def encode_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Pair merging by least rank, leftmost first."""
    parts = list(word)
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda k: ranks.get((parts[k], parts[k + 1]), len(ranks)))
        if (parts[best], parts[best + 1]) not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


def encoded_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """word counts of each document, and each distinct word's tokens under every arm: encoded once, joined back."""
    rules = spark.sql(f"WITH {merged(SparkDialect(sf_dir, spark))} SELECT concat(l, ' ', r) AS rule, rank_c, rank_d, is_added FROM arm_d").toArrow()  # bounded by the vocabulary
    shared = spark.sparkContext.broadcast(Rules.of(rules))
    del rules
    counts = table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).where("word IS NOT NULL").groupBy("doc_id", "word").count()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arms = {arm: shared.value.arm(arm) for arm in ARMS}
        for batch in batches:
            out = {"word": batch["word"]}
            for arm, by in arms.items():
                out[f"tokens_{arm.lower()}"] = [encode_word(w, by) for w in batch["word"]]
            yield pd.DataFrame(out)

    schema = "word string, " + ", ".join(f"tokens_{a.lower()} array<string>" for a in ARMS)
    return counts, counts.select("word").distinct().mapInPandas(encode, schema)


def bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, words = encoded_words(spark, sf_dir)
    total = lambda a: F.sum(F.size(f"tokens_{a}") * F.col("count")).alias(f"tokens_{a}")
    return counts.join(words, "word").groupBy("doc_id").agg(F.sum("count").alias("words"), *(total(a.lower()) for a in ARMS))


def bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, words = encoded_words(spark, sf_dir)
    return words.select("word", *(F.expr(f"array_join(tokens_{a.lower()}, '') = word").alias(f"exact_{a.lower()}") for a in ARMS))


def prompt_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of each document under each arm, in long form, with changes against the first arm."""
    wide = bpe_token_counts(spark, sf_dir)
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.col(f"tokens_{a.lower()}").alias("prompt_tokens")) for a in ARMS)))
    return wide.select("doc_id", "tokens_a", pairs.alias("p")).select("doc_id", "p.arm", "p.prompt_tokens", (F.col("p.prompt_tokens") - F.col("tokens_a")).alias("delta_a"), (F.col("p.prompt_tokens") != F.col("tokens_a")).alias("changed"))


def segmentation_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of each document, by the alphabet, whose tokens differ between D and E."""
    counts, words = encoded_words(spark, sf_dir)
    differ = counts.join(words.where("tokens_d <> tokens_e"), "word")
    first = Window.partitionBy("doc_id").orderBy("word")
    return differ.withColumn("r", F.row_number().over(first)).where("r = 1").select("doc_id", "word", "tokens_d", "tokens_e")


QUERIES = (doc_blocks, doc_blocks_v2, sentence_split_v2, journal_key, bpe_token_counts, bpe_roundtrip, prompt_token_counts, segmentation_examples)
