"""Byte-level BPE through a sentencepiece model that is serialised directly from a rank vocabulary.

Each byte sequence of the vocabulary becomes a piece of printable stand-in characters, one for each byte, with the
negative rank as its score; normalisation is the identity. A merge of least rank is then a merge of highest score,
so sentencepiece's BPE search gives the same segmentation. Pre-tokens are encoded one by one, a pre-token that is in
the vocabulary as a whole is its own id, and ids are decoded by the inverse of the byte map.

Null text counts as empty and has no ids; repeated rows are encoded each; other columns stay as they are, unless
they are named ids or decoded, which the results replace.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterable
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.common import arrow_pass, remembered, table, texts

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct pre-tokens, and distinct chunks, that a worker remembers at most; beyond it, it starts anew.
REMEMBERED, CHUNKS = 400_000, 120_000
#: A space beside other white space or at an end.
CROWDED = re.compile(r"^ | $| \s|\s ")
ROWS_AT_ONCE = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is printable in Latin-1, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _chunk(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialise_model(pieces: Iterable[str]) -> bytes:
    """A sentencepiece ModelProto of type BPE: piece k (in order of rank) has id k + 1 and score -k; id 0 is <unk>."""
    unknown = _chunk(1, b"<unk>") + struct.pack("<Bf", 2 << 3 | 5, 0.0) + _number(3, 2)
    out, n = [_chunk(1, unknown)], 1
    for k, piece in enumerate(pieces):
        out.append(_chunk(1, _chunk(1, piece.encode()) + struct.pack("<Bf", 2 << 3 | 5, -float(k))))
        n += 1
    trainer = _number(3, 2) + _number(4, n) + _number(40, 0) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    normalizer = _chunk(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join([*out, _chunk(2, trainer), _chunk(3, normalizer)])


class Codec:
    """Encodes texts to ranks and decodes ranks to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        letters = byte_letters()
        self.split = regex.compile(pattern).findall
        self.ordered = sorted(ranks, key=ranks.__getitem__)
        self.rank_of = [-1, *(ranks[t] for t in self.ordered)]
        self.ranks = ranks
        self.to_letters = {b: letters[b] for b in range(256)}
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(serialise_model(t.decode("latin-1").translate(self.to_letters) for t in self.ordered))
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.memo: dict[str, list[int]] = {}
        self.chunks: dict[str, list[int]] = {}

    def learn(self, pre_tokens: Iterable[str]) -> None:
        """Fills the memo for these pre-tokens."""
        whole, rest = self.ranks, []
        for token in pre_tokens:
            raw = token.encode("utf-8", "surrogatepass")
            if raw in whole:
                self.memo[token] = [whole[raw]]
            else:
                rest.append((token, raw.decode("latin-1").translate(self.to_letters)))
        rank_of = self.rank_of
        for (token, _), ids in zip(rest, self.model.encode([x for _, x in rest], out_type=int, num_threads=1), strict=True):
            self.memo[token] = [rank_of[i] for i in ids]

    def pre_tokens(self, texts: Iterable[str]) -> list[list[int]]:
        """Ids of each text by its pre-tokens."""
        memo = self.memo
        found = [self.split(t) for t in texts]
        if new := set(chain.from_iterable(found)).difference(memo):
            if len(memo) + len(new) > REMEMBERED:
                memo.clear()
                new = set(chain.from_iterable(found))
            self.learn(new)
        return [list(chain.from_iterable(map(memo.__getitem__, pre))) for pre in found]

    def encode(self, many: list[str]) -> list[list[int]]:
        """A space between two characters that are none begins a pre-token, so the chunks after such spaces are encoded once and remembered."""
        chunks, out = self.chunks, []
        for text in many:
            if CROWDED.search(text):
                out += self.pre_tokens([text])
                continue
            first, *rest = text.split(" ")
            if new := set(rest).difference(chunks):
                if len(chunks) + len(new) > CHUNKS:
                    chunks.clear()
                    new = set(rest)
                chunks.update(zip(new, self.pre_tokens([f" {c}" for c in new]), strict=True))
            out.append(list(chain(self.pre_tokens([first])[0], chain.from_iterable(map(chunks.__getitem__, rest)))))
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def make_codec(vocabulary: str | None = None, pattern: str | None = None) -> Codec:
    """vocabulary: path of a file of base64 tokens and ranks; None: the public multilingual one, found on the machine that runs.

    One for each worker process: what it remembers serves its later tasks of this kind.
    """
    import public_tokenizers

    return remembered(("bpe", vocabulary, pattern), lambda: Codec(read_ranks(vocabulary or public_tokenizers.path(VOCABULARY)), pattern or public_tokenizers.PATTERN))


def _kept(docs: DataFrame, *made: str) -> list[T.StructField]:
    return [f for f in docs.schema.fields if f.name not in made]


def encode(docs: DataFrame, text: str = "text", vocabulary: str | None = None, pattern: str | None = None, decoded: bool = False) -> DataFrame:
    """docs with ids (array of int) of each text; decoded: also the bytes that decoding these ids gives."""
    fields = _kept(docs, "ids", "decoded")
    kept, of = [f.name for f in fields], text
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.BinaryType())] * decoded)

    def make():
        codec = make_codec(vocabulary, pattern)

        def one(whole: pa.RecordBatch):
            for k in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(k, ROWS_AT_ONCE)
                ids = codec.encode(texts(batch, of))
                columns = [*map(batch.column, kept), pa.array(ids, pa.list_(pa.int32()))]
                if decoded:
                    columns.append(pa.array([codec.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "ids", *["decoded"] * decoded])

        return one

    return arrow_pass(docs, make, schema)


def decode(encoded: DataFrame, ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """encoded with decoded: the bytes of each row's ids; null ids count as none."""
    fields = _kept(encoded, "decoded")
    kept, of = [f.name for f in fields], ids

    def make():
        codec = make_codec(vocabulary)

        def one(batch: pa.RecordBatch):
            found = [codec.decode(x or ()) for x in batch.column(of).to_pylist()]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(found, pa.binary())], names=[*kept, "decoded"])

        return one

    return arrow_pass(encoded, make, T.StructType([*fields, T.StructField("decoded", T.BinaryType())]))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
