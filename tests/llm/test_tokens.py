import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import bpe, common, token_file

from .helpers import EDGES, documents


def test_byte_bpe_equals_tiktoken(spark, tmp_path):
    import tiktoken

    sf = documents(spark, EDGES, tmp_path)
    expect = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(bpe.VOCABULARY)), special_tokens={})
    got = {r.doc_id: r for r in bpe.op5_byte_bpe(spark, sf).collect()}
    assert len(got) == len(EDGES)
    for key, text in EDGES:
        ids = expect.encode_ordinary(text or "")
        assert (got[key].n_tokens, got[key].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[key].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_byte_bpe_keeps_columns_and_replaces_clashing_ones(spark):
    df = spark.createDataFrame([(1, "ab cd", "old")], "doc_id long, text string, ids string")
    row = bpe.decode(bpe.encode(df)).first()
    assert bytes(row.decoded) == b"ab cd" and row.doc_id == 1
    assert bpe.encode(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=300))
def test_packing_round_trip(ids):
    ids = np.array(ids, np.uint32)
    lengths = token_file.limited_lengths(np.bincount(ids, minlength=401), 12)
    codes = token_file.canonical_codes(lengths)
    payload, checkpoints = token_file.pack(ids, lengths, codes)
    assert (token_file.unpack(payload, checkpoints, len(ids), token_file.decoding_table(lengths)) == ids).all()


@pytest.mark.parametrize("longest", [4, 5, 8, 16])
def test_lengths_are_optimal_within_the_limit(longest):
    rng = np.random.default_rng(longest)
    counts = (2.0 ** rng.integers(0, 14, 14)).astype(np.int64)
    lengths = token_file.limited_lengths(counts, longest).astype(int)
    assert lengths.max() <= longest and sum(2.0**-x for x in lengths) <= 1
    if longest == 16:  # not limited here: an ordinary Huffman code
        import heapq

        heap, total = [(int(c), i) for i, c in enumerate(counts)], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            total += a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], a[1]))
        assert int((counts * lengths).sum()) == total


def test_token_file_equals_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    sf = documents(spark, EDGES, tmp_path)
    t = Tokenizer.from_file(P.path(token_file.TOKENIZER))
    t.encode_special_tokens = True
    got = {r.doc_id: r for r in token_file.op10_huffman_tokens(spark, sf).collect()}
    start = 0
    for key, text in EDGES:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, token_file.END_ID]
        assert (got[key].start, got[key].n_tokens) == (start, len(ids))
        assert got[key].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_file_of_an_empty_table(spark, tmp_path):
    sf = documents(spark, EDGES, tmp_path / "full")
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert token_file.op10_huffman_tokens(spark, f"{tmp_path}/none").count() == 0


def test_token_file_knows_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(1, "a b<|endoftext|> c"), (2, "plain"), (3, "<|startoftext|>A\u00a0B <|ENDOFTEXT|> <|endoftext|"), (4, "x\n<|endoftext|><|startoftext|>\n")]
    t = Tokenizer.from_file(P.path(token_file.TOKENIZER))
    got = {r.doc_id: r for r in token_file.op10_huffman_tokens(spark, documents(spark, rows, tmp_path)).collect()}
    start = 0
    for key, text in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, token_file.END_ID]
        assert (got[key].start, got[key].n_tokens) == (start, len(ids))
        assert got[key].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_workers_forget_what_their_task_does_not_ask_for():
    made = []
    ask = lambda key: lambda: common.remembered(key, lambda: made.append(key) or key)
    assert [common.begin(ask("a")), common.begin(ask("a")), common.begin(ask("b")), common.begin(ask("a"))] == ["a", "a", "b", "a"]
    assert made == ["a", "b", "a"]
    common.begin(lambda: None)


def test_full_memories_keep_their_younger_half(monkeypatch):
    monkeypatch.setattr(token_file, "CHUNKS", 40)
    monkeypatch.setattr(token_file, "WORDS", 30)
    small, fresh = token_file.Encoder(), token_file.Encoder().whole
    for k in range(30):
        text = f"The same words and Word{chr(97 + k % 26)}x, schön{chr(97 + k % 26)}ß w{k} don't {'日本 ' if k % 7 == 0 else ''}x{k}y. " * 2
        assert small.encode(text) == fresh(text)
        if k > 10:
            assert 20 <= len(small.chunks) <= 40 and 15 <= len(small.words) <= 30
