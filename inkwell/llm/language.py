"""Language identification with a blended-spectrum string kernel.

k(x, z) is the number of hashed character n-grams (N_GRAMS lengths together) present in both texts over the geometric
mean of the numbers present in each. LANDMARKS texts span the kernel's Nyström approximation; one ridge regression for
each language (one versus the rest, targets +1 and -1) is solved in that space. Texts are scored a batch at a time:
a presence matrix times the landmarks' gives kernels, and kernels times the weights give margins.

Only rows with a text, a language and crc32(doc_id) % 4 <> 2 are learned from: a sample of SAMPLE rows of each
language at most, by the order of hashes of doc_id and text; every language that occurs is learned. The driver holds
2 KB for each sampled row and 64 KB for each landmark. Null texts and texts without a letter are ``und``, score 0. Without any
row to learn from, everything is ``und``. Repeated rows are scored each; columns other than doc_id, text and lang
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import arrow_pass, materialise, record, table, texts

N_GRAMS = (1, 2, 3)
#: Buckets of the hashed n-grams.
BUCKETS = 1 << 14
#: Labelled rows of each language that are learned from at most, and landmarks in all and of each language at least.
SAMPLE, LANDMARKS, EACH = 400, 128, 2
RIDGE = 1e-3
UNKNOWN = "und"
#: Characters of one step of feature extraction, which bounds memory for very long texts.
STRETCH = 1 << 20
ROWS_AT_ONCE = 64


def presence(many: list[str]) -> np.ndarray:
    """A row of 0 and 1 for each text: which buckets its n-grams fall into. Letters are lower-cased; all else counts as a space."""
    out = np.zeros((len(many), BUCKETS), np.float32)
    flat = out.reshape(-1)
    longest = max(N_GRAMS)
    for row, text in enumerate(many):
        for at in range(0, len(text), STRETCH):
            part = text[max(0, at - longest + 1) : at + STRETCH].lower()
            code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
            code = np.where(((code >= 97) & (code <= 122)) | (code >= 0xC0), code, np.uint32(32))
            h = np.zeros(len(code), np.uint32)
            for n in range(1, longest + 1):
                if len(code) < n:
                    break
                h = h[: len(code) - n + 1] * np.uint32(0x9E3779B1) + code[n - 1 :] + np.uint32(n)
                if n in N_GRAMS:
                    x = h ^ (h >> np.uint32(15))
                    x = x * np.uint32(0x85EBCA6B)
                    flat[row * BUCKETS + (x >> np.uint32(18)).astype(np.int64)] = 1.0
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Model:
    """languages: sorted names; landmarks: their presence rows, divided by their norms; weights: from kernels to margins."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.languages, self.landmarks, self.weights = languages, landmarks, weights

    @staticmethod
    def kernels(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))
        return (rows @ landmarks.T) / norm

    @classmethod
    def fit(cls, bits: np.ndarray, names: list[str]) -> Model:
        """bits: a packed presence row for each name."""
        languages = sorted(set(names))
        number = {x: k for k, x in enumerate(languages)}
        of = np.array([number[x] for x in names])

        def unpacked(some: np.ndarray) -> np.ndarray:
            return np.unpackbits(some, axis=1).astype(np.float32)

        # landmarks alternate between the languages, in the order of the sample
        turn = np.zeros(len(of), np.int64)
        for k in range(len(languages)):
            turn[of == k] = np.arange((of == k).sum())
        picked = np.lexsort((of, turn))[: max(LANDMARKS, EACH * len(languages))]
        landmarks = unpacked(bits[picked])
        landmarks /= np.sqrt(np.maximum(landmarks.sum(1, keepdims=True), 1))
        inner = (landmarks @ landmarks.T).astype(np.float64)
        value, vector = np.linalg.eigh(inner)
        keep = value > 1e-6 * max(value.max(), 1e-12)
        whiten = vector[:, keep] / np.sqrt(value[keep])
        near = [cls.kernels(unpacked(bits[at : at + ROWS_AT_ONCE]), landmarks) for at in range(0, len(bits), ROWS_AT_ONCE)]
        features = np.vstack(near).astype(np.float64) @ whiten
        features = np.hstack([features, np.ones((len(features), 1))])
        target = np.where(of[:, None] == np.arange(len(languages)), 1.0, -1.0)
        # each language weighs the same
        weight = 1.0 / np.bincount(of, minlength=len(languages))[of]
        gram = (features * weight[:, None]).T @ features + RIDGE * np.eye(features.shape[1])
        solved = np.linalg.solve(gram, (features * weight[:, None]).T @ target)
        weights = np.vstack([whiten @ solved[:-1], solved[-1:]])
        return cls(languages, landmarks.astype(np.float32), weights.astype(np.float32))

    def margins(self, many: list[str]) -> np.ndarray:
        return self.kernels(presence(many), self.landmarks) @ self.weights[:-1] + self.weights[-1]


def fold(mod: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % mod


def sample(fit: DataFrame) -> DataFrame:
    """lang, key, tie and copies: the SAMPLE first (key, tie) of each language; each task finds its own first."""
    schema = pa.schema([("lang", pa.string()), ("keys", pa.list_(pa.struct([("key", pa.int64()), ("tie", pa.int64())])))])

    def make():
        held = {}

        def one(batch):
            for lang, key, tie in zip(*(batch.column(c).to_pylist() for c in ("lang", "key", "tie")), strict=True):
                first = held.setdefault(lang, [])
                first.append((key, tie))
                if len(first) >= 2 * SAMPLE:
                    held[lang] = sorted(first)[:SAMPLE]
            return ()

        def finish():
            for lang, first in held.items():
                yield record(schema, lang=[lang], keys=[[{"key": k, "tie": t} for k, t in sorted(first)[:SAMPLE]]])

        one.finish = finish
        return one

    firsts = arrow_pass(fit.select("lang", "key", "tie"), make, "lang string, keys array<struct<key:long,tie:long>>")
    merged = firsts.groupBy("lang").agg(F.slice(F.array_sort(F.flatten(F.collect_list("keys"))), 1, SAMPLE).alias("keys"))
    return merged.select("lang", F.explode("keys").alias("k")).groupBy("lang", "k.key", "k.tie").agg(F.count("*").alias("copies"))


def train(docs: DataFrame) -> Model | None:
    """docs: doc_id, text, lang of the rows that may be learned from. Feature rows come back as bits, SAMPLE for each language at most."""
    fit = docs.where("text is not null and lang is not null and lang <> ''").select("text", "lang", F.xxhash64("doc_id").alias("key"), F.xxhash64("text").alias("tie"))
    chosen = materialise(sample(fit), "language-sample")
    schema = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("tie", pa.int64()), ("copies", pa.int64()), ("bits", pa.binary())])

    def make():
        def one(batch):
            many = texts(batch)
            for k, text in enumerate(many):
                if has_letter(text):
                    yield record(schema, **{c: [batch.column(c)[k].as_py()] for c in ("lang", "key", "tie", "copies")}, bits=[np.packbits(presence([text])[0].astype(bool)).tobytes()])

        return one

    # rows of equal keys and texts are one row with its number of copies
    found = arrow_pass(fit.join(F.broadcast(chosen), ["lang", "key", "tie"]), make, "lang string, key long, tie long, copies long, bits binary")
    rows = found.groupBy("lang", "key", "tie", "copies").agg(F.min("bits").alias("bits")).collect()
    if not rows:
        return None
    rows = [r for r in sorted(rows, key=lambda r: (r.lang, r.key, bytes(r.bits))) for _ in range(r.copies)]
    bits = np.vstack([np.frombuffer(r.bits, np.uint8) for r in rows])
    return Model.fit(bits, [r.lang for r in rows])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score (the best margin's place between -1 and 1, as 0 to 1) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def make():
        def one(whole):
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                many = texts(batch)
                if model is None:
                    names, scores = [UNKNOWN] * len(many), [0.0] * len(many)
                else:
                    margins = model.margins(many)
                    best = margins.argmax(1)
                    letters = [has_letter(t) for t in many]
                    names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)]
                    top = np.clip((margins[np.arange(len(many)), best] + 1) / 2, 0, 1)
                    scores = [float(s) if ok else 0.0 for s, ok in zip(top, letters, strict=True)]
                yield record(schema, doc_id=batch.column("doc_id"), lang_pred=names, score=scores)

        return one

    return arrow_pass(docs.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang").where(fold(4) != 2))
    return identify(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language": op9_language}
