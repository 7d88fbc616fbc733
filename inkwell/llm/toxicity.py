"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon transducer turns the words of a clause into symbols: insult (three levels, learned from labels), threat,
target, negation, reported speech, or an ordinary word. Three small transducers are composed into one grammar:
negation within a few words mutes an insult or threat; reported speech mutes the rest of its clause; a target near
an insult, or after a threat, adds weight. Each clause that holds an insult or threat gets the weight of its best
path, and a logistic link, fitted on the learning rows, turns a document's strongest clause and sum into a score.

Only rows with crc32(doc_id) % 5 <> 0 are learned from: POSITIVES and NEGATIVES labelled rows at most, in the order
of a hash, near copies among them once. Null and empty texts score as texts without a match. Without a label of
both kinds the lexicon is empty and every score is 0. Repeated labels of a document count once, toxic if any is.
Repeated documents are scored each. Columns of other names are passed by, or kept by ``reject``. Of near copies in the
sample the one with the least doc_id (then text) is learned from, and ties between lexicon entries go by length and
spelling, so the model doesn't depend on how rows are dealt. An empty table gives no rows. A text is scored whole.
The lexicon comes from words of 3 to 40 letters, of which CANDIDATES at most are gone through, commonest first.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import arrow_pass, discard, materialise, record, table, texts, unused

POSITIVES, NEGATIVES = 4000, 8000
#: Candidate lexicon entries that come to the driver at most: one for each letter sequence that is frequent in toxic rows only.
CANDIDATES = 6000
STEMS = (4, 5, 6, 7, 8)
#: Least log odds of an entry, and of the two higher levels.
ODDS, LEVELS = 2.5, (3.5, 4.5)
MEMORY = 300_000
#: Entries that may look toxic by chance.
CHANCES = 200_000

#: Function words of the grammar in the corpus's languages.
TARGETS = "you your yours youre he she they them him her his their this these those everyone people du dich dir ihr euch er sie die tu te toi vous il elle ils elles lui leur usted ustedes ellos ellas él ella".split()
NEGATIONS = "not no never isn't aren't wasn't weren't don't doesn't didn't cannot can't won't nobody nicht kein keine keiner nie niemals ne pas jamais aucun aucune non nunca jamás ni ningún ninguna".split()
REPORTS = "said says say wrote writes quoted quotes quote claimed claims reported called calls allegedly sagte sagt schrieb zitierte behauptet dit écrit déclaré selon dijo dice escribió citó según".split()
THREATS = "kill killing hurt destroy stab shoot burn beat strangle murder töten umbringen verletzen schlagen zerstören tuer blesser frapper détruire matar herir golpear destruir".split()
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE_ENDS = re.compile(r"[.!?;:\n]")
WEIGHT = {"L": 1.0, "M": 2.0, "H": 3.0, "V": 0.5}
MUTED, TARGETED, THREATENED = 0.2, 1.0, 3.0


class Transducer:
    """arcs[state][symbol] holds (next state, output, weight); a path's weight is the sum of its arcs' weights."""

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def compose(self, other: Transducer) -> Transducer:
        """The machine that feeds this one's outputs to the other."""
        start = (self.start, other.start)
        arcs, todo = {}, [start]
        while todo:
            here = todo.pop()
            if here in arcs:
                continue
            arcs[here] = out = {}
            for symbol, mine in self.arcs[here[0]].items():
                for there, output, w in mine:
                    for then, final, v in other.arcs[here[1]].get(output, ()):
                        out.setdefault(symbol, []).append(((there, then), final, w + v))
                        todo.append((there, then))
        return Transducer(start, arcs)

    def best(self, symbols: str) -> float:
        """Weight of the heaviest path that reads all symbols."""
        now = {self.start: 0.0}
        for s in symbols:
            after: dict = {}
            for state, w in now.items():
                for there, _, v in self.arcs[state].get(s, ()):
                    if w + v > after.get(there, -math.inf):
                        after[there] = w + v
            now = after
        return max(now.values(), default=0.0)


SYMBOLS = "oTNRVLMH"


def negation(reach: int = 3) -> Transducer:
    """State: how many words the last negation still reaches. Muted symbols are in lower case."""
    arcs = {}
    for left in range(reach + 1):
        arcs[left] = {s: [(reach if s == "N" else max(0, left - 1), s.lower() if left and s in "VLMH" else s, 0.0)] for s in SYMBOLS}
    return Transducer(0, arcs)


def reported() -> Transducer:
    """After a word of reporting, insults and threats of the clause are muted."""
    symbols = SYMBOLS + "vlmh"
    return Transducer(0, {seen: {s: [(1 if s == "R" else seen, s.lower() if seen and s in "VLMH" else s, 0.0)] for s in symbols} for seen in (0, 1)})


def targeted(reach: int = 4) -> Transducer:
    """State: words since a target, since an insult, since a threat, as far as they reach. A target adds to an insult or completes a threat."""
    arcs: dict = {}
    todo = [(0, 0, 0)]
    while todo:
        state = todo.pop()
        if state in arcs:
            continue
        target, insult, threat = (max(0, x - 1) for x in state)
        arcs[state] = out = {}
        for s in SYMBOLS + "vlmh":
            now, w = (target, insult, threat), 0.0
            if s in "LMH":
                w = WEIGHT[s] + (TARGETED if target else 0)
                now = (0 if target else target, 0 if target else reach, threat)
            elif s == "V":
                w, now = WEIGHT["V"], (target, insult, reach)
            elif s in "vlmh":
                w = MUTED * WEIGHT[s.upper()]
            elif s == "T":
                w = (TARGETED if insult else 0) + (THREATENED if threat else 0)
                now = (reach, 0, 0)
            out[s] = [(now, s, w)]
            todo.append(now)
    return Transducer((0, 0, 0), arcs)


def grammar() -> Transducer:
    return negation().compose(reported()).compose(targeted())


class Scorer:
    """lexicon: word or stem (ending in '-') to level; link: intercept and weights of the strongest clause and of the sum."""

    def __init__(self, lexicon: dict[str, str], link: tuple[float, float, float] | None = None):
        self.grammar, self.link = grammar(), link
        self.words = dict.fromkeys(TARGETS, "T") | dict.fromkeys(THREATS, "V") | dict.fromkeys(REPORTS, "R") | dict.fromkeys(NEGATIONS, "N")
        self.words |= {w: level for w, level in lexicon.items() if w[-1] != "-"}
        self.stems = {w[:-1]: level for w, level in lexicon.items() if w[-1] == "-"}
        self.sizes = sorted({len(x) for x in self.stems})
        self.chunks: dict[str, str] = {}
        self.clauses: dict[str, float] = {}

    def symbol(self, word: str) -> str:
        found = self.words.get(word)
        if found is None:
            found = next((self.stems[word[:k]] for k in self.sizes if len(word) > k and word[:k] in self.stems), "o")
        return found

    def chunk(self, chunk: str) -> str:
        """Symbols of a chunk between spaces; '.' for the end of a clause."""
        out, at = [], 0
        for m in WORD.finditer(chunk):
            if CLAUSE_ENDS.search(chunk, at, m.start()):
                out.append(".")
            out.append(self.symbol(m[0].lower()))
            at = m.end()
        if CLAUSE_ENDS.search(chunk, at):
            out.append(".")
        return "".join(out)

    def matches(self, text: str) -> list[float]:
        """Weights of the clauses that hold an insult or a threat."""
        chunks = self.chunks
        parts = text.replace("\n", " ; ").split()
        for p in parts:
            if p not in chunks:
                if len(chunks) >= MEMORY:
                    self.chunks = chunks = {}
                    symbols = "".join(map(self.chunk, parts))
                    break
                chunks[p] = self.chunk(p)
        else:
            symbols = "".join(map(chunks.__getitem__, parts))
        if not any(s in symbols for s in "VLMH"):
            return []
        out = []
        for clause in symbols.split("."):
            if any(s in clause for s in "VLMH"):
                w = self.clauses.get(clause)
                if w is None:
                    w = self.grammar.best(clause)
                    if len(clause) <= 200 and len(self.clauses) < MEMORY:
                        self.clauses[clause] = w
                out.append(w)
        return out

    def features(self, text: str) -> tuple[float, float]:
        found = self.matches(text)
        return (max(found), math.log1p(sum(found))) if found else (0.0, 0.0)

    def score(self, text: str) -> float:
        if self.link is None:
            return 0.0
        a, b = self.features(text)
        z = self.link[0] + self.link[1] * a + self.link[2] * b
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def fold(mod: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % mod


def sketches(text: str) -> tuple[int, int]:
    """Two least hashes of three-word runs: near copies mostly share them."""
    words = text.lower().split()
    runs = [zlib.crc32(" ".join(words[k : k + 3]).encode("utf-8", "surrogatepass")) for k in range(max(1, len(words) - 2))]
    return min(runs), min((r * 2654435761 + 12345) & 0xFFFFFFFF for r in runs)


def entries_of(text: str) -> set[str]:
    out = set()
    for w in set(map(str.lower, WORD.findall(text))):
        if 3 <= len(w) <= 40:
            out.add(w)
            out.update(f"{w[:k]}-" for k in STEMS if len(w) > k)
    return out


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and toxic of the learning rows; near copies once for each label."""
    spark = docs.sparkSession
    marked = labels.where("doc_id is not null and toxic is not null").where(fold(5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    key = F.xxhash64("doc_id")
    top = marked.where("toxic = 1").orderBy(key, "doc_id").limit(POSITIVES).union(marked.where("toxic = 0").orderBy(key, "doc_id").limit(NEGATIVES))
    ids = spark.createDataFrame([(r.doc_id, r.toxic) for r in top.collect()], "doc_id long, toxic int")  # POSITIVES + NEGATIVES rows at most
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("toxic", pa.int32()), ("one", pa.int64()), ("two", pa.int64())])

    def make():
        def one(batch):
            many = texts(batch)
            both = [sketches(t) for t in many]
            yield record(schema, doc_id=batch.column("doc_id"), text=many, toxic=batch.column("toxic"), one=[a for a, _ in both], two=[b for _, b in both])

        return one

    found = arrow_pass(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), make, "doc_id long, text string, toxic int, one long, two long")
    # of near copies the least row stays, however the rows are dealt
    first = found.groupBy("toxic", "one").agg(F.min(F.struct("doc_id", "text", "two")).alias("m")).select("toxic", "m.*")
    first = first.groupBy("toxic", "two").agg(F.min(F.struct("doc_id", "text")).alias("m")).select("m.doc_id", "m.text", "toxic")
    return materialise(first, "toxicity-sample")


def learn_lexicon(rows: DataFrame, positives: int, negatives: int) -> dict[str, str]:
    """Words and stems that mark toxic rows. A stem that covers as much as a longer entry gives way to the longer one."""
    schema = pa.schema([("entry", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())])

    def make():
        pos, neg = Counter(), Counter()

        def one(batch):
            for text, toxic in zip(texts(batch), batch.column("toxic").to_pylist(), strict=True):
                (pos if toxic else neg).update(entries_of(text))
            return ()

        def finish():
            keys = [k for k in pos.keys() | neg.keys()]
            for at in range(0, len(keys), 20_000):
                part = keys[at : at + 20_000]
                yield record(schema, entry=part, pos=[pos[k] for k in part], neg=[neg[k] for k in part])

        one.finish = finish
        return one

    # so many rows, all of them toxic, are not a matter of chance among CHANCES entries
    least = max(3, math.ceil(math.log(CHANCES) / math.log((positives + negatives) / positives)))
    counted = arrow_pass(rows.select("text", "toxic"), make, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (positives + 1)) - F.log((F.col("neg") + 0.5) / (negatives + 1))
    kept = counted.where(F.col("pos") >= least).withColumn("odds", odds).where(F.col("odds") >= ODDS).where("neg <= 0.1 * pos")
    found = {r.entry: (r.pos, r.neg, r.odds) for r in kept.orderBy(F.desc("pos"), "entry").limit(CANDIDATES).collect()}
    if not found:
        return {}
    lists = pa.schema([("hits", pa.list_(pa.string()))])

    def make_hits():
        def one(batch):
            yield record(lists, hits=[sorted(entries_of(t).intersection(found)) for t in texts(batch)])

        return one

    hits = [set(r.hits) for r in arrow_pass(rows.where("toxic = 1").select("text"), make_hits, "hits array<string>").collect()]  # POSITIVES rows at most
    by: dict[str, set[int]] = {}
    for k, h in enumerate(hits):
        for e in h:
            by.setdefault(e, set()).add(k)
    chosen, open_rows = [], set(range(len(hits)))
    while by:
        gain = {e: len(s & open_rows) for e, s in by.items()}
        best = max(gain, key=lambda e: (gain[e] - 3 * found[e][1], len(e), e))
        if gain[best] < max(2, least // 3):
            break
        chosen.append(best)
        open_rows -= by.pop(best)
    chosen += [e for e in by if found[e][1] == 0 and found[e][0] >= 2 * least]
    # a stem says no more than a longer entry that as many rows hold
    chosen = [e for e in chosen if e[-1] != "-" or not any(o != e and o.startswith(e[:-1]) and found[o][0] >= found[e][0] for o in chosen)]
    level = lambda x: "LMH"[sum(x >= y for y in LEVELS)]
    return {e: level(found[e][2]) for e in chosen}


def fit_link(features: np.ndarray, toxic: np.ndarray, ridge: float = 1e-3) -> tuple[float, float, float]:
    """Logistic regression on the two features, both labels weighing the same (Newton's method)."""
    x = np.hstack([np.ones((len(features), 1)), features])
    weight = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic == 0).sum()))
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - toxic)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, str], tuple[float, float, float] | None]:
    """The lexicon and the link."""
    rows = sample(docs, labels)
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        discard(rows)
        return {}, None
    lexicon = learn_lexicon(rows, n[1], n[0])
    schema = pa.schema([("toxic", pa.int32()), ("a", pa.float64()), ("b", pa.float64())])

    def make():
        scorer = Scorer(lexicon)

        def one(batch):
            both = [scorer.features(t) for t in texts(batch)]
            yield record(schema, toxic=batch.column("toxic"), a=[x for x, _ in both], b=[x for _, x in both])

        return one

    got = sorted(arrow_pass(rows.select("text", "toxic"), make, "toxic int, a double, b double").collect())  # the sample's rows
    discard(rows)
    return lexicon, fit_link(np.array([(r.a, r.b) for r in got]), np.array([r.toxic for r in got]))


def score(docs: DataFrame, model: tuple[dict[str, str], tuple[float, float, float] | None], name: str = "toxicity") -> DataFrame:
    """docs with a column of scores, which replaces one of that name."""
    fields = [f for f in docs.schema.fields if f.name != name]
    kept = [f.name for f in fields]
    base = docs.select(kept)

    def make():
        scorer = Scorer(*model)

        def one(batch):
            found = [scorer.score(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(found, pa.float64())], names=[*kept, name])

        return one

    return arrow_pass(base, make, type(docs.schema)(list(base.schema.fields)).add(name, "double"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows whose score stays under the threshold, with their columns."""
    name = unused(docs.columns, "_toxicity")
    return score(docs, train(docs, labels), name).where(F.col(name) < threshold).drop(name)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model, "score").select("doc_id", (fold(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
