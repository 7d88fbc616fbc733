"""Secret scans: base patterns, and weak parts that only count when complementary parts co-occur in a scope.

Base kinds (leftmost non-overlapping matches, each kind on its own): ``assign`` (a named value, 6 characters or more),
``access`` (an access key id, 20 or more) and ``hex`` (24 digits or more). The linking step adds spans:

* parts of a credential are access identifiers (``access``, or a named user or client id), secrets (``assign`` and
  ``hex``, or a weak candidate: a mixed token of WEAK characters or more, high in entropy, that no base span covers)
  and endpoints (a URL, or a named host);
* a scope is the stretch of SCOPE characters around a part. Parts of a document are joined by interval: an endpoint or
  identifier reaches a secret whose span begins within its scope. So that no part meets all others of a very long
  document, parts are bucketed by start // SCOPE and a scope touches two buckets;
* a weak candidate is reported (``weak``) only if an identifier and an endpoint lie in its scope: the complementary
  parts that make it usable. An endpoint is reported (``endpoint``) with an identifier and a secret in its scope, a
  named identifier (``ident``) with a secret and an endpoint.

Counting parts inside buckets replaces pairs: each bucket keeps its parts' kinds with the least and greatest start, so
a bucket of very many parts costs one row. Null text counts as empty. Rows of equal doc_id stay apart by an own row
key. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import arrow_pass, materialise, ordered, record, table, texts, written

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: The same names in lower case; a text that lacks them all holds no assignment.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ENDPOINT = re.compile(r"(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp)://[^\s\"'<>]+|(?<![A-Za-z0-9_])(?:host|hostname|server|endpoint|base_url)[\"']?\x20{0,4}[:=]\x20{0,4}[\"']?([A-Za-z0-9.-]+(?::[0-9]+)?)")
IDENT = re.compile(r"(?<![A-Za-z0-9_])(?:user|username|login|account|client_id|access_key|key_id)[\"']?\x20{0,4}[:=]\x20{0,4}[\"']?([A-Za-z0-9@._+-]{3,})", re.IGNORECASE | re.ASCII)
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])", re.DOTALL)
WEAK, ENTROPY = 16, 3.3
#: Characters that a scope reaches to either side.
SCOPE = 300
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "endpoint", "ident", "weak")
SPANS = "array<struct<start:long,stop:long,kind:int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base kinds, by start and kind."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Endpoints, named identifiers and weak candidates outside base spans. A text without an identifier or endpoint has none to link."""
    out = []
    low = text.lower()
    if "://" in text or any(n in text for n in ("host", "server", "endpoint", "base_url")):
        out += [(*(m.span(1) if m[1] else m.span()), 3) for m in ENDPOINT.finditer(text)]
    if any(n in low for n in ("user", "login", "account", "client_id", "access_key", "key_id")):
        out += [(*m.span(1), 4) for m in IDENT.finditer(text)]
    if out or any(k == 1 for _, _, k in base):
        taken = sorted([(a, b) for a, b, _ in base] + [(a, b) for a, b, _ in out])
        at = 0
        for m in TOKEN.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if (at == len(taken) or taken[at][0] >= m.end()) and MIXED.match(m[0]) and entropy(m[0]) >= ENTROPY:
                out.append((*m.span(), 5))
    return out


def find_parts(docs: DataFrame) -> DataFrame:
    """row, doc_id, base (spans of the base kinds) and more (further parts of a credential)."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.int32())]))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("base", span), ("more", span)])
    named = lambda spans: [{"start": a, "stop": b, "kind": k} for a, b, k in spans]

    def make():
        def one(batch):
            base = [base_spans(t) for t in texts(batch)]
            more = [parts(t, b) for t, b in zip(texts(batch), base, strict=True)]
            yield record(schema, row=batch.column("row"), doc_id=batch.column("doc_id"), base=[*map(named, base)], more=[*map(named, more)])

        return one

    keyed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return arrow_pass(keyed, make, f"row long, doc_id long, base {SPANS}, more {SPANS}")


def link(found: DataFrame) -> DataFrame:
    """row and the added spans: parts with complementary parts in scope.

    An interval join on buckets of SCOPE characters: each part looks into its own bucket and both neighbours, where
    the nearest start of each role to either side is enough to know whether one lies within SCOPE.
    """
    each = found.where("size(more) > 0").select("row", F.explode(F.concat("base", "more")).alias("s")).select("row", "s.*").distinct()
    role = F.when(F.col("kind").isin(1, 4), "identifier").when(F.col("kind") == 3, "endpoint").otherwise("secret")
    each = each.withColumn("role", role).withColumn("bucket", F.floor(F.col("start") / SCOPE))
    ends = each.groupBy("row", "bucket", "role").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    # the bucket's own parts always lie within SCOPE; of a neighbour the end that is nearer to the part decides
    seen = each.select("row", "bucket").distinct().select("row", F.col("bucket").alias("home"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    near = seen.join(ends, ["row", "bucket"]).groupBy("row", "home").agg(*[
        F.max(F.when((F.col("role") == r) & (F.col("bucket") == F.col("home") + d), F.col(edge))).alias(f"{r}_{side}")
        for r in ("identifier", "endpoint", "secret") for d, edge, side in ((-1, "high", "before"), (0, "low", "own"), (1, "low", "after"))
    ])
    scoped = each.withColumnRenamed("bucket", "home").join(near, ["row", "home"])

    def within(r: str) -> F.Column:
        before, after = F.col(f"{r}_before"), F.col(f"{r}_after")
        return F.coalesce(F.col("start") - before <= SCOPE, F.lit(False)) | F.col(f"{r}_own").isNotNull() | F.coalesce(after - F.col("start") <= SCOPE, F.lit(False))

    complete = (
        F.when(F.col("kind") == 5, within("identifier") & within("endpoint"))
        .when(F.col("kind") == 3, within("identifier") & within("secret"))
        .when(F.col("kind") == 4, within("secret") & within("endpoint"))
        .otherwise(False)
    )
    return scoped.where(complete).groupBy("row").agg(F.collect_list(F.struct("start", "stop", "kind")).alias("added"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (base and added, by start and kind) of every row."""
    found = materialise(find_parts(docs), "secret-parts")
    spans = F.concat("base", F.coalesce("added", F.array().cast(SPANS)))
    return found.join(link(found), "row", "left").select("doc_id", "base", ordered(spans).alias("spans"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(BASE)),
        F.sha2(written("base", KINDS), 256).alias("base_sha256"),
        written("spans", KINDS).alias("spans"),
    )


QUERIES = {"op3_secrets": op3_secrets}
