"""Personal data by patterns and by bootstrapped contextual extraction, in DataFrame functions only.

Base kinds (leftmost non-overlapping matches, each kind on its own): ``email``, ``ip`` (parts up to 255), ``card``
(12 to 19 digits that pass Luhn) and ``phone`` (9 to 15 digits). They seed the extraction:

* instances are tokens: what follows a label (a word of two letters or more before ':', '=' or '#'; spaces may come
  between, and any white space after), and every piece between white space that holds a digit or '@', without
  punctuation around it. An instance that overlaps a base span is a seed, with score 1;
* lexical patterns are contexts of instances: ``label``, the word ``before`` and the word ``after``. A pattern's
  confidence is the sum of the scores of its distinct instances over their number and, for words before and after, that
  of the word's other occurrences in the whole corpus: ordinary words come to nothing;
* ROUNDS times, patterns are scored from instances and unseen instances from the patterns they occur with: for a
  pattern, an instance's score is the chance that another of its patterns is right, 1 - prod(1 - confidence). So a
  token that one pattern finds makes other patterns known, which no seed may stand beside;
* patterns with a confidence of CONFIDENCE, and SUPPORT distinct instances that score as much, discover the instances
  that hold a digit or '@' and overlap no base span: kind ``context``.

The patterns below find what the plain ones would: a look-behind keeps a match from starting inside a run that a
leftmost search would have taken whole, so that very long runs cost linear time; running sums and maxima over many
matches of one text go by CHUNK. Null text counts as empty. Rows of equal doc_id, and repeated rows, stay apart. An
empty table gives no rows. Spans are in code points, end exclusive; of equal starts, the kind listed first comes
first. ``redact`` keeps all columns of its input, whatever their names, and replaces spans in ``text``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import materialise, table, unused, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "context")
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this can't hold the kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
LABEL = r"(?<![\p{L}_])[\p{L}_]{2,}+\x20*+[:=#]\s*+[^\s\"'<>]++"
LABEL_PARTS = r"(?s)^([\p{L}_]++)\x20*+[:=#]\s*+(.*)$"
#: A piece between white space with a digit or '@', and the words of a context (of at most NEAR characters to either side).
MARKED = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
NEAR = 64
ROUNDS, CONFIDENCE, SUPPORT = 3, 0.7, 3
#: Matches of a text that are summed up in one step, and characters of a stretch of text.
CHUNK, STRETCH = 256, 4096
CUE = "array<struct<pattern:string,token:string,start:long,stop:long>>"


def bound(value: F.Column, body: Callable[[F.Column], F.Column]) -> F.Column:
    """body of a value that is worked out once, where functions of array elements would do so for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: F.Column, join: Callable[[F.Column, F.Column], F.Column]) -> F.Column:
    """The sums (or maxima, as join says) of an array of longs up to each of its places, a chunk of CHUNK at a time."""
    none = F.array().cast("array<long>")

    def along(array: F.Column) -> F.Column:
        return F.aggregate(array, none, lambda done, v: F.array_append(done, F.when(F.size(done) > 0, join(F.element_at(done, -1), v)).otherwise(v)))

    def chunked(values: F.Column) -> F.Column:
        starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: along(F.slice(values, at, F.lit(CHUNK))))

    def joined(parts: F.Column) -> F.Column:
        ends = along(F.transform(parts, lambda part: F.element_at(part, -1)))
        before = F.slice(F.concat(F.array(F.lit(None).cast("long")), ends), F.lit(1), F.size(parts))
        return F.flatten(F.zip_with(parts, before, lambda part, done: F.transform(part, lambda v: F.when(done.isNull(), v).otherwise(join(done, v)))))

    return bound(bound(values, chunked), joined)


def total(values: F.Column) -> F.Column:
    return running(values, lambda a, b: a + b)


def most(values: F.Column) -> F.Column:
    return running(values, lambda a, b: F.greatest(a, b))


def hits(text: F.Column, pattern: str, needs: str, around: bool = False) -> F.Column:
    """start, stop and string of each match: pieces between the matches give the places; around: also left and right, NEAR characters of the pieces beside it."""
    def placed(both):
        found, pieces = both.found, both.pieces
        sizes = F.flatten(F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda piece, hit: F.array(F.char_length(piece).cast("long"), F.char_length(hit).cast("long"))))
        side = lambda k: (F.right(F.get(pieces, k), F.lit(NEAR)).alias("left"), F.left(F.get(pieces, k + 1), F.lit(NEAR)).alias("right")) if around else ()
        return bound(total(sizes), lambda ends: F.transform(found, lambda hit, k: F.struct(F.get(ends, 2 * k).alias("start"), F.get(ends, 2 * k + 1).alias("stop"), hit.alias("hit"), *side(k))))

    out = bound(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces")), placed)
    has = text.contains(needs) if needs == "@" else text.rlike(needs)
    kind = "array<struct<start:long,stop:long,hit:string" + (",left:string,right:string" if around else "") + ">>"
    return F.when(has, out).otherwise(F.array().cast(kind))


def digits(hit: F.Column) -> F.Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: F.Column) -> F.Column:
    """Whether a string of digits passes Luhn's check."""
    back = F.reverse(number)

    def worth(k):
        d = F.substring(back, k, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(k % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(number), F.lit(1))), worth), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def valid(kind: str, hit: F.Column) -> F.Column:
    if kind == "ip":
        short = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(short, lambda p: (F.char_length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return luhn(digits(hit))
    if kind == "phone":
        return F.char_length(digits(hit)).between(9, 15)
    return F.lit(True)


def ordered(spans: F.Column) -> F.Column:
    """Spans (start, stop, kind) by start, then by kind as listed."""
    turned = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.stop.alias("stop"))))
    return F.transform(turned, lambda s: F.struct(s.start.alias("start"), s.stop.alias("stop"), s.kind.alias("kind")))


def base_spans(text: F.Column) -> F.Column:
    """Spans of the base kinds, by start and kind."""

    def of(k: int, kind: str) -> F.Column:
        good = F.filter(hits(text, PATTERNS[kind], NEEDS[kind]), lambda h: valid(kind, h.hit))
        return F.transform(good, lambda h: F.struct(h.start.alias("start"), h.stop.alias("stop"), F.lit(k).alias("kind")))

    return ordered(F.concat(*(of(k, kind) for k, kind in enumerate(BASE))))


def trimmed(token: F.Column) -> F.Column:
    return F.regexp_replace(token, r"[.,;:!?)\]}\"']++$", "")


def labelled(text: F.Column) -> F.Column:
    """pattern, token, start and stop of each token that follows a label."""

    def of(h):
        token = F.regexp_extract(h.hit, LABEL_PARTS, 2)
        start = h.stop - F.char_length(token)
        label = F.concat(F.lit("label:"), F.lower(F.regexp_extract(h.hit, LABEL_PARTS, 1)))
        return F.struct(label.alias("pattern"), trimmed(token).alias("token"), start.alias("start"), (start + F.char_length(trimmed(token))).alias("stop"))

    return F.filter(F.transform(hits(text, LABEL, "[:=#]"), of), lambda x: x.token != "")


def beside(text: F.Column) -> F.Column:
    """pattern, token, start and stop of each marked token with the word before, unless that is a label, and with the word after it."""

    def of(h):
        bare = F.regexp_replace(h.hit, r"^[(\[{\"']++", "")
        start = h.stop - F.char_length(bare)
        token = trimmed(bare)
        word = lambda near, pattern: F.lower(F.regexp_extract(near, pattern, 1))
        cue = lambda kind, near, pattern: F.struct(F.concat(F.lit(kind), word(near, pattern)).alias("pattern"), token.alias("token"), start.alias("start"), (start + F.char_length(token)).alias("stop"))
        return F.array(cue("before:", h.left, r"(?<![\p{L}\p{N}_])(\p{L}{2,}+)[^\p{L}\p{N}\s:=#]*+\s++$"), cue("after:", h.right, r"^\s++[^\p{L}\p{N}\s]*+(\p{L}{2,}+)(?![\p{L}\p{N}_])"))

    return F.filter(F.flatten(F.transform(hits(text, MARKED, "[0-9@]", True), of)), lambda x: (x.token != "") & ~x.pattern.endswith(":"))


def seeds(base: F.Column, cues: F.Column) -> F.Column:
    """For each of the cues, in the order of (stop, place), the greatest stop of a base span that begins before its stop, or -1."""
    event = lambda key, turn, place, stop: F.struct(key.alias("key"), turn.alias("turn"), place.alias("place"), stop.alias("stop"))
    begins = F.transform(base, lambda b: event(b.start, F.lit(1), F.lit(-1), b.stop))
    asks = F.transform(cues, lambda x, k: event(x.stop, F.lit(0), k, F.lit(-1).cast("long")))
    return F.array_sort(F.concat(begins, asks))


def find(docs: DataFrame, keep: tuple[str, ...], names: dict[str, str]) -> DataFrame:
    """The kept columns with row, base (base spans) and cues (instances with a pattern, and whether each is a seed)."""
    text = F.coalesce("text", F.lit(""))
    row, base, cues, events = (names[k] for k in ("row", "base", "cues", "events"))
    spans = docs.select(*keep, F.monotonically_increasing_id().alias(row), base_spans(text).alias(base), F.concat(labelled(text), beside(text)).cast(CUE).alias(cues))
    placed = spans.withColumn(events, F.when(F.size(cues) > 0, seeds(F.col(base), F.col(cues))))
    reach = F.zip_with(F.col(events), most(F.transform(events, lambda e: e.stop)), lambda e, m: F.struct(e.place.alias("place"), e.turn.alias("turn"), m.alias("reach")))
    asked = F.filter(reach, lambda e: e.turn == 0)

    def marked(e):
        x = F.get(F.col(cues), e.place)
        return F.struct(x.pattern.alias("pattern"), x.token.alias("token"), x.start.alias("start"), x.stop.alias("stop"), (e.reach > x.start).alias("seed"))

    return placed.withColumn(cues, F.when(F.size(cues) > 0, F.transform(asked, marked))).drop(events)


def confident(found: DataFrame, docs: DataFrame, cues: str) -> DataFrame:
    """Patterns whose confidence and support suffice."""
    each = found.select(F.explode(cues).alias("e"))
    edges = each.groupBy(F.col("e.pattern").alias("pattern"), F.xxhash64(F.lower("e.token")).alias("token")).agg(F.max("e.seed").alias("seed"), F.count("*").alias("times"))
    # a pattern of fewer instances than SUPPORT can't come to be known
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("tokens"), F.sum("times").alias("times")).where(F.col("tokens") >= SUPPORT)
    sizes = sizes.withColumn("word", F.when(~F.col("pattern").startswith("label:"), F.substring_index("pattern", ":", -1)))
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]++")).alias("word")).groupBy("word").agg(F.count("*").alias("uses"))
    least = F.col("tokens") + F.greatest(F.coalesce("uses", F.lit(0)) - F.col("times"), F.lit(0))
    sizes = materialise(sizes.join(words, "word", "left").select("pattern", least.alias("least")).where(F.col("least") * CONFIDENCE <= F.col("tokens")), "pii-patterns")
    graph = materialise(edges.select("pattern", "token", "seed").join(sizes, "pattern"), "pii-graph")
    score = graph.select("pattern", "token", "least", F.col("seed").cast("double").alias("score"))

    def trusted(score: DataFrame) -> DataFrame:
        support = F.count_if(F.col("score") >= CONFIDENCE)
        return score.groupBy("pattern").agg(F.least(F.sum("score") / F.max("least"), F.lit(0.999999)).alias("trust"), support.alias("support")).where(F.col("support") >= SUPPORT).select("pattern", "trust")

    for _ in range(ROUNDS):
        doubted = graph.join(trusted(score), "pattern", "left").withColumn("doubt", F.log1p(-F.coalesce("trust", F.lit(0.0))))
        doubts = doubted.groupBy("token").agg(F.sum("doubt").alias("all"))
        others = 1 - F.exp(F.least(F.col("all") - F.col("doubt"), F.lit(0.0)))
        score = doubted.join(doubts, "token").select("pattern", "token", "least", F.when(F.col("seed"), 1.0).otherwise(others).alias("score"))
    return trusted(score).where(F.col("trust") >= CONFIDENCE).select("pattern")


def with_spans(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, str, str]:
    """The kept columns with base spans, and all spans (base and discovered ones, by start and kind), and the names of these two columns."""
    names = {k: unused((*keep, *docs.columns), f"_pii_{k}") for k in ("row", "base", "cues", "events", "more", "spans")}
    row, base, cues, more = (names[k] for k in ("row", "base", "cues", "more"))
    found = materialise(find(docs, keep, names), "pii-found")
    unseen = F.filter(cues, lambda x: ~x.seed & x.token.rlike("[0-9@]"))
    new = (
        found.select(row, F.explode(unseen).alias("x"))
        .select(row, "x.pattern", "x.start", "x.stop")
        .join(confident(found, docs, cues), "pattern", "left_semi")
        .groupBy(row)
        .agg(F.collect_set(F.struct("start", "stop", F.lit(len(BASE)).alias("kind"))).alias(more))
    )
    both = F.concat(base, F.coalesce(more, F.array().cast("array<struct<start:long,stop:long,kind:int>>")))
    return found.join(new, row, "left").select(*keep, base, ordered(both).alias(names["spans"])), base, names["spans"]


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of ``text`` replaced by its kind in angle brackets; where spans overlap, the first stands. A null text stays null."""
    columns = docs.columns
    found, _, spans = with_spans(docs, tuple(columns))
    reach, parts = unused((*columns, spans), "_pii_reach"), unused((*columns, spans), "_pii_parts")
    # how far the spans before each one reach; a stretch is found without going through the text before it
    reached = found.withColumn(reach, F.concat(F.array(F.lit(0).cast("long")), most(F.transform(spans, lambda s: s.stop))))
    cut = reached.withColumn(parts, F.when(F.size(spans) > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))))

    def between(a: F.Column, b: F.Column) -> F.Column:
        i, j = F.floor(a / STRETCH).cast("int"), F.floor((b - 1) / STRETCH).cast("int")
        first, last = (a % STRETCH).cast("int"), ((b - 1) % STRETCH).cast("int")
        one = F.substring(F.get(parts, i), first + 1, (b - a).cast("int"))
        several = F.concat(F.substring(F.get(parts, i), first + 1, F.lit(STRETCH)), F.array_join(F.slice(parts, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(F.get(parts, j), F.lit(1), last + 1))
        return F.when(b <= a, F.lit("")).when(i == j, one).otherwise(several)

    def piece(s, k):
        at = F.get(reach, k)
        name = F.concat(F.lit("<"), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s.kind + 1)), F.lit(">"))
        return F.when(s.start >= at, F.concat(between(at, s.start), name)).otherwise("")

    rest = between(F.element_at(reach, -1), F.char_length("text").cast("long"))
    clean = F.when(F.size(spans) > 0, F.concat(F.array_join(F.transform(spans, piece), ""), rest)).otherwise(F.col("text"))
    return cut.withColumn("text", clean).select(*columns)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, base, spans = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter(base, lambda s: s.kind == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)),
        F.sha2(written(base, KINDS), 256).alias("base_sha256"),
        written(spans, KINDS).alias("spans"),
    )


QUERIES = {"op8_pii": op8_pii}
