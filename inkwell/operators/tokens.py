"""Tokenizer algebra: vocabularies and merge lists as relations, completion, order, and their invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.plans.dialect import Dialect, SparkDialect

#: Occurrences of a word that make its prefixes and suffixes tokens, and their longest length.
FREQUENT, LONGEST = 30, 7
SEED = "merge-order-42:"


def vocabulary(d: Dialect) -> str:
    """CTEs up to vocab(id, token): prefixes and suffixes of frequent lower-case ASCII words, ids by length and token."""
    lowered = d.all_matches("lower(text)", "[a-z]+")
    frequent = f"""found AS (SELECT doc_id, {lowered} AS w FROM {d.table('documents')}), words AS ({d.unnest('doc_id', 'w', 'found')}),
    frequent AS (SELECT val AS word FROM words GROUP BY val HAVING count(*) >= {FREQUENT})"""
    if getattr(d, "spark", None) is not None:  # a statement names the vocabulary up to eight times
        frequent = f"frequent AS (SELECT word FROM {d.held('frequent', f'WITH {frequent} SELECT word FROM frequent')})"
    return f"""{frequent},
    cut AS ({d.series('word', '1', str(LONGEST), 'frequent')}),
    pieces AS (SELECT substr(word, 1, CAST(k AS INT)) AS token FROM cut WHERE k <= length(word) UNION SELECT substr(word, CAST(length(word) - k + 1 AS INT)) AS token FROM cut WHERE k <= length(word)),
    vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY length(token), token) - 1 AS BIGINT) AS id FROM pieces)"""


def merged(d: Dialect) -> str:
    """CTEs up to original(rank_a, l, r) (the last letter joins last), splits(id, k, l, r) and added(place, l, r)."""
    return f"""{vocabulary(d)},
    cuts AS ({d.series('id, token', '1', str(LONGEST - 1), 'vocab')}),
    halves AS (SELECT id, token, k, substr(token, 1, CAST(k AS INT)) AS l, substr(token, CAST(k AS INT) + 1) AS r FROM cuts WHERE k < length(token)),
    splits AS (SELECT h.id, h.k, h.l, h.r FROM halves h WHERE h.l IN (SELECT token FROM vocab) AND h.r IN (SELECT token FROM vocab)),
    original AS (SELECT l, r, CAST(row_number() OVER (ORDER BY id, l) - 1 AS BIGINT) AS rank_a FROM splits WHERE length(r) = 1),
    missing AS (SELECT s.id, s.k, s.l, s.r FROM splits s LEFT JOIN original o ON s.l = o.l AND s.r = o.r WHERE o.l IS NULL),
    added AS (SELECT l, r, CAST(row_number() OVER (ORDER BY id, k, l, r) - 1 AS BIGINT) AS place FROM missing),
    arm_c AS (SELECT l, r, rank_a AS rank_c, FALSE AS is_added FROM original UNION ALL SELECT l, r, place + (SELECT count(*) FROM original), TRUE FROM added),
    arm_d AS (SELECT l, r, rank_c, is_added, CAST(row_number() OVER (ORDER BY {d.sha(f"'{SEED}' || CAST(rank_c AS STRING)")}, rank_c) - 1 AS BIGINT) AS rank_d FROM arm_c)"""


def vocab_checks(d: Dialect) -> str:
    return f"""WITH {vocabulary(d)} SELECT CAST(count(*) AS BIGINT) AS tokens, count(*) = count(DISTINCT id) AS ids_unique, count(*) = count(DISTINCT token) AS tokens_unique,
        CAST(sum(CASE WHEN {d.like('token', '[ \\t\\r\\n]')} THEN 1 ELSE 0 END) AS BIGINT) AS with_space, CAST(sum(CASE WHEN token LIKE '<|%' THEN 1 ELSE 0 END) AS BIGINT) AS special FROM vocab"""


def merge_parse(d: Dialect) -> str:
    """Rules as written, parsed again; a rule is malformed unless it has two parts that join to a token."""
    left, right = d.extract("rule", "^([^ ]+) ([^ ]+)$", 1), d.extract("rule", "^([^ ]+) ([^ ]+)$", 2)
    if type(d) is not Dialect:  # tokens are distinct and never null, so that a join on equality says what NOT IN does, which Spark answers by comparing all pairs
        return f"""WITH {merged(d)}, rules AS (SELECT rank_a, l || ' ' || r AS rule FROM original), parsed AS (SELECT rank_a, {left} AS l, {right} AS r FROM rules)
    SELECT p.rank_a, p.l, p.r, t.token IS NULL AS malformed FROM parsed p LEFT JOIN vocab t ON t.token = p.l || p.r"""
    return f"""WITH {merged(d)}, rules AS (SELECT rank_a, l || ' ' || r AS rule FROM original)
    SELECT rank_a, {left} AS l, {right} AS r, ({left} || {right}) NOT IN (SELECT token FROM vocab) AS malformed FROM rules"""


def merge_completion(d: Dialect) -> str:
    return f"WITH {merged(d)} SELECT l, r, rank_c, is_added FROM arm_c"


def merge_split_stats(d: Dialect) -> str:
    return f"""WITH {merged(d)}, by_target AS (SELECT id, count(*) AS n FROM splits GROUP BY id)
    SELECT CAST(sum(n) AS BIGINT) AS candidates, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS several, CAST(max(n) AS BIGINT) AS most,
           CAST((SELECT count(*) FROM original) AS BIGINT) AS original_n, CAST((SELECT count(*) FROM added) AS BIGINT) AS added_n, sum(n) = (SELECT count(*) FROM original) + (SELECT count(*) FROM added) AS accounted FROM by_target"""


def merge_shuffle_hash(d: Dialect) -> str:
    return f"WITH {merged(d)} SELECT l, r, rank_c, rank_d FROM arm_d"


def arm_e_filtered_order(d: Dialect) -> str:
    return f"WITH {merged(d)} SELECT x.l, x.r, x.rank_d, CAST(row_number() OVER (ORDER BY x.rank_d) - 1 AS BIGINT) AS rank_e FROM arm_d x WHERE EXISTS (SELECT 1 FROM original o WHERE o.l = x.l AND o.r = x.r)"


def first_difference(d: Dialect) -> str:
    """Zero-based place of the first differing word of neighbouring documents; null if equal, the shorter length if one begins the other."""
    words = d.split("text", " ")
    return f"""WITH base AS (SELECT doc_id, {words} AS w FROM {d.table('documents')}),
    spread AS ({d.unnest('doc_id', 'w', 'base')}), sizes AS (SELECT doc_id, count(*) AS n FROM spread GROUP BY doc_id),
    near AS (SELECT a.doc_id, a.pos, a.val AS x, b.val AS y FROM spread a JOIN spread b ON b.doc_id = a.doc_id + 1 AND b.pos = a.pos),
    differ AS (SELECT doc_id, min(CASE WHEN x <> y THEN pos END) AS at FROM near GROUP BY doc_id)
    SELECT a.doc_id, CAST(CASE WHEN differ.at IS NOT NULL THEN differ.at WHEN a.n = b.n THEN NULL ELSE least(a.n, b.n) END AS BIGINT) AS first_difference
    FROM sizes a JOIN sizes b ON b.doc_id = a.doc_id + 1 LEFT JOIN differ ON differ.doc_id = a.doc_id"""


def first_difference_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first_difference in Spark: neighbours' whole texts are joined, since rows of single words take many times the input on disk."""
    d = SparkDialect(sf_dir, spark)
    words = d.split("text", " ")
    return spark.sql(f"""WITH base AS (SELECT doc_id, text FROM {d.table('documents')} WHERE text IS NOT NULL),
    sizes AS (SELECT doc_id, sum(size({words})) AS n FROM base GROUP BY doc_id),
    pairs AS (SELECT a.doc_id, array_position(zip_with({d.split('a.text', ' ')}, {d.split('b.text', ' ')}, (x, y) -> x <> y), TRUE) AS place FROM base a JOIN base b ON b.doc_id = a.doc_id + 1),
    differ AS (SELECT doc_id, min(CASE WHEN place > 0 THEN place - 1 END) AS at FROM pairs GROUP BY doc_id)
    SELECT a.doc_id, CAST(CASE WHEN differ.at IS NOT NULL THEN differ.at WHEN a.n = b.n THEN NULL ELSE least(a.n, b.n) END AS BIGINT) AS first_difference
    FROM sizes a JOIN sizes b ON b.doc_id = a.doc_id + 1 LEFT JOIN differ ON differ.doc_id = a.doc_id""")


def special_subsequence(d: Dialect) -> str:
    """Whether the roles' marks of a conversation, in order, are those of its rendered form."""
    mark = r"<[|]im_(start|end)[|]>"
    rendered = "'<|im_start|>' || role || text || '<|im_end|>'"
    if type(d) is not Dialect:
        rendered = "concat('<|im_start|>', role, text, '<|im_end|>')"
    return f"""WITH turns AS (SELECT conv_id, turn, {rendered} AS body FROM {d.table('conversations')}),
    chats AS (SELECT conv_id, count(*) AS turns, {d.gather('body', 'turn', '')} AS chat FROM turns GROUP BY conv_id)
    SELECT conv_id, CAST(turns AS BIGINT) AS turns, {d.matches('chat', mark)} AS marks, {d.matches('chat', mark)} = 2 * turns AS kept FROM chats"""


QUERIES = (vocab_checks, merge_parse, merge_completion, merge_split_stats, merge_shuffle_hash, arm_e_filtered_order, first_difference, special_subsequence)
