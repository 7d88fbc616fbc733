"""Corpus selection: ordered exclusion cascade, first occurrences, hash-seeded order, quotas and caps, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.operators.audit import flagged
from inkwell.operators.text import ADMITTED, sixes
from inkwell.plans.dialect import Dialect, SparkDialect

#: The prefix that seeds the order, and the limits of a month, of a journal, and of a month's pool.
SEED, MONTH_QUOTA, JOURNAL_CAP, POOL = "holdout-2021:", 10, 3, 1000


def candidates(d: Dialect) -> str:
    """A search result for each document: some without an identifier, some repeated, some out of date."""
    return f"""candidates AS (SELECT doc_id, doc_id AS search_order, source AS journal, lang, doc_id % 12 + 1 AS month,
        CASE WHEN doc_id % 41 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN 'PMC' || CAST(doc_id - 12 AS STRING) ELSE 'PMC' || CAST(doc_id AS STRING) END AS pmcid,
        CASE WHEN doc_id % 9 = 0 THEN '2019-12-31' ELSE '2020-06-15' END AS published, CASE WHEN doc_id % 23 = 0 THEN 'N' ELSE 'Y' END AS open_access
        FROM {d.table('documents')})"""


def cascade(d: Dialect) -> str:
    return f"""WITH {candidates(d)}, {sixes(d)},
    numbered AS (SELECT candidates.*, CASE WHEN pmcid IS NOT NULL THEN row_number() OVER (PARTITION BY pmcid ORDER BY search_order) END AS seen FROM candidates),
    outcomes AS (SELECT n.doc_id, n.search_order, n.pmcid, CASE
        WHEN n.pmcid IS NULL THEN 'no_pmcid'
        WHEN n.seen > 1 THEN 'duplicate_pmcid'
        WHEN n.published NOT LIKE '2020-%' THEN 'date_outside_2020'
        WHEN n.open_access <> 'Y' THEN 'not_oa_research_article_metadata'
        WHEN n.lang <> 'en' THEN 'xml_not_english'
        WHEN six.doc_id IS NULL OR n_sentences < 6 THEN 'insufficient_sentences_or_continuation'
        WHEN latin < 0.9 OR words < 35 THEN 'non_english_or_too_short'
        WHEN NOT {ADMITTED} THEN 'short_or_noisy_sentence'
        ELSE 'selected' END AS outcome
      FROM numbered n LEFT JOIN six ON n.doc_id = six.doc_id)"""


def exclusion_cascade(d: Dialect) -> str:
    return cascade(d) + " SELECT doc_id, pmcid, outcome FROM outcomes"


def exclusion_counts(d: Dialect) -> str:
    return cascade(d) + " SELECT outcome, CAST(count(*) AS BIGINT) AS n FROM outcomes WHERE outcome <> 'selected' GROUP BY outcome"


def first_selected(d: Dialect) -> str:
    """The first 20 eligible in search order, and how many were examined up to each."""
    kept, examined = ("chosen", "candidates") if d.by_row("documents", "doc_id") else ("kept", "outcomes")  # a row's own kept sentences have that name; each candidate has one outcome then
    return cascade(d) + f""", {kept} AS (SELECT doc_id, search_order, row_number() OVER (ORDER BY search_order) AS place FROM outcomes WHERE outcome = 'selected' ORDER BY search_order LIMIT 20)
    SELECT k.doc_id, CAST(k.place AS BIGINT) AS selection_order, CAST(count(*) AS BIGINT) AS examined FROM {kept} k JOIN {examined} o ON o.search_order <= k.search_order GROUP BY k.doc_id, k.place"""


def pooled(d: Dialect) -> str:
    return f"""{candidates(d)},
    firsts AS (SELECT doc_id, pmcid, month, journal, search_order, row_number() OVER (PARTITION BY month, pmcid ORDER BY search_order) AS seen,
                      row_number() OVER (PARTITION BY month ORDER BY search_order) AS fetched FROM candidates WHERE pmcid IS NOT NULL),
    pool AS (SELECT doc_id, pmcid, month, journal, {d.sha(f"'{SEED}' || pmcid")} AS hash_key FROM firsts WHERE seen = 1 AND fetched <= {POOL})"""


def pool_dedupe_hash_order(d: Dialect) -> str:
    return f"WITH {pooled(d)} SELECT doc_id, month, pmcid, hash_key, CAST(row_number() OVER (PARTITION BY month ORDER BY hash_key, pmcid) AS BIGINT) AS place FROM pool"


def holdout_oracle(d: Dialect) -> str:
    """The months' fold as a chain of statements: each month sees what earlier ones took of each journal and identifier."""
    out = [f"WITH {pooled(d)}"]
    taken: list[str] = []
    for m in range(1, 13):
        before = " UNION ALL ".join(f"SELECT journal, pmcid FROM s{k}" for k in taken) or "SELECT journal, pmcid FROM pool WHERE FALSE"
        out.append(f"""s{m} AS MATERIALIZED (WITH earlier AS ({before}), prior AS (SELECT journal, count(*) AS n FROM earlier GROUP BY journal),
        open_ AS (SELECT p.*, row_number() OVER (PARTITION BY p.journal ORDER BY hash_key, p.pmcid) + coalesce(prior.n, 0) AS of_journal FROM pool p LEFT JOIN prior ON p.journal = prior.journal
                  WHERE p.month = {m} AND p.pmcid NOT IN (SELECT pmcid FROM earlier))
        SELECT doc_id, pmcid, month, journal, hash_key FROM open_ WHERE of_journal <= {JOURNAL_CAP} ORDER BY hash_key, pmcid LIMIT {MONTH_QUOTA})""")
        taken.append(str(m))
    union = " UNION ALL ".join(f"SELECT * FROM s{m}" for m in range(1, 13))
    return ",\n".join(out) + f" SELECT doc_id, pmcid, month, journal, CAST(row_number() OVER (PARTITION BY month ORDER BY hash_key, pmcid) AS BIGINT) AS selection_order FROM ({union}) u"


def holdout_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MONTH_QUOTA of each month and JOURNAL_CAP of each journal over all months, in hash order.

    Months depend on earlier ones only through how much of each journal is taken, so the driver keeps the selected
    rows, MONTH_QUOTA a month, and each month's pool is reduced by windows and a top-k in Spark.
    """
    pool = spark.sql(f"WITH {pooled(SparkDialect(sf_dir, spark))} SELECT * FROM pool")
    schema = "doc_id long, pmcid string, month long, journal string, selection_order long"
    taken: list[tuple] = []
    for m in range(1, 13):
        prior: dict[str, int] = {}
        for row in taken:
            prior[row[3]] = prior.get(row[3], 0) + 1
        used = F.coalesce(F.create_map(*[F.lit(x) for kv in prior.items() for x in kv])[F.col("journal")], F.lit(0)) if prior else F.lit(0)
        known = [r[1] for r in taken]
        place = F.row_number().over(Window.partitionBy("journal").orderBy("hash_key", "pmcid"))
        fresh = pool.where(F.col("month") == m).where(~F.col("pmcid").isin(known) if known else F.lit(True))
        top = fresh.withColumn("of_journal", place + used).where(F.col("of_journal") <= JOURNAL_CAP).orderBy("hash_key", "pmcid").limit(MONTH_QUOTA)
        taken += [(r.doc_id, r.pmcid, r.month, r.journal, k + 1) for k, r in enumerate(top.collect())]
    return spark.createDataFrame(taken, schema)


def decided(d: Dialect) -> str:
    """decisions(doc_id, batch, decision, exclusion_code, flags): labels decide, and critical flags exclude."""
    return f"""{flagged(d)},
    critical AS (SELECT doc_id, count(*) AS n_flags, max(CASE WHEN type IN ('unbalanced_punctuation', 'missing_space_after_period') THEN 1 ELSE 0 END) AS critical FROM flags GROUP BY doc_id),
    decisions AS (SELECT l.doc_id, CASE WHEN l.doc_id % 2 = 0 THEN 'pilot' ELSE 'holdout' END AS batch, coalesce(n_flags, 0) AS n_flags,
        CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN 'low_quality' WHEN coalesce(critical, 0) = 1 THEN 'critical_flag' END AS exclusion_code
        FROM {d.table('labels')} l LEFT JOIN critical c ON l.doc_id = c.doc_id)"""


def review_decisions(d: Dialect) -> str:
    return f"WITH {decided(d)} SELECT doc_id, batch, CAST(n_flags AS BIGINT) AS n_flags, exclusion_code, CASE WHEN exclusion_code IS NULL THEN 'include' ELSE 'exclude' END AS decision FROM decisions"


def decision_summary(d: Dialect) -> str:
    return f"""WITH {decided(d)} SELECT batch, CASE WHEN exclusion_code IS NULL THEN 'include' ELSE 'exclude' END AS decision, exclusion_code, CAST(count(*) AS BIGINT) AS n,
        CAST(sum(CASE WHEN n_flags > 0 THEN 1 ELSE 0 END) AS BIGINT) AS flagged FROM decisions GROUP BY 1, 2, 3"""


def stratified_manual_sample(d: Dialect) -> str:
    """The first and the last unflagged row of each bucket of ten labelled rows in order."""
    return f"""WITH {decided(d)}, placed AS (SELECT doc_id, batch, n_flags, {d.whole('row_number() OVER (PARTITION BY batch ORDER BY doc_id) - 1', '10')} + 1 AS bucket FROM decisions)
    SELECT batch, CAST(bucket AS BIGINT) AS bucket, min(doc_id) AS first_id, max(doc_id) AS last_id FROM placed WHERE n_flags = 0 GROUP BY batch, bucket"""


QUERIES = (exclusion_cascade, exclusion_counts, first_selected, pool_dedupe_hash_order, review_decisions, decision_summary, stratified_manual_sample)
