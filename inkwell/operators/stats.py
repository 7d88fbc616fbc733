"""Paired statistics: wide tables of arms, differences, distributions, tests, bootstrap, sensitivity.

Scores come from the lines of orders: an order is a paper, its line number picks an arm, and each line is a token whose
negative log likelihood is its unit price in thousands. Every statistic is taken for each batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from operator import methodcaller

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.statistics import resampled_means
from inkwell.plans.dialect import Dialect, SparkDialect

#: The reference's paired analysis.
REPLICATES = 20_000
#: Seed and resamples of the holdout analysis.
SEED, SEEDED_REPLICATES = 2021, 10_000
#: Tasks that the draws are dealt out to, for each eight cores here; draws that are hashed at once.
TASKS, AT_ONCE = 64, 1 << 14
PAIRS = (("D_minus_E", "d_e"), ("D_minus_B", "d_b"), ("D_minus_A", "d_a"))


def scores(d: Dialect) -> str:
    """scores(batch, paper, arm, n_tokens, total, mean, prompt_tokens)"""
    return f"""scores AS (SELECT CASE WHEN l_orderkey % 5 = 0 THEN 'pilot' ELSE 'holdout' END AS batch, l_orderkey AS paper,
        CASE l_linenumber % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'D' ELSE 'E' END AS arm, CAST(count(*) AS BIGINT) AS n_tokens,
        sum(l_extendedprice / l_quantity / 1000) AS total, avg(l_extendedprice / l_quantity / 1000) AS mean, CAST(sum(l_quantity) AS BIGINT) AS prompt_tokens,
        min(l_extendedprice / l_quantity / 1000) AS least, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned
        FROM {d.table('lineitem')} GROUP BY 1, 2, 3)"""


def wide(d: Dialect) -> str:
    """wide: a row for each paper that has all four arms."""
    means = ", ".join(f"max(CASE WHEN arm = '{a}' THEN mean END) AS {a.lower()}_mean, max(CASE WHEN arm = '{a}' THEN prompt_tokens END) AS {a.lower()}_tokens" for a in "ABDE")
    return f"""{scores(d)}, pivoted AS (SELECT batch, paper, {means}, max(returned) AS returned FROM scores GROUP BY batch, paper HAVING count(*) = 4),
    wide AS (SELECT pivoted.*, d_mean - e_mean AS d_e, d_mean - b_mean AS d_b, d_mean - a_mean AS d_a, CAST(d_tokens AS DOUBLE) / e_tokens AS r_de, CAST(d_tokens AS DOUBLE) / b_tokens AS r_db FROM pivoted)"""


def long(d: Dialect) -> str:
    parts = " UNION ALL ".join(f"SELECT batch, paper, returned, '{name}' AS comparison, {column} AS diff FROM wide" for name, column in PAIRS)
    return f"{wide(d)}, diffs AS ({parts})"


def score_validation(d: Dialect) -> str:
    return f"""WITH {scores(d)} SELECT paper, arm, {d.is_finite('total')} AND least >= 0 AS finite, abs(total / n_tokens - mean) <= greatest(1e-9 * greatest(abs(mean), abs(total / n_tokens)), 1e-12) AS mean_agrees, n_tokens > 0 AS counted FROM scores"""


def per_paper_wide(d: Dialect) -> str:
    return f"WITH {wide(d)} SELECT batch, paper, round(a_mean + 1e-10, 6) AS a_mean_nll, round(b_mean + 1e-10, 6) AS b_mean_nll, round(d_mean + 1e-10, 6) AS d_mean_nll, round(e_mean + 1e-10, 6) AS e_mean_nll, a_tokens, b_tokens, d_tokens, e_tokens FROM wide"


def paired_differences(d: Dialect) -> str:
    return f"WITH {wide(d)} SELECT batch, paper, round(d_e + 1e-10, 6) AS d_minus_e, round(d_b + 1e-10, 6) AS d_minus_b, round(d_a + 1e-10, 6) AS d_minus_a, round(r_de + 1e-10, 6) AS d_over_e, round(r_db + 1e-10, 6) AS d_over_b FROM wide"


def macro_mean_nll(d: Dialect) -> str:
    return f"WITH {scores(d)} SELECT batch, arm, CAST(count(*) AS BIGINT) AS papers, round(avg(mean), 6) AS mean_nll FROM scores GROUP BY batch, arm"


def distribution_stats(d: Dialect) -> str:
    return f"""WITH {long(d)} SELECT batch, comparison, CAST(count(*) AS BIGINT) AS n, round(avg(diff), 6) AS mean, round({d.percentile('diff', 0.5)}, 6) AS median, round({d.percentile('diff', 0.25)}, 6) AS q1,
        round({d.percentile('diff', 0.75)}, 6) AS q3, round(min(diff), 6) AS low, round(max(diff), 6) AS high FROM diffs GROUP BY batch, comparison"""


def paired_summary(d: Dialect) -> str:
    return f"""WITH {long(d)} SELECT batch, comparison, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN diff < 0 THEN 1 ELSE 0 END) AS BIGINT) AS lower_n, CAST(sum(CASE WHEN diff > 0 THEN 1 ELSE 0 END) AS BIGINT) AS higher_n,
        CAST(sum(CASE WHEN diff = 0 THEN 1 ELSE 0 END) AS BIGINT) AS equal_n, round(avg(diff), 6) AS mean, round({d.percentile('diff', 0.5)}, 6) AS median FROM diffs GROUP BY batch, comparison"""


def log_factorial(x: str) -> str:
    """ln(x!) by Stirling's series at x + 8, within 1e-12."""
    z = f"(CAST({x} AS DOUBLE) + 8)"
    product = " * ".join(f"(CAST({x} AS DOUBLE) + {k})" for k in range(1, 9))
    return f"({z} * ln({z}) - {z} + 0.5 * ln(6.283185307179586 * {z}) + 1 / (12 * {z}) - 1 / (360 * {z} * {z} * {z}) + 1 / (1260 * {z} * {z} * {z} * {z} * {z}) - ln({product}))"


def sign_test(d: Dialect) -> str:
    """Exact two-sided sign test without ties: terms further than 20 standard deviations below the last one count for nothing."""
    term = f"exp({log_factorial('n')} - {log_factorial('k')} - {log_factorial('(n - k)')} - n * ln(2e0))"
    return f"""WITH {long(d)}, signs AS (SELECT batch, comparison, CAST(sum(CASE WHEN diff < 0 THEN 1 ELSE 0 END) AS BIGINT) AS low_n, CAST(sum(CASE WHEN diff > 0 THEN 1 ELSE 0 END) AS BIGINT) AS high_n FROM diffs GROUP BY batch, comparison),
    bounds AS (SELECT batch, comparison, low_n, high_n, low_n + high_n AS n, least(low_n, high_n) AS m, CAST(greatest(0, least(low_n, high_n) - 50 - CAST(floor(20 * sqrt(low_n + high_n)) AS BIGINT)) AS BIGINT) AS bottom FROM signs),
    terms AS ({d.series('batch, comparison, low_n, high_n, n', 'bottom', 'm', 'bounds')})
    SELECT batch, comparison, low_n, high_n, round(least(1.0e0, 2 * sum({term})), 9) AS p FROM terms GROUP BY batch, comparison, low_n, high_n"""


def spearman_length(d: Dialect) -> str:
    """Rank correlation of a difference with the difference and the ratio of prompt lengths; null without variance."""
    rank = lambda x: f"rank() OVER (PARTITION BY batch ORDER BY {x}) + (count(*) OVER (PARTITION BY batch, {x}) - 1) / 2e0"
    return f"""WITH {wide(d)}, exact AS (SELECT batch, round(d_e, 9) AS y, d_tokens - e_tokens AS gap, round(r_de, 9) AS ratio FROM wide),
    ranked AS (SELECT batch, {rank('y')} AS ry, {rank('gap')} AS rg, {rank('ratio')} AS rr FROM exact)
    SELECT batch, CAST(count(*) AS BIGINT) AS n, round(corr(ry, rg), 6) AS with_difference, round(corr(ry, rr), 6) AS with_ratio FROM ranked GROUP BY batch"""


def leave_one_out(d: Dialect) -> str:
    return f"WITH {long(d)} SELECT batch, comparison, round((sum(diff) - max(diff)) / (count(*) - 1), 6) AS low, round((sum(diff) - min(diff)) / (count(*) - 1), 6) AS high FROM diffs GROUP BY batch, comparison HAVING count(*) > 1"


def extreme_papers(d: Dialect) -> str:
    return f"""WITH {long(d)}, exact AS (SELECT batch, comparison, paper, round(diff, 9) AS diff FROM diffs),
    placed AS (SELECT batch, comparison, paper, diff, row_number() OVER (PARTITION BY batch, comparison ORDER BY diff, paper) AS up, row_number() OVER (PARTITION BY batch, comparison ORDER BY diff DESC, paper DESC) AS down FROM exact)
    SELECT batch, comparison, 'improved' AS kind, CAST(up AS BIGINT) AS place, paper, round(diff, 6) AS diff FROM placed WHERE up <= 5
    UNION ALL SELECT batch, comparison, 'worsened', CAST(down AS BIGINT), paper, round(diff, 6) FROM placed WHERE down <= 5"""


def hash_bootstrap(d: Dialect) -> str:
    """Percentile interval of the mean over REPLICATES resamples; a draw's index is a hash of replicate and draw.

    Spark's hints deal out the papers before they are drawn and send the values to the draws, so that tasks sum up each
    replicate before the shuffle; to DuckDB they are comments.
    """
    index = f"{d.hex_number('substr(' + d.sha(chr(39) + 'r' + chr(39) + ' || CAST(k AS STRING) || ' + chr(39) + ':' + chr(39) + ' || CAST(place AS STRING)') + ', 1, 8)')} % n + 1"
    return f"""WITH {wide(d)}, numbered AS (SELECT batch, d_e, row_number() OVER (PARTITION BY batch ORDER BY paper) AS place, count(*) OVER (PARTITION BY batch) AS n FROM wide),
    dealt AS (SELECT /*+ REPARTITION({TASKS}) */ batch, place, n FROM numbered),
    draws AS ({d.series('batch, place, n', '1', str(REPLICATES), 'dealt')}),
    picked AS (SELECT batch, k, {index} AS pick FROM draws),
    means AS (SELECT /*+ BROADCAST(x) */ p.batch, p.k, avg(x.d_e) AS mean FROM picked p JOIN numbered x ON p.batch = x.batch AND p.pick = x.place GROUP BY p.batch, p.k)
    SELECT batch, CAST(count(*) AS BIGINT) AS replicates, round({d.percentile('mean', 0.025)}, 6) AS low, round({d.percentile('mean', 0.975)}, 6) AS high FROM means GROUP BY batch"""


def seeded_bootstrap(spark: SparkSession, sf_dir: str, seed: int = SEED, replicates: int = SEEDED_REPLICATES) -> DataFrame:
    """The interval by Python's random stream of a seed, begun anew for each batch and comparison, over papers in order of their ids.

    That is the holdout analysis's resampling. (The paired analysis lets one stream, of another seed, run on through all
    batches and comparisons; that order is not built.) A stream has one order, so each batch and comparison is one task,
    which holds 8 bytes a paper; hash_bootstrap is the form whose draws are dealt out.
    """
    diffs = spark.sql(f"WITH {long(SparkDialect(sf_dir, spark))} SELECT batch, comparison, paper, diff FROM diffs")

    def interval(group: pa.Table) -> pa.Table:
        values = group.column("diff").to_numpy()[np.argsort(group.column("paper").to_numpy(), kind="stable")].astype(np.float64)
        means = resampled_means(values, seed, replicates)
        low, high = np.quantile(means, [0.025, 0.975])
        return pa.table({"batch": group.column("batch")[:1], "comparison": group.column("comparison")[:1], "papers": [group.num_rows], "low": [round(low, 6)], "high": [round(high, 6)]})

    return diffs.groupBy("batch", "comparison").applyInArrow(interval, "batch string, comparison string, papers long, low double, high double")


def replicate_sums(values: np.ndarray, replicates: list[int]) -> np.ndarray:
    """For each replicate the sum of the values that its draws pick: draw p of replicate k picks the place that the first 32 bits of sha256('r<k>:<p>') give."""
    sums, digest = np.zeros((len(replicates), values.shape[1])), methodcaller("digest")
    for first in range(1, len(values) + 1, AT_ONCE):
        places = [b"%d" % p for p in range(first, min(first + AT_ONCE, len(values) + 1))]
        for row, k in enumerate(replicates):
            drawn = b"".join(map(digest, map(sha256, map((b"r%d:" % k).__add__, places))))
            sums[row] += values[np.frombuffer(drawn, ">u4")[::8].astype(np.int64) % len(values)].sum(axis=0)
    return sums


def hash_bootstrap_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash_bootstrap in Spark: tasks share out the replicates, and each holds the values (16 bytes a paper) and hashes its replicates' draws in bulk; nothing but means is shuffled."""
    rows = spark.sql(f"WITH {wide(SparkDialect(sf_dir, spark))} SELECT batch, paper, d_e FROM wide").orderBy("batch", "paper").selectExpr("batch = 'pilot' AS pilot", "d_e").toArrow()
    pilot, d_e = rows.column("pilot").to_numpy().astype(bool), rows.column("d_e")
    both = np.column_stack([d_e.fill_null(0.0).to_numpy(), d_e.is_valid().to_numpy().astype(np.float64)])  # null differences are drawn, and not counted
    del rows, d_e
    groups = {name: values for name, values in (("pilot", both[pilot]), ("holdout", both[~pilot])) if len(values)}
    shared = spark.sparkContext.broadcast(groups)
    names = list(groups)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for which, name in enumerate(names):
                ks = (ids[ids % len(names) == which] // len(names) + 1).tolist()
                sums = replicate_sums(shared.value[name], ks)
                yield pa.RecordBatch.from_pydict({"batch": pa.array([name] * len(ks), pa.string()), "mean": pa.array([float(t / n) if n else None for t, n in sums], pa.float64())})

    drawn = spark.range(0, REPLICATES * len(names), 1, TASKS * max(1, spark.sparkContext.defaultParallelism // 8)).mapInArrow(means, "batch string, mean double")
    return drawn.groupBy("batch").agg(F.count("*").alias("replicates"), F.expr("round(percentile(mean, 0.025), 6) AS low"), F.expr("round(percentile(mean, 0.975), 6) AS high"))


def near_length_ids(d: Dialect) -> str:
    """Papers of near length, and those of them that got worse, as lists in order."""
    ids = lambda test: f"coalesce({d.gather(f'CASE WHEN {test} THEN CAST(paper AS STRING) END', 'paper', ',')}, '')"
    return f"WITH {wide(d)} SELECT batch, {ids('true')} AS near_papers, {ids('d_e > 0')} AS worse_papers FROM wide WHERE r_de BETWEEN 0.95 AND 1.05 GROUP BY batch"


def scoring_seconds(d: Dialect) -> str:
    """Seconds of each batch and arm: the sum over its tokens' tax in thousandths, in whole numbers."""
    return f"""WITH {scores(d)} SELECT batch, arm, CAST(count(*) AS BIGINT) AS sessions, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, round(sum(round(total, 3)), 2) AS seconds FROM scores GROUP BY batch, arm"""


def length_diagnostics(d: Dialect) -> str:
    return f"""WITH {wide(d)} SELECT batch, round({d.percentile('r_de', 0.5)}, 6) AS median_ratio, round(min(r_de), 6) AS least_ratio, round(max(r_de), 6) AS greatest_ratio, CAST(sum(CASE WHEN r_de BETWEEN 0.95 AND 1.05 THEN 1 ELSE 0 END) AS BIGINT) AS near_n,
        round(avg(CASE WHEN r_de BETWEEN 0.95 AND 1.05 THEN d_e END), 6) AS near_mean FROM wide GROUP BY batch"""


def old_new_comparison(d: Dialect) -> str:
    """Means of a first analysis, on whole thousands, and of this one; papers whose direction changed."""
    return f"""WITH {wide(d)}, both_runs AS (SELECT batch, d_e, round(d_mean) - round(e_mean) AS old_d_e FROM wide)
    SELECT batch, CAST(count(*) AS BIGINT) AS n, round(avg(d_e), 6) AS new_mean, round(avg(old_d_e), 6) AS old_mean, CAST(sum(CASE WHEN (old_d_e < 0) <> (d_e < 0) THEN 1 ELSE 0 END) AS BIGINT) AS direction_changes FROM both_runs GROUP BY batch"""


def posthoc_sensitivity(d: Dialect) -> str:
    return f"""WITH {long(d)} SELECT batch, comparison, CAST(count(*) AS BIGINT) AS n, round(avg(diff), 6) AS mean, CAST(sum(CASE WHEN returned = 0 THEN 1 ELSE 0 END) AS BIGINT) AS retained,
        round(avg(CASE WHEN returned = 0 THEN diff END), 6) AS retained_mean, CAST(sum(CASE WHEN returned = 0 AND diff < 0 THEN 1 ELSE 0 END) AS BIGINT) AS retained_lower FROM diffs GROUP BY batch, comparison"""


def plot_points(d: Dialect) -> str:
    return f"""WITH {long(d)}, exact AS (SELECT batch, comparison, paper, round(diff, 9) AS y FROM diffs)
    SELECT batch, comparison, paper, CAST(row_number() OVER (PARTITION BY batch, comparison ORDER BY y, paper) AS BIGINT) AS x, round(y, 6) AS y, CASE WHEN y < 0 THEN 'lower' WHEN y > 0 THEN 'higher' ELSE 'equal' END AS colour FROM exact"""


QUERIES = (score_validation, per_paper_wide, paired_differences, macro_mean_nll, distribution_stats, paired_summary, sign_test, spearman_length, leave_one_out, extreme_papers, hash_bootstrap, near_length_ids, scoring_seconds, length_diagnostics, old_new_comparison, posthoc_sensitivity, plot_points)
