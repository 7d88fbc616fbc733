"""The library's queries, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkwell.operators import audit, documents, records, selection, stats, text, tokens
from inkwell.plans.dialect import Dialect, SparkDialect

STATEMENTS = {f.__name__: f for module in (text, selection, audit, stats, tokens, records) for f in module.QUERIES}


def _query(statement: Callable[[Dialect], str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.sql(statement(SparkDialect(sf_dir, spark)))


QUERIES = {name: _query(f) for name, f in STATEMENTS.items()} | {"first_difference": tokens.first_difference_of_pairs, "holdout_selection": selection.holdout_selection, "hash_bootstrap": stats.hash_bootstrap_of_values, "seeded_bootstrap": stats.seeded_bootstrap} | {f.__name__: f for f in documents.QUERIES}
SQL = {name: f(Dialect()) for name, f in STATEMENTS.items()} | {"holdout_selection": selection.holdout_oracle(Dialect())}
