"""Scoring plug-in: negative log likelihoods of target tokens given prompts, validation, flags and resumption.

A scorer is a function from a batch of (prompt ids, target ids) to arrays of doubles, one value for each target token.
``unigram`` is a deterministic stand-in for a model: add-one counts over a corpus of ids.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.sources.sinks import pending

Scorer = Callable[[list[list[int]], list[list[int]]], list[list[float]]]


def unigram(counts: dict[int, int]) -> Scorer:
    total = sum(counts.values()) + len(counts) + 1

    def score(prompts: list[list[int]], targets: list[list[int]]) -> list[list[float]]:
        return [[-math.log((counts.get(i, 0) + 1) / total) for i in target] for target in targets]

    return score


def score(rows: DataFrame, scorer: Scorer, keys: list[str], done: DataFrame | None = None) -> DataFrame:
    """keys, target_token_nll, total and mean of every row (keys, prompt_ids, target_ids) that isn't done."""
    work = (rows if done is None else pending(rows, done, keys)).select(*keys, "prompt_ids", "target_ids")
    kept = [f for f in work.schema.fields if f.name in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", target_token_nll array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = scorer([list(x) for x in batch["prompt_ids"]], [list(x) for x in batch["target_ids"]])
            yield batch[keys].assign(target_token_nll=found)

    total = F.aggregate("target_token_nll", F.lit(0.0), lambda a, x: a + x)
    return work.mapInPandas(run, schema).withColumn("target_total_nll", total).withColumn("mean_nll_per_target_token", F.col("target_total_nll") / F.nullif(F.size("target_token_nll"), F.lit(0)))


def valid_score(n_targets: str = "target_token_count") -> F.Column:
    """Length, finite and non-negative values, and total and mean that agree with them."""
    values = F.col("target_token_nll")
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    close = lambda a, b: F.abs(a - b) <= F.greatest(1e-9 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-9))
    fine = F.forall(values, lambda x: ~F.isnan(x) & (x >= 0) & (x < float("inf")))
    return (F.size(values) == F.col(n_targets)) & fine & close(F.col("target_total_nll"), total) & close(F.col("mean_nll_per_target_token"), total / F.size(values))


def generation_flags(ids: str, end_ids: list[int], most: int) -> list[F.Column]:
    """eos_reached, max_new_tokens_reached, possibly_truncated and stop_reason of generated ids."""
    ended = F.arrays_overlap(F.col(ids), F.array(*map(F.lit, end_ids)))
    full = F.size(ids) >= most
    return [ended.alias("eos_reached"), full.alias("max_new_tokens_reached"), (full & ~ended).alias("possibly_truncated"), F.when(ended, "eos").when(full, "max_new_tokens").otherwise("other").alias("stop_reason")]


def reusable(old: DataFrame, again: DataFrame, keys: list[str]) -> bool:
    """Whether a repeated run of some rows gives the old values, so that the old rest may be kept."""
    joined = again.alias("n").join(old.alias("o"), keys)
    return joined.where("n.target_token_nll <> o.target_token_nll").isEmpty() and joined.count() == again.count()
