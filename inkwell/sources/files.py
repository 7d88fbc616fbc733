"""Typed scans of the artifacts that stages exchange: JSON documents, CSV tables, raw files, tokenizer files, rule tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAPERS = (
    "batch string, pmcid string, target_token_count int, A_mean_nll double, B_mean_nll double, D_mean_nll double, E_mean_nll double, D_minus_E double, D_minus_B double, D_minus_A double, "
    "A_prompt_tokens int, B_prompt_tokens int, D_prompt_tokens int, E_prompt_tokens int, D_over_E_length_ratio double, D_over_B_length_ratio double"
)


def json_rows(spark: SparkSession, path: str, rows: str, schema: str | None = None) -> DataFrame:
    """The rows that a JSON document lists under the name ``rows``; its header fields are left out."""
    read = spark.read.option("multiLine", True)
    found = (read.schema(f"{rows} array<struct<{schema}>>") if schema else read).json(path)
    return found.select(F.explode(rows).alias("r")).select("r.*")


def csv_table(spark: SparkSession, path: str, schema: str = PAPERS) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def raw_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """stem, length, sha256 and content of each file with the suffix."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    stem = F.regexp_extract("path", r"([^/]+)" + suffix.replace(".", "[.]") + "$", 1)
    return found.select(stem.alias("stem"), "length", F.sha2("content", 256).alias("sha256"), "content")


def tokenizer_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vocab(token, id) and merges(rank, l, r) of a tokenizer's JSON file; a merge is 'l r' or [l, r]."""
    text = spark.read.text(path, wholetext=True)
    vocab = text.select(F.explode(F.from_json(F.get_json_object("value", "$.model.vocab"), "map<string,bigint>")).alias("token", "id"))
    plain = F.from_json(F.get_json_object("value", "$.model.merges"), "array<string>")
    parts = F.when(F.col("rule").startswith("["), F.from_json("rule", "array<string>")).otherwise(F.split("rule", " "))
    merges = text.select(F.posexplode(plain).alias("rank", "rule")).select("rank", parts.alias("p")).select("rank", F.col("p")[0].alias("l"), F.col("p")[1].alias("r"))
    return vocab, merges


def rule_table(spark: SparkSession, rules: dict[str, tuple], schema: str) -> DataFrame:
    """A literal table of a fixed number of rules, small enough to send along with any join."""
    return F.broadcast(spark.createDataFrame([(k, *v) for k, v in rules.items()], schema))


class CursorSearch(DataSource):
    """A search service that pages by cursor: one sequential partition. ``fetch`` gets a cursor and gives (rows, next cursor).

    Reading stops at an empty page, without a next cursor, at a cursor that was seen before, or after ``pages``.
    """

    fetch: Callable[[str | None], tuple[list[tuple], str | None]]
    columns = "pmcid string, title string"
    pages = 8

    @classmethod
    def name(cls) -> str:
        return "cursor_search"

    def schema(self) -> str:
        return type(self).columns

    def reader(self, schema) -> DataSourceReader:
        return _CursorReader(type(self).fetch, type(self).pages)


class _CursorReader(DataSourceReader):
    def __init__(self, fetch, pages: int):
        self.fetch, self.pages = fetch, pages

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        cursor, seen = None, set()
        for _ in range(self.pages):
            rows, following = self.fetch(cursor)
            if not rows:
                return
            yield from rows
            if following is None or following in seen:
                return
            seen.add(following)
            cursor = following


def retried(get: Callable[[], bytes], wait: Callable[[float], None], retryable: Callable[[Exception], bool], most: int, attempts: int = 4) -> bytes:
    """get() with waits of 1, 2, 4... seconds (or the error's retry_after, 300 at most) between attempts; larger payloads than ``most`` are refused."""
    for k in range(attempts):
        try:
            data = get()
        except Exception as error:
            if k == attempts - 1 or not retryable(error):
                raise
            wait(min(300.0, float(getattr(error, "retry_after", None) or 2**k)))
            continue
        if len(data) > most:
            raise ValueError(f"payload of {len(data)} bytes is over {most}")
        return data
    raise ValueError("no attempts")
