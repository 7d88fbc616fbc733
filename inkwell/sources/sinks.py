"""Write-once outputs, identical rewrites, lineage and resumable runs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_digest(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order: the count and the sum of the rows' hashes, over canonical JSON."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")
    r = df.agg(F.count("*").alias("n"), *(F.sum(part(k)).alias(f"h{k}") for k in range(5))).first()
    return "-".join(str(x or 0) for x in r)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_once(df: DataFrame, path: str) -> None:
    """Refuses to overwrite; Spark's commit makes the output appear whole or not at all."""
    df.write.mode("errorifexists").parquet(path)


def write_or_verify(df: DataFrame, path: str, verify_only: bool = False) -> bool:
    """Writes a new table, or checks that the present one has the same rows. Tells whether it wrote."""
    spark = df.sparkSession
    if exists(spark, path):
        if content_digest(spark.read.parquet(path).select(df.columns)) != content_digest(df):
            raise ValueError(f"{path} holds other rows")
        return False
    if verify_only:
        raise FileNotFoundError(path)
    write_once(df, path)
    return True


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """One CSV file with these columns in this order; for reports, whose rows are few."""
    df.select(columns).coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def write_rules(df: DataFrame, path: str) -> None:
    """Merge rules as lines 'l r' in order of rank."""
    df.orderBy("rank").select(F.concat_ws(" ", "l", "r").alias("value")).coalesce(1).write.mode("errorifexists").text(path)


def lineage(spark: SparkSession, run: str, inputs: dict[str, DataFrame], status: str) -> DataFrame:
    """A row for each input with its digest, the run's name and status (new, running, complete or error), and the time."""
    rows = [(run, name, content_digest(df), status) for name, df in inputs.items()]
    return spark.createDataFrame(rows, "run string, input string, digest string, status string").withColumn("recorded_at", F.current_timestamp()).withColumn("spark_version", F.lit(spark.version))


def pending(work: DataFrame, done: DataFrame, keys: Iterable[str]) -> DataFrame:
    """What is left of the work: a resumed run skips finished keys."""
    return work.join(done.select(*keys).distinct(), [*keys], "left_anti")


def verify_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Files of a manifest (file, size_bytes, sha256) that are missing or differ from raw_files' rows."""
    found = files.select(F.col("stem").alias("file"), "length", F.col("sha256").alias("found"))
    return manifest.join(found, "file", "left").where(~(F.col("length").eqNullSafe(F.col("size_bytes")) & F.col("found").eqNullSafe(F.col("sha256")))).select("file")
