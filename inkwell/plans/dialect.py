"""One relational statement for two engines: Spark SQL, which runs it, and DuckDB, which checks it.

An operator is a function of a Dialect that returns SQL. What both engines spell alike stands in the statement; what
they spell differently is asked of the dialect.
"""

from __future__ import annotations

import uuid


class Dialect:
    """DuckDB's spelling; tables are views of their names."""

    def table(self, name: str) -> str:
        return name

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def matches(self, x: str, pattern: str) -> str:
        return f"CAST(len(regexp_extract_all({x}, '{pattern}')) AS BIGINT)"

    def extract(self, x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, '{pattern}', {group})"

    def all_matches(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, '{pattern}')"

    def words(self, x: str) -> str:
        """Number of ASCII words between word boundaries (Unicode letters, digits and _ are word characters)."""
        return f"CAST(len(list_filter(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Za-z]+'))) AS BIGINT)"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def split(self, x: str, mark: str) -> str:
        return f"string_split({x}, '{mark}')"

    def unnest(self, columns: str, array: str, source: str) -> str:
        """Rows with pos (from 0) and val."""
        return f"SELECT {columns}, CAST(generate_subscripts({array}, 1) - 1 AS BIGINT) AS pos, unnest({array}) AS val FROM {source}"

    def series(self, columns: str, low: str, high: str, source: str) -> str:
        """Rows with k from low to high."""
        return f"SELECT {columns}, CAST(unnest(generate_series({low}, {high})) AS BIGINT) AS k FROM {source}"

    def gather(self, value: str, order: str, mark: str) -> str:
        return f"string_agg({value}, '{mark}' ORDER BY {order})"

    def percentile(self, x: str, p: float) -> str:
        return f"quantile_cont({x}, {p})"

    def hex_number(self, x: str) -> str:
        return f"CAST('0x' || {x} AS BIGINT)"

    def array_text(self, array: str, mark: str) -> str:
        return f"array_to_string({array}, '{mark}')"

    def log_gamma(self, x: str) -> str:
        return f"lgamma({x})"

    def is_finite(self, x: str) -> str:
        return f"isfinite({x})"

    def whole(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def by_row(self, name: str, key: str) -> bool:
        """Whether what belongs to one key of the table may be computed within its row, with no window or grouping."""
        return False

    def tail(self, x: str, n: int) -> str:
        return f"right({x}, {n})"


#: Tables of texts: work for each row is heavy, so that a single small file must not mean a single task.
HEAVY = ("documents",)


class SparkDialect(Dialect):
    """Spark's spelling; tables are Parquet folders. With a session, a heavy table of fewer partitions than cores is dealt out first."""

    def __init__(self, sf_dir: str, spark=None):
        self.sf_dir, self.spark = sf_dir, spark

    def table(self, name: str) -> str:
        path = f"{self.sf_dir}/{name}.parquet"
        if self.spark is not None and name in HEAVY:
            df, cores = self.spark.read.parquet(path), self.spark.sparkContext.defaultParallelism
            if df.rdd.getNumPartitions() < cores:
                view = f"dealt_{name}_{abs(hash(path)):x}"
                df.repartition(cores, "doc_id").createOrReplaceTempView(view)
                return view
        return f"parquet.`{path}`"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, r'{pattern}', r'{by.replace(chr(92), '$')}')"

    def like(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE r'{pattern}')"

    def matches(self, x: str, pattern: str) -> str:
        return f"CAST(regexp_count({x}, r'{pattern}') AS BIGINT)"

    def extract(self, x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, r'{pattern}', {group})"

    def all_matches(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, r'{pattern}', 0)"

    def words(self, x: str) -> str:
        return f"CAST(regexp_count({x}, r'(?<![\\p{{L}}\\p{{N}}_])[A-Za-z]+(?![\\p{{L}}\\p{{N}}_])') AS BIGINT)"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def split(self, x: str, mark: str) -> str:
        return f"split({x}, '{mark}', -1)"

    def unnest(self, columns: str, array: str, source: str) -> str:
        return f"SELECT {columns}, CAST(pos AS BIGINT) AS pos, val FROM {source} LATERAL VIEW OUTER posexplode({array}) e AS pos, val WHERE pos IS NOT NULL"

    def series(self, columns: str, low: str, high: str, source: str) -> str:
        return f"SELECT {columns}, CAST(k AS BIGINT) AS k FROM {source} LATERAL VIEW explode(CASE WHEN {high} >= {low} THEN sequence({low}, {high}) ELSE array() END) e AS k"

    def gather(self, value: str, order: str, mark: str) -> str:
        return f"array_join(transform(array_sort(collect_list(CASE WHEN {value} IS NOT NULL THEN named_struct('o', {order}, 'v', {value}) END)), s -> s.v), '{mark}')"

    def percentile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})"

    def hex_number(self, x: str) -> str:
        return f"CAST(conv({x}, 16, 10) AS BIGINT)"

    def array_text(self, array: str, mark: str) -> str:
        return f"array_join({array}, '{mark}')"

    def log_gamma(self, x: str) -> str:
        return f"aggregate(sequence(1, greatest(1, CAST({x} AS INT) - 1)), CAST(0 AS DOUBLE), (a, v) -> a + ln(v))"

    def is_finite(self, x: str) -> str:
        return f"(NOT isnan({x}) AND abs({x}) < double('infinity'))"

    def whole(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def by_row(self, name: str, key: str) -> bool:
        """With a session: whether each row has a key of its own, which one narrow count tells. Repeated and null keys take the statement's windows."""
        if self.spark is None:
            return False
        keys = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").groupBy(key).count()
        return keys.where(f"count > 1 OR {key} IS NULL").isEmpty()

    def held(self, name: str, statement: str) -> str:
        """A view of the statement's rows, computed once however often a query names it; for vocabularies, not for tables. With a checkpoint folder they lie there."""
        rows = self.spark.sql(statement)
        rows = rows.localCheckpoint() if self.spark.sparkContext.getCheckpointDir() is None else rows.checkpoint()
        view = f"held_{name}_{uuid.uuid4().hex}"
        rows.createOrReplaceTempView(view)
        return view

    def once(self, columns: str, value: str, name: str, source: str) -> str:
        """columns, and value under this name, computed once for each row: filters and later uses can't copy an expression through a generator."""
        return f"SELECT {columns}, {name} FROM {source} LATERAL VIEW OUTER inline(array(named_struct('{name}', {value}))) once AS {name}"
