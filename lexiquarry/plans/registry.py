"""Every registered query of the core library, with its oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table, small in bytes, that one task is given where each is much work.
TASK_ROWS, LEAST_ROWS = 8192, 512


def pieces(table: DataFrame) -> int:
    """Partitions for a table whose rows are much work: they grow with its rows, which the files' footers tell, as bytes don't."""
    rows, usual = table.count(), int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // TASK_ROWS), min(usual, -(-rows // LEAST_ROWS)))


def spread(table: DataFrame, key: str) -> DataFrame:
    return table.repartition(pieces(table), key)


from lexiquarry.plans import documents, library, papers  # noqa: E402, F401
