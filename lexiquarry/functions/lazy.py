"""Vectorised functions that need no session until they are called."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Rows that a light function and a parser take at once, and bytes of an Arrow batch: what Python holds is bounded by them.
ROWS, FEW, BATCH_BYTES = 1024, 64, 8 << 20


def small_batches(spark: SparkSession | None) -> None:
    """A session that leaves the size of Arrow batches to Spark gets smaller ones."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark and spark.conf.get(key) == "67108864b":
        spark.conf.set(key, f"{BATCH_BYTES}b")


def sliced(f: Callable, kind: str, columns: int, rows: int) -> Callable:
    """f over iterators of batches, so many rows at a time: results go to Arrow before the next rows are worked on."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            held = batch if isinstance(batch, tuple) else (batch,)
            for i in range(0, len(held[0]), rows):
                yield f(*(c.iloc[i : i + rows].reset_index(drop=True) for c in held))

    run = wraps(f)(run)
    del run.__wrapped__
    out = pd.DataFrame if kind.startswith("struct<") else pd.Series
    run.__annotations__ = {"batches": Iterator[pd.Series if columns == 1 else tuple[(pd.Series,) * columns]], "return": Iterator[out]}
    return run


def vectorised(kind: str, rows: int = ROWS) -> Callable:
    def made(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns: Column | str) -> Column:
            small_batches(SparkSession.getActiveSession())
            return F.pandas_udf(sliced(f, kind, len(columns), rows), kind)(*columns)

        return call

    return made
