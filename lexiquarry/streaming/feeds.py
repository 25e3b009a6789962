"""Streams: remote changes folded into stored state, and mastery kept card by card.

Both give what the batch operators give on the same rows. The fold compares strictly, so a replayed batch changes
nothing; the state is a versioned table, so a batch that failed half way leaves the last version whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexiquarry.operators import sync

CHANGE = "id string, title string, markdown string, created_at bigint, updated_at bigint, deleted boolean, deleted_at bigint"
STATE = "id string, alive boolean, title string, markdown string, created_at bigint, updated_at bigint, deleted_at bigint"
#: Pushes wait this long for more changes.
DEBOUNCE = "1 second"


class SetStore:
    """The folded state, one folder a version; the newest whole one is the state."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        done = lambda p: fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("v") and done(s.getPath()))

    def read(self) -> DataFrame:
        versions = self._versions()
        return self.spark.read.schema(STATE).parquet(f"{self.path}/v{versions[-1]}") if versions else self.spark.createDataFrame([], STATE)

    def fold(self, changes: DataFrame, batch: int) -> None:
        state = self.read()
        local, tombs = state.where("alive").select("id", *sync.SET), state.where("deleted_at is not null").select("id", "deleted_at")
        merged = sync.merge_sets(local, tombs, sync.latest(changes)).select(*(c.split()[0] for c in STATE.split(", ")))
        merged.where("alive or deleted_at is not null").write.mode("overwrite").parquet(f"{self.path}/v{batch + 1}")


def fold_changes(spark: SparkSession, source: str, store: SetStore, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Folds JSON change files into the store, a micro-batch at a time."""
    stream = spark.readStream.schema(CHANGE).json(source)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": DEBOUNCE})).foreachBatch(store.fold).start()


def push_loop(spark: SparkSession, source: str, plan: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Calls plan with each debounced batch of local changes."""
    stream = spark.readStream.schema(CHANGE).json(source)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=DEBOUNCE).foreachBatch(lambda rows, _: plan(rows)).start()


ANSWER = "set_id string, card_id string, correct boolean, ts bigint"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    box, seen, right, last = state.get if state.exists else (0, 0, 0, 0)
    for row in pd.concat(list(batches)).sort_values("ts", kind="stable").itertuples():
        box = min(3, max(1, box) + 1) if row.correct else 1
        seen, right, last = seen + 1, right + bool(row.correct), int(row.ts)
    state.update((box, seen, right, last))
    yield pd.DataFrame([{"set_id": key[0], "card_id": key[1], "box": box, "seen": seen, "correct": right, "wrong": seen - right, "last": last}])


def mastery(answers: DataFrame) -> DataFrame:
    """A stream of answers to a card's progress after each micro-batch; answers of one card must not come late."""
    out = "set_id string, card_id string, box int, seen bigint, correct bigint, wrong bigint, last bigint"
    return answers.groupBy("set_id", "card_id").applyInPandasWithState(_step, out, "box int, seen bigint, correct bigint, last bigint", "update", GroupStateTimeout.NoTimeout)


def activity(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events in windows by type, with a watermark that bounds the state."""
    rows = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    return rows.groupBy(F.window("_at", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")
