"""Mastery as an event-sourced state machine, in closed form over windows.

A card starts in box 0. The first correct answer puts it in box 2, each further one a box higher up to 3; a wrong one
puts it in box 1. So a card that has been seen is in box min(3, 1 + correct answers since the last wrong one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_BOX = 3


def boxes(events: DataFrame, keys: list[str], correct: str = "correct", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """One row a card: box, seen, correct, wrong, last. Partial aggregates only: no window, so hot cards don't hurt.

    The streak is the number of correct answers after the latest wrong one; events are ordered by (ts, tie).
    """
    at = F.struct(F.col(ts), *([F.col(tie)] if tie else []))
    base = events.select(*keys, F.col(correct).alias("_ok"), at.alias("_at"), F.col(ts).alias("_ts"))
    last_wrong = base.where(~F.col("_ok")).groupBy(*keys).agg(F.max("_at").alias("_wrong"))
    joined = base.join(last_wrong, keys, "left")
    after = F.col("_ok") & (F.col("_wrong").isNull() | (F.col("_at") > F.col("_wrong")))
    return joined.groupBy(*keys).agg(
        F.least(F.lit(TOP_BOX), 1 + F.count_if(after)).cast("int").alias("box"),
        F.count("*").alias("seen"),
        F.count_if("_ok").alias("correct"),
        F.count_if(~F.col("_ok")).alias("wrong"),
        F.max("_ts").alias("last"),
    )


def trajectory(events: DataFrame, keys: list[str], order: list[str], correct: str = "correct") -> DataFrame:
    """The box after every event."""
    w = Window.partitionBy(*keys).orderBy(*order)
    falls = F.sum(F.when(F.col(correct), 0).otherwise(1)).over(w)
    with_run = events.withColumn("_run", falls)
    streak = F.sum(F.when(F.col(correct), 1).otherwise(0)).over(Window.partitionBy(*keys, "_run").orderBy(*order))
    return with_run.withColumn("box", F.least(F.lit(TOP_BOX), 1 + streak).cast("int")).drop("_run")


def with_progress(cards: DataFrame, progress: DataFrame, keys: list[str]) -> DataFrame:
    """Cards with their box; none yet is box 0."""
    return cards.join(progress.select(*keys, "box"), keys, "left").withColumn("box", F.coalesce("box", F.lit(0)))


def half_up(c: Column) -> Column:
    """Rounds halves up, as positive percentages are."""
    return F.floor(c + 0.5)


def mastery_percent(cards: DataFrame, progress: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    found = with_progress(cards, progress, keys)
    return found.groupBy(*by).agg(half_up(F.sum("box") / (F.count("*") * TOP_BOX) * 100).cast("long").alias("percent"))


def weak_cards(cards: DataFrame, progress: DataFrame, keys: list[str]) -> DataFrame:
    return with_progress(cards, progress, keys).where(F.col("box") < TOP_BOX)


def deck(cards: DataFrame, choice: str = "all") -> DataFrame:
    """Cards with box and starred: all of them, the weak or the starred."""
    test = {"all": F.lit(True), "weak": F.col("box") < TOP_BOX, "starred": F.coalesce(F.col("starred"), F.lit(False))}[choice]
    return cards.where(test)


def stars(toggles: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Starred after an odd number of toggles; last touched at the latest."""
    return toggles.groupBy(*keys).agg((F.count("*") % 2 == 1).alias("starred"), F.max(ts).alias("last"))


def stamp(cards: DataFrame, by: list[str], last: str = "last") -> DataFrame:
    """When a set's progress was last touched; 0 without cards."""
    return cards.groupBy(*by).agg(F.coalesce(F.max(last), F.lit(0)).alias("stamp"))


def match_answers(pairs: DataFrame, missed: DataFrame, keys: list[str]) -> DataFrame:
    """A round's pairs as answers: those never missed are correct."""
    gone = missed.select(*keys).distinct().withColumn("_missed", F.lit(True))
    return pairs.join(gone, keys, "left").withColumn("correct", F.col("_missed").isNull()).drop("_missed")


def best_time(old: Column, new: Column) -> Column:
    """The faster of two times; one that is missing or not positive doesn't count."""
    real = lambda c: F.when(c > 0, c)
    return F.least(real(old), real(new))
