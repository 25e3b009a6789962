"""Mixing sources to target weights by Sainte-Laguë apportionment of blocks.

A source's documents are dealt by a seeded hash into shards, a shard's words (in seeded document order) are cut into at
most ``BLOCKS`` blocks of equal size (to a word), and whole numbers of block draws are apportioned, by highest
quotients w / (2 s + 1), first to sources and then to the shards of each. A shard with q draws of n blocks takes every
block q div n times and q mod n of them, by a seeded permutation, once more. No block is drawn more than ``MOST`` times.
Numbers of blocks are powers of two, so that shards of a source fall into a few classes that quotients don't tell apart:
the driver apportions to classes, and ranks within a class say which shards get the last seats.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.llm.common import WORD, materialise

WEIGHTS, SHARE, MOST = (3, 1, 2), Fraction(3, 2), 2
#: Blocks in a shard at most (a power of two), words in a shard about, shards that are ranked together.
BLOCKS, SHARD_WORDS, RANKED = 1024, 65536, 4096
SEED = 20240607


def targets(sizes: list[int], weights: list[int], share: Fraction = SHARE, most: int = MOST) -> list[float]:
    """Splits share * sum(sizes) by weight; none above most * its size, whose excess the others get by weight."""
    left, free, out = share * sum(sizes), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while free:
        total = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / total >= most * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
            free.discard(i)
    return [float(x) for x in out]


def sainte_lague(weights: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by highest quotients weight / (2 * seats so far + 1), ties to the first; none gets more than its cap."""
    weights, caps = np.asarray(weights, dtype=float), np.asarray(caps, dtype=np.int64)
    seats = min(int(seats), int(caps[weights > 0].sum()))
    given = lambda divisor: np.minimum(caps, np.floor(weights / divisor + 0.5).astype(np.int64))
    if seats <= 0:
        return np.zeros(len(weights), dtype=np.int64)
    low, high = weights[weights > 0].min() / (2 * seats + 2 * len(weights) + 2), 4 * weights.max() + 1
    for _ in range(200):  # high always gives too few seats, or as many as there are
        mid = (low + high) / 2
        low, high = (low, mid) if given(mid).sum() <= seats else (mid, high)
    out = given(high)
    queue = [(-w / (2 * s + 1), i) for i, (w, s, c) in enumerate(zip(weights, out.tolist(), caps.tolist())) if w > 0 and s < c]
    heapq.heapify(queue)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(queue)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(queue, (-weights[i] / (2 * out[i] + 1), i))
    return out


def class_seats(classes: dict[int, int], seats: int, most: int = MOST) -> dict[int, tuple[int, int]]:
    """Sainte-Laguë for shards by class: {blocks: number of shards} to {blocks: (seats of each, shards with one more)}.

    The same as ``sainte_lague`` with the blocks as weights and ``most`` times the blocks as caps. Powers of two over odd
    numbers differ between classes, so only shards of one class ever tie.
    """
    kinds = sorted((b for b in classes if b > 0), reverse=True)
    given = dict.fromkeys(kinds, 0)
    left = min(seats, sum(most * b * classes[b] for b in kinds))
    if kinds and left:
        low, high = 0.0, 4.0 * kinds[0] + 1
        at = lambda d: {b: min(most * b, int(b / d + 0.5)) for b in kinds}
        for _ in range(200):  # high always gives too few seats, or as many as there are
            mid = (low + high) / 2
            low, high = (low, mid) if mid > 0 and sum(n * classes[b] for b, n in at(mid).items()) <= left else (mid, high)
        given = at(high)
        left -= sum(n * classes[b] for b, n in given.items())
    more = dict.fromkeys(kinds, 0)
    while left > 0:
        b = max((b for b in kinds if given[b] < most * b), key=lambda b: b / (2 * given[b] + 1))
        take = min(left, classes[b])
        left -= take
        given, more = (given | {b: given[b] + 1}, more) if take == classes[b] else (given, more | {b: take})
    return {b: (given[b], more[b]) for b in kinds}


def _ranks(shards: DataFrame) -> DataFrame:
    """Adds each shard's rank (from 0) among those of its source and number of blocks, without a task for all of them."""
    shards = shards.withColumn("part", F.col("shard") % F.greatest(F.lit(1), F.ceil(F.col("shards") / RANKED)).cast("int"))
    own = F.row_number().over(Window.partitionBy("source_no", "n", "part").orderBy("shard")) - 1
    parts = shards.groupBy("source_no", "n", "part").agg(F.count("*").alias("many"))
    before = F.coalesce(F.sum("many").over(Window.partitionBy("source_no", "n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return shards.withColumn("own", own).join(parts.withColumn("before", before).drop("many"), ["source_no", "n", "part"]).withColumn("rank", F.col("before") + F.col("own")).drop("own", "before", "part")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (), seed: int = SEED) -> DataFrame:
    """One row for each row of df: doc_id, the columns to keep, source, size, source_size, target, taken, copies, extra.

    The mix takes the whole document ``copies`` times and the word ranges [start, end) of ``extra`` once more; taken
    counts those words. Texts without words, null ones too, have size 0 and aren't taken; a null source is a source of
    its own, the last; null ids and repeated rows are rows like any other. The same rows give the same mix. No rows give
    no rows. What the driver gathers is a row for each source and each power of two up to ``BLOCKS``.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("doc_id"), *keep, F.col(source_col).alias("source"), F.xxhash64(text_col).alias("tie"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"))
    totals = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    names = sorted(totals, key=lambda s: (s is None, s if s is not None else ""))
    sizes = [totals[s] for s in names]
    aims = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))])
    plan = [(i, s, n, t, max(1, -(-n // SHARD_WORDS))) for i, (s, n, t) in enumerate(zip(names, sizes, aims))]
    kind = rows.schema["source"].dataType.simpleString()
    sources = spark.createDataFrame(plan, f"source_no int, name {kind}, source_size long, target double, shards long")
    deal = F.pmod(F.xxhash64("doc_id", "tie", F.lit(seed)), F.col("shards"))
    dealt = rows.join(sources, rows["source"].eqNullSafe(sources["name"])).withColumn("shard", deal)
    blocks = F.when(F.col("words") >= BLOCKS, F.lit(BLOCKS)).when(F.col("words") > 0, F.expr("shiftleft(1, int(floor(log2(words))))")).otherwise(0)
    held = dealt.groupBy("source_no", "shards", "shard").agg(F.sum("size").alias("words")).withColumn("n", blocks.cast("int"))
    held = materialise(held, "shards")
    classes: dict[int, dict[int, int]] = {i: {} for i in range(len(names))}
    for r in held.groupBy("source_no", "n").agg(F.count("*").alias("many")).collect():
        classes[r["source_no"]][r["n"]] = r["many"]
    n = np.array([sum(b * c for b, c in classes[i].items()) for i in range(len(names))], dtype=np.int64)
    ratio = np.array([t / s if s else 0.0 for s, t in zip(sizes, aims)])
    draws = sainte_lague(ratio * n, round(float((ratio * n).sum())), MOST * n)
    quotas = [(i, b, each, more) for i, total in enumerate(draws.tolist()) for b, (each, more) in class_seats(classes[i], total).items()]
    quota = spark.createDataFrame([*quotas, *((i, 0, 0, 0) for i in range(len(names)))], "source_no int, n int, each long, more long")
    shards = _ranks(held).join(quota, ["source_no", "n"]).select("source_no", "shard", "words", "n", (F.col("each") + (F.col("rank") < F.col("more")).cast("long")).alias("draws"))
    order = Window.partitionBy("source_no", "shard").orderBy(F.xxhash64("doc_id", "tie", F.lit(seed + 1)), "doc_id", "tie")
    placed = dealt.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("at", F.col("upto") - F.col("size"))
    placed = placed.join(shards, ["source_no", "shard"])
    turn = F.lit(2) * F.pmod(F.xxhash64("source_no", "shard", F.lit(seed + 2)), F.lit(BLOCKS // 2)) + 1
    shift = F.pmod(F.xxhash64("source_no", "shard", F.lit(seed + 3)), F.lit(BLOCKS))
    placed = placed.withColumn("turn", turn).withColumn("shift", shift)
    first, last = F.expr("((at + 1) * n - 1) div words"), F.expr("(upto * n - 1) div words")
    touched = F.when((F.col("size") > 0) & (F.col("draws") % F.col("n") > 0), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    drawn = F.filter(touched, lambda j: F.pmod(j * F.col("turn") + F.col("shift"), F.col("n")) < F.col("draws") % F.col("n"))
    edge = lambda j: F.call_function("div", j * F.col("words"), F.col("n").cast("long"))
    extra = F.transform(drawn, lambda j: F.struct((F.greatest(edge(j), F.col("at")) - F.col("at")).alias("start"), (F.least(edge(j + 1), F.col("upto")) - F.col("at")).alias("end")))
    placed = placed.withColumn("extra", extra).withColumn("copies", F.when(F.col("size") > 0, F.floor(F.col("draws") / F.col("n"))).otherwise(0).cast("int"))
    taken = F.col("copies") * F.col("size") + F.aggregate("extra", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return placed.select("doc_id", *keep, "source", "size", "source_size", "target", taken.alias("taken"), "copies", "extra")


def taken_text() -> Column:
    """The texts that the mix takes of a row of ``mix`` that kept its text, as an array: whole copies, then the rest."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    parts = F.transform("extra", lambda x: F.array_join(F.slice(words, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")), " "))
    rest = F.when(F.size("extra") > 0, F.array(F.array_join(parts, "\n"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array_repeat("text", F.col("copies")), rest)
