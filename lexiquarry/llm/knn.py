"""Exact top-k by inner product as a Voronoi join.

A bounded number of pivots cut both sides into cells. Summaries tell a cell's count, its radius around the pivot and the
longest vector in it. For queries q of cell i around p with radius u, any score with a row o lies in p.o - u|o| .. p.o +
u|o|; the best lower bounds of all rows give the cell's threshold. Cells of data whose summary can't reach it are left out
for that cell of queries as a whole; of other cells those rows are sent whose own upper bound reaches it. Near cells of
queries are solved together, large ones in blocks, over slices of rows, and the slices' best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.llm.common import materialise, parts_for

SCALE, TOP, EVERY = 64, 20, 20
#: Queries in a group, and rows that a group meets in one task, about.
GROUP_QUERIES, SLICE_ROWS = 512, 32_768
#: Rows of a cell, about, and pivots at most: they and the summaries are all that the driver gathers.
CELL_ROWS, PIVOTS = 512, 256


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v: floor(scale * x) as little-endian doubles): rows whose id, vector and components are there and finite."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    whole = F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            flat, at = np.floor(scale * x.flatten().to_numpy(zero_copy_only=False)), x.offsets.to_numpy()
            at = at - at[0]
            cells = [flat[s:e].astype("<f8").tobytes() for s, e in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cells, pa.binary())], ["vec_id", "v"])

    return rows.where(whole).mapInArrow(run, "vec_id long, v binary")


def _matrix(column: pa.Array | pd.Series, width: int) -> np.ndarray:
    cells = column.to_pylist() if isinstance(column, pa.Array) else column.tolist()
    return np.frombuffer(b"".join(cells), dtype="<f8").reshape(-1, width)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while no sum can pass 2**53, else in Python's integers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= 2.0**53:
        big = np.vectorize(int, otypes=[object])
        return np.clip(big(a) @ big(b).T, -(2**63), 2**63 - 1)
    return a @ b.T


def best(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Positions in rows and scores of each query's k best, ties to smaller ids; -1 where there are fewer."""
    order = np.argsort(ids, kind="stable")
    top = np.full((len(queries), k), -1, dtype=np.int64)
    score = np.full((len(queries), k), None, dtype=object)
    for s in range(0, len(order), step):
        at = order[s : s + step]
        got = _products(queries, rows[at])
        free = ids[at][None, :] != own[:, None]
        if got.dtype == object:
            rank = np.array([sorted(range(len(at)), key=lambda j, r=r: (not free[r, j], -got[r, j]))[:k] for r in range(len(queries))], dtype=np.int64)
        else:
            rank = np.argsort(np.where(free, -got, np.inf), axis=1, kind="stable")[:, :k]
        r = np.arange(len(queries))[:, None]
        here = np.where(free[r, rank], at[rank], -1)
        new = np.concatenate([score, got[r, rank].astype(object)], axis=1)
        where = np.concatenate([top, here], axis=1)
        values = np.where(where >= 0, new, 0)
        keep = np.argsort(np.where(where >= 0, -values, np.inf).astype(float), axis=1, kind="stable")[:, :k] if got.dtype != object else np.array([sorted(range(where.shape[1]), key=lambda j, q=q: (where[q, j] < 0, -values[q, j]))[:k] for q in range(len(queries))])
        top, score = where[r, keep], new[r, keep]
    return top, score


@dataclass
class Plan:
    """What the summaries decide. Arrays by cell of queries (i) and of data (j); group numbers of a cell's blocks."""

    pivots: np.ndarray
    radius: np.ndarray  # of the queries of a cell; -1 where there are none
    least: np.ndarray  # score that a row must be able to reach to matter to a cell's queries
    meets: np.ndarray  # [j, i]: whether a row of data cell j can matter to queries of cell i
    first: np.ndarray
    blocks: np.ndarray
    slices: list[int]  # by group

    def excluded(self) -> float:
        """Share of the pairs of cells that the summaries alone leave out."""
        asked = self.meets[:, self.radius >= 0]
        return 1.0 - float(asked.mean()) if asked.size else 0.0


def search(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of highest integer inner product for each row whose id is
    divisible by ``every``; ties go to the smaller id.

    Rows with a null id, a null or empty vector, or a null or non-finite component take no part. Repeated rows are
    candidates each; a query asked twice has one answer, and rows of its id, its own among them, aren't in it. Vectors
    score only with those of their length. Fewer than k candidates give fewer rows, none none.
    """
    spark = df.sparkSession
    rows = materialise(vectors(df, id_col, vector_col, scale).withColumn("width", (F.length("v") / 8).cast("int")), "vectors")
    found = None
    for width in sorted(r["width"] for r in rows.select("width").distinct().collect()):
        part = _search_width(rows.where(F.col("width") == width).select("vec_id", "v"), width, k, every)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pivots(data: DataFrame, width: int) -> np.ndarray:
    n = int(min(PIVOTS, max(1, -(-data.count() // CELL_ROWS))))
    return np.array([np.frombuffer(r["v"], dtype="<f8") for r in data.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(n).collect()]).reshape(-1, width)


def cells(data: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """(vec_id, v, cell, far, norm): the nearest pivot, its distance and the vector's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            gap = (x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(axis=1)[None, :]
            near = gap.argmin(axis=1)
            far, norm = np.sqrt(((x - pivots[near]) ** 2).sum(axis=1)), np.sqrt((x**2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(near.astype(np.int32)), pa.array(far), pa.array(norm)], ["vec_id", "v", "cell", "far", "norm"])

    return data.mapInArrow(run, "vec_id long, v binary, cell int, far double, norm double")


def _thresholds(data: DataFrame, pivots: np.ndarray, radius: np.ndarray, width: int, need: int) -> np.ndarray:
    """For each cell of queries the need-th best of all rows' lower bounds; -inf where there are fewer."""

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = np.zeros((0, len(pivots)))
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            bound = x @ pivots.T - np.maximum(radius, 0)[None, :] * np.sqrt((x**2).sum(axis=1))[:, None]
            tops = -np.sort(-np.concatenate([tops, bound]), axis=0)[:need]
        if len(tops):
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(len(pivots), dtype=np.int32), len(tops))), pa.array(tops.ravel())], ["cell", "bound"])

    ranked = Window.partitionBy("cell").orderBy(F.desc("bound"))
    least = np.full(len(pivots), -np.inf)
    for r in data.select("v").mapInArrow(lower, "cell int, bound double").withColumn("n", F.row_number().over(ranked)).where(F.col("n") == need).collect():
        least[r["cell"]] = r["bound"]
    return least - 1e-6 * (1 + np.where(np.isfinite(least), np.abs(least), 0))


def _groups(pivots: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First group and number of groups of each cell of queries: near cells share one, large ones have several."""
    first, blocks = np.zeros(len(asked), dtype=np.int64), np.ones(len(asked), dtype=np.int64)
    left, group = set(np.flatnonzero(asked).tolist()), 0
    while left:
        seed = max(left, key=lambda i: (asked[i], -i))
        if asked[seed] > GROUP_QUERIES:
            first[seed], blocks[seed] = group, -(-asked[seed] // GROUP_QUERIES)
            group += int(blocks[seed])
            left.discard(seed)
            continue
        room = GROUP_QUERIES
        for i in sorted(left, key=lambda i: (float(((pivots[i] - pivots[seed]) ** 2).sum()), i)):
            if asked[i] <= room:
                first[i], room = group, room - int(asked[i])
                left.discard(i)
        group += 1
    return first, blocks


def plan(data: DataFrame, pivots: np.ndarray, width: int, k: int, every: int) -> Plan:
    """data: rows of ``cells``. Two aggregates by cell, and the thresholds."""
    n = len(pivots)
    count, far, norm, asked, radius = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, dtype=np.int64), np.full(n, -1.0)
    for r in data.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm")).collect():
        count[r["cell"]], far[r["cell"]], norm[r["cell"]] = r["n"], r["far"], r["norm"]
    queries = data.where(F.col("vec_id") % every == 0)
    for r in queries.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
        asked[r["cell"]], radius[r["cell"]] = r["n"], r["far"]
    own = queries.groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    least = _thresholds(data, pivots, radius, width, k + own)
    size = np.sqrt((pivots**2).sum(axis=1))
    # p_i.o + u_i|o| for any o of cell j: its offset from p_j adds at most |p_i| times the cell's radius
    most = pivots @ pivots.T + far[:, None] * size[None, :] + norm[:, None] * np.maximum(radius, 0)[None, :]
    meets = (most * (1 + 1e-9) + 1e-6 >= least[None, :]) & (count > 0)[:, None] & (radius >= 0)[None, :]
    first, blocks = _groups(pivots, asked)
    rows = np.zeros(int((first + blocks)[asked > 0].max(initial=0)))
    for g in range(len(rows)):
        mine = (asked > 0) & (first <= g) & (g < first + blocks)
        rows[g] = count[meets[:, mine].any(axis=1)].sum()
    return Plan(pivots, radius, least, meets, first, blocks, [max(1, -(-int(r) // SLICE_ROWS)) for r in rows])


def _search_width(rows: DataFrame, width: int, k: int, every: int) -> DataFrame:
    pivots = _pivots(rows, width)
    data = materialise(cells(rows, pivots, width), "cells")
    p = plan(data, pivots, width, k, every)
    first, blocks, deal = p.first, p.blocks, np.array(p.slices or [1])
    asked = np.flatnonzero(p.radius >= 0)
    groups = [(int(first[i]) + b, int(i)) for i in asked for b in range(int(blocks[i]))]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cell = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("cell").to_numpy(zero_copy_only=False)
            g = first[cell] + (ids.astype(np.uint64) // np.uint64(max(every, 1)) % blocks[cell].astype(np.uint64)).astype(np.int64)
            at = np.repeat(np.arange(len(ids)), deal[g])
            s = np.arange(len(at)) - np.repeat(np.cumsum(deal[g]) - deal[g], deal[g])
            yield pa.RecordBatch.from_arrays([pa.array(g[at].astype(np.int32)), pa.array(s), pa.array(ids[at]), batch.column("v").take(pa.array(at))], ["g", "s", "query_id", "q"])

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, cell = _matrix(batch.column("v"), width), batch.column("cell").to_numpy(zero_copy_only=False)
            ids, norm = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("norm").to_numpy()
            reach = np.zeros((len(x), len(deal)), dtype=bool)
            sure = 1e-9 * norm[:, None] * np.sqrt((p.pivots[asked] ** 2).sum(axis=1))[None, :]
            hits = p.meets[cell][:, asked] & (x @ p.pivots[asked].T + p.radius[asked][None, :] * norm[:, None] + sure >= p.least[asked][None, :])
            column = {int(i): c for c, i in enumerate(asked)}
            for g, i in groups:
                reach[:, g] |= hits[:, column[i]]
            at, g = np.nonzero(reach)
            s = (np.abs(ids[at] * 2654435761) >> 7) % deal[g]
            yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(s), pa.array(ids[at]), batch.column("v").take(pa.array(at))], ["g", "s", "vec_id", "v"])

    def solve(asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if asks.empty or rows.empty:
            return pd.DataFrame({"query_id": [], "query_key": [], "vec_id": [], "score": []}).astype("int64")
        own, ids = asks["query_id"].to_numpy(), rows["vec_id"].to_numpy()
        top, score = best(_matrix(asks["q"], width), own, ids, _matrix(rows["v"], width), k)
        at, j = np.nonzero(top >= 0)
        key = pd.util.hash_array(asks["q"].to_numpy(dtype=object), categorize=False).astype("int64") if again else np.zeros(len(own), dtype=np.int64)
        return pd.DataFrame({"query_id": own[at], "query_key": key[at], "vec_id": ids[top[at, j]], "score": np.array([int(x) for x in score[at, j]], dtype=np.int64)})

    n = parts_for(data)
    queries = data.where(F.col("vec_id") % every == 0).select("vec_id", "v", "cell").distinct()
    again = not queries.groupBy("vec_id").count().where("count > 1").isEmpty()
    left = queries.mapInArrow(ask, "g int, s long, query_id long, q binary")
    right = data.select("vec_id", "v", "cell", "norm").mapInArrow(replicate, "g int, s long, vec_id long, v binary")
    return left.repartition(n, "g", "s").groupBy("g", "s").cogroup(right.repartition(n, "g", "s").groupBy("g", "s")).applyInPandas(solve, "query_id long, query_key long, vec_id long, score long")
