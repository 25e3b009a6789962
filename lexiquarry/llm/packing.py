"""Best-two-fit packing of token sequences, planned on the histogram of piece lengths.

Pieces of one length are alike to a packer, so the plan needs only the count of each length: at most ``capacity``
numbers, whatever the corpus. Each step of the plan is a pattern of lengths with the number of sequences filled by it.
Pieces then take their places by their rank among those of their length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.llm.common import materialise, slices, texts

CAPACITY, END_ID, VOCABULARY = 2048, 0, "byte_bpe_50k"
#: Texts of these characters alone are cut alike by both regex engines; the quicker encoder takes them.
PLAIN = re.compile("[\t\n\r -~¡-ſ]*")
#: Pieces of one length that are ranked together, about.
RANKED = 4096


@cache
def encoder(vocabulary: str):
    """text to token ids as an array. Both encoders hold the same vocabulary; the second covers all of Unicode."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact: list[Tokenizer] = []

    def encode(text: str) -> np.ndarray:
        if PLAIN.fullmatch(text):
            return quick.encode_to_numpy(text, disallowed_special=())
        if not exact:
            exact.append(Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json")))
            exact[0].encode_special_tokens = True
        return np.array(exact[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece int, start long, length long, ids_crc32 long): each document's ids and an end id, cut only if
    longer than capacity; then all pieces but the first are full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for part, data, offsets in slices(batches, "text"):
            rows: list[tuple[int, int, int, int, int]] = []
            for i, (s, e) in enumerate(zip(offsets, offsets[1:])):
                ids = np.append(encode(data[s:e].tobytes().decode()), END_ID).astype("<u4")
                cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                rows += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            own = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(own[0], pa.int64())), pa.array(own[1], pa.int32()), *(pa.array(x, pa.int64()) for x in own[2:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = texts(df, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def _fill(have: np.ndarray, first: int, capacity: int) -> list[int]:
    """One sequence's lengths from those there are: greedily the longest that fits, then the exchange."""
    free = have.copy()
    bin_, gap = [first], capacity - first
    free[first] -= 1
    while gap:
        fits = np.flatnonzero(free[1 : gap + 1])
        if not len(fits):
            break
        bin_.append(int(fits[-1]) + 1)
        free[bin_[-1]] -= 1
        gap -= bin_[-1]
    if not gap or len(bin_) < 2:
        return bin_
    small = bin_[-1]
    room = gap + small
    there = np.zeros(room + 1, dtype=np.int64)
    idx = np.arange(room + 1)
    there[1:] = np.where(free[1 : room + 1] > 0, idx[1:], 0)
    upto = np.maximum.accumulate(there)  # the longest there is of at most so many tokens
    a = idx[1:][there[1:] > 0]
    b = upto[np.minimum(room - a, a - (free[a] < 2))]
    both = np.where(b > 0, a + b, 0)
    if len(a) and both.max() > small:
        best = int(both.argmax())
        return [*bin_[:-1], int(a[best]), int(b[best])]
    return bin_


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Counts of lengths to places (length, first rank, per sequence, first sequence, offset), and the sequences used.

    The longest piece left opens a sequence, which is filled greedily; then its smallest piece gives way to two others
    if these leave a smaller gap. The same pattern is used as long as there are pieces for it.
    """
    have = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        have[length] = n
    used = np.zeros(capacity + 1, dtype=np.int64)
    places, sequence = [], 0
    while len(left := np.flatnonzero(have)):
        lengths, need = np.unique(_fill(have, int(left[-1]), capacity), return_counts=True)
        times = int((have[lengths] // need).min())
        offset = 0
        for length, n in zip(lengths.tolist(), need.tolist()):
            places.append((length, int(used[length]), n, sequence, offset))
            offset += length * n
        have[lengths] -= times * need
        used[lengths] += times * need
        sequence += times
    return places, sequence


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end id alone. Repeated rows and null ids are packed like any other row.
    No rows give no rows. The driver gathers the count of each length, no more than ``capacity`` rows.
    """
    rows = materialise(pieces(df, id_col, text_col, capacity, vocabulary), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places, _ = plan(counts, capacity)
    salts = np.ones(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        salts[length] = min(RANKED, -(-n // RANKED))
    salted = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(F.lit([int(x) for x in salts]), (F.col("length") + 1).cast("int")))
    rows = rows.withColumn("salt", salted.cast("int"))
    sizes = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = rows.withColumn("rank", rank).join(sizes, ["length", "salt"]).withColumn("rank", F.col("rank") - 1 + F.col("before"))
    table = np.array(sorted(places), dtype=np.int64).reshape(-1, 5)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy()
        row = table[np.searchsorted((table[:, 0] << 48) | table[:, 1], (length << 48) | rank, side="right") - 1]
        nth = rank - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 3] + nth // row[:, 2], "offset": row[:, 4] + nth % row[:, 2] * length})

    out = ranked.withColumn("place", place("length", "rank"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
