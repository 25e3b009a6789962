"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds the hashes of its prefixes, in two bases modulo the prime 2**31 - 1. One subtraction and one
product give any span's hash, so spans are compared in constant time and the longest common extension of two places
is found by binary search. A fingerprint is the whole text's hash and length, the prefix array at up to ``MARKS`` places
from either end, and the least ``SKETCH`` hashes of the spans of ``SPAN`` characters. Two fingerprints' longest common
extensions from the first and the last character are found by binary search in those arrays; the spans within them are
surely shared. The sketch estimates the share of all spans, so the likeness is the larger of the two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.common import dealt, mix, parts_for, slices, texts

PRIME, BASES = (1 << 31) - 1, (1_103_515_245, 1_664_525_893)
SPAN, SKETCH, MARKS = 16, 64, 32
#: Cuts that are looked at for each partition, so that partitions hold much the same number of characters.
FINE = 16
_powers: dict[int, np.ndarray] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """Any uint64 modulo 2**31 - 1."""
    p = np.uint64(PRIME)
    x = (x & p) + (x >> np.uint64(31))
    x = (x & p) + (x >> np.uint64(31))
    return np.where(x >= p, x - p, x)


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        have = np.ones(size, dtype=np.uint64)
        at, step = 1, base
        while at < size:  # doubling: the next part is this one times base ** at
            have[at : 2 * at] = _fold(have[: min(at, size - at)] * np.uint64(step))
            at, step = 2 * at, step * step % PRIME
        _powers[base] = have
    return have


class PrefixHash:
    """The prefix arrays of one text (or of several, one after the other), given as code points."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.sums, self.turn = [], []
        for base in BASES:
            terms = _fold((points.astype(np.uint64) + np.uint64(1)) * _power(base, self.n + 1)[: self.n])
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(terms, out=sums[1:])  # fewer than 2**33 terms below 2**31
            self.sums.append(_fold(sums))
            self.turn.append(_power(pow(base, -1, PRIME), self.n + 1))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """62-bit hashes of spans: of equal spans, wherever they stand, equal."""
        out = None
        for sums, turn in zip(self.sums, self.turn):
            each = _fold(_fold(sums[ends] + np.uint64(PRIME) - sums[starts]) * turn[starts])
            out = each if out is None else (out << np.uint64(31)) | each
        return out

    def equal(self, a: int, b: int, length: int) -> bool:
        x = self.spans(np.array([a, b]), np.array([a, b]) + length)
        return bool(x[0] == x[1])

    def common(self, a: int, b: int) -> int:
        """Length of the longest common extension of the places a and b."""
        low, high = 0, self.n - max(a, b)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(a, b, mid) else (low, mid - 1)
        return low


@dataclass
class Fingerprint:
    whole: int
    length: int
    head: np.ndarray  # hashes of the first 1, 2, 3 .. strides of characters
    tail: np.ndarray  # of the last ones
    least: np.ndarray  # the least hashes of spans, ascending

    @property
    def stride(self) -> int:
        return stride(self.length)

    def __str__(self) -> str:
        marks = "".join(f"{x:08x}" for x in [*self.head.tolist(), *self.tail.tolist()])
        return f"{self.whole:016x}{self.length:08x}{marks}" + "".join(f"{x:016x}" for x in self.least.tolist())


def stride(length: int) -> int:
    """Characters between marks: a power of two, so that the coarser of two grids is a part of the finer."""
    return 1 << max(0, (max(length, 1) - 1) // MARKS).bit_length()


def fingerprints(points: np.ndarray, at: np.ndarray) -> list[Fingerprint]:
    """The fingerprints of texts one after the other, with n + 1 offsets."""
    table = PrefixHash(points)
    size = np.diff(at)
    whole = mix(table.spans(at[:-1], at[1:]) ^ mix(size.astype(np.uint64)))
    if not len(points):
        none = np.zeros(0, dtype=np.uint64)
        return [Fingerprint(w, 0, none, none, none) for w in whole.tolist()]
    starts = np.arange(len(points))
    grams = mix(table.spans(starts, np.minimum(starts + SPAN, len(points))))
    step = np.array([stride(n) for n in size.tolist()], dtype=np.int64)
    many = size // step
    of = np.repeat(np.arange(len(size)), many)
    reach = (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + 1) * step[of]
    head = mix(table.spans(at[:-1][of], at[:-1][of] + reach)) >> np.uint64(32)
    tail = mix(table.spans(at[1:][of] - reach, at[1:][of])) >> np.uint64(32)
    cuts, out = np.concatenate(([0], np.cumsum(many))).tolist(), []
    for i, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        own = grams[s : e - SPAN + 1] if e - s >= SPAN else whole[i : i + 1][: e - s]
        if len(own) > 8 * SKETCH:
            least = np.unique(np.partition(own, 4 * SKETCH)[: 4 * SKETCH])
            own = least if len(least) >= SKETCH else own
        out.append(Fingerprint(int(whole[i]), e - s, head[cuts[i] : cuts[i + 1]], tail[cuts[i] : cuts[i + 1]], np.unique(own)[:SKETCH]))
    return out


def extension(a: Fingerprint, b: Fingerprint, end: str) -> int:
    """Characters that the texts surely share from their first (end = "head") or last ("tail") one on, by binary search."""
    step = max(a.stride, b.stride)
    x, y = (getattr(f, end)[step // f.stride - 1 :: step // f.stride] for f in (a, b))
    low, high = 0, min(len(x), len(y))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if x[mid - 1] == y[mid - 1] else (low, mid - 1)
    return low * step


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """The Jaccard similarity of the texts' spans, as far as their fingerprints tell: 0 to 1, 1 for equal texts."""
    if (a.whole, a.length) == (b.whole, b.length):
        return 1.0
    if not len(a.least) or not len(b.least):
        return 0.0
    spans = max(0, a.length - SPAN + 1) + max(0, b.length - SPAN + 1)
    head = extension(a, b, "head")
    tail = min(extension(a, b, "tail"), min(a.length, b.length) - head)
    shared = max(0, head - SPAN + 1) + max(0, tail - SPAN + 1)
    both = np.union1d(a.least, b.least)[:SKETCH]
    sketch = float((np.isin(both, a.least, assume_unique=True) & np.isin(both, b.least, assume_unique=True)).mean())
    return max(sketch, shared / max(spans - shared, 1))


def _dealt(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows in partitions by descending id, each followed by the row that comes next in the whole table (lent = true).

    Ids are cut at many quantiles, and runs of what lies between them make up buckets of much the same number of
    characters. A bucket's first row also goes to the bucket before it, and the very first to the last. What the driver
    gathers is ``FINE`` values for each bucket.
    """
    n = parts_for(df)
    rows = texts(df, id_col, text_col).withColumn("tie", F.xxhash64("text")).withColumn("id_", F.col("doc_id").cast("double"))
    fine = n * FINE if n > 1 else 1
    ids = df.select(F.col(id_col).cast("double").alias("id")).where("id is not null")
    cuts = sorted({float(c) for c in ids.approxQuantile("id", [i / fine for i in range(1, fine)], 0.2 / fine)}) if n > 1 else []
    rows = rows.withColumn("slot_", F.lit(0.0)) if not cuts else Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="id_", outputCol="slot_", handleInvalid="keep").transform(rows)
    # descending ids need ascending buckets; null ids come last. Buckets are runs of slots of much the same size
    size = dict(rows.where("doc_id is not null").groupBy(F.col("slot_").cast("int")).agg(F.sum(F.length("text") + F.lit(64))).collect())
    total, upto, bucket = sum(size.values()), 0, {}
    for slot in sorted(size, reverse=True):
        bucket[slot] = min(n - 1, upto * n // max(total, 1))
        upto += size[slot]
    of_slot = F.lit([bucket.get(i, 0) for i in range(len(cuts) + 1)])
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(n)).otherwise(F.element_at(of_slot, F.col("slot_").cast("int") + 1))).drop("id_", "slot_")
    first = F.struct((-F.col("doc_id")).alias("down"), F.col("tie").alias("tie"))
    heads = [(r["bucket"], r["head"]) for r in rows.groupBy("bucket").agg(F.min(first).alias("head")).orderBy("bucket").collect()]
    table = [(b, h["down"], h["tie"], heads[i - 1][0] if i else heads[-1][0], i == 0) for i, (b, h) in enumerate(heads)]
    lent = rows.sparkSession.createDataFrame(table, "bucket int, down long, tie long, to int, wraps boolean")
    match = (F.col("d.bucket") == F.col("h.bucket")) & (-F.col("d.doc_id")).eqNullSafe(F.col("h.down")) & (F.col("d.tie") == F.col("h.tie"))
    heads_ = F.broadcast(lent).alias("h")  # a row for each bucket
    own = F.struct(F.col("d.bucket").alias("to"), F.lit(False).alias("lent"))
    more = F.when(F.col("h.to").isNotNull(), F.array(own, F.struct(F.col("h.to").alias("to"), F.lit(True).alias("lent")))).otherwise(F.array(own))
    out = rows.alias("d").join(heads_, match, "left").select("d.doc_id", "d.text", "d.tie", F.explode(more).alias("go"))
    out = out.select("doc_id", "text", "tie", F.col("go.to").alias("bucket"), F.col("go.lent").alias("lent"))
    return dealt(out, n, "bucket").sortWithinPartitions("bucket", "lent", F.desc_nulls_last("doc_id"), "tie", "text").select("doc_id", "text", "bucket", "lent")


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def compare(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third replaced by as many (or all) first characters of the next row, by descending id
    (rows of one id by a hash of the text, null ids last); after the last comes the first, and a single row is its own
    next. Null texts count as empty; two empty texts are alike 1. Ids must be numbers. No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row, whose next is still to come

        def finish(rows: list[tuple]) -> pa.RecordBatch | None:
            """rows: (doc_id, text, bucket, lent). All but the last get a result, lent ones and ends of buckets aside."""
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[3] and a[2] == b[2]]
            if not pairs:
                return None
            own = [a[1] for a, _ in pairs]
            last = [b[1] for (_, b), (c, _) in zip(pairs, [*pairs[1:], ((None,) * 4, None)]) if b is not c]
            edited = [a[: len(a) - len(a) // 3] + b[1][: len(a) // 3] for a, (_, b) in zip(own, pairs)]
            every = own + last + edited
            points = [_points(t) for t in every]
            at = np.concatenate(([0], np.cumsum([len(p) for p in points])))
            prints = fingerprints(np.concatenate(points), at)
            k, m, extra = len(own), len(own) + len(last), len(own)
            near_next = []
            for i, (_, b) in enumerate(pairs):
                if i + 1 < k and pairs[i + 1][0] is b:
                    j = i + 1
                else:
                    j, extra = extra, extra + 1
                near_next.append(likeness(prints[i], prints[j]))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([a[0] for a, _ in pairs], pa.int64()),
                    pa.array([len(p) for p in points[:k]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array(map(str, prints[:k])),
                    pa.array(map(str, prints[m:])),
                    pa.array([likeness(prints[i], prints[m + i]) for i in range(k)]),
                    pa.array(near_next, pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for part, _, _ in slices(batches, "text"):
            held += list(zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "lent"))))
            if (out := finish(held)) is not None:
                yield out
            held = held[-1:]

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _dealt(df, id_col, text_col).mapInArrow(run, schema)
