"""Helpers that all training-data operators share: shared storage, text batches, word spans."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text a Python worker looks at in one vectorised step; numpy temporaries are about 40 times this.
SLICE_BYTES = 1 << 20
#: Bytes of a batch that goes to a Python worker; Spark's own bound of 64 MB is several times that in either process.
BATCH_BYTES = 8 << 20
#: The six ASCII white-space bytes that separate words everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one, which only a local
    session's executors share; on a cluster that is an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="lexiquarry-")
    spark.conf.set("spark.checkpoint.dir", made)
    spark.sparkContext.setCheckpointDir(made)
    return made


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage and survives lost executors. What is
    written goes when the application ends, or with ``discard``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _files(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def discard(*tables: DataFrame) -> None:
    """Deletes what ``materialise`` wrote for these tables, once nothing reads them any more."""
    for t in tables:
        if path := getattr(t, "written_to", None):
            files, at = _files(t.sparkSession, path)
            files.delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) and what is to be kept, no other column, so that clashing names can't matter; a null text becomes
    empty. A session that leaves the size of Arrow batches to Spark gets smaller ones, for long texts' sake."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, f"{BATCH_BYTES}b")
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *keep)


def parts_for(df: DataFrame) -> int:
    """How many partitions a shuffle of df should have, from the session's setting."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of stored input for each group that rows are dealt to by number.
DEALT_BYTES = 4 << 20


def groups_for(df: DataFrame) -> int:
    """How many groups df should be dealt to: a partition's worth each, but no more than the input fills. What goes from
    every group to every other then grows with the data, not with the square of the session's partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(parts_for(df), max(8, -(-size // DEALT_BYTES)))


_labels: dict[int, list[int]] = {}


def labels(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions the least number that Spark's hash partitioning sends there."""
    if n not in _labels:
        found: dict[int, int] = {}
        span = int(n * (np.log(n + 1) + 8)) + 8
        while len(found) < n:
            for r in spark.range(span).select(F.col("id").cast("int").alias("id"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("at")).groupBy("at").agg(F.min("id").alias("id")).collect():
                found[r["at"]] = r["id"]
            span *= 2
        _labels[n] = [found[i] for i in range(n)]
    return _labels[n]


def dealt(df: DataFrame, n: int, column: str) -> DataFrame:
    """df in n partitions, each row in that of its number in the column modulo n: none is empty and none has two by chance."""
    return df.repartition(n, F.element_at(F.lit(labels(df.sparkSession, n)), (F.pmod(F.col(column), F.lit(n)) + 1).cast("int")))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts record batches by bytes of text. Gives each piece with its text as bytes and the n + 1 offsets into them."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(column))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            to = min(to, n)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes and offsets; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the n + 1 offsets of each document's first word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = np.zeros(n + 1, dtype=bool)
    ink[:n] = ~IS_SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)  # a document starts here
    cut[offsets] = True
    first = ink[:n].copy()
    first[1:] &= ~ink[: n - 1] | cut[1:n]
    last = ink[:n] & (~ink[1:] | cut[1:])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


#: Odd base of the polynomial hash modulo 2**64, and its inverse.
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    key = int(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        have = np.ones(max(n, 1024, 2 * (0 if have is None else len(have))), dtype=np.uint64)
        with np.errstate(over="ignore"):
            have[1:] = base
            np.multiply.accumulate(have, out=have)
        _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """P with P[i] = sum over j < i of values[j] * BASE**j modulo 2**64; any span's hash is one subtraction away."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hashes of spans: equal spans have equal hashes wherever they stand."""
    with np.errstate(over="ignore"):
        raw = (sums[ends] - sums[starts]) * powers(UNBASE, len(sums))[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_values() -> np.ndarray:
    """A fixed random-looking 64-bit value for each byte, so that the polynomial's terms fill all bits."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


BYTE_VALUES = byte_values()


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_sums(BYTE_VALUES[data]), starts, ends)
