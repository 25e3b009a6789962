"""Repeated byte strings removed with a logarithmic family of suffix arrays.

Suffixes are sampled and dealt as ``anchors`` tells. An index family takes its suffixes in batches: a new batch gets
suffix arrays (to the right and to the left of the anchors) and is merge-scanned with each level there is for windows in
common; then levels of one size merge, so that each suffix is merged a logarithmic number of times.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm import anchors as A
from lexiquarry.llm.common import BYTE_VALUES, groups_for, materialise, prefix_sums, span_hashes

#: Bytes of a string that is removed, of one that is only reported, and of an anchor.
LENGTH, REPORTED, GRAM = 400, 200, 32
BATCH = 512


def _units(data: np.ndarray, offsets: np.ndarray):
    sums = prefix_sums(BYTE_VALUES[data])
    starts = np.arange(max(len(data), 0))
    grams = span_hashes(sums, starts, np.minimum(starts + GRAM, len(data)))
    return grams, offsets, lambda s, e: span_hashes(sums, s, e)


def _read(data: np.ndarray, offsets: np.ndarray):
    sums = prefix_sums(BYTE_VALUES[data])
    return np.append(data, np.uint8(0)), offsets, lambda s, e: span_hashes(sums, s, e)


class IndexFamily:
    """Levels of suffix arrays of 1, 2, 4 .. batches; ``marks`` tells which windows of each run occur twice."""

    def __init__(self, length: int, runs: int):
        self.length, self.levels = length, []
        self.marks = np.zeros((runs, length), dtype=bool)

    def _scan(self, level: A.Suffixes) -> None:
        def settle(offset: int, members: np.ndarray, classes: np.ndarray) -> None:
            twice = members[np.bincount(classes)[classes] > 1]
            self.marks[level.info["at"][twice], offset] = True

        level.scan(self.length, 1, settle)

    def add(self, new: A.Suffixes) -> None:
        """A batch meets itself and every level; levels of one rank then merge, which needs no scan."""
        keys = np.unique(new.info["key"])
        self._scan(new)
        for _, level in self.levels:
            shared = level.having(keys)
            if len(shared):
                self._scan(shared.merge(new))
        self.levels.append((0, new))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, b), (_, a) = self.levels.pop(), self.levels.pop()
            self.levels.append((rank + 1, a.merge(b)))


def family_marks(rec: np.ndarray, length: int, batch: int = BATCH) -> np.ndarray:
    """A row of marks by offset for each run: windows that some other run has too."""
    info = np.empty(len(rec), dtype=[("key", "u8"), ("back", "u2"), ("near", "u2"), ("at", "i8")])
    info["key"], info["back"], info["near"], info["at"] = rec["key"], rec["back"], rec["near"], np.arange(len(rec))
    family = IndexFamily(length, len(rec))
    left, right = rec["left"][:, : length - 1], rec["right"][:, :length]
    for s in range(0, len(rec), batch):
        family.add(A.Suffixes(info[s : s + batch], right[s : s + batch], left[s : s + batch]))
    return family.marks


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, reported: int | None = None, group: int = A.GROUP) -> DataFrame:
    """One row for each row of df: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated, spans, kept (binary).

    A byte goes if a string of ``length`` bytes over it also starts elsewhere in any document, its own included.
    n_repeated counts the bytes under strings of ``reported`` bytes that do so (of ``length`` if it is None): what stays
    but is found elsewhere as well. Null texts are empty. Repeated rows are documents of their own, hence each other's
    copies; null ids are kept. No rows give no rows. Strings are equal if their bytes are, or 64-bit hashes of all bytes
    of the runs that hold them, or of their own where more than ``group`` suffixes share an anchor.
    """
    shards = chunks = parts = groups_for(df)
    docs = A.numbered(df, id_col, text_col)
    windows = (length,) if reported is None else (length, reported)
    gram = min(GRAM, *windows)
    record = A.record_type("u1", gram, windows)
    sent = A.sampled(docs, _units, gram, windows, shards, chunks, earlier_only=False)
    flags = materialise(A.judged(sent, windows, shards, chunks, parts, False, group), "judged")
    found = A.resolved(A.contexts(docs, flags, _read, record, windows, shards, chunks, parts), record, family_marks, windows, shards, chunks, parts, False, group)

    def cut(ids, data, offsets, spans) -> pa.RecordBatch:
        rows = []
        for s, e, mine in zip(offsets.tolist(), offsets[1:].tolist(), spans):
            raw = data[s:e].tobytes()
            start, end = A.union(None if mine is None else mine[mine["w"] == 0])
            seen, until = A.union(mine)
            kept = b"".join(raw[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(raw)])) if len(start) else raw
            places = [{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist())]
            rows.append((len(raw), len(raw) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), int((until - seen).sum()), places, kept))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        doc = pa.array([None if x == A.NO_ID else x for x in ids.tolist()], pa.int64())
        return pa.RecordBatch.from_arrays([doc, *(pa.array(x, t) for x, t in zip(zip(*rows), kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "spans", "kept"])

    spans = flags.where(F.col("kind") == A.SPANS).unionByName(found)
    return A.meet(docs, spans, A.SPAN, chunks, parts, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, spans array<struct<start:long,end:long>>, kept binary")
