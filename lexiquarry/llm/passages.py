"""Repeated passages of words removed with prefix-partitioned suffix trees.

Suffixes are sampled and dealt as ``anchors`` tells, by prefixes of variable length: the anchor's k-gram, or the whole
window where more suffixes than fit a group begin with it. In each group the suffixes in order with their common lengths
are a suffix tree; its internal nodes of a window's depth, met with those of the tree to the left, are the windows that
occur more than once, each with the least document id under it.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm import anchors as A
from lexiquarry.llm.common import groups_for, materialise, prefix_sums, span_hashes, word_hashes, word_spans

WINDOW, GRAM = 13, 4


def _units(data: np.ndarray, offsets: np.ndarray):
    starts, ends, at = word_spans(data, offsets)
    sums = prefix_sums(word_hashes(data, starts, ends))
    place = np.arange(len(starts))
    grams = span_hashes(sums, place, np.minimum(place + GRAM, len(starts)))
    return grams, at, lambda s, e: span_hashes(sums, s, e)


def _read(data: np.ndarray, offsets: np.ndarray):
    starts, ends, at = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    sums = prefix_sums(hashes)
    return np.append((hashes >> np.uint64(32)).astype(np.uint32), np.uint32(0)), at, lambda s, e: span_hashes(sums, s, e)


def subtree(rec: np.ndarray, window: int) -> np.ndarray:
    """A row of marks by offset for each run of a group: windows that a document of a smaller id has too."""
    info = rec[["key", "back", "near", "doc"]]
    marks = np.zeros((len(info), window), dtype=bool)
    tree = A.Suffixes(info, *(np.ascontiguousarray(rec[s].astype(">u4")).view(np.uint8).reshape(len(rec), -1) for s in ("right", "left")))

    def settle(offset: int, members: np.ndarray, classes: np.ndarray) -> None:
        least = np.full(classes.max() + 1, A.NO_ID)
        np.minimum.at(least, classes, info["doc"][members])
        marks[members, offset] = info["doc"][members] > least[classes]

    tree.scan(window, 4, settle)
    return marks


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group: int = A.GROUP) -> DataFrame:
    """One row for each row of df: doc_id, n_words, n_removed, kept_sha256, spans (of words), kept (words and blanks).

    A word goes if ``window`` words over it are also found in a document of a smaller id. Null texts have no words.
    Repeated rows have one id, so neither loses words to the other; a null id counts as larger than any. No rows give no
    rows. Words are equal if their 32-bit hashes are equal through a whole window, or 64-bit hashes of all words of the
    runs that hold them, or of the window where more than ``group`` suffixes share an anchor.
    """
    shards = chunks = parts = groups_for(df)
    docs = A.numbered(df, id_col, text_col)
    gram, windows = min(GRAM, window), (window,)
    record = A.record_type("<u4", gram, windows)
    sent = A.sampled(docs, _units, gram, windows, shards, chunks, earlier_only=True)
    flags = materialise(A.judged(sent, windows, shards, chunks, parts, True, group), "judged")
    found = A.resolved(A.contexts(docs, flags, _read, record, windows, shards, chunks, parts), record, subtree, windows, shards, chunks, parts, True, group)

    def cut(ids, data, offsets, spans) -> pa.RecordBatch:
        rows = []
        for s, e, mine in zip(offsets.tolist(), offsets[1:].tolist(), spans):
            words = data[s:e].tobytes().split()
            start, end = A.union(mine)
            kept = [w for a, b in zip([0, *end.tolist()], [*start.tolist(), len(words)]) for w in words[a:b]] if len(start) else words
            text = b" ".join(kept)
            rows.append((len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), [{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist())], text.decode()))
        n, gone, digest, places, kept = zip(*rows)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
        doc = pa.array([None if x == A.NO_ID else x for x in ids.tolist()], pa.int64())
        return pa.RecordBatch.from_arrays([doc, *(pa.array(x, t) for x, t in zip((n, gone, digest, places, kept), kinds))], ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"])

    spans = flags.where(F.col("kind") == A.SPANS).unionByName(found)
    return A.meet(docs, spans, A.SPAN, chunks, parts, cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept string")
