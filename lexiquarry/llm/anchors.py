"""What the two repeat removers share: sampled suffixes, their suffix orders, and documents met with what concerns them.

A window of W units (bytes or words) is anchored at the least hash among its k-grams, the leftmost of equals. Equal
windows have equal anchors at equal offsets, so all repeats of a window meet under its anchor's key. Consecutive windows
share anchors: a run of windows first .. last with one anchor is one sampled suffix, read from the anchor to the right
and to the left. Passes follow:

1. Runs with one fingerprint are equal in all their windows. Those of one piece of the table are settled there and then,
   and one of them goes on, so that however often a run is copied, a piece sends it once. Runs are then dealt by their
   key as (key, fingerprint of all units, place). A key that occurs once has no repeats; one with several fingerprints is
   left open.
2. Open runs, one for each fingerprint, are read with their units, and suffix orders tell which windows repeat. Prefixes
   that deal them are as long as it takes: the anchor's k-gram, or, where more than ``GROUP`` suffixes begin with it, the
   whole window, each of the run's windows then being a suffix of its own.
3. Documents meet their spans.

Several window lengths may be asked for at once; they share the passes. Rows are packed into binary blobs, so that a
shuffled row holds thousands of records.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.common import dealt, mix, slices, texts

NO_ID = np.iinfo(np.int64).max
SPANS, ASKED, DOCUMENTS, RUNS = 0, 1, 2, 3
SLICE = 4 << 20
#: Suffixes that one prefix may deal to one group.
GROUP = 2048
RUN = np.dtype([("key", "<u8"), ("print", "<u8"), ("row", "<u2"), ("pos", "<u4"), ("back", "<u2"), ("near", "<u2"), ("twice", "?")])
SPAN = np.dtype([("doc", "<i8"), ("tie", "<u4"), ("start", "<u4"), ("end", "<u4"), ("w", "u1")])
ASK = np.dtype([("doc", "<i8"), ("tie", "<u4"), ("pos", "<u4"), ("back", "<u2"), ("near", "<u2"), ("key", "<u8"), ("known", "?"), ("w", "u1"), ("long", "?")])
WINDOW = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("tie", "<u4"), ("start", "<u4"), ("known", "?")])


def window_minima(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` consecutive values, the leftmost of equals."""
    value, place, have = grams, np.arange(len(grams), dtype=np.int32), 1
    while 2 * have <= width:
        right = value[have:] < value[:-have]
        value = np.where(right, value[have:], value[:-have])
        place = np.where(right, place[have:], place[:-have])
        have *= 2
    if rest := width - have:
        right = value[rest:] < value[:-rest]
        place = np.where(right, place[rest:], place[:-rest])
    return place


def runs(grams: np.ndarray, offsets: np.ndarray, size: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window start of each run. grams[i] is the hash of units i .. i + size - 1; offsets are
    the documents' n + 1 places among the units; no window crosses them."""
    width = window - size + 1
    if len(grams) < width:
        return (np.zeros(0, dtype=np.int64),) * 3
    step = np.zeros(len(grams) + 2, dtype=np.int32)
    np.add.at(step, offsets[:-1], 1)
    np.add.at(step, np.maximum(offsets[:-1], offsets[1:] - window + 1), -1)
    starts = np.flatnonzero(np.cumsum(step)[: len(grams)] > 0)
    if not len(starts):
        return (np.zeros(0, dtype=np.int64),) * 3
    place = window_minima(grams, width)[starts].astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    end = np.append(begin[1:], len(starts)) - 1
    return place[begin], starts[begin], starts[end]


def numbered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts(df, id_col, text_col).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))))


def chunk_of(doc: np.ndarray, chunks: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(chunks)).astype(np.int32)


def ties(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tells rows of one id but different texts apart."""
    raw = data.tobytes()
    return np.array([zlib.crc32(raw[s:e]) for s, e in zip(offsets.tolist(), offsets[1:].tolist())], dtype=np.uint32)


def by_chunk(kind: int, records: np.ndarray, chunks: int, at: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(at, kind="stable")
    records, at = records[order], at[order]
    edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else []
    for s, e in zip(edge, [*edge[1:], len(at)]):
        yield int(at[s]), kind, records[s:e].tobytes()


def blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    c, kind, blob = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["c", "kind", "blob"])


BLOBS = "c int, kind int, blob binary"
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, Callable]]


def _pairs(key: np.ndarray, mark: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records in order of key, fingerprint and document; each one's group of equal runs; where the groups begin."""
    order = np.lexsort((doc, mark, key))
    begin = starts_of(key[order], mark[order])
    return order, np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key)))), begin


def _span_records(doc: np.ndarray, tie: np.ndarray, rec: np.ndarray, window: int, w: int) -> np.ndarray:
    spans = np.empty(len(rec), dtype=SPAN)
    spans["doc"], spans["tie"], spans["w"] = doc, tie, w
    spans["start"], spans["end"] = rec["pos"] - rec["back"], rec["pos"] - rec["near"].astype(np.uint32) + np.uint32(window)
    return spans


def sampled(docs: DataFrame, units: Units, size: int, windows: tuple[int, ...], shards: int, chunks: int, earlier_only: bool) -> DataFrame:
    """Pass 1, first half: a piece's different runs by shard of their window and key, and the spans of the others.
    units(data, offsets) gives k-gram hashes, unit offsets and a span hasher."""

    def of_window(w: int, grams: np.ndarray, at: np.ndarray, hasher: Callable, ids: np.ndarray, tie: np.ndarray) -> list[tuple[int, int, bytes]]:
        anchor, first, last = runs(grams, at, size, windows[w])
        if not len(anchor):
            return []
        row = np.searchsorted(at, anchor, side="right") - 1
        rec = np.empty(len(anchor), dtype=RUN)
        rec["key"], rec["print"] = grams[anchor], hasher(first, last + windows[w])
        rec["row"], rec["pos"], rec["back"], rec["near"] = row, anchor - at[row], anchor - first, anchor - last
        order, group, begin = _pairs(rec["key"], rec["print"], ids[row])
        rec, row = rec[order], row[order]
        if earlier_only:
            settled = ids[row] > ids[row][begin][group]
        else:
            settled = np.ones(len(rec), dtype=bool)
            settled[begin] = False
        rec["twice"] = np.bincount(group)[group] > 1
        spans = _span_records(ids[row[settled]], tie[row[settled]], rec[settled], windows[w], w)
        out = list(by_chunk(SPANS, spans, chunks, chunk_of(spans["doc"], chunks)))
        rec = rec[~settled]
        for r, kind, blob in by_chunk(RUNS, rec, shards, (rec["key"] % np.uint64(shards)).astype(np.int32)):
            mine = np.frombuffer(blob, dtype=RUN).copy()
            docs_, mine["row"] = np.unique(mine["row"], return_inverse=True)
            out.append((w * shards + r, kind, np.uint32(len(docs_)).tobytes() + ids[docs_].astype("<i8").tobytes() + tie[docs_].astype("<u4").tobytes() + mine.tobytes()))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text", SLICE):
            ids, tie = part.column("doc_id").to_numpy(zero_copy_only=False), ties(data, offsets)
            for low in range(0, part.num_rows, 60_000):
                high = min(low + 60_000, part.num_rows)
                grams, at, hasher = units(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                for w in range(len(windows)):
                    if out := of_window(w, grams, at, hasher, ids[low:high], tie[low:high]):
                        yield blobs(out)

    return docs.mapInArrow(run, BLOBS)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    rec = np.frombuffer(blob, dtype=RUN, offset=4 + 12 * n)
    row = rec["row"].astype(np.int64)
    return np.frombuffer(blob, "<i8", n, 4)[row], np.frombuffer(blob, "<u4", n, 4 + 8 * n)[row], rec


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Rows in order of c to (c, its (kind, blob)s)."""
    c_now, held = None, []
    for batch in batches:
        for c, kind, blob in zip(batch.column("c").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob")):
            if c != c_now and held:
                yield c_now, held
                held = []
            c_now = c
            held.append((kind, blob.as_buffer()))
    if held:
        yield c_now, held


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def judged(sent: DataFrame, windows: tuple[int, ...], shards: int, chunks: int, parts: int, earlier_only: bool, group: int = GROUP) -> DataFrame:
    """Pass 1, second half: spans of runs that are repeated as a whole, those settled before too, and the open runs.

    A run is repeated if its key and fingerprint occur elsewhere; with earlier_only, in a document of a smaller id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, held in grouped(batches):
            if settled := [(c, kind, blob.to_pybytes()) for kind, blob in held if kind == SPANS]:
                yield blobs(settled)
            if not (sent_runs := [_unpacked(b) for kind, b in held if kind == RUNS]):
                continue
            docs, tie, recs = zip(*sent_runs)
            doc, tie, rec = np.concatenate(docs), np.concatenate(tie), np.concatenate(recs)
            order, of_mark, by_mark = _pairs(rec["key"], rec["print"], doc)
            doc, tie, rec = doc[order], tie[order], rec[order]
            by_key = starts_of(rec["key"])
            of_key = np.repeat(np.arange(len(by_key)), np.diff(np.append(by_key, len(rec))))
            least = doc[by_mark][of_mark]
            known = doc > least if earlier_only else (np.bincount(of_mark)[of_mark] > 1) | rec["twice"]
            marks = np.diff(np.append(np.searchsorted(by_mark, by_key), len(by_mark)))  # fingerprints of each key
            first = np.zeros(len(rec), dtype=bool)
            first[by_mark] = True
            ask = (marks > 1)[of_key] & (doc == least if earlier_only else first)
            out = []
            w = c // shards
            spans = _span_records(doc[known], tie[known], rec[known], windows[w], w)
            out += by_chunk(SPANS, spans, chunks, chunk_of(spans["doc"], chunks))
            asks = np.empty(int(ask.sum()), dtype=ASK)
            asks["doc"], asks["tie"], asks["known"], asks["w"] = doc[ask], tie[ask], known[ask], w
            asks["long"] = np.bincount(of_key[ask], minlength=len(by_key))[of_key[ask]] > group
            for f in ("pos", "back", "near", "key"):
                asks[f] = rec[f][ask]
            out += by_chunk(ASKED, asks, chunks, chunk_of(asks["doc"], chunks))
            yield blobs(out)

    return dealt(sent, parts, "c").sortWithinPartitions("c").mapInArrow(run, BLOBS)


def packed(docs: DataFrame, chunks: int) -> DataFrame:
    """Documents by the chunk of their id, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for part, _, _ in slices(batches, "text", SLICE):
            at = chunk_of(part.column("doc_id").to_numpy(zero_copy_only=False), chunks)
            rows = []
            for c in np.unique(at).tolist():
                mine = part.take(pa.array(np.flatnonzero(at == c)))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, mine.schema, options=options) as writer:
                    writer.write_batch(mine)
                rows.append((c, DOCUMENTS, sink.getvalue().to_pybytes()))
            yield blobs(rows)

    return docs.mapInArrow(run, BLOBS)


#: Bytes of records held back so that they leave in few blobs.
HELD_BYTES = 32 << 20


def meet(docs: DataFrame, records: DataFrame, dtype: np.dtype, chunks: int, parts: int, visit: Callable, schema: str, deal: Callable | None = None) -> DataFrame:
    """Brings documents and records of their (doc, tie) together.

    visit(doc ids, data, offsets, records of each document or None) gives a record batch for a piece of documents, or,
    with deal, arrays of records; deal then makes a record batch of many pieces' arrays.
    """
    rows = packed(docs, chunks).unionByName(records)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in grouped(batches):
            found = [np.frombuffer(b, dtype=dtype) for k, b in held if k != DOCUMENTS]
            rec = np.concatenate(found) if found else np.zeros(0, dtype=dtype)
            rec = rec[np.lexsort((rec["tie"], rec["doc"]))]
            edge = starts_of(rec["doc"], rec["tie"]) if len(rec) else np.zeros(0, int)
            kept: list[tuple[np.ndarray, ...]] = []
            where = {(int(rec["doc"][s]), int(rec["tie"][s])): rec[s:e] for s, e in zip(edge, np.append(edge[1:], len(rec)))}
            for k, blob in held:
                if k != DOCUMENTS:
                    continue
                for part, data, offsets in slices(pa.ipc.open_stream(blob), "text"):
                    ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                    out = visit(ids, data, offsets, [where.get(x) for x in zip(ids.tolist(), ties(data, offsets).tolist())])
                    if out is None:
                        continue
                    if deal is None:
                        yield out
                        continue
                    kept.append(out)
                    if sum(y.nbytes for x in kept for y in x) > HELD_BYTES:
                        yield deal(*map(np.concatenate, zip(*kept)))
                        kept = []
            if kept:
                yield deal(*map(np.concatenate, zip(*kept)))

    return dealt(rows, parts, "c").sortWithinPartitions("c", "kind").mapInArrow(run, schema)


def record_type(unit: str, size: int, windows: tuple[int, ...]) -> np.dtype:
    """An open run with its units before the anchor, backwards, and from it on."""
    return np.dtype([*ASK.descr, ("left", unit, (max(max(windows) - size, 1),)), ("right", unit, (max(windows),))])


def contexts(docs: DataFrame, flags: DataFrame, read: Callable, record: np.dtype, windows: tuple[int, ...], shards: int, chunks: int, parts: int) -> DataFrame:
    """Pass 2, first half: open runs with their units, by key, and the windows of those with long prefixes, by window.
    read(data, offsets) gives the units with one more at the end, unit offsets and a span hasher."""

    def visit(ids, data, offsets, asked) -> tuple[np.ndarray, np.ndarray] | None:
        rows = [(i, a) for i, a in enumerate(asked) if a is not None]
        if not rows:
            return None
        values, at_, hasher = read(data, offsets)
        asks = np.concatenate([a for _, a in rows])
        base = np.repeat([at_[i] for i, _ in rows], [len(a) for _, a in rows]).astype(np.int64)
        ends = np.repeat([at_[i + 1] for i, _ in rows], [len(a) for _, a in rows]).astype(np.int64)
        short = ~asks["long"]
        out = np.empty(int(short.sum()), dtype=record)
        for f in ASK.names:
            out[f] = asks[f][short]
        at, low, high = (base + asks["pos"])[short, None], base[short, None], ends[short, None]
        left, right = at - 1 - np.arange(record["left"].shape[0])[None, :], at + np.arange(record["right"].shape[0])[None, :]
        # beyond what the run's own windows hold nothing is sent; suffixes that share a window share all of it either way
        back, reach = asks["back"][short, None], np.array(windows, dtype=np.int64)[asks["w"]][short, None] - asks["near"][short, None]
        out["left"] = values[np.where((left >= low) & (at - left <= back), left, len(values) - 1)]
        out["right"] = values[np.where((right < high) & (right - at < reach), right, len(values) - 1)]
        asks, base = asks[~short], base[~short]
        times = asks["back"].astype(np.int64) - asks["near"] + 1
        of = np.repeat(np.arange(len(asks)), times)
        start = asks["pos"].astype(np.int64)[of] - asks["back"][of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        each = np.empty(len(of), dtype=[*WINDOW.descr, ("w", "u1")])
        for f in ("doc", "tie", "known", "w"):
            each[f] = asks[f][of]
        each["start"] = start
        size = np.array(windows, dtype=np.int64)[each["w"]]
        each["hash"] = hasher(base[of] + start, base[of] + start + size)
        return out, each

    def deal(flat: np.ndarray, each: np.ndarray) -> pa.RecordBatch:
        out = []
        for w in range(len(windows)):
            mine = flat[flat["w"] == w]
            out += [(w * shards + c, ASKED, b) for c, _, b in by_chunk(0, mine, shards, (mine["key"] % np.uint64(shards)).astype(np.int32))]
            mine = each[each["w"] == w][list(WINDOW.names)].astype(WINDOW)
            out += [(w * shards + c, RUNS, b) for c, _, b in by_chunk(0, mine, shards, (mine["hash"] % np.uint64(shards)).astype(np.int32))]
        return blobs(out)

    return meet(docs, flags.where(F.col("kind") == ASKED), ASK, chunks, parts, visit, BLOBS, deal=deal)


def resolved(opened: DataFrame, record: np.dtype, settle: Callable, windows: tuple[int, ...], shards: int, chunks: int, parts: int, earlier_only: bool, group: int = GROUP) -> DataFrame:
    """Pass 2, second half: the spans of repeated windows. settle(runs, window) gives a row of marks by offset for each run
    of a group; whole keys make up a group, ``group`` runs or less if each key has so many at most."""

    def of_windows(held: list, window: int, w: int) -> np.ndarray:
        rec = np.concatenate(held) if held else np.zeros(0, dtype=WINDOW)
        order = np.lexsort((rec["doc"], rec["hash"]))
        rec = rec[order]
        begin = starts_of(rec["hash"])
        size = np.diff(np.append(begin, len(rec)))
        hit = rec["doc"] > np.repeat(rec["doc"][begin], size) if earlier_only else (np.repeat(size, size) > 1) & ~rec["known"]
        spans = np.empty(int(hit.sum()), dtype=SPAN)
        for f in ("doc", "tie", "start"):
            spans[f] = rec[f][hit]
        spans["end"], spans["w"] = spans["start"] + np.uint32(window), w
        return spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, held in grouped(batches):
            w = c // shards
            window, found = windows[w], []
            if (rec := [np.frombuffer(b, dtype=record) for k, b in held if k == ASKED]):
                rec = np.concatenate(rec)
                rec = rec[np.argsort(rec["key"], kind="stable")]
                begin = np.append(starts_of(rec["key"]), len(rec))
                at = 0
                while at < len(begin) - 1:
                    to = max(at + 1, int(np.searchsorted(begin, begin[at] + group, side="right")) - 1)
                    mine = rec[begin[at] : begin[to]]
                    todo = ~mine["known"]
                    found.append(spans_of(mine[todo], settle(mine, window)[todo], window, w))
                    at = to
            found.append(of_windows([np.frombuffer(b, dtype=WINDOW) for k, b in held if k == RUNS], window, w))
            spans = np.concatenate(found)
            yield blobs(list(by_chunk(SPANS, spans, chunks, chunk_of(spans["doc"], chunks))))

    return dealt(opened, parts, "c").sortWithinPartitions("c").mapInArrow(run, BLOBS)


class Suffixes:
    """Open runs in suffix order: by key and units to the right, and by key and units to the left."""

    def __init__(self, info: np.ndarray, right: np.ndarray, left: np.ndarray, orders: tuple[np.ndarray, np.ndarray] | None = None):
        """info has key, back and near; right and left hold the units' bytes from the anchor on and before it, backwards."""
        self.info, self.right, self.left = info, right, left
        keys = info["key"].astype(">u8").view(np.uint8).reshape(-1, 8)
        self.sorts = [np.ascontiguousarray(np.concatenate([keys, side], axis=1)).view(f"S{8 + side.shape[1]}").ravel() for side in (right, left)]
        self.orders = orders or tuple(np.argsort(s, kind="stable") for s in self.sorts)

    def __len__(self) -> int:
        return len(self.info)

    def merge(self, other: Suffixes) -> Suffixes:
        """Merges two sorted indexes without sorting again."""
        orders = []
        for a, b, x, y in zip(self.orders, other.orders, self.sorts, other.sorts):
            to = np.searchsorted(x[a], y[b], side="right") + np.arange(len(b))
            out = np.empty(len(a) + len(b), dtype=np.int64)
            mine = np.ones(len(out), dtype=bool)
            mine[to] = False
            out[to], out[mine] = b + len(self), a
            orders.append(out)
        both = [np.concatenate(p) for p in ((self.info, other.info), (self.right, other.right), (self.left, other.left))]
        return Suffixes(*both, orders=tuple(orders))

    def having(self, keys: np.ndarray) -> Suffixes:
        """The suffixes of these keys (ascending) as an index of their own, found by binary search."""
        picked = []
        for order in self.orders:
            mine = self.info["key"][order]
            low, high = np.searchsorted(mine, keys, side="left"), np.searchsorted(mine, keys, side="right")
            times = high - low
            picked.append(order[np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)])
        at = np.sort(picked[0])
        return Suffixes(self.info[at], self.right[at], self.left[at], orders=tuple(np.searchsorted(at, p) for p in picked))

    def common(self, side: int, unit: int) -> np.ndarray:
        """Units that each suffix has in common with the one before it in order; -1 where the key differs."""
        rows = (self.right, self.left)[side][self.orders[side]]
        key = self.info["key"][self.orders[side]]
        differs = rows[1:] != rows[:-1]
        out = np.where(differs.any(axis=1), differs.argmax(axis=1) // unit, rows.shape[1] // unit)
        return np.concatenate(([-1], np.where(key[1:] == key[:-1], out, -1)))

    def scan(self, window: int, unit: int, settle: Callable[[int, np.ndarray, np.ndarray], None]) -> None:
        """For each offset of a window's start before its anchor, calls settle(offset, members, class of each member):
        windows are equal if their classes are. Members without a partner long enough are left out."""
        if len(self) < 2:
            return
        lcps = [self.common(side, unit) for side in (0, 1)]
        reach = np.zeros(len(self), dtype=np.int64)
        for order, lcp in zip(self.orders, lcps):
            most = np.maximum(np.maximum(lcp, np.append(lcp[1:], -1)), 0)
            here = np.empty(len(self), dtype=np.int64)
            here[order] = most
            reach += here
        able = reach >= window
        if not able.any():
            return
        back, near = self.info["back"].astype(np.int64), self.info["near"].astype(np.int64)
        for offset in range(int(near[able].min()), int(back[able].max()) + 1):
            members = np.flatnonzero(able & (near <= offset) & (offset <= back))
            if len(members) < 2:
                continue
            code = np.zeros(len(self), dtype=np.int64)
            for order, lcp, need in zip(self.orders, lcps, (window - offset, offset)):
                ids = np.empty(len(self), dtype=np.int64)
                ids[order] = np.cumsum(lcp < need)
                code = code * (len(self) + 1) + ids
            settle(offset, members, np.unique(code[members], return_inverse=True)[1])


def spans_of(info: np.ndarray, marked: np.ndarray, window: int, w: int) -> np.ndarray:
    """info and a row of marks by offset for each run to spans of the windows that are marked."""
    padded = np.zeros((len(marked), marked.shape[1] + 2), dtype=np.int8)
    padded[:, 1:-1] = marked
    step = np.diff(padded, axis=1)
    row, low = np.nonzero(step == 1)
    _, high = np.nonzero(step == -1)
    out = np.empty(len(row), dtype=SPAN)
    out["doc"], out["tie"], out["w"] = info["doc"][row], info["tie"][row], w
    pos = info["pos"][row].astype(np.int64)
    out["start"], out["end"] = pos - (high - 1), pos - low + window
    return out


def union(spans: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that spans cover."""
    if spans is None or not len(spans):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(spans["start"], kind="stable")
    start, end = spans["start"][order].astype(np.int64), np.maximum.accumulate(spans["end"][order].astype(np.int64))
    new = np.concatenate(([True], start[1:] > end[:-1]))
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:], len(start)) - 1]
