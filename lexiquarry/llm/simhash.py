"""SimHash near-duplicates found by Golay-code fuzzy hashing.

Fingerprints of 64 bits are cut into segments of 22, 21 and 21 bits. If two differ in at most 4 bits, then either one
segment is equal and another differs in at most 2 bits, or two segments differ in exactly one bit each (pigeonhole).
In the first case the equal segment together with a Golay codeword near both versions of the other is a common key; in
the second, the codeword nearest to one version is among those near the other, in both segments, and each segment's
parity differs, which tells the two roles apart. Rows that share a key are verified by their real distance.

Similarity of word shingles at a threshold such as 0.8 leaves fingerprints too far apart for 4 bits. ``representatives``
therefore takes keys of two kinds: Golay keys of fingerprints of the set of words, which a few changed words hardly move,
and keys of min-wise samples of the shingles, which two texts share with a probability that depends on the similarity of
their shingles alone, whatever was edited (``recall``). What meets is passed on as groups, a row a member, and each group
is settled where it lies by the shingles of its members' texts: all pairs of it count, but only trees of links leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm import golay
from lexiquarry.llm.common import materialise, mix, parts_for, slices, texts
from lexiquarry.llm.components import components

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: A similarity of 0.8 of five-word shingles leaves 9.7 of 64 bits different on average, and 12 or fewer in 8 of 10 cases.
SIMILAR_SHINGLE, SIMILAR_BITS = 5, 12
#: Keys of min-wise samples, and the samples that make one: of pairs with a similarity of 0.8, 2 in 10,000 share none.
BANDS, DEEP = 16, 4
#: Numerator and denominator of the least similarity of a link.
LEAST = (4, 5)
#: Bits of four shingle fingerprints in which a pair of a min-wise key may differ to be looked at: 0.8 leaves 38.8 of 256
#: different on average with a deviation of 5.7. In buckets over LARGE_BUCKET, groups are found without making their pairs.
FAR_BITS, LARGE_BUCKET = 66, 64
SEGMENTS = ((42, 22), (21, 21), (0, 21))
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def shingle_hashes(text: bytes, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``size`` words, joined by a space; of the whole sequence if there are fewer words."""
    words = text.split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) <= size:
        return np.array([hashed(joined, seed)], dtype=np.uint64)
    return np.array([hashed(joined[s : e - 1], seed) for s, e in zip([0, *ends], ends[size - 1 :])], dtype=np.uint64)


def word_prints(text: bytes) -> tuple[int, int]:
    """Two independent fingerprints of the set of words."""
    hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in sorted(set(text.split()))], dtype=np.uint64)
    return majority(hashes), majority(mix(hashes))


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0, dtype=np.uint32) * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, columns to keep, fp long): the signed form of the 64-bit SimHash of each row's whole text. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, data, offsets in slices(batches, "text"):
            data = ASCII_LOWER[data]
            raw = [data[s:e].tobytes() for s, e in zip(offsets, offsets[1:])]
            made = np.array([majority(shingle_hashes(t, size)) for t in raw], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in own), pa.array(made.view(np.int64))], [*own, "fp"])

    own = ["doc_id", *keep]
    rows = texts(df, id_col, text_col, tuple(k for k in keep if k != "text"))
    return rows.mapInArrow(run, ", ".join([f"{c} {rows.schema[c].dataType.simpleString()}" for c in own] + ["fp long"]))


def fuzzy_keys(batches: Iterator[pa.RecordBatch], probes: tuple[str, ...] = ("fp",)) -> Iterator[pa.RecordBatch]:
    """fp and probes to the probes' keys. role 0: any two rows of a key are compared; 1 and 2: one of each."""
    for batch, name, lowest in ((b, p, 16 * i) for b in batches for i, p in enumerate(probes)):
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        raw = batch.column(name).to_numpy(zero_copy_only=False).view(np.uint64)
        out: list[tuple[np.ndarray, int, np.ndarray]] = []
        seg = [((raw >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
        near = [golay.nearby(s, width) for s, (_, width) in zip(seg, SEGMENTS)]
        first = [golay.nearest(s) for s in seg]
        odd = [np.bitwise_count(s).astype(np.int64) & 1 for s in seg]
        tag = lowest
        for i in range(3):
            for j in range(3):
                if i != j:
                    row, col = np.nonzero(near[j][1])
                    out.append(((tag << 40) | (seg[i][row] << 12) | near[j][0][row, col], 0, fp[row]))
                    tag += 1
        for i, j in ((0, 1), (0, 2), (1, 2)):
            row = np.flatnonzero(odd[i] == 0)
            out.append(((tag << 40) | (odd[j][row] << 24) | (first[i][row] << 12) | first[j][row], 1, fp[row]))
            ask = np.flatnonzero(odd[i])
            (ri, ci), (rj, cj) = np.nonzero(near[i][1][ask]), np.nonzero(near[j][1][ask])
            per = np.bincount(rj, minlength=len(ask))  # keys of j for each row
            begin = np.concatenate(([0], np.cumsum(per)))
            times = per[ri]
            left = np.repeat(np.arange(len(ri)), times)
            right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + begin[ri[left]]
            row = ask[ri[left]]
            out.append(((tag << 40) | ((1 - odd[j][row]) << 24) | (near[i][0][row, ci[left]] << 12) | near[j][0][row, cj[right]], 2, fp[row]))
            tag += 1
        key = np.concatenate([k for k, _, _ in out])
        role = np.concatenate([np.full(len(k), r, dtype=np.int8) for k, r, _ in out])
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(role), pa.array(np.concatenate([f for _, _, f in out]))], ["key", "role", "fp"])


def _close(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= most  # of a signed number it would count the magnitude's bits


def _stars(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A bucket's linked groups as edges from each member to the group's least: fewer than rows, though the links may be
    their square, and the same edges in every bucket that holds the group. fp is ascending."""
    rest, left, right = np.arange(len(fp)), [], []
    while len(rest):
        queue, least, rest = [rest[0]], rest[0], rest[1:]
        while queue and len(rest):
            hit = _close(fp[rest], fp[queue.pop()], most)
            found, rest = rest[hit], rest[~hit]
            left.append(np.full(len(found), least))
            right.append(found)
            queue.extend(found.tolist())
    none = [np.zeros(0, dtype=np.int64)]
    return fp[np.concatenate(left or none)], fp[np.concatenate(right or none)]


def _bucket_links(key: np.ndarray, role: np.ndarray, fp: np.ndarray, most: int = MOST_BITS, large: int = 8) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((begin, [len(key)])))
    left, right = [], []
    for s, n in zip(begin[size > large], size[size > large]):
        a, b = _stars(np.unique(fp[s : s + n]), most)
        left.append(a)
        right.append(b)
    begin, size = begin[(size > 1) & (size <= large)], size[(size > 1) & (size <= large)]
    at = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    end = np.repeat(begin + size, size)
    step = 1
    while len(at):
        keep = at + step < end
        at, end = at[keep], end[keep]
        a, b = fp[at], fp[at + step]
        hit = _close(a, b, most) & (a != b) & ((role[at] == 0) | (role[at] != role[at + step]))
        left.append(a[hit])
        right.append(b[hit])
        step += 1
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def verified(batches: Iterator[pa.RecordBatch], most: int = MOST_BITS) -> Iterator[pa.RecordBatch]:
    """Rows in order of their keys to links between fingerprints: in a key's bucket, all of them or stars of its groups."""
    held: list[np.ndarray] | None = None

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        a, b = _bucket_links(*rows, most)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "role", "fp")]
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        held = [x[cut:] for x in rows]
        if cut:
            yield links([x[:cut] for x in rows])
    if held is not None:
        yield links(held)


def links(fps: DataFrame, most: int = MOST_BITS, probes: tuple[str, ...] = ("fp",)) -> DataFrame:
    """Distinct (fp, probes) to links (a, b) between fps of at most ``most`` bits whose probes share a key. With fp itself
    as the probe, the links' transitive closure is that of all links of at most 4 bits."""
    keys = fps.select("fp", *(p for p in probes if p != "fp")).mapInArrow(partial(fuzzy_keys, probes=probes), "key long, role byte, fp long")
    dealt = keys.repartition(parts_for(fps), "key").sortWithinPartitions("key", "role")
    return dealt.mapInArrow(partial(verified, most=most), "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row for each row of df: doc_id, fp (long), component_id.

    Texts without words have fingerprint 0 and link like any other. Equal fingerprints are one node, so copies cost
    nothing. Repeated rows each get a row; null ids get one too, but never name a component (it is null if all its
    rows' ids are). No rows give no rows; columns other than the two named are not read.
    """
    rows = materialise(fingerprints(df, id_col, text_col, size), "fingerprints")
    return rows.join(classes(rows), "fp", "left").select("doc_id", "fp", "component_id")


def classes(rows: DataFrame) -> DataFrame:
    """(doc_id, fp) to (fp, root, component_id), a row for each fingerprint; a class has one root, and its least id."""
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes))
    grouped = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return grouped.join(named, "root").select("fp", "root", "component_id")


def recall(similarity: float) -> float:
    """Probability that two texts of this similarity of shingles share a min-wise key."""
    return 1 - (1 - similarity**DEEP) ** BANDS


_FACTORS = mix(np.arange(1, BANDS * DEEP + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SALTS = mix(np.arange(101, 105, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketched(hashes: np.ndarray) -> tuple[list[int], list[int]]:
    """Four independent fingerprints of the set of a text's shingle hashes, and the keys of its min-wise samples."""
    hashes = np.unique(hashes)
    least, ones = np.full(BANDS * DEEP, np.iinfo(np.uint64).max, dtype=np.uint64), np.zeros(256, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        piece = hashes[at : at + 4096, None]
        least = np.minimum(least, (piece * _FACTORS).min(axis=0))
        ones += np.unpackbits(mix(piece ^ _SALTS).astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    keys = np.arange(BANDS, dtype=np.uint64)
    for i in range(DEEP):
        keys = mix(keys ^ least[i::DEEP])
    prints = np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")
    return prints.view(np.int64).tolist(), keys.view(np.int64).tolist()


def plain(text: bytes) -> bytes:
    """What decides similarity: the words, ASCII letters in lower case."""
    return b" ".join(text.lower().split())


def prints_and_keys(df: DataFrame) -> DataFrame:
    """(doc_id, tie, text) to (doc_id, tie, node, fp, probe_a, probe_b, prints, keys); texts of the same words are one node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, data, offsets in slices(batches, "text"):
            raw = [plain(data[s:e].tobytes()) for s, e in zip(offsets, offsets[1:])]
            node = [xxhash.xxh64_intdigest(t, SEED) for t in raw]
            hashes = [shingle_hashes(t, SIMILAR_SHINGLE) for t in raw]
            made = [node, [majority(h) for h in hashes], *zip(*map(word_prints, raw))]
            prints, keys = zip(*map(sketched, hashes))
            longs = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in made]
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (prints, keys)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("tie"), *longs, *lists], ["doc_id", "tie", "node", "fp", "probe_a", "probe_b", "prints", "keys"])

    id_type = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "tie", "text").mapInArrow(run, f"doc_id {id_type}, tie long, node long, fp long, probe_a long, probe_b long, prints array<long>, keys array<long>")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _large_bucket(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places: a tree of each group of members that may be similar, by way of others or not."""
    rest, left, right = np.arange(len(prints)), [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            hit = _apart(prints[rest], prints[one]) <= FAR_BITS
            found, rest = rest[hit], rest[~hit]
            left.append(np.full(len(found), one))
            right.append(found)
            queue.extend(found.tolist())
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _bucket_pairs(key: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(begin, len(key)))
    left, right = [], []
    for s, n in zip(begin[size > LARGE_BUCKET], size[size > LARGE_BUCKET]):
        a, b = _large_bucket(prints[s : s + n])
        left.append(s + a)
        right.append(s + b)
    begin, size = begin[(size > 1) & (size <= LARGE_BUCKET)], size[(size > 1) & (size <= LARGE_BUCKET)]
    at = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    end, step = np.repeat(begin + size, size), 1
    while len(at):
        keep = at + step < end
        at, end = at[keep], end[keep]
        hit = _apart(prints[at], prints[at + step]) <= FAR_BITS
        left.append(at[hit])
        right.append(at[hit] + step)
        step += 1
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _joined(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least place that each of n places is joined to."""
    label = np.arange(n)
    while True:
        before, least = label.copy(), np.minimum(label[left], label[right])
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)
        label = label[label]
        if (label == before).all():
            return label


def _named(group: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """Groups of two or more by a hash of their members, so that a group that meets under many keys is one."""
    order = np.argsort(group, kind="stable")
    group, node = group[order], node[order]
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(begin, len(group)))
    name = mix(np.add.reduceat(mix(node.view(np.uint64)), begin)).view(np.int64)
    keep = np.repeat(size > 1, size)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[keep]), pa.array(node[keep])], ["group", "node"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their keys to the members of each group of nodes of a key that may be similar."""
    held: list[np.ndarray] | None = None

    def groups(key: np.ndarray, node: np.ndarray, *prints: np.ndarray) -> pa.RecordBatch:
        a, b = _bucket_pairs(key, np.stack(prints, axis=1).view(np.uint64))
        return _named(_joined(len(key), a, b), node)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "p0", "p1", "p2", "p3")]
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        held = [x[cut:] for x in rows]
        if cut:
            yield groups(*(x[:cut] for x in rows))
    if held is not None:
        yield groups(*held)


def min_wise_groups(rows: DataFrame) -> DataFrame:
    """(node, prints, keys) to (group, node): nodes that share a key and may be similar are in a group together. A node has
    at most a row for each of its keys, whatever the size of the groups."""
    once = rows.groupBy("node").agg(F.first("prints").alias("p"), F.first("keys").alias("k"))
    keyed = once.select(F.explode("k").alias("key"), "node", *(F.col("p")[i].alias(f"p{i}") for i in range(4)))
    return keyed.repartition(parts_for(rows), "key").sortWithinPartitions("key", "node").mapInArrow(_met, "group long, node long")


def _twos(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            both = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")], axis=1)
            yield _named(np.repeat(np.arange(len(both)), 2), both.ravel())


def golay_groups(rows: DataFrame) -> DataFrame:
    """(node, fp, probe_a, probe_b, prints, keys) to (group, node): pairs of nodes of near or equal fingerprints, as stars, less
    those that a min-wise key has in a group already."""
    one = F.struct("node", "prints", "keys")
    of_fp = rows.groupBy("fp").agg(F.min(one).alias("one"))
    near = links(rows.select("fp", "probe_a", "probe_b").distinct(), SIMILAR_BITS, ("probe_a", "probe_b")).distinct()
    near = near.join(of_fp.toDF("a", "x"), "a").join(of_fp.toDF("b", "y"), "b").select("x", "y")
    equal = rows.select("fp", one.alias("y")).join(of_fp.toDF("fp", "x"), "fp").where("x.node <> y.node").select("x", "y")
    apart = sum(F.bit_count(F.col("x.prints")[i].bitwiseXOR(F.col("y.prints")[i])) for i in range(4))
    met = F.arrays_overlap("x.keys", "y.keys") & (apart <= FAR_BITS)
    pairs = near.union(equal).where(~met).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    return pairs.mapInArrow(_twos, "group long, node long")


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) to (node, shingles): the set of XXH64 of the text's shingles, ascending."""
    for piece, data, offsets in slices(batches, "text"):
        made = [np.unique(shingle_hashes(plain(data[s:e].tobytes()), SIMILAR_SHINGLE)).tobytes() for s, e in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays([piece.column("node"), pa.array(made, pa.binary())], ["node", "shingles"])


def _forest(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places, each LEAST similar or more: a tree of each group that all such pairs make. Every set is held against
    all that no tree has yet, so that none of those pairs leads out of its tree."""
    size = np.array([len(s) for s in sets])
    begin = np.cumsum(size) - size
    shingle, code = np.unique(np.concatenate(sets), return_inverse=True)
    code, of = code.astype(np.int32), np.repeat(np.arange(len(size), dtype=np.int32), size)
    has, waits, rest, left, right = np.zeros(len(shingle), dtype=bool), np.ones(len(size), dtype=bool), np.arange(len(size)), [], []
    shared = np.bincount(code, minlength=len(shingle))[code] > 1
    open_code, open_of, opened = code[shared], of[shared], len(size)
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        waits[queue[0]] = False
        while queue and len(rest):
            one = queue.pop()
            if 4 * len(rest) < 3 * opened:
                still = waits[open_of]
                open_code, open_of, opened = open_code[still], open_of[still], len(rest)
            own = code[begin[one] : begin[one] + size[one]]
            has[own] = True
            both = np.bincount(open_of[has[open_code]], minlength=len(size))[rest]
            has[own] = False
            hit = both * LEAST[1] >= (size[rest] + size[one] - both) * LEAST[0]
            found, rest = rest[hit], rest[~hit]
            waits[found] = False
            left.append(np.full(len(found), one))
            right.append(found)
            queue.extend(found.tolist())
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their groups to links of nodes: a group has fewer than members."""
    now, nodes, sets = None, [], []

    def links() -> tuple[np.ndarray, np.ndarray]:
        node, (a, b) = np.array(nodes, dtype=np.int64), _forest(sets)
        return node[a], node[b]

    for batch in batches:
        found = []
        for group, node, raw in zip(batch.column("group").to_pylist(), batch.column("node").to_pylist(), batch.column("shingles")):
            if group != now:
                if len(nodes) > 1:
                    found.append(links())
                now, nodes, sets = group, [], []
            nodes.append(node)
            sets.append(np.frombuffer(raw.as_py(), dtype=np.uint64))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["a", "b"])
    if len(nodes) > 1:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in links()], ["a", "b"])


def similar(groups: DataFrame, rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """(group, node) to links (a, b), whose shingles, read from the texts, are LEAST similar or more: their transitive closure
    is that of all such pairs of a group, though they are fewer than its members."""
    groups = materialise(groups.distinct(), "groups")
    ends = groups.select("node").distinct()
    chosen = rows.join(ends, "node").groupBy("node").agg(F.min("tie").alias("tie"))
    read = fresh.select("tie", "text").join(chosen, "tie").dropDuplicates(["node"]).select("node", "text")
    read = materialise(read.mapInArrow(_shingled, "node long, shingles binary"), "ends")
    met = groups.join(read, "node").select("group", "node", "shingles")
    return met.repartition(parts_for(rows), "group").sortWithinPartitions("group").mapInArrow(_similar, "a long, b long")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text and the columns to keep of one row of each group of documents whose five-word shingles are 0.8
    similar or more: the smallest id's (rows without an id come last), of its rows the one of the least text hash."""
    fresh = texts(df, id_col, text_col, keep).withColumn("tie", F.xxhash64("text"))
    rows = materialise(prints_and_keys(fresh), "fingerprints")
    roots = components(similar(min_wise_groups(rows).union(golay_groups(rows)), rows, fresh))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    grouped = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = grouped.groupBy("root").agg(F.min(first).alias("f")).select(F.col("f.doc_id").alias("_id"), F.col("f.tie").alias("_tie"))
    left = fresh.join(kept, (fresh["tie"] == kept["_tie"]) & fresh["doc_id"].eqNullSafe(kept["_id"]), "left_semi")
    return left.dropDuplicates(["tie", "doc_id"]).select("doc_id", "text", *keep)
