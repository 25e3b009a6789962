"""The ten training-data operators against brute-force versions, on small fixtures with every awkward row."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from lexiquarry.llm import anchors, common, components, fingerprints, golay, knn, langid, mixing, packing, passages, pii, simhash, substrings, toxicity
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, c int, fp string"
WORDS = "the of and river stone light cloud summer winter garden window letter paper silver golden market bridge forest mountain valley ocean".split()


def sentence(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + (str(rng.integers(99)) if rng.random() < 0.3 else "") for i in rng.integers(0, len(WORDS), n))


def fixture() -> list[tuple]:
    shared = sentence(1, 120)
    texts = [
        None, "", " \t\n", "word", "a b c", "Ünïcödé ✓ 漢字 text", shared, shared, f"before {shared} after", f"{sentence(2, 30)} {shared[:500]} {sentence(3, 30)}",
        "x " * 700, "ab" * 600, sentence(4, 3000), sentence(4, 3000)[100:9000], sentence(5, 60), sentence(5, 60).replace("river", "brook", 1), "!!! ??? 123", "\x00nul\x00 byte " + shared,
    ]
    rows = [(i, t, "en" if i % 3 else None, ["s1", "s0", None][i % 3], i, "k", 1, "f") for i, t in enumerate(texts)]
    rows.append((30, sentence(7, 20_000), "en", "s0", 1, "k", 1, "f"))
    return [*rows, rows[6], (None, "no id here " + shared, None, None, None, None, None, None), (3, "another text of id three " + sentence(6, 40), "de", "s1", 1, "k", 1, "f")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_golay():
    assert len(np.unique(golay._LEADERS)) == 2048
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 22, 3000)
    masks = [0, *(1 << b for b in range(22)), *((1 << a) | (1 << b) for a in range(22) for b in range(a))]
    other = words ^ rng.choice(masks, len(words))
    (a, am), (b, bm) = golay.nearby(words, 22), golay.nearby(other, 22)
    assert all(set(x[m]) & set(y[n]) for x, m, y, n in zip(a, am, b, bm))


def test_links_lose_none(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base:
        for n in (1, 2, 3, 4, 5):
            fps.add(int(b) ^ sum(1 << int(i) for i in rng.choice(64, n, replace=False)))
    dense = int(base[0])
    fps |= {dense ^ (1 << i) ^ (1 << j) for i in range(16) for j in range(i)}  # one large bucket
    arr = np.array(sorted(fps), dtype=np.uint64)
    near = np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 4
    label = np.arange(len(arr))
    while True:
        new = np.array([label[m].min() for m in near])
        if (new == label).all():
            break
        label = new
    table = spark.createDataFrame([(int(x),) for x in arr.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.links(table)).collect()}
    got = [roots.get(int(x), int(x)) for x in arr.view(np.int64)]
    assert len({(a, b) for a, b in zip(label.tolist(), got)}) == len(set(label.tolist())) == len(set(got))


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 60)], [(1, 2), (2, 1), (4, 3), (None, 3)]])
def test_components(spark, edges):
    parent = {x: x for e in edges for x in e if x is not None and e[0] != e[1] and None not in e}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        if a in parent and b in parent and None not in (a, b):
            parent[root(a)] = root(b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got.keys() == parent.keys() and len({(root(x), got[x]) for x in parent}) == len({root(x) for x in parent}) == len(set(got.values()))


def plain_fingerprint(text: str | None, size: int = 4) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs, none):
    rows = docs.collect()
    fps = np.array([plain_fingerprint(r.text) for r in rows], dtype=np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    reach = near
    for _ in range(6):
        reach = (reach @ near) > 0
    want = Counter((r.doc_id, int(fps[i].view(np.int64)), min(rows[j].doc_id for j in np.flatnonzero(reach[i]) if rows[j].doc_id is not None)) for i, r in enumerate(rows) if r.doc_id is not None)
    got = simhash.near_duplicates(docs).collect()
    assert Counter(tuple(r) for r in got if r.doc_id is not None) == want and len(got) == len(rows)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.representatives(docs, keep=("lang",))
    assert kept.count() == len({frozenset(np.flatnonzero(r).tolist()) for r in reach})


def cover(n, starts, length):
    gone = np.zeros(n, dtype=bool)
    for s in starts:
        gone[s : s + length] = True
    return gone


@pytest.mark.parametrize(("length", "reported", "group"), [(400, 200, 2048), (40, 34, 2), (40, None, 3)])
def test_substrings(docs, none, length, reported, group):
    """Whole and part repeats; a small group makes prefixes long."""
    raw = [(r.text or "").encode() for r in docs.collect()]
    seen = Counter(b[i : i + n] for n in {length, reported or length} for b in raw for i in range(len(b) - n + 1))
    want = Counter()
    for r, b in zip(docs.collect(), raw):
        gone = cover(len(b), [i for i in range(len(b) - length + 1) if seen[b[i : i + length]] > 1], length)
        kept, n = bytes(np.frombuffer(b, np.uint8)[~gone]), reported or length
        told = cover(len(b), [i for i in range(len(b) - n + 1) if seen[b[i : i + n]] > 1], n)
        want[(r.doc_id, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest(), int(told.sum()))] += 1
    found = substrings.remove_repeats(docs, length=length, reported=reported, group=group)
    got = Counter(tuple(r) for r in found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated").collect())
    assert got == want
    assert substrings.remove_repeats(none).count() == 0


@pytest.mark.parametrize(("window", "group"), [(13, 2048), (13, 2), (5, 3)])
def test_passages(docs, none, window, group):
    words = [((r.doc_id if r.doc_id is not None else 2**62), re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode())) for r in docs.collect()]
    first: dict = {}
    for i, w in words:
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            first[key] = min(i, first.get(key, i))
    want = Counter()
    for i, w in words:
        gone = cover(len(w), [j for j in range(len(w) - window + 1) if first[tuple(w[j : j + window])] < i], window)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want[(None if i == 2**62 else i, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest())] += 1
    got = Counter(tuple(r) for r in passages.remove_repeats(docs, window=window, group=group).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == want
    assert passages.remove_repeats(none).count() == 0


def test_index_family_merges():
    """Levels of one size merge; every pair of runs meets, whatever batches they came in."""
    rng = np.random.default_rng(3)
    length, n = 12, 700
    text = rng.integers(97, 99, size=(n, 2 * length - 1), dtype=np.uint8)
    rec = np.zeros(n, dtype=anchors.record_type("u1", 1, (length,)))
    rec["key"], rec["back"] = text[:, length - 1] % 2, length - 1
    rec["right"], rec["left"] = text[:, length - 1 :], text[:, : length - 1][:, ::-1]
    seen = Counter((k, o, bytes(t[length - 1 - o : 2 * length - 1 - o])) for k, t in zip(rec["key"], text) for o in range(length))
    want = [[seen[(k, o, bytes(t[length - 1 - o : 2 * length - 1 - o]))] > 1 for o in range(length)] for k, t in zip(rec["key"], text)]
    assert (substrings.family_marks(rec, length, batch=32) == np.array(want)).all()
    family, sizes = substrings.IndexFamily(length, 7 * 32), []
    info = np.zeros(7 * 32, dtype=[("key", "u8"), ("back", "u2"), ("near", "u2"), ("at", "i8")])
    for s in range(0, 7 * 32, 32):
        family.add(anchors.Suffixes(info[s : s + 32], rec["right"][s : s + 32], rec["left"][s : s + 32]))
        sizes.append([len(x) for _, x in family.levels])
    assert sizes == [[32], [64], [64, 32], [128], [128, 32], [128, 64], [128, 64, 32]]


def test_window_minima():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 9, 300).astype(np.uint64)
    for width in (1, 2, 3, 7, 8, 31):
        assert anchors.window_minima(values, width).tolist() == [i + int(values[i : i + width].argmin()) for i in range(len(values) - width + 1)]


def test_prints_are_whole(spark):
    """Different runs of one key whose hashes agree in the upper half aren't taken for repeats."""

    def units(data, offsets):
        grams, at, hasher = substrings._units(data, offsets)
        return grams, at, lambda s, e: hasher(s, e) & np.uint64(0xFFFFFFFF)

    letters = lambda seed, n: bytes(np.random.default_rng(seed).integers(97, 123, n, dtype=np.uint8)).decode()
    rows = [(i, letters(i, 60) + letters(999, 39) + letters(100 + i, 60)) for i in range(50)]
    sent = anchors.sampled(spark.createDataFrame(rows, "doc_id long, text string"), units, 32, (40,), 1, 1, earlier_only=False)
    kinds = {r.kind for r in anchors.judged(sent, (40,), 1, 1, 1, earlier_only=False).collect()}
    assert kinds == {anchors.ASKED}


def test_language(spark, docs, none):
    train = [(i, f"der hund und die katze sind im haus nummer {i}", "de") for i in range(40)] + [(100 + i, f"the dog and the cat are in house number {i}", "en") for i in range(40)]
    table = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = langid.train(table)
    assert model.langs == ["de", "en"]
    rows = docs.collect()
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 6)) for r in langid.predict(docs, model).collect())
    assert got == Counter((r.doc_id, *(lambda p: (p[0], round(p[1], 6)))(langid.predict_one(model, r.text))) for r in rows)
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect() if r.doc_id in (0, 1, 2, 16)} == dict.fromkeys((0, 1, 2, 16), "und")
    checks = [("das haus", "de"), ("hunden", "de"), ("the thing", "en"), ("houses", "en")]
    assert [langid.predict_one(model, t)[0] for t, _ in checks] == [w for _, w in checks]
    out = langid.identify(table).collect()
    assert all(r.lang_pred == ("de" if r.doc_id < 100 else "en") for r in out) and {r.held_out for r in out} == {True, False}
    empty = langid.identify(none)
    assert empty.count() == 0 and langid.predict(docs, langid.train(none)).where("lang_pred <> 'und' or score <> 0").count() == 0


def test_language_of_marks_alone(spark):
    """Combining marks, digits and signs are no letters; a mark in a word is a part of it."""
    table = spark.createDataFrame([(i, t, "de") for i, t in enumerate(["das haus", "die maus"] * 20)], "doc_id long, text string, lang string")
    model, odd = langid.train(table), ["\u0301 \u0302", "²3 ½ !", "\u0301", "das hau\u0301s"]
    got = langid.predict(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "de"] == [langid.predict_one(model, t)[0] for t in odd]


def test_language_ignores_held_out_labels(spark):
    rows = [(i, "le chat et le chien", "fr") for i in range(50)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wrong = table.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang")))
    assert langid.train(wrong).langs == ["fr"]


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.3
        text = sentence(1000 + i, 30) + (" you are an idiot and a clown" if bad else " you are kind")
        rows.append((i, text))
        labels.append((i, int(bad)))
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score(table, marks).collect()}
    held = [(out[i], y) for i, y in labels if out[i].held_out]
    assert len(held) > 200 and all(r.predicted == y and (r.score >= 0.7) == bool(y) for r, y in held)
    model = toxicity.train(table, marks)
    got = toxicity.predict(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert toxicity.score(none, marks).count() == 0
    assert toxicity.predict(docs, toxicity.train(table, marks.limit(0))).where("score <> 0").count() == 0


def test_isotonic():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0, 1, 0, 1, 1]))
    assert (np.diff(y) >= 0).all() and np.interp([1, 2.5, 4], x, y).tolist() == [0, 0.5, 1]


@pytest.fixture
def small_groups(monkeypatch):
    """Few queries and rows a group, so that blocks, slices and shared groups all occur."""
    for name, n in (("GROUP_QUERIES", 3), ("SLICE_ROWS", 50), ("CELL_ROWS", 20)):
        monkeypatch.setattr(knn, name, n)


def plain_top(vecs, k=20, every=20):
    ok = [(i, np.floor(64 * np.float32(v).astype(float))) for i, v in vecs if i is not None and v and None not in v and np.isfinite(v).all()]
    want = {}
    for q, v in ok:
        if q % every == 0:
            scores = sorted((-int(v @ o), i) for i, o in ok if i != q and len(o) == len(v))[:k]
            want |= {(q, n): (i, -s) for n, (s, i) in enumerate(scores, 1)}
    return want


def awkward_vectors():
    rng = np.random.default_rng(6)
    vecs = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    odd = [(200, vecs[3][1]), (201, vecs[3][1]), (220, None), (240, [float("nan")] * 8), (None, vecs[0][1]), (260, [None] * 8), (280, [1.0, 2.0]), (281, [2.0, 1.0]), (300, [])]
    return [*vecs, *odd, *[vecs[20]] * 3, vecs[3], vecs[7]]  # a query three times, candidates twice


def test_knn(spark):
    vecs = awkward_vectors()
    table = spark.createDataFrame([(i, v, "x") for i, v in vecs], "vec_id long, embedding array<float>, score string")
    got = knn.search(table).collect()
    assert len(got) == len({(r.query_id, r["rank"]) for r in got}) and {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == plain_top(vecs)
    assert knn.search(table.limit(0)).count() == 0


def test_knn_in_small_groups(spark, small_groups):
    vecs = awkward_vectors()
    table = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in knn.search(table).collect()} == plain_top(vecs)


def test_knn_leaves_cells_out(spark, small_groups):
    """Tight groups: the summaries exclude most pairs of cells, and nothing is lost."""
    rng = np.random.default_rng(16)
    centres = rng.normal(size=(8, 16)) * 10
    vecs = [(i, (centres[i % 8] + rng.normal(size=16) * 0.05).tolist()) for i in range(600)]
    table = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in knn.search(table).collect()} == plain_top(vecs)
    rows = knn.vectors(table)
    pivots = knn._pivots(rows, 16)
    assert knn.plan(knn.cells(rows, pivots, 16), pivots, 16, 20, 20).excluded() > 0.5


def test_packing(docs, none):
    encode = packing.encoder("byte_bpe_50k")
    for text in ("plain text's here", "Ünïcödé", "漢字 mixed   text", "<|endoftext|>"):
        from public_tokenizers import path
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(path("byte_bpe_50k.json"))
        exact.encode_special_tokens = True
        assert encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids
    got = packing.pack(docs, capacity=64).toPandas()
    assert (got["length"] <= 64).all() and (got[got.start + got.length <= got.start].empty)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 64
    total = sum(len(encode(r.text or "")) + 1 for r in docs.collect())
    assert got.length.sum() == total and got.sequence_id.nunique() <= -(-total // 64) + 1
    long = got[got.doc_id == 12].sort_values("piece")
    assert (long.length.iloc[1:] == 64).all() and long.start.tolist() == [0, *long.length.cumsum().tolist()[:-1]]
    assert packing.pack(none).count() == 0


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(7)
    counts = {int(k): int(rng.integers(1, 40)) for k in rng.choice(np.arange(1, 101), 60, replace=False)}
    places, used = packing.plan(counts, 100)
    bins: dict[int, int] = {}
    ranks = {k: sorted((p for p in places if p[0] == k), key=lambda p: p[1]) for k in counts}
    for k, n in counts.items():
        for r in range(n):
            _, first, per, sequence, offset = [p for p in ranks[k] if p[1] <= r][-1]
            b = sequence + (r - first) // per
            bins.setdefault(b, 0)
            bins[b] += k
    assert len(bins) == used and max(bins.values()) <= 100
    plain: list[int] = []  # first-fit decreasing, for comparison
    for k in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        at = next((i for i, b in enumerate(plain) if b + k <= 100), None)
        if at is None:
            plain.append(k)
        else:
            plain[at] += k
    assert used <= len(plain)


def test_best_two_fit():
    have = np.zeros(101, dtype=np.int64)
    have[[60, 30, 25, 14]] = 1
    assert sorted(packing._fill(have, 60, 100)) == [14, 25, 60]  # 60 + 30 leaves 10; 30 gives way to 25 + 14


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    sizes: dict = Counter()
    for r in docs.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    aims = dict(zip(names, mixing.targets([sizes[n] for n in names], [3, 1, 2])))
    taken: dict = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - aims[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - aims[s]) <= 0.02 * aims[s] + 2 for s in names)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r["size"], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    texts = mixing.mix(docs, keep=("text",)).withColumn("t", mixing.taken_text()).collect()
    assert all(sum(len(t.split()) for t in r.t) == r.taken for r in texts if r.doc_id not in (5, 17))
    assert mixing.mix(none).count() == 0


def test_sainte_lague():
    rng = np.random.default_rng(8)
    for _ in range(50):
        n = int(rng.integers(1, 9))
        weights, caps, seats = rng.integers(0, 50, n).astype(float), rng.integers(0, 12, n), int(rng.integers(0, 60))
        want = np.zeros(n, dtype=np.int64)
        for _ in range(seats):
            quotients = [(w / (2 * s + 1) if s < c else -1.0) for w, s, c in zip(weights, want, caps)]
            if max(quotients) <= 0:
                break
            want[int(np.argmax(quotients))] += 1
        assert mixing.sainte_lague(weights, seats, caps).tolist() == want.tolist()


def test_class_seats():
    """Classes of equal shards get what Sainte-Laguë gives the shards one by one."""
    rng = np.random.default_rng(18)
    for _ in range(60):
        shards = (1 << rng.integers(0, 6, int(rng.integers(1, 30)))).tolist()
        seats = int(rng.integers(0, 2 * sum(shards) + 5))
        want = sorted(zip(shards, mixing.sainte_lague(np.array(shards), seats, 2 * np.array(shards)).tolist()))
        got = mixing.class_seats(dict(Counter(shards)), seats)
        assert want == sorted((b, each + (i < more)) for b, (each, more) in got.items() for i in range(shards.count(b)))
    assert mixing.class_seats({}, 3) == {} and mixing.class_seats({0: 2}, 3) == {}


def plain_mix(rows, seed, hashed):
    """The mix by its definition, one word block after the other; hashed gives Spark's hashes."""
    sizes: dict = {}
    for r in rows:
        sizes.setdefault(r["source"], []).append(r)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    words = {s: sum(r["size"] for r in sizes[s]) for s in names}
    aims = dict(zip(names, mixing.targets([words[s] for s in names], [3, 1, 2, 3][: len(names)])))
    shards = {}
    for i, s in enumerate(names):
        n = max(1, -(-words[s] // mixing.SHARD_WORDS))
        for r in sizes[s]:
            shards.setdefault((i, hashed(r, seed) % n), []).append(r)
    blocks = {k: 0 if not (w := sum(r["size"] for r in v)) else min(mixing.BLOCKS, 1 << (w.bit_length() - 1)) for k, v in shards.items()}
    of = [sum(b for (j, _), b in blocks.items() if j == i) for i in range(len(names))]
    ratio = np.array([aims[s] / words[s] if words[s] else 0.0 for s in names])
    seats = mixing.sainte_lague(ratio * np.array(of), round(float((ratio * np.array(of)).sum())), 2 * np.array(of))
    return names, shards, blocks, dict(enumerate(seats.tolist()))


def test_mixing_draws_by_definition(spark, monkeypatch):
    """Each shard's words are drawn block by block: the draws of a source's shards add up to its seats."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 400)
    rows = [(i, sentence(i, 5 + i % 60), ["b", "a", None, "c"][i % 4]) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keyed = table.select("doc_id", F.xxhash64("doc_id", F.xxhash64("text"), F.lit(mixing.SEED)).alias("h")).collect()
    hashes = {r.doc_id: r.h for r in keyed}
    plain = [{"doc_id": i, "size": len(t.split()), "source": s} for i, t, s in rows]
    names, shards, blocks, seats = plain_mix(plain, mixing.SEED, lambda r, _: hashes[r["doc_id"]])
    got = {r.doc_id: r for r in mixing.mix(table).collect()}
    for i, _ in enumerate(names):
        drawn = {}
        for (j, k), mine in shards.items():
            if j == i:
                total, n = sum(r["size"] for r in mine), blocks[(j, k)]
                taken = sum(got[r["doc_id"]].taken for r in mine)
                near = [q for q in range(2 * n + 1) if abs(q * total / n - taken) < n + 1]  # blocks differ by a word
                drawn[k] = (near, n)
                copies = {got[r["doc_id"]].copies for r in mine}
                assert len(copies) == 1 and all(q // n <= 2 for q in near) and near
        assert sum(min(q) for q, _ in drawn.values()) <= seats[i] <= sum(max(q) for q, _ in drawn.values())


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == [200.0, 250 / 3, 500 / 3]
    assert mixing.targets([0, 10], [3, 1]) == [0.0, 15.0] and mixing.targets([], []) == []


def test_prefix_hashes():
    text = "abcabcabcabd" + "é漢" * 3
    h = fingerprints.PrefixHash(fingerprints._points(text))
    for a in range(len(text)):
        for b in range(len(text)):
            n = 0
            while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert h.common(a, b) == n


def test_fingerprints(spark, docs, none):
    rows = [r for r in docs.collect() if r.doc_id is not None and (r.doc_id, r.text) != (3, "word")]
    table = spark.createDataFrame([(r.doc_id, r.text) for r in {x.doc_id: x for x in rows}.values()], "doc_id long, text string")
    order = sorted(table.collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in fingerprints.compare(table).collect()}
    for i, r in enumerate(order):
        a, b = r.text or "", order[(i + 1) % len(order)].text or ""
        edited = a[: len(a) - len(a) // 3] + b[: len(a) // 3]
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
        assert (g.fingerprint == g.edited_fingerprint) == (a == edited) and 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
    assert got[6].fingerprint == got[7].fingerprint and got[0].fingerprint == got[1].fingerprint
    assert len({g.fingerprint for g in got.values()}) == len({r.text or "" for r in order})
    assert fingerprints.compare(docs).count() == docs.count() and fingerprints.compare(none).count() == 0
    one = fingerprints.compare(table.limit(1)).first()
    assert one.near_next == 1.0


def test_likeness_by_fingerprints():
    """Against the exact similarity of spans: cut, extended, edited within, and unrelated texts; strides that differ."""
    rng = np.random.default_rng(9)
    alphabet = np.array(list("abcdefghijklmnop qrstuvwxyz"))
    make = lambda n: "".join(rng.choice(alphabet, n))
    grams = lambda t: {t[i : i + fingerprints.SPAN] for i in range(len(t) - fingerprints.SPAN + 1)}
    errors = []
    for n in (40, 300, 3000, 20_000):
        a, other = make(n), make(n)
        for b in (a, a[: n - n // 3] + other[: n // 3], a[n // 2 :], a + other, other, a[: n // 3] + "X" + a[n // 3 :], other[: n // 4] + a):
            points = [fingerprints._points(x) for x in (a, b)]
            x, y = fingerprints.fingerprints(np.concatenate(points), np.array([0, len(a), len(a) + len(b)]))
            assert (str(x) == str(y)) == (a == b) and len(x.head) <= fingerprints.MARKS
            for end, common in (("head", next((i for i, (c, d) in enumerate(zip(a, b)) if c != d), min(len(a), len(b)))), ("tail", next((i for i, (c, d) in enumerate(zip(a[::-1], b[::-1])) if c != d), min(len(a), len(b))))):
                assert 0 <= common - fingerprints.extension(x, y, end) < max(x.stride, y.stride) or common == min(len(a), len(b))
            errors.append(fingerprints.likeness(x, y) - len(grams(a) & grams(b)) / len(grams(a) | grams(b)))
    assert max(map(abs, errors)) < 0.2 and np.mean(np.abs(errors)) < 0.05


def test_written_tables_go(spark, tmp_path):
    """What is written can be deleted at once, and a session of a cluster must name a shared folder."""
    import os

    kept = common.materialise(spark.range(3), "kept")
    where = kept.written_to.removeprefix("file://")
    assert kept.count() == 3 and os.path.isdir(where)
    common.discard(kept, spark.range(1))
    assert not os.path.exists(where)


def test_dealt(spark):
    """Every number has a partition of its own, whatever Spark's hash makes of it."""
    got = common.dealt(spark.range(23).withColumn("c", F.col("id").cast("int")), 23, "c").select("c", F.spark_partition_id().alias("p")).collect()
    assert all(r.c == r.p for r in got) and len(got) == 23


PRIVATE = [
    "mail a.b+c@mail.example.org, x@y or _z@q.de.", "10.0.0.1 and 256.1.1.1 and 1.2.3.4.5", "4111 1111 1111 1111 or 4111-1111-1111-1112", "+1 (310) 555-4510 and +12 or +49 30 123456.",
    "a@b.c_d@e.f 000000255.0.0.1", None, "", "é漢 a@b.c é", "+1 2.3.4.5.6.7.8.9 a@b@c.d " + "z" * 5000,
]


def test_pii_base(spark, none):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, value):
        digits = re.sub("[^0-9]", "", value)
        luhn = sum(v - 9 if (v := int(c) * (1 + i % 2)) > 9 else v for i, c in enumerate(reversed(digits))) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")), "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]

    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(PRIVATE)], "doc_id long, text string, at string")
    for r in pii.find(table).collect():
        for kind, p in patterns.items():
            assert [(x.start, x.end) for x in r[kind]] == [m.span() for m in re.finditer(p, PRIVATE[r.doc_id] or "") if good(kind, m[0])], (r.doc_id, kind)
    assert pii.find(none).count() == 0


def test_pii_terms(spark):
    """A word that always and only stands beside one address gives it away; common words don't."""
    rows = [(i, f"{sentence(i, 20)} write to quillfeather at qf@mail.org {sentence(i + 50, 20)}") for i in range(5)] + [(100 + i, sentence(200 + i, 60)) for i in range(200)]
    out = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("clean", pii.redacted()).collect()}
    for i, text in rows:
        found = [text[x.start : x.end] for x in out[i].term]
        assert ("quillfeather" in found) == (i < 5) and not {"the", "river"} & set(found)
        assert i >= 5 or ("qf@mail.org" not in out[i].clean and "<EMAIL>" in out[i].clean and "quillfeather" not in out[i].clean)


def test_pii_terms_anywhere(spark):
    """A term that stands far from the value is found, wherever and how often; a document without the value keeps it."""
    long = "q" * 80
    rows = [(i, f"Zanthorpe, {sentence(i, 90)} reach {long} of the clinic {sentence(i + 50, 5)} by za@mail.org. {sentence(i + 90, 40)} (ZANTHORPE)!") for i in range(5)]
    rows += [(90, "zanthorpe alone"), *((100 + i, sentence(200 + i, 60)) for i in range(200))]
    out = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("clean", pii.redacted()).collect()}
    for i, text in rows[:5]:
        found = [text[x.start : x.end] for x in out[i].term]
        assert found.count("Zanthorpe,") == found.count("(ZANTHORPE)!") == found.count(long) == 1 and "the" not in found
        assert "zanthorpe" not in out[i].clean.lower() and "za@mail.org" not in out[i].clean
    assert out[90].clean == "zanthorpe alone"


def test_redaction(spark):
    text = "a 10.0.0.1 b +1 (310) 555-4510 c"
    row = pii.find(spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "doc_id long, text string")).withColumn("clean", pii.redacted())
    assert {r.doc_id: r.clean for r in row.collect()} == {1: "a <IP> b <PHONE> c", 2: "plain", 3: ""}


def plain_terms(texts: list[str], support: int, discloses: float, sure: float, reach: int) -> list[set[tuple[int, int]]]:
    """The term spans of texts by the definition: loops over documents, words and entities."""
    word, trim = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"^[\W_]+|[\W_]+$")
    code = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}")
    bare = lambda w: trim.sub("", w).lower()
    letter = lambda t: any(c.isalpha() for c in t)
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    held = []
    for t in texts:
        found = [(m.start(), m.end(), "email", "email:" + m[0].lower()) for m in mail.finditer(t)]
        blank = lambda s, spans: "".join("\0" if any(a <= i < b for a, b, *_ in spans) else c for i, c in enumerate(s))
        found += [(m.start(), m.end(), "code", m[0]) for m in code.finditer(blank(t, found)) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
        found.sort()
        holed = blank(t, found)
        words = [(m.start(), m.end(), bare(m[0])) for m in word.finditer(holed) if "\0" not in m[0]]
        before = []
        for i, (s, _, kind, key) in enumerate(found):
            low = found[i - 1][1] if i else 0
            # what is left of a word that an entity is a part of counts as a word
            tail = [(low + m.start(), low + m.end(), bare(m[0])) for m in word.finditer(t[low:s])][-reach:]
            before.append((kind, key, s, found[i][1], tail))
        held.append((found, {w for *_, w in words if letter(w)}, before, words))
    n, n_term = len(texts), Counter(w for t in texts for w in {bare(m[0]) for m in word.finditer(t)})
    gives = lambda share, c: c < n and share > 0 and np.log2(n * share / c) >= discloses * np.log2(n / c)
    flagged: dict[str, set[str]] = {}
    of_class = Counter(k for f, *_ in held for k in {x[2] for x in f})
    for kind in of_class:
        keys: dict[str, set[str]] = {}
        for _, _, before, _ in held:
            for k, key, _, _, tail in before:
                for *_, w in tail:
                    if k == kind and letter(w):
                        keys.setdefault(w, set()).add(key)
        for w, values in keys.items():
            both, m = sum(w in ws and any(x[2] == kind for x in f) for f, ws, *_ in held), len(values)
            p = both / n_term[w]
            low = (p + sure**2 / (2 * m) - sure * np.sqrt(p * (1 - p) / m + sure**2 / (4 * m * m))) / (1 + sure**2 / m)
            if m >= support and n_term[w] >= support and gives(low, of_class[kind]):
                flagged.setdefault(kind, set()).add(w)
    values = Counter(key for f, *_ in held for key in {x[3] for x in f if x[2] == "email"})
    given: dict[str, set[str]] = {}
    for key, c in values.items():
        mine = [i for i, (f, *_) in enumerate(held) if key in {x[3] for x in f}]
        joint = Counter(w for i in mine for w in held[i][1])
        alike = {w: len({texts[i] for i in mine if w in held[i][1]}) for w in joint}
        given[key] = {w for w, b in joint.items() if alike[w] >= support and gives(b / n_term[w], c)} if len({texts[i] for i in mine}) >= support else set()
    out = []
    for f, _, before, words in held:
        spans = {(s, e) for s, e, w in words for x in f if w in given.get(x[3], ())}
        for kind, _, s, e, tail in before:
            hits = {(a, b) for a, b, w in tail if w in flagged.get(kind, ())}
            spans |= hits | ({(s, e)} if hits and kind == "code" else set())
        out.append(spans)
    return out


def test_pii_terms_by_definition(spark):
    """Secrets behind a word that introduces them, chance codes, copies, shared addresses and glued words."""
    rng = np.random.default_rng(11)
    secret = lambda: bytes(rng.integers(0, 256, 12, dtype=np.uint8)).hex() + "a1"
    texts = [f'{sentence(i, 25)} {["token", "TOKEN"][i % 2]} = "{secret()}"{["", "###", " and token again"][i % 3]} {sentence(i + 500, 10)}' for i in range(40)]
    texts += [f"{sentence(i, 20)} {secret()} {sentence(i + 50, 9)}" for i in range(60, 64)] + [texts[0]] * 3
    texts += [f"{sentence(i, 15)} quillfeather, at qf@mail.org {sentence(i, 6)}" for i in range(70, 75)]
    texts += [f"reach river.{i}@mail{i}.org now" for i in range(24)] + [sentence(i, 50) for i in range(100, 400)] + ["", "token", "￾ odd token = " + secret()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: {(x.start, x.end) for x in r.term} for r in pii.find(rows).collect()}
    want = plain_terms(texts, pii.SUPPORT, pii.DISCLOSES, pii.SURE, pii.REACH)
    assert [found[i] for i in range(len(texts) - 1)] == want[:-1] and found[len(texts) - 1] == set()
    marked = {t[a:b] for t, spans in zip(texts, want) for a, b in spans}
    assert {"token", "TOKEN", "reach", "quillfeather,"} <= marked and all(len(want[i]) >= 2 for i in range(40)) and not any(want[40:44])
