"""Inner parts of the training-data operators against plain versions: features, trees, calibration, pieces."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from lexiquarry.llm import common, packing, toxicity
from pyspark.sql import functions as F

from llm.test_llm_operators import docs, none, sentence  # noqa: F401


def plain_features(text: str, learned: dict[str, float]) -> list[float]:
    """One text, word by word and character by character."""
    raw, words = text.encode(), [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return [0.0] * len(toxicity.FEATURES)
    marks = [toxicity.traits(w, learned) for w in words]
    bad = [i for i, m in enumerate(marks) if m[0] or m[1] > 0 or m[2]]
    you = [i for i, m in enumerate(marks) if m[3]]
    n, weight = len(words), sum(m[1] for m in marks)
    share = lambda k: sum(m[k] for m in marks) / n
    # each insult looks at the nearest second person before it and after it
    gaps = [g for i in bad for g in (min((abs(i - y) for y in you if y <= i), default=1000), min((abs(i - y) for y in you if y >= i), default=1000))]
    beyond = [min((abs(i - y) for y in you), default=1000) for i in bad]
    letters = sum(b in range(65, 91) or b in range(97, 123) or b > 127 for b in raw)
    count = lambda ok: sum(map(ok, raw))
    signs = set(range(33, 48)) | set(range(58, 65)) | set(range(91, 97)) | set(range(123, 127))
    out = [share(0), len({w for w, m in zip(words, marks) if m[0]}), weight / n, max((m[1] for m in marks), default=0.0), weight, share(2)]
    out += [None, share(3), min(beyond, default=1000.0) if you else 1000.0]
    out += [count(lambda b: 65 <= b < 91) / max(letters, 1), share(4), count(lambda b: b == 33) / len(raw), count(lambda b: b == 63) / len(raw)]
    out += [count(lambda b: b in signs) / len(raw), count(lambda b: 48 <= b < 58) / len(raw), share(5), share(6), np.log1p(n)]
    return [x if x is not None else sum(g <= toxicity.REACH for g in gaps) / n for x in out]


def test_features_by_definition():
    learned = {"brook": 4.0, "silver": 7.5}
    texts = ["", "you idiot", "What a CLOWN, you! 1d10t?? sooo baaad", "silver brook you silver", sentence(3, 400) + " you moron", "Ünïcödé dreck dein", "a\tb\nyou far away " + "x " * 30 + "scum", sentence(8, 20_000) + " idiota tú"]
    data, offsets = common.text_bytes(pa.array(texts))
    got = toxicity.features(pa.array(texts), data, offsets, learned, {})
    skip = toxicity.FEATURES.index("near_you")
    for row, text in zip(got, texts):
        want = plain_features(text, learned)
        assert np.allclose(np.delete(row, skip), np.delete(want, skip)), text[:40]
        assert (row[skip] > 0) == (want[skip] > 0)


def plain_tree(trees: toxicity.Trees, x: np.ndarray) -> float:
    out = trees.start
    for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if x[feature[node]] > cut[node] else 1)
        out += leaf[node - len(feature)]
    return out


def test_trees_by_definition():
    """Predictions follow each tree from its root; boosting lowers the loss, and finds a rule of two features."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.2) & (x[:, 2] < 0.5)).astype(int)
    loss = lambda t: float(np.mean(np.logaddexp(0, t.raw(x)) - y * t.raw(x)))
    few, many = toxicity.boost(x, y, trees=3), toxicity.boost(x, y, trees=60)
    assert np.allclose(many.raw(x), [plain_tree(many, r) for r in x])
    assert loss(many) < loss(few) < 0.69 and ((many.raw(x) > 0) == y).mean() > 0.98


def test_first_split_is_best():
    """The root's cut has the highest gain of all cuts that are looked at."""
    rng = np.random.default_rng(4)
    x, bins = rng.integers(0, 9, size=(300, 3)).astype(float), 32
    y = (rng.random(300) < 0.2 + 0.08 * x[:, 1]).astype(int)
    tree = toxicity.boost(x, y, trees=1, depth=1, bins=bins)
    p = np.full(len(y), np.clip(y.mean(), 1e-3, 1 - 1e-3))
    g, h = y - p, p * (1 - p)
    gain = {}
    for f in range(3):
        for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])):
            low = x[:, f] <= c
            if h[low].sum() >= 1 and h[~low].sum() >= 1:
                gain[f, c] = g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
    assert np.isclose(gain[int(tree.feature[0, 0]), float(tree.cut[0, 0])], max(gain.values()))


def test_isotonic_by_definition():
    """The fit at each score is the greatest, over starts, of the least mean, over ends, of the labels between."""
    rng = np.random.default_rng(5)
    raw, y = rng.integers(0, 12, 80).astype(float), rng.integers(0, 2, 80)
    knots, values = toxicity.isotonic(raw, y)
    xs = np.unique(raw)
    mean = lambda a, b: y[(raw >= a) & (raw <= b)].mean()
    want = [max(min(mean(a, b) for b in xs if b >= x) for a in xs if a <= x) for x in xs]
    assert np.allclose(np.interp(xs, knots, values), want)


def test_labels_with_other_columns(spark):
    """Labels and documents may share names; labels for unknown or null ids, null ones and contradictions are settled."""
    rows = spark.createDataFrame([(i, f"you are {'an idiot' if i % 3 == 0 else 'kind'} {sentence(i, 12)}", 0.5, "x") for i in range(300)], "doc_id long, text string, score double, fold string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0), "text", 9) for i in range(300)] + [(None, 1, "t", 1), (9999, 1, "t", 1), (5, None, "t", 1), (4, 1, "t", 1)], "doc_id long, toxic int, text string, mark int")
    out = toxicity.score(rows, marks).collect()
    assert len(out) == 300 and sum(r.predicted == int(r.doc_id % 3 == 0) for r in out if r.held_out) >= 0.95 * sum(r.held_out for r in out)
    plain = toxicity.score(rows.select("doc_id", "text"), marks.select("doc_id", "toxic")).collect()
    assert Counter(tuple(r) for r in out) == Counter(tuple(r) for r in plain)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_pieces_by_definition(docs, none, capacity):  # noqa: F811
    """Every piece of every text, ids and all: only the first may be shorter, and only long documents are cut."""
    encode, want = packing.encoder(packing.VOCABULARY), Counter()
    for r in docs.collect():
        ids = [*encode(r.text or "").tolist(), 0]
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
        for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
            want[(r.doc_id, k, s, e - s, zlib.crc32(np.array(ids[s:e], dtype="<u4").tobytes()))] += 1
    got = packing.pack(docs, capacity=capacity).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert Counter(tuple(r) for r in got) == want
    assert packing.pack(docs.select(F.lit(1).alias("length"), "doc_id", "text", F.lit(2).alias("offset")), capacity=capacity).count() == len(got)
