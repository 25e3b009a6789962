"""Toxicity by gradient-boosted trees over dense features of the text, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.common import slices, texts

#: Labelled rows learned from (about), and words of the learned lexicon.
SAMPLE_ROWS, LEARNED = 24_000, 300
THRESHOLD = 0.7
#: Words that a worker keeps the traits of between batches.
CACHED = 60_000
#: Fixed word list: insults by language.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb clown clowns pathetic worthless disgusting loser losers trash garbage scum filth ugly fool fools hate hateful imbecile jerk "
    "creep vile useless dumm dummkopf idioten abschaum dreck trottel depp versager widerlich wertlos crétin crétins imbécile ordure débile minable nul dégoûtant "
    "idiota idiotas estúpido imbécil basura escoria asqueroso inútil patético tonto".split()
)
#: Fixed word list: the second person by language.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu toi te ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split())
#: Fixed table: characters that stand for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
FEATURES = (
    "insult_density insult_kinds learned_density learned_best learned_sum hidden_density near_you you_density nearest_you capitals caps_words exclaims questions "
    "punctuation digits obfuscated stretched log_words".split()
)
REACH = 5
_CLASS = np.zeros((6, 256), dtype=bool)
_CLASS[0, 65:91] = True  # capitals
_CLASS[1, 65:91] = _CLASS[1, 97:123] = _CLASS[1, 128:] = True  # letters, roughly
_CLASS[2, 33] = True
_CLASS[3, 63] = True
_CLASS[4, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_CLASS[5, 48:58] = True


def traits(word: str, learned: dict[str, float]) -> tuple[float, ...]:
    """Of one word as written: insult, learned weight, hidden insult, second person, all capitals, obfuscated, stretched."""
    low = word.lower()
    bare = low.strip("\"'.,;:!?()[]{}<>«»¿¡%&$#*|~-_")
    insult = bare in INSULTS
    inner = not bare.isalpha() and any(c.isalpha() for c in bare) and len(bare) > 2
    plain = bare.translate(LEET) if inner else bare
    weight = learned.get(bare, 0.0)
    hidden = inner and (plain in INSULTS or learned.get(plain, 0.0) > 0)
    stretched = any(a == b == c and a.isalpha() for a, b, c in zip(low, low[1:], low[2:]))
    return insult, weight, hidden, bare in SECOND_PERSON, len(bare) > 1 and word.isupper(), inner, stretched


def features(text: pa.Array, data: np.ndarray, offsets: np.ndarray, learned: dict[str, float], cache: dict) -> np.ndarray:
    """A row of ``FEATURES`` for each text; zeros for an empty one."""
    split = pc.split_pattern_regex(text, r"[\x20\x09-\x0D]+")
    begin = split.offsets[0].as_py()
    coded = split.values.slice(begin, split.offsets[-1].as_py() - begin).dictionary_encode()
    at = split.offsets.to_numpy() - begin
    own = coded.dictionary.to_pylist()
    table = np.zeros((len(own) + 1, 8))
    if len(cache) > CACHED:
        cache.clear()
    for i, w in enumerate(own):
        if w:
            if (row := cache.get(w)) is None:
                row = cache[w] = traits(w, learned)
            table[i, :7] = row
            table[i, 7] = 1
    code = coded.indices.to_numpy(zero_copy_only=False)
    per = table[code] if len(code) else np.zeros((0, 8))
    sums = np.zeros((len(per) + 1, 8))
    np.cumsum(per, axis=0, out=sums[1:])
    total = sums[at[1:]] - sums[at[:-1]]
    docs = np.repeat(np.arange(len(at) - 1), np.diff(at))
    words = np.maximum(total[:, 7], 1)
    bad = np.flatnonzero((per[:, 0] > 0) | (per[:, 1] > 0) | (per[:, 2] > 0)) if len(per) else np.zeros(0, int)
    you = np.flatnonzero(per[:, 3] > 0) if len(per) else np.zeros(0, int)
    nearest = np.full(len(at) - 1, 1000.0)
    near = np.zeros(len(at) - 1)
    if len(bad) and len(you):
        k = np.searchsorted(you, bad)
        for side in (np.maximum(k - 1, 0), np.minimum(k, len(you) - 1)):
            gap = np.where(docs[you[side]] == docs[bad], np.abs(you[side] - bad), 1000)
            np.minimum.at(nearest, docs[bad], gap)
            np.add.at(near, docs[bad], gap <= REACH)
    best, kinds = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
    np.maximum.at(best, docs[bad], per[bad, 1])
    hits = bad[per[bad, 0] > 0]
    if len(hits):
        pairs = np.unique(np.stack([docs[hits], code[hits]], axis=1), axis=0)
        np.add.at(kinds, pairs[:, 0], 1)
    chars = [np.concatenate(([0], np.cumsum(c[data]))) for c in _CLASS]
    chars = [c[offsets[1:]] - c[offsets[:-1]] for c in chars]
    size, letters = np.maximum(np.diff(offsets), 1), np.maximum(chars[1], 1)
    columns = [total[:, 0] / words, kinds, (total[:, 1] > 0) * total[:, 1] / words, best, total[:, 1], total[:, 2] / words, near / words, total[:, 3] / words, nearest]
    columns += [chars[0] / letters, total[:, 4] / words, chars[2] / size, chars[3] / size, chars[4] / size, chars[5] / size, total[:, 5] / words, total[:, 6] / words, np.log1p(total[:, 7])]
    return np.where((total[:, 7] > 0)[:, None], np.stack(columns, axis=1), 0.0)


@dataclass
class Trees:
    """Boosted trees of one depth: cut points and features of the inner nodes, values of the leaves, in heap order."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            while inner and node[:1].size and node.min() < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 8.0) -> Trees:
    """Second-order boosting of the logistic loss on histograms of the features."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)  # bin b: cuts[b-1] < v <= cuts[b]
    score, inner = np.full(len(y), start), 2**depth - 1
    all_f, all_c, all_l = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            gain, where, at = np.zeros(width), np.zeros(width, dtype=np.int64), np.full(width, np.inf)
            for f, c in enumerate(cuts):
                k = len(c) + 1
                slot = (node - first) * k + binned[:, f]
                g = np.bincount(slot, grad, width * k).reshape(width, k).cumsum(axis=1)
                h = np.bincount(slot, hess, width * k).reshape(width, k).cumsum(axis=1)
                if k < 2:
                    continue
                gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                won = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                won = np.where((hl >= least / 8) & (ht - hl >= least / 8), won, 0)
                best = won.argmax(axis=1)
                top = won[np.arange(width), best]
                better = top > gain + 1e-9
                gain, where, at = np.where(better, top, gain), np.where(better, f, where), np.where(better, c[best], at)
            feature[first : first + width], cut[first : first + width] = where, at
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        slot = node - inner
        leaf = rate * np.bincount(slot, grad, inner + 1) / (np.bincount(slot, hess, inner + 1) + 1)
        score += leaf[slot]
        all_f.append(feature)
        all_c.append(cut)
        all_l.append(leaf)
    return Trees(start, np.array(all_f), np.array(all_c), np.array(all_l))


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (raw score, probability) of the best non-decreasing fit."""
    order = np.argsort(raw, kind="stable")
    xs, first = np.unique(raw[order], return_index=True)
    weight = np.diff(np.append(first, len(raw))).astype(float)
    mean = np.add.reduceat(y[order].astype(float), first) / weight
    blocks: list[list[float]] = []  # mean, weight, low, high
    for x, m, w in zip(xs, mean, weight):
        blocks.append([m, w, x, x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, high = blocks.pop()
            m1, w1, low, _ = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, low, high])
    knots = [(at, b[0]) for b in blocks for at in ((b[2], b[3]) if b[2] < b[3] else (b[2],))]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


@dataclass
class Model:
    learned: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(x))
        return np.clip(np.interp(self.trees.raw(x), *self.knots), 0.0, 1.0)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _measure(rows: DataFrame, learned: dict[str, float], keep: list[str]) -> DataFrame:
    """Adds an array of ``FEATURES`` to the kept columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for part, data, offsets in slices(batches, "text", 2 << 20):
            x = features(part.column("text"), data, offsets, learned, cache)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(list(x), pa.list_(pa.float64()))], [*keep, "features"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, features array<double>")


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from about ``sample_rows`` labelled rows whose ids aren't held out, taken by a hash of the id: half for the
    lexicon, a third for the trees and a sixth for the calibration. A document with both labels counts as toxic."""
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("mark")).where(F.col("mark").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    marks = marks.groupBy("doc_id").agg(F.max((F.col("mark") > 0).cast("int")).alias("mark"))
    many = marks.count()
    if not many:
        return Model({}, None, (np.zeros(1), np.zeros(1)))
    share = min(1.0, sample_rows / many)
    marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 20)) < share * (1 << 20)).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(6)))
    rows = texts(df, id_col, text_col).join(F.broadcast(marks), "doc_id")  # at most about sample_rows
    bare = F.regexp_replace(F.lower("word"), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    words = rows.where("fold < 3").select("doc_id", "mark", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).select("doc_id", "mark", bare.alias("word")).where("word <> ''")
    seen = words.distinct().groupBy("word").agg(F.sum("mark").alias("bad"), F.count("*").alias("n")).where("n >= 5")
    base = marks.where("fold < 3").agg(F.sum("mark"), F.count("*")).first()
    prior = (base[0] or 0) / max(base[1], 1)
    expected = F.col("n") * F.lit(prior)
    signed = (F.col("bad") - expected) / F.sqrt(expected * F.lit(1 - prior) + 1)
    best = seen.withColumn("z", signed).where("z > 3").orderBy(F.desc("z"), "word").limit(LEARNED).collect()
    learned = {r["word"]: float(min(r["z"], 20.0)) for r in best}
    got = _measure(rows.where("fold >= 3").select("mark", "fold", "text"), learned, ["mark", "fold"]).toPandas()
    if got.empty:
        return Model(learned, None, (np.zeros(1), np.zeros(1)))
    x, y, late = np.stack(got["features"].to_numpy()), got["mark"].to_numpy(), got["fold"].to_numpy() == 5
    if late.all() or not late.any():
        late = np.zeros(len(y), dtype=bool)
    order = np.lexsort((*x.T, y, late))  # rows come in any order; sums must not depend on it
    x, y, late = x[order], y[order], late[order]
    trees = boost(x[~late], y[~late])
    at = late if late.any() else ~late
    return Model(learned, trees, isotonic(np.round(trees.raw(x[at]), 9), y[at]))


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, score (0 to 1), predicted (1 from ``THRESHOLD`` on).

    Null and empty texts score as texts without any feature; with nothing learned every score is 0. Repeated rows and
    null ids are kept; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for part, data, offsets in slices(batches, "text", 2 << 20):
            score = model.score(features(part.column("text"), data, offsets, model.learned, cache))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = texts(df, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from the labels, then scores every row: doc_id, held_out, score, predicted."""
    return predict(df, train(df, labels, id_col, text_col), id_col, text_col).select("doc_id", held_out().alias("held_out"), "score", "predicted")
