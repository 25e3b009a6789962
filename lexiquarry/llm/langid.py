"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to its character n-grams, from
five letters down to one, and scores by the mean log frequency of the first order of which at least half are known.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.common import slices, texts

UNKNOWN = "und"
#: Bounds of the model: documents learned from for each language (about), words, n-grams of each order.
SAMPLE_DOCS, WORDS, GRAMS = 3000, 40_000, 20_000
ORDERS = (5, 4, 3, 2, 1)
#: Words whose evidence a score counts as if independent; more do not make it surer.
EVIDENCE = 24
NOT_LETTERS = r"[^\p{L}\p{M}]+"
#: Words an executor's cache keeps between batches.
CACHED = 60_000


@dataclass
class Model:
    """langs; rows of log frequencies by language for words and for n-grams (with ^ and $ at a word's ends)."""

    langs: list[str]
    words: dict[str, int]
    word_rows: np.ndarray
    grams: dict[str, int]
    gram_rows: np.ndarray
    cache: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    def score(self, word: str) -> np.ndarray:
        """Log frequencies by language of a lower-case word of letters; zeros if nothing of it is known."""
        row = self.words.get(word)
        if row is not None:
            return self.word_rows[row]
        padded = f"^{word}$"
        for n in ORDERS:
            ends = len(padded) - n + 1
            if ends < 1:
                continue
            known = [r for i in range(ends) if (r := self.grams.get(padded[i : i + n])) is not None]
            if known and 2 * len(known) >= ends:
                return self.gram_rows[known].mean(axis=0)
        return np.zeros(len(self.langs))

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}


def _rows(counts: dict[str, np.ndarray], totals: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
    names = sorted(counts)
    table = np.array([counts[k] for k in names]).reshape(len(names), len(totals))
    rows = np.log((table + 0.1) / (totals + 0.1 * (len(names) + 1)))
    return {k: i for i, k in enumerate(names)}, rows - rows.mean(axis=1, keepdims=True)  # only differences matter


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learns from rows with a text, a language and an id that isn't held out: about ``sample_docs`` a language, taken by
    a hash of the id. What reaches the driver is the model: ``WORDS`` words and ``GRAMS`` n-grams of each order."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    have = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(have)
    empty = np.zeros((0, len(langs)))
    if not langs:
        return Model([], {}, empty, {}, empty)
    rate = F.lit(0.0)
    for lang in langs:
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_docs / have[lang]))).otherwise(rate)
    taken = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < rate * (1 << 20))
    words = taken.select("lang", F.explode(F.split(F.lower("text"), NOT_LETTERS)).alias("word")).where("word <> ''")
    counts = words.groupBy("word", "lang").agg(F.count("*").alias("n")).groupBy("word")
    counts = counts.agg(*(F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(langs)))
    each = [f"n{i}" for i in range(len(langs))]
    total = sum((F.col(c) for c in each[1:]), F.col(each[0]))
    counts = counts.withColumn("total", total).cache()

    def top(rows: DataFrame, key: str, most: int) -> dict[str, np.ndarray]:
        best = rows.where("total >= 2").orderBy(F.desc("total"), key).limit(most)
        return {r[0]: np.array(r[1:], dtype=float) for r in best.select(key, *each).collect()}

    sums = np.array(counts.agg(*(F.sum(c) for c in each)).first(), dtype=float)
    kept, rows_ = _rows(top(counts, "word", WORDS), sums)
    grams: dict[str, np.ndarray] = {}
    padded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    for n in ORDERS:
        at = F.when(F.length("word") + 2 >= n, F.sequence(F.lit(1), F.length("word") + 3 - n)).otherwise(F.array().cast("array<int>"))
        pieces = counts.select(*each, padded.alias("padded"), F.explode(at).alias("i")).select(*each, F.substring("padded", F.col("i"), F.lit(n)).alias("gram"))
        pieces = pieces.groupBy("gram").agg(*(F.sum(c).alias(c) for c in each)).withColumn("total", total)
        found = top(pieces, "gram", GRAMS)
        share = sum(found.values(), np.zeros(len(langs))) + 1
        index, table = _rows(found, share)
        grams |= {g: table[i] for g, i in index.items()}
    counts.unpersist()
    names = sorted(grams)
    return Model(langs, kept, rows_, {g: i for i, g in enumerate(names)}, np.array([grams[g] for g in names]).reshape(len(names), len(langs)))


def lettered(word: str | None) -> bool:
    """Marks alone are no word."""
    return bool(word) and any(c.isalpha() for c in word)


def decide(langs: list[str], sums: np.ndarray, n: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Per document: summed word scores and number of words to language and score; none without words."""
    if not langs:
        return [UNKNOWN] * len(n), np.zeros(len(n))
    each = sums / np.maximum(n, 1)[:, None] * np.minimum(n, EVIDENCE)[:, None]
    odds = np.exp(each - each.max(axis=1, keepdims=True))
    odds /= odds.sum(axis=1, keepdims=True)
    best = odds.argmax(axis=1)
    return [langs[b] if k else UNKNOWN for b, k in zip(best, n)], np.where(n > 0, odds.max(axis=1), 0.0)


def predict_one(model: Model, text: str | None) -> tuple[str, float]:
    """The plain form of what ``predict`` does in batches."""
    words = [w for w in regex.split(NOT_LETTERS, (text or "").lower()) if lettered(w)]
    sums = sum((model.score(w) for w in words), np.zeros(len(model.langs)))
    langs, score = decide(model.langs, np.array([sums]), np.array([len(words)]))
    return langs[0], float(score[0])


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of df: doc_id, the columns to keep, lang_pred, score (0 to 1).

    A null text, or one without letters, is ``und`` with score 0; so is every text if the model has no languages. Equal
    scores go to the first language by code point. Repeated rows and null ids are kept; no rows give no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE_DOCS, WORDS and GRAMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        width = len(m.langs)
        for part, _, _ in slices(batches, "text", 2 << 20):
            split = pc.split_pattern_regex(pc.utf8_lower(part.column("text")), NOT_LETTERS)
            coded = split.values.slice(split.offsets[0].as_py(), split.offsets[-1].as_py() - split.offsets[0].as_py()).dictionary_encode()
            known = coded.dictionary.to_pylist()
            if len(m.cache) > CACHED:
                m.cache.clear()
            table = np.zeros((len(known), width))
            for i, w in enumerate(known):
                if lettered(w):
                    if (row := m.cache.get(w)) is None:
                        row = m.cache[w] = m.score(w)
                    table[i] = row
            real = np.array([lettered(w) for w in known], dtype=np.int64)
            code = coded.indices.to_numpy(zero_copy_only=False)
            at = split.offsets.to_numpy()
            at = at - at[0]
            run_sums = np.zeros((len(code) + 1, width))
            np.cumsum(table[code], axis=0, out=run_sums[1:])
            count = np.concatenate(([0], np.cumsum(real[code]))) if len(code) else np.zeros(1, np.int64)
            langs, score = decide(m.langs, run_sums[at[1:]] - run_sums[at[:-1]], count[at[1:]] - count[at[:-1]])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(langs, pa.string()), pa.array(score)], [*own, "lang_pred", "score"])

    own = ["doc_id", *keep]
    rows = texts(df, id_col, text_col, tuple(k for k in keep if k != "text"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in own)
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from df's own labelled rows, then predicts every row: doc_id, held_out, lang_pred, score.

    Rows without a language are only predicted; null ids are learned from and never held out; null texts and those
    without a letter are ``und``. Repeated rows have a row each; no rows give no rows; other columns aren't read.
    """
    out = predict(df, train(df, id_col, text_col, lang_col), id_col, text_col)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
