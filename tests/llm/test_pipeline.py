"""The pipeline's stages against plain versions, each on what its predecessor kept."""

import re
from collections import Counter

import corpus_pipeline as P
import numpy as np
from lexiquarry.llm import langid, mixing, packing, pii, simhash
from lexiquarry.llm.common import WORD
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ENGLISH = "the river runs under an old stone bridge while people watch small boats from their windows and talk about summer rain".split()
GERMAN = "der fluss und die alte stadt liegen unter einem hellen himmel weil kinder dort jeden abend spiele mit ihren freunden haben".split()


def text(seed: int, words: list[str], n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(words[i] + str(rng.integers(999)) * (rng.random() < 0.4) for i in rng.integers(0, len(words), n))


def table(spark):
    rows = [(i, text(i, ENGLISH if i % 2 else GERMAN, 80 + i), "en" if i % 2 else "de", f"s{i % 3}", 1) for i in range(60)]
    base = rows[5][1].split()
    changed = " ".join(w if i != 20 else "changed" for i, w in enumerate(base))
    rows += [(100, rows[5][1], "en", "s0", 1), (101, changed, "en", "s0", 1), (102, None, "en", "s1", None), (103, "123 !!!", None, "s1", 1), (104, "", None, None, 1)]
    rows += [(105, text(300, ENGLISH, 90) + " call +1 (310) 555-4510 or a@b.org now", None, None, 1), rows[7]]
    return spark.createDataFrame(rows, SCHEMA)


def jaccard(a: str, b: str) -> float:
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_stages(spark):
    docs = table(spark)
    model = langid.train(docs)
    kept = P.language(spark, docs, "").cache()
    plain = [r for r in docs.collect() if (p := langid.predict_one(model, r.text))[0] != "und" and p[1] >= P.LEAST_SCORE]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in plain) and not {102, 103, 104} & {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and kept.where("lang is null").count() == 0

    fresh = P.near_duplicates(spark, kept, "").cache()
    rows = sorted(kept.collect(), key=lambda r: r.doc_id)
    group = {}
    for i, r in enumerate(rows):
        group[i] = next((group[j] for j in range(i) if jaccard(rows[j].text, r.text) >= 0.8), i)
    assert sorted(r.doc_id for r in fresh.collect()) == sorted(rows[i].doc_id for i in set(group.values()))
    assert not {100, 101} & {r.doc_id for r in fresh.collect()} and fresh.columns == docs.columns

    clean = P.personal_data(spark, fresh, "").cache()
    found = {r.doc_id: r for r in pii.find(fresh).collect()}
    for r in clean.collect():
        want, marks = found[r.doc_id].text, []
        for kind in (*pii.KINDS, "term"):
            marks += [(x.start, x.end, f"<{kind.upper()}>") for x in found[r.doc_id][kind]]
        for s, e, mark in sorted(marks, reverse=True):
            want = want[:s] + mark + want[e:]
        assert r.text == want and r.n_chars == len(want)
    assert "call <PHONE> or <EMAIL> now" in clean.where("doc_id = 105").first().text and clean.count() == fresh.count()

    mixed = P.mix(spark, clean, "").cache()
    words = lambda df: df.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(WORD))).alias("n"))
    sizes = {r.source: r.n for r in words(clean).collect()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    aims = dict(zip(names, mixing.targets([sizes[n] for n in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])))
    for r in words(mixed).collect():
        assert abs(r.n - aims[r.source]) <= 0.02 * aims[r.source] + 2
    every = {r.doc_id: r.text.split() for r in clean.collect()}
    used = Counter((r.doc_id, w) for r in mixed.collect() for w in r.text.split())
    assert all(n <= 2 * every[d].count(w) for (d, w), n in used.items()) and mixed.columns == docs.columns

    packed = P.pack(spark, mixed, "").toPandas()
    encode = packing.encoder("byte_bpe_50k")
    total = sum(len(encode(r.text)) + 1 for r in mixed.collect())
    assert packed.length.sum() == total and packed.groupby("sequence_id").length.sum().max() <= 2048
    assert packed.sequence_id.nunique() == -(-total // 2048)


def test_run_and_empty(spark, tmp_path):
    docs = table(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = P.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0
    none = docs.limit(0)
    for _, stage in P.STAGES:
        none = stage(spark, none, "")
        assert none.count() == 0
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "personal_data", "mix", "pack"]
    assert not re.search("except", open(P.__file__).read())


def edited() -> list[tuple[int, str, int]]:
    """(id, text, id of its original): fresh texts, each with its tail cut off, more appended, or a block replaced."""
    out = []
    for k in range(40):
        word = lambda i, k=k: f"w{k}x{i}"
        words = [word(i) for i in range(400)]
        other = {0: words[:330], 1: words + [word(1000 + i) for i in range(80)], 2: words[:200] + [word(2000 + i) for i in range(30)] + words[230:], 3: words[60:]}[k % 4]
        out += [(2 * k, " ".join(words), 2 * k), (2 * k + 1, " ".join(other), 2 * k)]
    return out


def test_near_duplicates_of_any_edit(spark):
    rows = edited()
    assert all(jaccard(rows[i][1], rows[i + 1][1]) >= 0.8 for i in range(0, len(rows), 2)) and simhash.recall(0.8) > 0.999
    kept = P.near_duplicates(spark, spark.createDataFrame([(i, t, None, None, 1) for i, t, _ in rows], SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted({o for _, _, o in rows})


def test_large_buckets_lose_none():
    """Of a bucket over the limit, what is passed on links whatever is near."""
    rng = np.random.default_rng(3)
    bits = np.repeat(rng.integers(0, 2, (3, 256)), 40, axis=0) ^ (rng.random((120, 256)) < 0.04)
    prints = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view("<u8")
    a, b = simhash._large_bucket(prints)
    label = np.arange(120)
    for _ in range(120):
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
    assert (label == np.repeat([0, 40, 80], 40)).all()


def test_equal_fingerprints_are_not_enough(spark):
    """One shingle said over and over decides the fingerprint; the texts share little else."""
    rows = [(i, "a " * 50 + text(900 + i, ENGLISH, 6), None, None, 1) for i in range(4)]
    assert len({simhash.majority(simhash.shingle_hashes(r[1].encode(), simhash.SIMILAR_SHINGLE)) for r in rows}) == 1
    kept = P.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3]


def test_large_groups_stay_linear(spark, monkeypatch):
    """Many near copies of one text, some linked only by way of others, some not at all: all groups, but no square of rows."""
    rng, base = np.random.default_rng(11), text(77, ENGLISH, 120).split()
    rows = []
    for i in range(240):
        words = list(base)
        for k in rng.choice(120, 1 + i % 9, replace=False):
            words[k] = f"new{i}x{k}"
        rows.append((i, " ".join(words), None, None, 1))
    group = list(range(240))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (r[1].split() for r in rows)]
    for i in range(240):
        for j in range(i):
            if group[i] != group[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {min(i for i in range(240) if group[i] == g) for g in set(group)}
    assert 40 < len(least) < 200

    made, write = {}, simhash.materialise

    def counted(df, label):
        out = write(df, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(simhash, "materialise", counted)
    monkeypatch.setattr(simhash, "components", lambda edges, found=simhash.components: found(counted(edges, "links")))
    kept = P.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least)
    assert made["links"] <= 1500 and max(made.values()) <= simhash.BANDS * 240 + 1000, made
