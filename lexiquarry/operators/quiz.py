"""Seeded quizzes and match rounds, bit for bit reproducible, and the distractor candidates by SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.functions import text as T
from lexiquarry.functions.python import key_of

MASK = 0xFFFFFFFF


def generator(seed: int) -> Callable[[], float]:
    """The mulberry32 generator: 32-bit state to numbers in [0, 1)."""
    state = seed & MASK

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & MASK
        t = (state ^ state >> 15) * (state | 1) & MASK
        t ^= (t + ((t ^ t >> 7) * (t | 61) & MASK)) & MASK
        return (t ^ t >> 14) / 2**32

    return draw


def shuffled(items: Iterable, draw: Callable[[], float]) -> list:
    """Fisher and Yates, from the end."""
    out = list(items)
    for i in range(len(out) - 1, 0, -1):
        j = int(draw() * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def _long_words(text: str) -> frozenset[str]:
    return frozenset(w for w in key_of(text).split() if len(w) > 2)


def distractors(pool: list[str], correct: str, n: int, draw: Callable[[], float]) -> list[str]:
    """Up to six options that share most words with the answer, shuffled, then the others that share none, shuffled."""
    keyed: dict[str, str] = {}
    for option in pool:
        keyed.setdefault(key_of(option), option)
    for k in ("", key_of(correct)):
        keyed.pop(k, None)
    mine = _long_words(correct)
    shares = {option: len(mine & _long_words(option)) for option in keyed.values()}
    near = sorted((o for o in shares if shares[o]), key=lambda o: -shares[o])[:6]
    return (shuffled(near, draw) + shuffled((o for o in shares if not shares[o]), draw))[:n]


def build(terms: list[dict], clozes: list[dict], count: int = 0, seed: int = 1, only: set[str] | None = None) -> list[dict]:
    draw, questions = generator(seed), []

    def ask(card: dict, kind: str, prompt: str, correct: str, pool: list[str]) -> None:
        wrong = distractors(pool, correct, 3, draw)
        if len(wrong) >= 2:
            options = shuffled([correct, *wrong], draw)
            questions.append({"card_id": card["id"], "kind": kind, "prompt": prompt, "options": options, "answer": options.index(correct), "section": card["section"]})

    picked = lambda cards: [c for c in cards if only is None or c["id"] in only]
    if len(terms) >= 4:
        for i, t in enumerate(picked(terms)):
            sides = ("definition", "term") if t["source"] != "section" and i % 2 == 0 else ("term", "definition")
            ask(t, "def-to-term" if sides[1] == "term" else "term-to-def", t[sides[0]], t[sides[1]], [x[sides[1]] for x in terms])
    pool = list(dict.fromkeys([c["answer"] for c in clozes] + [t["term"] for t in terms]))
    if len(pool) >= 4:
        for c in picked(clozes):
            ask(c, "cloze", c["prompt"], c["answer"], pool)
    mixed = shuffled(questions, draw)
    return mixed[:count] if count > 0 else mixed


def quizzes(terms: DataFrame, clozes: DataFrame, count: int = 0, seed: int = 1) -> DataFrame:
    """doc_id, n and a question: card_id, kind, prompt, options, answer (index), section. One document is one group: its cards
    are at most 140 and 60."""

    def one(key: tuple, t: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        rows = build(t.sort_values("n").to_dict("records"), c.sort_values("n").to_dict("records"), count, seed)
        out = pd.DataFrame(rows, columns=["card_id", "kind", "prompt", "options", "answer", "section"])
        out.insert(0, "n", range(len(out)))
        out.insert(0, "doc_id", key[0])
        return out

    kind = terms.schema["doc_id"].dataType.simpleString()
    clozes = clozes.select(*(F.col(c).alias(c) for c in clozes.columns))  # both may come from one table
    return terms.groupBy("doc_id").cogroup(clozes.groupBy("doc_id")).applyInPandas(one, f"doc_id {kind}, n int, card_id string, kind string, prompt string, options array<string>, answer int, section string")


def match_rounds(terms: DataFrame, size: int, seed: int) -> DataFrame:
    """A seeded sample of each document's pairs: doc_id, n, id, term, definition."""

    def one(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        rows = shuffled(t.sort_values("n")[["id", "term", "definition"]].to_dict("records"), generator(seed))[: max(0, size)]
        out = pd.DataFrame(rows, columns=["id", "term", "definition"])
        out.insert(0, "n", range(len(out)))
        out.insert(0, "doc_id", key[0])
        return out

    kind = terms.schema["doc_id"].dataType.simpleString()
    return terms.groupBy("doc_id").applyInPandas(one, f"doc_id {kind}, n int, id string, term string, definition string")


def tiles(pairs: DataFrame) -> DataFrame:
    """Two tiles for each pair; definitions are cut to 110 characters."""
    cut = F.when(F.length("definition") > 110, F.concat(F.rtrim(F.substring("definition", 1, 109)), F.lit("…"))).otherwise(F.col("definition"))
    side = F.array(F.struct(F.lit("term").alias("side"), F.col("term").alias("text")), F.struct(F.lit("definition").alias("side"), cut.alias("text")))
    return pairs.select("doc_id", F.col("id").alias("pair_id"), F.explode(side).alias("t")).select("doc_id", "pair_id", "t.side", "t.text")


def clicks(first: DataFrame, second: DataFrame) -> DataFrame:
    """Clicks (round, pair_id, side) paired by round: a match is one pair's two different tiles."""
    b = second.select("round", F.col("pair_id").alias("_p"), F.col("side").alias("_s"))
    return first.join(b, "round").select("round", "pair_id", ((F.col("pair_id") == F.col("_p")) & (F.col("side") != F.col("_s"))).alias("matched"))


#: Options of a group that may meet by one word alone, and frequent words of a set that are taken in all combinations.
FREQUENT, COMBINED = 64, 8


def overlaps(options: DataFrame, by: list[str], most: int = 6, frequent: int = FREQUENT, combined: int = COMBINED) -> DataFrame:
    """(by, id, text) to each option's ``most`` others that share words of over two letters: by, id, other, shared, rank.

    Options meet by a word that at most ``frequent`` of their group have. What they share of frequent words depends on
    their sets of such words alone, so it is found a set at a time: of the options with one set only the ``most`` + 1
    least ids can be among another's best. Of those that share just S with a set only the least ids that have S can, so
    each combination of a set's words needs the ``most`` + 1 least ids that have it, not all. A set of more than
    ``combined`` frequent words meets the other sets by each of them.

    Joins are merges: sizes that are guessed from packed files would let whole tables be broadcast.
    """
    words = F.array_distinct(F.filter(F.split(T.normalize_key(F.col("text")), " "), lambda w: F.length(w) > 2))
    tokens = options.select(*by, "id", F.explode(words).alias("token"))
    common = tokens.groupBy(*by, "token").agg(F.count("*").alias("many")).where(F.col("many") > frequent).drop("many").hint("merge")
    rare, often = tokens.join(common, [*by, "token"], "left_anti"), tokens.join(common, [*by, "token"], "left_semi")
    held = often.groupBy(*by, "id").agg(F.array_sort(F.collect_set("token")).alias("held"))

    def least(rows: DataFrame, *key: str) -> DataFrame:
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by, *key).orderBy("id"))).where(F.col("_n") <= most + 1).drop("_n")

    first = least(held, "held")  # (by, held, id): all that other sets need
    few, many = first.where(F.size("held") <= combined), first.where(F.size("held") > combined)
    chosen = lambda mask: F.filter("held", lambda w, i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1)
    masks = F.sequence(F.lit(1), F.expr("shiftleft(1, size(held)) - 1"))
    keys = lambda rows, *more: rows.select(*by, *more, "held", F.explode(F.transform(masks, lambda m: F.array_join(chosen(m), " "))).alias("token"))
    # every option that has the combination counts, also one whose frequent words are too many to combine
    asked = keys(few.select(*by, "held").distinct())
    wanted = asked.select(*by, "token").distinct().withColumn("first", F.split("token", " ")[0])
    rest = wanted.join(many.select(*by, "id", "held", F.explode("held").alias("first")).hint("merge"), [*by, "first"])
    rest = rest.where(F.forall(F.split("token", " "), lambda w: F.array_contains("held", w))).select(*by, "id", "held", "token")
    other = lambda rows: rows.select(*by, "token", F.col("id").alias("other"), F.col("held").alias("others")).hint("merge")
    long = many.select(*by, "held").distinct().select(*by, "held", F.explode("held").alias("token"))
    met = asked.join(other(least(keys(few, "id").unionByName(rest), "token")), [*by, "token"])
    met = met.unionByName(long.join(other(first.select(*by, "id", "held", F.explode("held").alias("token"))), [*by, "token"]))
    common_to = F.size(F.array_intersect("held", "others")).cast("long")
    met = met.select(*by, "held", "other", common_to.alias("shared")).distinct()
    best = Window.partitionBy(*by, "held").orderBy(F.desc("shared"), "other")
    near = met.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most + 1).drop("_n")
    pairs = held.join(near.hint("merge"), [*by, "held"]).where("id <> other").select(*by, "id", "other", "shared")
    # by rare words, with what such options share of the frequent ones
    close = rare.join(rare.select(*by, "token", F.col("id").alias("other")).hint("merge"), [*by, "token"]).where("id <> other").groupBy(*by, "id", "other").agg(F.count("*").alias("n"))
    close = close.join(held.hint("merge"), [*by, "id"], "left").join(held.select(*by, F.col("id").alias("other"), F.col("held").alias("others")).hint("merge"), [*by, "other"], "left")
    close = close.select(*by, "id", "other", (F.col("n") + F.coalesce(F.when(F.col("held").isNotNull() & F.col("others").isNotNull(), common_to), F.lit(0))).alias("shared"))
    every = pairs.unionByName(close).groupBy(*by, "id", "other").agg(F.max("shared").alias("shared"))
    n = F.row_number().over(Window.partitionBy(*by, "id").orderBy(F.desc("shared"), "other"))
    return every.withColumn("rank", n).where(F.col("rank") <= most)


def weak_first(cards: DataFrame, seed: int = 1) -> DataFrame:
    """Cards with box in a seeded order, the weak before the strong."""
    return cards.orderBy((F.col("box") >= 3).cast("int"), F.xxhash64("card_id", F.lit(seed)), "card_id")
