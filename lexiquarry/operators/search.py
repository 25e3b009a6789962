"""Ranked search over a library, search inside documents, identifier lookup and identity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.functions import text as T


def records(papers: DataFrame) -> DataFrame:
    """(id, title, authors, journal, year, pmid, pmcid, doi, body) in lower case, ids as an array."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).alias(c)
    ids = F.filter(F.array(*(F.lower(c) for c in ("pmid", "pmcid", "doi"))), lambda x: x.isNotNull() & (x != ""))
    return papers.select("id", F.col("title").alias("shown"), low("title"), low("authors"), low("journal"), F.coalesce("year", F.lit("")).alias("year"), ids.alias("ids"), F.lower(T.strip_front_matter(F.col("body"))).alias("body"), F.col("body").alias("original"))


def token_match(token: Column) -> Column:
    """struct(score, fields) of one token against a record: the best field counts; the body only if nothing else does."""
    exact, part = F.array_contains("ids", token), F.exists("ids", lambda x: x.contains(token))
    tests = [("id", exact | part, F.when(exact, 100).otherwise(40)), ("title", F.col("title").contains(token), F.when(F.col("title").startswith(token), 30).otherwise(20)), ("author", F.col("authors").contains(token), F.lit(15)), ("journal", F.col("journal").contains(token), F.lit(10)), ("year", F.col("year") == token, F.lit(8))]
    score = F.greatest(*(F.when(hit, value).otherwise(0) for _, hit, value in tests))
    in_text = (score == 0) & F.col("body").contains(token)
    fields = F.filter(F.array(*(F.when(hit, F.lit(name)) for name, hit, _ in tests), F.when(in_text, F.lit("text"))), lambda f: f.isNotNull())
    return F.struct(F.when(in_text, 3).otherwise(score).alias("score"), fields.alias("fields"))


def search(papers: DataFrame, tokens: list[str]) -> DataFrame:
    """Papers that every token matches: id, title, score, fields, snippet; no token finds all with score 0.

    Tokens are a handful of literals, so each record is scored where it lies: no join and no shuffle.
    """
    found = records(papers)
    if not tokens:
        return found.select("id", F.col("shown").alias("title"), F.lit(0).alias("score"), F.array().cast("array<string>").alias("fields"), F.lit(None).cast("string").alias("snippet"))
    found = found.withColumn("hits", F.array(*(token_match(F.lit(t)) for t in tokens)))
    found = found.where(F.forall("hits", lambda h: h["score"] > 0))
    score = F.aggregate("hits", F.lit(0), lambda a, h: a + h["score"])
    shown = F.coalesce(*(F.when(F.array_contains(F.col("hits")[i]["fields"], "text"), T.snippet(T.strip_front_matter(F.col("original")), F.lit(t))) for i, t in enumerate(tokens)))
    fields = F.array_distinct(F.flatten(F.transform("hits", lambda h: h["fields"])))
    return found.select("id", F.col("shown").alias("title"), score.alias("score"), fields.alias("fields"), shown.alias("snippet"))


def ranked(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("score"), F.collate("title", "UNICODE_CI"), "id")


def in_document(blocks: DataFrame, needle: str, most: int = 200) -> DataFrame:
    """Blocks (doc_id, pos, section, kind, text) with the needle's places; the first ``most`` of each document."""
    needle = needle.strip().lower()
    if len(needle) < 2:
        return blocks.limit(0).withColumn("ranges", T.match_ranges(F.col("text"), F.lit("x")))
    hits = blocks.where((F.col("kind") != "rule") & F.lower("text").contains(needle)).withColumn("ranges", T.match_ranges(F.col("text"), F.lit(needle)))
    w = Window.partitionBy("doc_id").orderBy("pos")
    return hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def highlight(text: Column, ranges: Column) -> Column:
    """array<struct(text, marked)>: a text cut at its ranges."""
    cuts = F.aggregate(
        ranges,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,marked:boolean>>").alias("out")),
        lambda acc, r: F.struct(
            r["e"].alias("at"),
            F.concat(acc["out"], F.array(F.struct(F.substring(text, acc["at"] + 1, r["s"] - acc["at"]).alias("text"), F.lit(False).alias("marked")), F.struct(F.substring(text, r["s"] + 1, r["e"] - r["s"]).alias("text"), F.lit(True).alias("marked")))).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.array(F.struct(F.substring(text, acc["at"] + 1, F.length(text)).alias("text"), F.lit(False).alias("marked")))),
    )
    return F.filter(cuts, lambda x: x["text"] != "")


def find_existing(wanted: DataFrame, saved: DataFrame) -> DataFrame:
    """wanted (kind, value) to the first saved paper (pos, id, pmid, pmcid, doi) it refers to, if any.

    A disjunction of keys would be a nested loop; here each saved paper has a row for each of its keys, and one equi-join
    finds them all.
    """
    key = lambda kind, value: F.concat(F.lit(kind + ":"), value)
    keys = F.array_distinct(F.filter(F.array(key("pmid", F.col("pmid")), key("pmcid", T.normalize_pmcid(F.col("pmcid"))), key("doi", F.lower("doi"))), lambda k: k.isNotNull()))
    have = saved.select("pos", "id", F.explode(keys).alias("_key"))
    value = F.when(F.col("kind") == "pmcid", T.normalize_pmcid(F.col("value"))).when(F.col("kind") == "doi", F.lower("value")).otherwise(F.col("value"))
    hits = wanted.withColumn("_key", F.concat("kind", F.lit(":"), value)).join(have, "_key", "left")
    return hits.groupBy("kind", "value").agg(F.min_by("id", "pos").alias("id"))


def missing(bibliography: DataFrame, saved: DataFrame) -> DataFrame:
    """Bibliography rows whose DOI, whatever its case, isn't saved."""
    have = saved.select(F.lower("doi").alias("_doi")).where("_doi is not null").distinct()
    return bibliography.join(have, F.lower(bibliography["doi"]) == have["_doi"], "left_anti")


def dedupe(papers: DataFrame, richer: Column, order: str = "pos") -> DataFrame:
    """One row an identity: the first of the richer copies, at the place of the first copy of all."""
    ident = T.paper_identity(*(F.col(c) for c in ("pmid", "pmcid", "doi", "title")))
    names = papers.columns
    best = F.min_by(F.struct(*names), F.struct((~richer).alias("poor"), F.col(order).alias("at")))
    return papers.groupBy(ident.alias("identity")).agg(F.min(order).alias("place"), best.alias("_b")).select("identity", "place", "_b.*")


def unseen(identities: DataFrame, saved: DataFrame, most: int = 120, order: str = "pos") -> DataFrame:
    """First of each identity that isn't saved, with ``over`` for those past the cap (a row each, never dropped)."""
    fresh = identities.join(saved.select("identity").distinct(), "identity", "left_anti")
    first = fresh.groupBy("identity").agg(F.min(order).alias(order))
    within = first.orderBy(order, "identity").limit(most).select("identity", F.lit(False).alias("over"))  # a top-k, not a global window
    return first.join(within, "identity", "left").withColumn("over", F.coalesce("over", F.lit(True)))


def prioritised(copies: DataFrame) -> DataFrame:
    """(pmcid, archive A or B, xml) to the full text to use: A with a body, B with one, then A without."""
    body = T.has_article_body(F.col("xml"))
    rank = F.when(body & (F.col("archive") == "A"), 1).when(body & (F.col("archive") == "B"), 2).when(F.col("archive") == "A", 3)
    real = copies.where(F.col("xml").contains("<article")).withColumn("rank", rank).where("rank is not null")
    return real.groupBy("pmcid").agg(F.min_by(F.struct("archive", "xml"), "rank").alias("_b")).select("pmcid", "_b.archive", "_b.xml")


def identifiers(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    found = df.select(F.col(id_col).alias("doc_id"), F.posexplode(T.parse_paper_ids(F.col(text_col))).alias("pos", "ident"))
    return found.select("doc_id", "pos", "ident.kind", "ident.value")


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
