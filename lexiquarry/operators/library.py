"""The stored library: import and export, upserts, deletes, the installer, accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.functions import text as T

#: Fixed value: how an export says what it is.
FORMAT = "recall-set"
EXPORT = "format string, version int, title string, markdown string, exportedAt bigint"
LIBRARY = "sets array<struct<id:string,title:string,markdown:string,createdAt:bigint,updatedAt:bigint>>, progress map<string,struct<cards:map<string,struct<box:double,seen:bigint,correct:bigint,wrong:bigint,starred:boolean,last:bigint>>,bestMatchMs:bigint>>, tombstones map<string,bigint>"


def export_json(sets: DataFrame) -> DataFrame:
    """(id, json): a set as a printed JSON object."""
    body = F.struct(F.lit(FORMAT).alias("format"), F.lit(1).alias("version"), "title", "markdown", F.col("updated_at").alias("exportedAt"))
    return sets.select("id", F.to_json(body, {"pretty": "true"}).alias("json"))


def parse_exports(rows: DataFrame, json_col: str = "json") -> tuple[DataFrame, DataFrame]:
    """Exports to (title, markdown) rows, and those that aren't one to rejects."""
    read = rows.withColumn("_x", F.from_json(json_col, EXPORT))
    good = F.coalesce((F.col("_x.format") == FORMAT) & F.col("_x.markdown").isNotNull(), F.lit(False))
    return read.where(good).select(F.coalesce("_x.title", F.lit("Imported set")).alias("title"), "_x.markdown"), rows.where(~F.coalesce((F.from_json(json_col, EXPORT)["format"] == FORMAT) & F.from_json(json_col, EXPORT)["markdown"].isNotNull(), F.lit(False)))


def load_library(rows: DataFrame, json_col: str = "json") -> dict[str, DataFrame]:
    """A library's JSON to its tables, sanitised: sets (the first of an id), cards, best times, tombstones. A corrupt text
    is an empty library."""
    read = rows.select(F.from_json(json_col, LIBRARY).alias("x"))
    s = read.select(F.posexplode("x.sets").alias("pos", "s")).select("pos", "s.*").where("id is not null and markdown is not null")
    first = s.groupBy("id").agg(F.min_by(F.struct("pos", "title", "markdown", "createdAt", "updatedAt"), "pos").alias("r")).select("id", "r.*")
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled set"))
    sets = first.select("id", title.alias("title"), "markdown", F.coalesce("createdAt", F.lit(0)).alias("created_at"), F.coalesce("updatedAt", F.lit(0)).alias("updated_at"), "pos")
    p = read.select(F.explode("x.progress").alias("set_id", "p"))
    c = p.select("set_id", F.explode("p.cards").alias("card_id", "c"))
    zero = lambda n: F.coalesce(F.col(f"c.{n}"), F.lit(0)).alias(n)
    box = F.coalesce(F.when(F.col("c.box").between(0, 3), F.floor(F.col("c.box") + 0.5).cast("int")), F.lit(0))
    cards = c.select("set_id", "card_id", box.alias("box"), zero("seen"), zero("correct"), zero("wrong"), F.coalesce("c.starred", F.lit(False)).alias("starred"), zero("last"))
    best = p.where("p.bestMatchMs > 0").select("set_id", F.col("p.bestMatchMs").alias("best_match_ms"))
    tombs = read.select(F.explode("x.tombstones").alias("id", "deleted_at")).where("deleted_at > 0")
    return {"sets": sets, "cards": cards, "best": best, "tombstones": tombs}


def upsert(sets: DataFrame, changed: DataFrame) -> DataFrame:
    return sets.join(changed.select("id"), "id", "left_anti").unionByName(changed.select(*sets.columns))


def delete(sets: DataFrame, cards: DataFrame, tombstones: DataFrame, ids: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets and progress without the ids, and a tombstone for each."""
    gone = ids.select("id").distinct()
    left = tombstones.join(gone, "id", "left_anti").select("id", "deleted_at").unionByName(gone.withColumn("deleted_at", F.lit(now_ms).cast("long")))
    return sets.join(gone, "id", "left_anti"), cards.join(gone.withColumnRenamed("id", "set_id"), "set_id", "left_anti"), left


def create_sets(drafts: DataFrame, now_ms: int, prefix: str = "", blank: str = "Untitled set") -> DataFrame:
    """(pos, title, markdown) to sets; ids of one batch differ by their positions' times."""
    at = F.lit(now_ms) + F.col("pos")
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit(blank))
    return drafts.select(T.set_id(at, F.col("markdown"), prefix).alias("id"), title.alias("title"), "markdown", at.alias("created_at"), at.alias("updated_at"))


def append_note(markdown, note):
    """A note under ``## Added notes``, which is added once."""
    head = F.when(markdown.rlike(r"(?m)^## Added notes\s*$"), F.lit("")).otherwise(F.lit("\n\n## Added notes"))
    return F.concat(F.rtrim(markdown), head, F.lit("\n\n"), F.trim(note), F.lit("\n"))


def refresh(saved: DataFrame, fetched: DataFrame) -> DataFrame:
    """(id, markdown, full) kept or replaced: full text is never replaced by an abstract, equal text changes nothing."""
    new = fetched.select("id", F.col("markdown").alias("_m"), F.col("full").alias("_f"))
    take = F.coalesce(F.col("_m").isNotNull() & ~(F.col("full") & ~F.col("_f")) & (F.col("_m") != F.col("markdown")), F.lit(False))
    return saved.join(new, "id", "left").select("id", F.when(take, F.col("_m")).otherwise(F.col("markdown")).alias("markdown"), F.when(take, F.col("_f")).otherwise(F.col("full")).alias("full"), take.alias("changed"))


def install_bundled(bundled: DataFrame, sets: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Bundled sets that aren't deleted, nor there by id, nor there by content."""
    fresh = bundled.join(tombstones.select("id"), "id", "left_anti").join(sets.select("id"), "id", "left_anti")
    have = sets.select(F.xxhash64("markdown").alias("_h"), F.col("markdown").alias("_m"))
    return fresh.join(have, (F.xxhash64(fresh["markdown"]) == have["_h"]) & (fresh["markdown"] == have["_m"]), "left_anti")


def counts(sets: DataFrame) -> DataFrame:
    paper = T.is_paper(F.col("id"))
    return sets.agg(F.count_if(paper).alias("papers"), F.count_if(~paper).alias("notes"))


def record_meta(records: DataFrame) -> DataFrame:
    """Search records (pmid, pmcid, doi, title, author_string, journal, pub_year) as metadata of an article."""
    authors = F.filter(F.transform(F.split(F.regexp_replace("author_string", r"\.$", ""), r",\s*"), lambda a: F.trim(a)), lambda a: a != "")
    title = F.regexp_replace(F.coalesce("title", F.lit("Untitled paper")), r"\s*\.$", "")
    return records.select("pmid", "pmcid", "doi", title.alias("title"), authors.alias("authors"), "journal", F.col("pub_year").cast("string").alias("year"))


def route_imports(pastes: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ids and route: what a paste holds decides between an error, one lookup and a bulk import."""
    rows = pastes.withColumn("ids", T.parse_paper_ids(F.col(text_col)))
    one = T.parse_paper_id(F.col(text_col))
    rows = rows.withColumn("ids", F.when((F.size("ids") == 0) & one.isNotNull(), F.array(one)).otherwise(F.col("ids")))
    return rows.withColumn("route", F.when(F.size("ids") == 0, "error").when(F.size("ids") == 1, "lookup").otherwise("bulk"))


def answer_events(submits: DataFrame) -> DataFrame:
    """Submitted answers (set_id, card_id, given, expected, ts) as progress events."""
    from lexiquarry.functions.python import check_answer

    checked = submits.withColumn("_c", check_answer(F.col("given"), F.col("expected")))
    return checked.select("set_id", "card_id", F.col("_c.correct").alias("correct"), F.col("_c.close").alias("close"), "ts")
