"""Two-way sync: last-writer-wins merges with tombstones, per-card merges, and what is to be pushed.

Tables. sets: (id, title, markdown, created_at, updated_at); tombstones: (id, deleted_at); remote: a set's columns and
(deleted, deleted_at), one row an id: ``latest`` reduces a batch that repeats ids. All comparisons are strict, so a
replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_TITLE, MAX_MARKDOWN = 240, 600_000
SET = ("title", "markdown", "created_at", "updated_at")
ID_PATTERN = r"^[A-Za-z0-9_-]{1,120}$"


def tombstone_time(deleted_at: Column, updated_at: Column) -> Column:
    return F.coalesce(deleted_at, updated_at)


def sanitize_sets(raw: DataFrame) -> DataFrame:
    """Rows with an id and a text; blank titles get the fixed one, missing times are 0."""
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled set"))
    kept = raw.where(F.col("id").isNotNull() & F.col("markdown").isNotNull())
    return kept.withColumns({"title": title, "created_at": F.coalesce("created_at", F.lit(0)), "updated_at": F.coalesce("updated_at", F.lit(0))})


def sanitize_card(box: Column, seen: Column, correct: Column, wrong: Column, starred: Column, last: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0))
    safe = F.coalesce(F.when(box.between(0, 3), F.floor(box + 0.5).cast("int")), F.lit(0))
    return F.struct(safe.alias("box"), zero(seen).alias("seen"), zero(correct).alias("correct"), zero(wrong).alias("wrong"), F.coalesce(starred, F.lit(False)).alias("starred"), zero(last).alias("last"))


def latest(remote: DataFrame) -> DataFrame:
    """One row an id: that of the latest time; a tombstone before a live row of the same time."""
    when = F.when(F.col("deleted"), tombstone_time(F.col("deleted_at"), F.col("updated_at"))).otherwise(F.col("updated_at"))
    names = [c for c in remote.columns if c != "id"]
    return remote.groupBy("id").agg(F.max_by(F.struct(*names), F.struct(when.alias("t"), F.col("deleted").alias("d"))).alias("_r")).select("id", "_r.*")


def merge_sets(sets: DataFrame, tombstones: DataFrame, remote: DataFrame) -> DataFrame:
    """Folds remote rows into local ones. One row for each id that is known: alive, the set's columns, deleted_at
    (the tombstone that is left), outcome: kept, replaced, inserted, dropped, raised or ignored."""
    local = sets.select("id", F.struct(*SET).alias("l"))
    far = remote.select("id", F.struct(*SET).alias("r"), F.coalesce("deleted", F.lit(False)).alias("gone"), tombstone_time(F.col("deleted_at"), F.col("updated_at")).alias("gone_at"), F.lit(True).alias("heard"))
    all_ = local.join(tombstones.select("id", F.col("deleted_at").alias("tomb")), "id", "full_outer").join(far, "id", "full_outer")
    here, heard, gone = F.col("l").isNotNull(), F.coalesce("heard", F.lit(False)), F.coalesce("gone", F.lit(False))
    tomb, mine, theirs = F.coalesce("tomb", F.lit(0)), F.col("l.updated_at"), F.coalesce(F.col("r.updated_at"), F.lit(0))
    readable = F.col("r.markdown").isNotNull()
    outcome = (
        F.when(~heard, "kept")
        .when(gone & here & (mine > F.col("gone_at")), "kept")
        .when(gone & here, "dropped")
        .when(gone & (tomb < F.col("gone_at")), "raised")
        .when(gone | ~readable, "ignored")
        .when(here, F.when(theirs > mine, "replaced").otherwise("kept"))
        .otherwise(F.when(tomb >= theirs, "ignored").otherwise("inserted"))
    )
    out = all_.withColumn("outcome", outcome)
    arrived = F.col("outcome").isin("replaced", "inserted")
    alive = F.when(F.col("outcome") == "dropped", False).otherwise(here | arrived)
    left = F.when(F.col("outcome") == "inserted", None).when(F.col("outcome").isin("dropped", "raised"), F.greatest(tomb, "gone_at")).otherwise(F.nullif(tomb, F.lit(0)))
    row = F.when(~alive, None).when(arrived, F.col("r")).otherwise(F.col("l"))
    return out.select("id", alive.alias("alive"), row.alias("s"), left.alias("deleted_at"), "outcome").select("id", "alive", *(F.col(f"s.{c}").alias(c) for c in SET), "deleted_at", "outcome")


def merge_cards(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(set_id, card_id, box, seen, correct, wrong, starred, last) of both sides: the later touch wins, ours if equal."""
    keys, names = ["set_id", "card_id"], ["box", "seen", "correct", "wrong", "starred", "last"]
    both = local.select(*keys, F.struct(*names).alias("l")).join(remote.select(*keys, F.struct(*names).alias("r")), keys, "full_outer")
    won = F.when(F.col("l").isNull() | (F.col("r.last") > F.col("l.last")), F.col("r")).otherwise(F.col("l"))
    return both.select(*keys, won.alias("c")).select(*keys, *(F.col(f"c.{n}").alias(n) for n in names))


def live_only(progress: DataFrame, sets: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Remote progress without that of sets that are tombstoned and absent."""
    dead = tombstones.select(F.col("id").alias("set_id")).join(sets.select(F.col("id").alias("set_id")), "set_id", "left_anti")
    return progress.join(dead, "set_id", "left_anti")


def plan_push(sets: DataFrame, tombstones: DataFrame, index: DataFrame) -> DataFrame:
    """What local state is strictly newer than the remote index (id, created_at, updated_at, deleted, deleted_at):
    rows of (kind, id, stamp), kind being set, oversized or tombstone."""
    meta = index.select("id", F.coalesce("deleted", F.lit(False)).alias("gone"), F.col("updated_at").alias("there"), tombstone_time(F.col("deleted_at"), F.col("updated_at")).alias("gone_at"))
    known = F.coalesce(F.when(F.col("gone"), F.col("gone_at")).otherwise(F.col("there")), F.lit(-1))
    up = sets.join(meta, "id", "left").where(F.col("updated_at") > known)
    units = F.octet_length(F.encode("markdown", "UTF-16BE")) / 2
    kind = F.when(units > MAX_MARKDOWN, "oversized").otherwise("set")
    up = up.select(kind.alias("kind"), "id", F.col("updated_at").alias("stamp"))
    down = tombstones.join(sets.select("id"), "id", "left_anti").join(meta, "id", "left")
    down = down.where(~F.coalesce("gone", F.lit(False)) & ~F.coalesce(F.col("there") > F.col("deleted_at"), F.lit(False)))
    return up.unionByName(down.select(F.lit("tombstone").alias("kind"), "id", F.col("deleted_at").alias("stamp")))


def plan_progress(cards: DataFrame, sets: DataFrame, index: DataFrame) -> DataFrame:
    """(set_id, stamp) of live sets' progress that is newer than the remote's (set_id, updated_at)."""
    own = cards.groupBy("set_id").agg(F.coalesce(F.max("last"), F.lit(0)).alias("stamp"))
    live = own.join(sets.select(F.col("id").alias("set_id")), "set_id", "left_semi")
    seen = index.select("set_id", F.col("updated_at").alias("there"))
    return live.join(seen, "set_id", "left").where(F.col("stamp") > F.coalesce("there", F.lit(-1))).select("set_id", "stamp")


def to_remote(sets: DataFrame) -> DataFrame:
    whole = lambda c: F.round(c).cast("long").alias(c)
    return sets.select("id", F.substring("title", 1, MAX_TITLE).alias("title"), "markdown", whole("created_at"), whole("updated_at"))


def tombstones_to_remote(tombstones: DataFrame) -> DataFrame:
    """(id, deleted_at, created_at) as remote rows."""
    at = F.round("deleted_at").cast("long")
    return tombstones.select("id", F.lit("Deleted set").alias("title"), F.lit("").alias("markdown"), F.round("created_at").cast("long").alias("created_at"), at.alias("updated_at"), F.lit(True).alias("deleted"), at.alias("deleted_at"))


def violations(new: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Adds an array of what a remote set row breaks: shape, sizes, and its history if the old rows are given."""
    gone = F.coalesce("deleted", F.lit(False))
    rules = [
        ("id", ~F.coalesce(F.col("id").rlike(ID_PATTERN), F.lit(False))),
        ("title", ~F.coalesce(F.length("title").between(1, MAX_TITLE), F.lit(False))),
        ("markdown", ~F.coalesce(F.length("markdown") <= MAX_MARKDOWN, F.lit(False))),
        ("created_at", F.col("created_at").isNull() | (F.col("created_at") < 0)),
        ("updated_at", F.col("updated_at").isNull() | (F.col("updated_at") < F.col("created_at"))),
        ("tombstone", gone & (F.col("deleted_at").isNull() | (F.col("markdown") != "")) | ~gone & F.col("deleted_at").isNotNull()),
    ]
    rows = new
    if old is not None:
        rows = new.join(old.select("id", F.col("created_at").alias("_c"), F.col("updated_at").alias("_u")), "id", "left")
        rules += [("created_at changes", F.coalesce(F.col("_c") != F.col("created_at"), F.lit(False))), ("updated_at goes back", F.coalesce(F.col("_u") > F.col("updated_at"), F.lit(False)))]
    out = rows.withColumn("violations", F.filter(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules)), lambda v: v.isNotNull()))
    return out.drop("_c", "_u")


def progress_violations(rows: DataFrame) -> DataFrame:
    best = F.col("best_match_ms")
    return rows.withColumn("violations", F.filter(F.array(F.when(F.col("set_id").isNull(), F.lit("set_id")), F.when(best.isNotNull() & (best <= 0), F.lit("best_match_ms"))), lambda v: v.isNotNull()))


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
