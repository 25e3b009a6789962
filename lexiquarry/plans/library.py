"""Queries over progress, sync and the stored library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.operators import library as L
from lexiquarry.operators import progress as P
from lexiquarry.operators import sync as S
from lexiquarry.plans.registry import query, read

_EVENTS = "SELECT user_id, event_id, epoch_us(ts) AS t, event_type = 'purchase' AS ok FROM events WHERE event_type IN ('purchase', 'error')"
_BOX = f"""
    WITH e AS ({_EVENTS}), r AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM e),
    s AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY t, event_id) AS streak,
          row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS back, count(*) OVER (PARTITION BY user_id) AS seen,
          sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS correct FROM r),
    boxes AS (SELECT user_id, least(3, 1 + streak)::INTEGER AS box, seen, correct::BIGINT AS correct, (seen - correct)::BIGINT AS wrong, t AS last FROM s WHERE back = 1)
"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return rows.select("user_id", "event_id", at.alias("at"), (F.col("event_type") == "purchase").alias("correct"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.boxes(_answers(spark, sf_dir), ["user_id"], ts="at", tie="event_id")


@query(_BOX + "SELECT user_id, box, seen, correct, wrong, last FROM boxes")
def mastery_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir)


@query(_BOX + "SELECT event_id, least(3, 1 + streak)::INTEGER AS box FROM s")
def mastery_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.trajectory(_answers(spark, sf_dir), ["user_id"], ["at", "event_id"]).select("event_id", "box")


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("nation"))


@query(_BOX + "SELECT c_nationkey AS nation, floor(sum(coalesce(box, 0)) / (count(*) * 3) * 100 + 0.5)::BIGINT AS percent FROM customer LEFT JOIN boxes ON user_id = c_custkey GROUP BY 1")
def mastery_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.mastery_percent(_cards(spark, sf_dir), _boxes(spark, sf_dir), ["user_id"], ["nation"])


@query(_BOX + "SELECT c_custkey AS user_id, coalesce(box, 0) AS box FROM customer LEFT JOIN boxes ON user_id = c_custkey WHERE coalesce(box, 0) < 3")
def weak_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.weak_cards(_cards(spark, sf_dir), _boxes(spark, sf_dir), ["user_id"]).select("user_id", "box")


@query("SELECT user_id, count(*) % 2 = 1 AS starred, max(epoch_us(ts)) AS last FROM events WHERE event_type = 'click' GROUP BY user_id")
def star_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return P.stars(rows, ["user_id"], ts="at")


@query("SELECT o_custkey AS round, o_orderkey AS pair, NOT (o_orderpriority LIKE '1%') AS correct FROM orders")
def match_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("round"), F.col("o_orderkey").alias("pair"), "o_orderpriority")
    missed = pairs.where("o_orderpriority like '1%'")
    return P.match_answers(pairs.drop("o_orderpriority"), missed, ["pair"]).select("round", "pair", "correct")


#: Local sets, tombstones and remote rows made of orders by their keys; the oracles spell the same rules out.
_LOCAL = "SELECT 'set-' || o_orderkey AS id, o_orderpriority AS title, o_orderstatus AS markdown, o_orderkey AS created_at, o_orderkey + (o_orderkey * 7) % 50 AS updated_at FROM orders WHERE o_orderkey % 4 < 3"
_TOMBS = "SELECT 'set-' || o_orderkey AS id, o_orderkey + (o_orderkey * 3) % 40 AS deleted_at FROM orders WHERE o_orderkey % 4 = 3 AND o_orderkey % 3 = 0"
_REMOTE = """SELECT 'set-' || o_orderkey AS id, o_orderstatus AS title, o_orderpriority AS markdown, o_orderkey AS created_at, o_orderkey + (o_orderkey * 11) % 60 AS updated_at,
    o_orderkey % 5 = 0 AS deleted, CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey + (o_orderkey * 13) % 70 END AS deleted_at FROM orders WHERE o_orderkey % 7 <> 0"""


def _views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    orders = read(spark, sf_dir, "orders")
    return tuple(spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=orders) for sql in (_LOCAL, _TOMBS, _REMOTE))


@query(f"""
    WITH l AS ({_LOCAL}), t AS ({_TOMBS}), r AS ({_REMOTE}),
    j AS (SELECT coalesce(l.id, t.id, r.id) AS id, l.id IS NOT NULL AS here, l.title AS lt, l.markdown AS lm, l.updated_at AS lu, coalesce(t.deleted_at, 0) AS tomb,
        r.id IS NOT NULL AS heard, coalesce(r.deleted, FALSE) AS gone, coalesce(r.deleted_at, r.updated_at) AS gone_at, r.title AS rt, r.markdown AS rm, r.updated_at AS ru
        FROM l FULL OUTER JOIN t ON l.id = t.id FULL OUTER JOIN r ON r.id = coalesce(l.id, t.id)),
    o AS (SELECT *, CASE WHEN NOT heard THEN 'kept'
        WHEN gone THEN CASE WHEN here AND lu > gone_at THEN 'kept' WHEN here THEN 'dropped' WHEN tomb < gone_at THEN 'raised' ELSE 'ignored' END
        WHEN here THEN CASE WHEN ru > lu THEN 'replaced' ELSE 'kept' END WHEN tomb >= ru THEN 'ignored' ELSE 'inserted' END AS outcome FROM j)
    SELECT id, outcome, CASE WHEN outcome = 'dropped' THEN FALSE ELSE here OR outcome IN ('replaced', 'inserted') END AS alive,
        CASE WHEN outcome IN ('replaced', 'inserted') THEN rt WHEN here AND outcome <> 'dropped' THEN lt END AS title,
        CASE WHEN outcome IN ('replaced', 'inserted') THEN ru WHEN here AND outcome <> 'dropped' THEN lu END AS updated_at,
        CASE WHEN outcome = 'inserted' THEN NULL WHEN outcome IN ('dropped', 'raised') THEN greatest(tomb, gone_at) WHEN tomb > 0 THEN tomb END AS deleted_at FROM o
""")
def merge_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_sets(*_views(spark, sf_dir)).select("id", "outcome", "alive", "title", "updated_at", "deleted_at")


@query(f"""
    WITH l AS ({_LOCAL}), t AS ({_TOMBS}), r AS ({_REMOTE}), m AS (SELECT id, deleted AS gone, updated_at AS there, coalesce(deleted_at, updated_at) AS gone_at FROM r)
    SELECT CASE WHEN length(l.markdown) > 600000 THEN 'oversized' ELSE 'set' END AS kind, l.id, l.updated_at AS stamp FROM l LEFT JOIN m ON l.id = m.id
    WHERE l.updated_at > coalesce(CASE WHEN gone THEN gone_at ELSE there END, -1)
    UNION ALL SELECT 'tombstone', t.id, t.deleted_at FROM t LEFT JOIN m ON t.id = m.id
    WHERE t.id NOT IN (SELECT id FROM l) AND NOT coalesce(gone, FALSE) AND NOT coalesce(there > t.deleted_at, FALSE)
""")
def plan_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, tombs, remote = _views(spark, sf_dir)
    return S.plan_push(local, tombs, remote)


_SIDE = "SELECT l_orderkey AS set_id, l_linenumber AS card_id, l_partkey % 4 AS box, l_suppkey AS seen, l_partkey AS correct, 0 AS wrong, l_linestatus = 'O' AS starred, {0} AS last FROM lineitem WHERE l_linenumber {1}"
_MINE, _THEIRS = _SIDE.format("l_partkey % 97", "<= 5"), _SIDE.format("l_suppkey % 89", ">= 3")


@query(f"""
    WITH l AS ({_MINE}), r AS ({_THEIRS})
    SELECT coalesce(l.set_id, r.set_id) AS set_id, coalesce(l.card_id, r.card_id) AS card_id, CASE WHEN l.set_id IS NULL OR r.last > l.last THEN r.last ELSE l.last END AS last,
        CASE WHEN l.set_id IS NULL OR r.last > l.last THEN r.box ELSE l.box END AS box FROM l FULL OUTER JOIN r ON l.set_id = r.set_id AND l.card_id = r.card_id
""")
def merge_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    mine, theirs = (spark.sql(q.replace("FROM lineitem", "FROM {items}"), items=items) for q in (_MINE, _THEIRS))
    return S.merge_cards(mine, theirs).select("set_id", "card_id", "last", "box")


@query("SELECT l_orderkey AS set_id, max(l_partkey % 97) AS stamp FROM lineitem WHERE l_linenumber <= 5 AND l_orderkey % 2 = 0 GROUP BY 1 HAVING max(l_partkey % 97) > coalesce(CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey % 90 END, -1)")
def plan_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    cards = spark.sql(_MINE.replace("FROM lineitem", "FROM {items}"), items=items)
    ids = items.select("l_orderkey").distinct()
    index = ids.where("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("set_id"), (F.col("l_orderkey") % 90).alias("updated_at"))
    return S.plan_progress(cards, ids.where("l_orderkey % 2 = 0").withColumnRenamed("l_orderkey", "id"), index)


@query("SELECT c_custkey AS id, left(c_name || repeat('x', 300), 240) AS title, c_mktsegment AS markdown, round(c_acctbal * 10 + 10000)::BIGINT AS created_at, c_custkey AS updated_at FROM customer")
def remote_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_name", F.repeat(F.lit("x"), 300)).alias("title"), F.col("c_mktsegment").alias("markdown"), (F.col("c_acctbal") * 10 + 10000).alias("created_at"), F.col("c_custkey").alias("updated_at"))
    return S.to_remote(rows)


@query("""
    SELECT 'set-' || o_orderkey AS id, array_to_string(list_filter([CASE WHEN length(o_orderpriority) > 240 OR o_orderpriority = '' THEN 'title' END,
        CASE WHEN o_orderkey + (o_orderkey * 11) % 60 - 5 < o_orderkey THEN 'updated_at' END,
        CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 9 = 0 THEN 'tombstone' END], lambda x: x IS NOT NULL), ',') AS violations FROM orders
""")
def sink_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(F.concat(F.lit("set-"), k).alias("id"), F.col("o_orderpriority").alias("title"), F.lit("text").alias("markdown"), k.alias("created_at"), (k + (k * 11) % 60 - 5).alias("updated_at"), (k % 5 == 0).alias("deleted"), F.when((k % 9 == 0) & (k % 5 != 0), k).alias("deleted_at"))
    return S.violations(rows).select("id", F.array_join("violations", ",").alias("violations"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END AS title FROM part UNION ALL SELECT 100000000 + s_suppkey, s_name FROM supplier")
def upsert_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, new = read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier")
    sets = part.select(F.col("p_partkey").cast("long").alias("id"), F.col("p_type").alias("title"))
    changed = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_brand").alias("title"))
    changed = changed.unionByName(new.select((F.lit(100000000) + F.col("s_suppkey")).alias("id"), F.col("s_name").alias("title")))
    return L.upsert(sets, changed)


@query("SELECT 'sets' AS kind, c_custkey AS id FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'tombstones', c_custkey FROM customer WHERE c_nationkey = 3 OR c_custkey % 100 = 0")
def delete_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    old = c.where("id % 100 = 0").select("id", F.lit(1).cast("long").alias("deleted_at"))
    sets, _, tombs = L.delete(c.select("id"), c.select(F.col("id").alias("set_id")), old, c.where("c_nationkey = 3"), 99)
    return sets.select(F.lit("sets").alias("kind"), "id").unionByName(tombs.select(F.lit("tombstones").alias("kind"), "id"))


@query("SELECT 'Part ' || p_partkey AS title, p_type AS markdown FROM part")
def export_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("Part "), "p_partkey").alias("title"), F.col("p_type").alias("markdown"), F.lit(5).alias("updated_at"))
    return L.parse_exports(L.export_json(part))[0]


@query("SELECT p_partkey AS id FROM part p WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 50 NOT IN (SELECT p_partkey % 50 FROM part WHERE p_partkey % 97 = 0 AND p_partkey < 1000)")
def install_bundled(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("m"), F.col("p_partkey") % 50).alias("markdown"))
    by_text = part.where("id % 97 = 0 and id < 1000").select((F.col("id") + 10**8).alias("id"), "markdown")
    sets = part.where("id % 7 = 0").select("id", F.concat("markdown", F.lit(" changed")).alias("markdown")).unionByName(by_text)
    return L.install_bundled(part, sets, part.where("id % 5 = 0")).select("id")


@query("SELECT c_nationkey AS nation, median(c_acctbal) AS middle FROM customer GROUP BY 1")
def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.coalesce(F.median("c_acctbal"), F.lit(0.0)).alias("middle"))


@query("SELECT count(*) FILTER (WHERE c_custkey % 3 = 0) AS papers, count(*) FILTER (WHERE c_custkey % 3 <> 0) AS notes FROM customer")
def library_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.when(F.col("c_custkey") % 3 == 0, "paper-").otherwise("note-")
    return L.counts(read(spark, sf_dir, "customer").select(F.concat(prefix, "c_custkey").alias("id")))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'missing-email' WHEN c_custkey % 3 <> 0 THEN 'unverified-email' END AS problem FROM customer")
def account_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiquarry.functions import text as T

    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("id"), T.account_problem(F.when(k % 4 == 0, " ").otherwise(F.col("c_name")), k % 3 == 0).alias("problem"))


@query("SELECT e.user_id, CASE WHEN min(v) > 0 THEN min(v) END AS best FROM (SELECT user_id, CASE WHEN value > 0 THEN value END AS v FROM events) e GROUP BY 1")
def best_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", P.best_time(F.col("value"), F.lit(None).cast("double")).alias("v"))
    return rows.groupBy("user_id").agg(F.min("v").alias("best"))
