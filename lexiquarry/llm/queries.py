"""The registered queries of the training-data operators: each derives its digest columns from the operator's output."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm import fingerprints, knn, langid, mixing, packing, passages, pii, simhash, substrings, toxicity
from lexiquarry.llm.common import table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"), reported=substrings.REPORTED)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")


def op4_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_prefix_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def _listed(kind: str, span: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), span["start"], span["end"])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    lists = [F.transform(kind, partial(_listed, kind)) for kind in (*pii.KINDS, "term")]
    return found.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in pii.KINDS),
        F.sha2(F.array_join(F.concat(*lists[:-1]), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*lists), ",").alias("spans"),
        F.size("term").cast("long").alias("n_term"),
        sum((F.size(kind) for kind in (*pii.KINDS, "term")), F.lit(0)).cast("long").alias("n_spans"),
    )


def op5_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.search(table(spark, sf_dir, "embeddings"))


def op6_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_language, op2_toxicity, op3_suffix_arrays, op4_simhash_golay, op5_voronoi_knn, op6_best_two_fit, op7_suffix_trees, op8_prefix_hashes, op9_pii, op10_sainte_lague)}
ORACLE_SQL: dict[str, str] = {
    "op5_voronoi_knn": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
        ), s AS (
            SELECT q.vec_id AS query_id, o.vec_id, list_inner_product(q.e, o.e)::BIGINT AS score
            FROM v q JOIN v o ON q.vec_id % 20 = 0 AND o.vec_id <> q.vec_id
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op7_suffix_trees": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), p AS (
            SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM d
        ), k AS (
            SELECT *, CASE WHEN i + 12 <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) END AS win FROM p
        ), f AS (
            SELECT doc_id, word, i, CASE WHEN win IS NOT NULL AND min(doc_id) OVER (PARTITION BY win) < doc_id THEN 1 ELSE 0 END AS dup FROM k
        ), c AS (
            SELECT doc_id, word, i, max(dup) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM f
        ), g AS (
            SELECT doc_id, sum(gone)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM c GROUP BY doc_id
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
    """,
}
