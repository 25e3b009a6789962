"""Queries over texts, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiquarry.functions import html, python
from lexiquarry.functions import text as T
from lexiquarry.plans.registry import query, read

_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> '')"
_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"
_NUMBER = T.MEASUREMENT.replace("'", "''")
_BARE = r"regexp_replace(regexp_replace(regexp_replace(text, '\b10\.\d{4,9}/\S+', ' ', 'g'), '(?i)\b(?:PMID|PMCID|PMC|DOI|ISBN|ISSN|accession(?: number)?)\s*:?\s*\S+', ' ', 'g'), 'https?://\S+', ' ', 'g')"
_FOUND = rf"list_filter(list_transform(regexp_extract_all({_BARE}, '{_NUMBER}'), lambda x: trim(x)), lambda x: NOT (regexp_full_match(x, '\d{{4}}') AND x > '1500' AND x < '2100'))"


@query(f"""
    SELECT doc_id, len({_SENTENCES})::BIGINT AS sentences, len({_WORDS.format('text')})::BIGINT AS words,
           greatest(1, floor(len({_WORDS.format('text')}) / 200 + 0.5))::BIGINT AS minutes
    FROM documents
""")
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.size(T.words(F.col("text"))).cast("long")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.size(T.study_sentences(F.col("text"))).cast("long").alias("sentences"), words.alias("words"))
    return docs.withColumn("minutes", F.greatest(F.lit(1), F.floor(F.col("words") / 200 + 0.5)).cast("long"))


@query(f"""
    SELECT doc_id, len({_FOUND})::BIGINT AS found, array_to_string({_FOUND}, '|') AS numbers
    FROM documents WHERE len({_FOUND}) > 0
""")
def sentence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.transform(F.regexp_extract_all(T.strip_identifiers(F.col("text")), F.lit(T.MEASUREMENT), F.lit(0)), lambda x: F.trim(x))
    kept = F.filter(kept, lambda x: ~(x.rlike(r"^\d{4}$") & (x > "1500") & (x < "2100")))
    docs = read(spark, sf_dir, "documents").withColumn("n", kept).where(F.size("n") > 0)
    return docs.select("doc_id", F.size("n").cast("long").alias("found"), F.array_join("n", "|").alias("numbers"))


_KEY = r"trim(regexp_replace(regexp_replace(translate(lower({0}), '" + T.ACCENTED + "', '" + T.PLAIN + r"'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_KEY.format('text')}) AS key_md5, md5(regexp_replace({_KEY.format('text')}, '^(a|an|the)\\s+', '')) AS answer_md5 FROM documents")
def normalized_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(T.normalize_key(F.col("text")).cast("binary")).alias("key_md5"), F.md5(T.normalize_answer(F.col("text")).cast("binary")).alias("answer_md5"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS key_md5 FROM documents")
def normalized_keys_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(python.normalize_key(F.col("text")).cast("binary")).alias("key_md5"))


_DEDUP = "row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id)"


@query(f"SELECT doc_id, copies FROM (SELECT doc_id, {_DEDUP} AS n, count(*) OVER (PARTITION BY md5(text)) AS copies FROM documents) WHERE n = 1")
def identity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.groupBy(F.md5(F.col("text").cast("binary")).alias("identity")).agg(F.min_by("doc_id", F.struct((-F.col("n_chars")).alias("l"), "doc_id")).alias("doc_id"), F.count("*").alias("copies")).drop("identity")


@query(r"""
    SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'),
        '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages
""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query(r"""
    SELECT page_id, regexp_matches(html, '(?i)</?(?:h[1-6]|p|br|div|ul|ol|li|blockquote|b|i|em|strong|sup|sub|code|a|span|abbr|small|u)\b[^>]*>') AS is_html,
        regexp_matches(html, '(?i)</?(?:h[1-6]|p|br|div|ul|ol|li|blockquote|table|tr|td|th|section|article)\b[^>]*>') AS has_blocks,
        coalesce(list_min(list_transform(regexp_extract_all(html, '(?i)<h([1-6])\b', 1), lambda x: x::INTEGER)) - 2, 0)::INTEGER AS shift FROM pages
""")
def html_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return read(spark, sf_dir, "pages").select("page_id", T.looks_like_html(h).alias("is_html"), T.has_block_html(h).alias("has_blocks"), T.heading_shift(h).alias("shift"))


@query()
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", html.html_to_markdown(F.col("html")).alias("markdown"))


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n, len(string_split(text, chr(10))) AS total FROM documents"


@query(f"""
    WITH l AS ({_LINES}), k AS (
        SELECT doc_id, n, regexp_replace(lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))), '\\d+', '#', 'g') AS key, total,
               length(trim(regexp_replace(line, '\\s+', ' ', 'g'))) AS size FROM l
    ), f AS (SELECT key, count(*) AS n FROM k WHERE size BETWEEN 4 AND 120 AND (n <= 2 OR n > total - 2) GROUP BY key HAVING count(*) >= 3)
    SELECT key, n FROM f
""")
def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select(F.split("text", "\n").alias("l")).select(F.size("l").alias("total"), F.posexplode("l").alias("n", "line"))
    edge = lines.where((F.col("n") < 2) | (F.col("n") >= F.col("total") - 2)).select(T.normalize_running(F.col("line")).alias("key")).where("key is not null")
    return edge.groupBy("key").agg(F.count("*").alias("n")).where("n >= 3")


@query(f"""
    WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents)
    SELECT doc_id, array_to_string(list_slice(s, 1, 2), ' ') AS gist FROM s
""")
def skim_gist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(T.study_sentences(F.col("text")), 1, 2), " ").alias("gist"))


_CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"""
    WITH c AS (SELECT doc_id, {_CLEAN} AS t, left({_CLEAN}, 421) AS clip FROM documents), p AS (
        SELECT *, greatest(CASE WHEN instr(reverse(clip), ' .') > 0 THEN length(clip) - instr(reverse(clip), ' .') - 1 ELSE -1 END,
            CASE WHEN instr(reverse(clip), ' ?') > 0 THEN length(clip) - instr(reverse(clip), ' ?') - 1 ELSE -1 END,
            CASE WHEN instr(reverse(clip), ' !') > 0 THEN length(clip) - instr(reverse(clip), ' !') - 1 ELSE -1 END) AS stop,
            CASE WHEN instr(reverse(clip), ' ') > 0 THEN length(clip) - instr(reverse(clip), ' ') ELSE -1 END AS blank FROM c
    )
    SELECT doc_id, CASE WHEN length(t) <= 420 THEN t ELSE trim(left(clip, greatest(1, CASE WHEN stop >= 231 THEN stop + 1 ELSE blank END)::INTEGER)) || '…' END AS short FROM p
""")
def concise_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.concise(F.col("text")).alias("short"))


@query(r"""
    SELECT doc_id, len(string_split(lower(text), 'the')) - 1 AS hits, instr(lower(text), 'the') - 1 AS first_at FROM documents WHERE contains(lower(text), 'the')
""")
def text_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").where(F.lower("text").contains("the"))
    hits = F.size(F.split(F.lower("text"), "the", -1)) - 1
    return docs.select("doc_id", hits.cast("long").alias("hits"), T.match_ranges(F.col("text"), F.lit("the"), 1)[0]["s"].cast("long").alias("first_at"))


@query(r"""
    WITH t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, text AS question, next_text AS answer FROM t WHERE role = 'user' AND next_role = 'assistant'
""")
def conversation_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)})
    return rows.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), F.col("next_text").alias("answer"))


@query(r"""
    SELECT doc_id, to_base(list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT)),
        lambda h, c: (h * 33 + c) % 4294967296), 36) AS id FROM documents
""")
def hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.upper(python.hash_id(F.col("text"))).alias("id"))


@query(f"""
    WITH r AS (SELECT doc_id, source, lower(text) AS body FROM documents),
    h AS (SELECT doc_id, CASE WHEN source = 'src3' THEN 10 WHEN contains(body, 'src3') THEN 3 ELSE 0 END AS a, CASE WHEN source = 'the' THEN 10 WHEN contains(body, 'the') THEN 3 ELSE 0 END AS b FROM r)
    SELECT doc_id, a + b AS score FROM h WHERE a > 0 AND b > 0
""")
def library_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiquarry.operators import search

    none = F.lit(None).cast("string")
    docs = read(spark, sf_dir, "documents")
    papers = docs.select(F.col("doc_id").alias("id"), F.lit("").alias("title"), none.alias("authors"), F.col("source").alias("journal"), none.alias("year"), none.alias("pmid"), none.alias("pmcid"), none.alias("doi"), F.col("text").alias("body"))
    return search.search(papers, ["src3", "the"]).select(F.col("id").alias("doc_id"), "score")


@query()
def speech_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = T.speech_sentences(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(said).alias("n", "text"))


@query(r"""
    SELECT doc_id, (regexp_matches(trim(text), '[.!?]$') OR length(text) > 80 OR length(text) < 2) AS no_term, contains(text, '|') AS piped FROM documents
""")
def term_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    shape = F.trim(t).rlike(r"[.!?]$") | ~F.length(t).between(2, 80)
    return read(spark, sf_dir, "documents").select("doc_id", shape.alias("no_term"), t.contains("|").alias("piped"))
