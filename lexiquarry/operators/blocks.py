"""The flat block table that study and reading views are derived from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.functions import markdown
from lexiquarry.functions import text as T


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Columns that are computed once a row: filters go below a projection with copies of what they test, and below each
    other, but not below a generator."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def parse_documents(df: DataFrame, id_col: str = "doc_id", markdown_col: str = "markdown") -> DataFrame:
    """(doc_id, title, meta, blocks): parsed once; everything else is a view of it."""
    return df.select(F.col(id_col).alias("doc_id"), markdown.parsed(F.col(markdown_col)).alias("d")).select("doc_id", "d.*")


def block_table(parsed: DataFrame) -> DataFrame:
    """One row a block: doc_id, pos, the block's columns, and the section it is in by both rules.

    ``section`` follows headings of any level wherever they are, ``part`` those of level 3 or less at the top.
    """
    rows = parsed.select("doc_id", F.posexplode("blocks").alias("pos", "b")).select("doc_id", "pos", "b.*")
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("kind") == "heading"
    carried = lambda test: F.coalesce(F.last(F.when(test, F.col("text")), ignorenulls=True).over(w), F.lit("Overview"))
    return rows.withColumns({"section": carried(heading & (F.col("text") != "")), "part": carried(heading & (F.col("depth") <= 3) & (F.size("path") == 1))})


def units(blocks: DataFrame) -> DataFrame:
    """Paragraphs and list items, also those in quotes, in order."""
    return blocks.where(F.col("kind").isin("para", "item")).select("doc_id", "pos", "text", "inlines", "section", (F.col("kind") == "item").alias("is_item"))


def outline(blocks: DataFrame) -> DataFrame:
    return blocks.where((F.col("kind") == "heading") & (F.col("depth") <= 3) & (F.size("path") == 1)).select("doc_id", "pos", F.col("slug").alias("id"), F.col("text").alias("title"), "depth")


def document_words(blocks: DataFrame) -> DataFrame:
    """Words of headings, paragraphs, list items and tables; code and rules have none."""
    counted = blocks.where(F.col("kind").isin("heading", "para", "item", "table"))
    return counted.groupBy("doc_id").agg(F.sum(T.word_count(F.col("text"))).alias("words"))


def unique_slugs(headings: DataFrame, key: str = "doc_id", order: str = "pos", text: str = "text") -> DataFrame:
    """Adds slug: the n-th repeat of one in a document gets -n."""
    base = headings.withColumn("_base", T.slug_base(F.col(text)))
    n = F.row_number().over(Window.partitionBy(key, "_base").orderBy(order)) - 1
    return base.withColumn("slug", F.when(n == 0, F.col("_base")).otherwise(F.concat_ws("-", "_base", n))).drop("_base")


def speakable(blocks: DataFrame) -> DataFrame:
    """(doc_id, block, n, text): what is read aloud, by top-level block; code and rules are silent."""
    cell = lambda r, i: F.coalesce(F.try_element_at(r, F.lit(i)), F.lit(""))
    two = F.transform("rows", lambda r: F.when((cell(r, 1) != "") & (cell(r, 2) != ""), F.concat(cell(r, 1), F.lit(": "), cell(r, 2), F.lit("."))).when(cell(r, 1) != "", F.concat(cell(r, 1), F.lit("."))))
    many = F.transform("rows", lambda r: F.concat(F.array_join(F.filter(r, lambda x: x != ""), ", "), F.lit(".")))
    table = F.array_join(F.filter(F.when(F.size("header") == 2, two).otherwise(many), lambda x: x.isNotNull()), " ")
    said = F.when(F.col("kind") == "heading", F.array(F.trim("text"))).when(F.col("kind").isin("para", "item"), T.speech_sentences(F.col("text"))).when(F.col("kind") == "table", T.speech_sentences(table))
    rows = blocks.where(said.isNotNull()).select("doc_id", "pos", F.col("path")[0].alias("block"), F.posexplode(said).alias("n", "text"))
    return rows.where("text <> ''")
