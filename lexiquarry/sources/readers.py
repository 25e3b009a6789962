"""Readers: every source is a DataFrame with one row a file, item or span; what can't be read is a row that says so."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.functions import articles
from lexiquarry.functions import text as T
from lexiquarry.functions.markdown import parsed

LIST_FILES = "*.{docx,txt,md,markdown,csv,tsv,nbib,ris,json}"


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, markdown): one row a file; the title is the front matter's, the first heading's, or a fixed one."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.{md,markdown,txt}").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("markdown"))
    title = F.coalesce(F.nullif(F.trim(parsed(F.col("markdown"))["title"]), F.lit("")), F.lit("Untitled set"))
    return rows.select("path", title.alias("title"), "markdown")


def dropped_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error): files as text; one that isn't UTF-8 is an error row, not a failure."""
    rows = spark.read.format("binaryFile").load(path)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return rows.select("path", text.alias("text"), F.when(text.isNull(), "not readable as text").alias("error"))


def json_exports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Exported sets and the files that aren't one."""
    from lexiquarry.operators.library import parse_exports

    return parse_exports(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json")))


def account_library(spark: SparkSession, path: str, uid: str) -> DataFrame:
    """One account's part of a library that is stored by account: only its partition is read."""
    return spark.read.parquet(path).where(F.col("uid") == F.url_encode(F.lit(uid)))


def has_account(spark: SparkSession, path: str, uid: str) -> bool:
    return not account_library(spark, path, uid).isEmpty()


def zip_member(data: bytes, wanted: str) -> bytes | None:
    """A member that is stored or deflated; None if there is none, or the archive is broken."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            info = z.getinfo(wanted)
            return z.read(info) if info.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) else None
    except (zipfile.BadZipFile, KeyError, EOFError, OSError, RuntimeError):
        return None


def docx_lines(xml: str) -> list[str]:
    """A line for each paragraph with text."""
    found = re.findall(r"<w:p[ >].*?</w:p>", xml, re.S)
    lines = (articles.squeeze("".join(articles.decode(t) for t in re.findall(r"<w:t(?:\s[^>]*)?>([^<]*)</w:t>", re.sub(r"<w:(?:tab|br)\b[^>]*/>", "<w:t> </w:t>", p)))) for p in found)
    return [x for x in lines if x]


def reference_lists(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error) of reference lists: docx by its paragraphs, the other kinds as plain text."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = []
            for name, data in zip(rows["path"], rows["content"]):
                if name.lower().endswith(".docx"):
                    data = zip_member(data, "word/document.xml")
                    texts.append("\n".join(docx_lines(data.decode("utf-8", "replace"))) if data is not None else None)
                else:
                    texts.append(bytes(data).decode("utf-8", "replace"))
            yield pd.DataFrame({"path": rows["path"], "text": texts, "error": [None if t is not None else "no readable document" for t in texts]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", LIST_FILES).load(path).select("path", "content")
    return files.mapInPandas(read, "path string, text string, error string")


def article_files(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))
    return rows.select("path", articles.converted(F.col("xml")).alias("a")).select("path", "a.*")


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A constant relation, such as a bibliography or bundled documents."""
    return spark.createDataFrame(rows, schema)


def best_abstract(text):
    """The longest paragraph of over 180 characters that isn't a metadata label."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), T.squeeze), lambda p: (F.length(p) > 180) & ~p.rlike(r"(?i)^(author information|doi|pmid|pmcid|copyright|conflict of interest|comment)"))
    return F.aggregate(parts, F.lit(None).cast("string"), lambda a, p: F.when(a.isNull() | (F.length(p) > F.length(a)), p).otherwise(a))


def prefer(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Metadata of two sources: the first's columns, where null the second's."""
    names = [c for c in first.columns if c != key]
    both = first.alias("a").join(second.alias("b"), key, "full_outer")
    return both.select(key, *(F.coalesce(f"a.{n}", f"b.{n}").alias(n) if n in second.columns else F.col(f"a.{n}") for n in names))
