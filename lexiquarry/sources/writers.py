"""Writers. Failures surface; nothing is swallowed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.functions import text as T
from lexiquarry.operators.library import export_json


def save_library(tables: dict[str, DataFrame], path: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def save_account(table: DataFrame, path: str) -> None:
    """Replaces only the partitions of the accounts (uid) in the table."""
    rows = table.withColumn("uid", F.url_encode("uid"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("uid").parquet(path)


def export_sets(sets: DataFrame, path: str) -> None:
    export_json(sets).select(F.col("json").alias("value")).write.mode("overwrite").text(path, lineSep="\n")


def file_name(title, extension: str = ".md"):
    """A file name of a title's slug, of 60 characters at most."""
    slug = F.regexp_replace(F.substring(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), 1, 60), "^-+|-+$", "")
    return F.concat(F.when(slug == "", "untitled").otherwise(slug), F.lit(extension))


def bibliography_text(rows: DataFrame) -> DataFrame:
    """One DOI a line, in order of pos."""
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "doi"))), lambda x: x["doi"]), "\n").alias("text"))


def download_names(sets: DataFrame) -> DataFrame:
    return sets.select("id", file_name(F.col("title")).alias("file"), T.strip_front_matter(F.col("markdown")).alias("body"))
