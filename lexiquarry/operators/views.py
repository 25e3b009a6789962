"""Reading views of a paper: claims, measurements and gists by SQL; floats by a fold over a document's blocks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.functions import text as T
from lexiquarry.functions.lazy import FEW, vectorised
from lexiquarry.operators import blocks as B

MAX_CLAIMS, MAX_NUMBERS, MAX_SKIM_NUMBERS = 40, 300, 8
AVAILABILITY = r"(?i)(data|code|software|materials?)\s+availability|availability of (data|code)|accession (codes?|numbers?)"
SUPPLEMENTS = r"(?i)^(supplementary|supporting)\s+(material|information|data|files?)$"
PROSE = ("para", "list", "quote")


def top(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.size("path") == 1)


def sentences(blocks: DataFrame) -> DataFrame:
    rows = top(blocks).where(F.col("kind").isin(*PROSE))
    return rows.select("doc_id", "pos", "part", F.posexplode(T.paper_sentences(F.col("text"))).alias("s", "sentence"))


def claims(rows: DataFrame, most: int = MAX_CLAIMS) -> DataFrame:
    """(doc_id, pos, s, part, sentence) to each document's strongest claims: by score, then place; each text once."""
    scored = B.once(rows, c=T.score_claim(F.col("sentence"), F.col("part"))).where("c is not null")
    best = scored.groupBy("doc_id", "sentence").agg(F.max_by(F.struct("part", "c", "pos", "s"), F.struct("c.score", (-F.col("pos")).alias("p"), (-F.col("s")).alias("q"))).alias("b"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos", "s"))
    flat = best.select("doc_id", F.col("sentence").alias("text"), F.col("b.part").alias("section"), "b.c.kind", "b.c.score", "b.c.trigger", "b.pos", "b.s")
    return flat.withColumn("rank", n).where(F.col("rank") <= most).drop("pos", "s")


def claim_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def numbers(rows: DataFrame, most: int = MAX_NUMBERS) -> DataFrame:
    """Measurements with their sentences: each value and start of a sentence once, the first ``most`` of a document."""
    each = rows.select("doc_id", "pos", "s", "part", "sentence", F.posexplode(T.find_numbers(F.col("sentence"))).alias("v", "value"))
    at = F.struct("pos", "s", "v")
    first = each.groupBy("doc_id", "value", F.substring("sentence", 1, 40).alias("start")).agg(F.min_by(F.struct("sentence", "part", "pos", "s", "v"), at).alias("f"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("f.pos", "f.s", "f.v"))
    return first.withColumn("n", n).where(F.col("n") <= most).select("doc_id", "n", "value", F.col("f.sentence").alias("text"), F.col("f.part").alias("section"))


def skim(blocks: DataFrame) -> DataFrame:
    """A row for each section: title, gist (two sentences of the first long paragraph), eight numbers, words."""
    rows = top(blocks)
    head = (F.col("kind") == "heading") & (F.col("depth") <= 3)
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sec", F.sum(head.cast("int")).over(w)).where("sec > 0")
    listed = F.col("part").rlike(SUPPLEMENTS) & (F.col("kind") == "list")
    body = F.col("kind").isin(*PROSE) & ~listed
    gist = F.when((F.col("kind") == "para") & (F.length("text") > 40), F.array_join(F.slice(T.paper_sentences(F.col("text")), 1, 2), " "))
    nums = F.array_sort(F.collect_list(F.when(body, F.struct("pos", T.find_numbers(F.col("text")).alias("v")))))
    out = rows.groupBy("doc_id", "sec").agg(
        F.min_by(F.struct(F.col("slug").alias("id"), F.col("text").alias("title"), "depth"), "pos").alias("h"),
        F.coalesce(F.min_by(gist, F.when(gist.isNotNull(), F.col("pos"))), F.lit("")).alias("gist"),
        F.slice(F.array_distinct(F.flatten(F.transform(nums, lambda x: x["v"]))), 1, MAX_SKIM_NUMBERS).alias("numbers"),
        F.coalesce(F.sum(F.when(body, T.word_count(F.col("text")))), F.lit(0)).alias("words"),
    )
    return out.where((F.col("gist") != "") | (F.size("numbers") > 0) | (F.col("words") > 0)).select("doc_id", "sec", "h.*", "gist", "numbers", "words")


def supplements(blocks: DataFrame, pmcid: DataFrame | None = None) -> DataFrame:
    """Items of lists in supplementary sections, as names, descriptions, files and addresses."""
    rows = blocks.where((F.col("kind") == "item") & F.trim("part").rlike(SUPPLEMENTS))
    rows = rows.join(pmcid, "doc_id", "left") if pmcid is not None else rows.withColumn("pmcid", F.lit(None).cast("string"))
    return rows.withColumn("x", T.supplement(F.col("text"), F.col("pmcid"))).where("x is not null").select("doc_id", "pos", "x.*")


def availability(blocks: DataFrame) -> DataFrame:
    rows = top(blocks).where(F.col("kind").isin("para", "list") & F.col("part").rlike(AVAILABILITY) & (F.col("text") != ""))
    return rows.select("doc_id", "pos", F.col("part").alias("title"), "text")


_LABEL = re.compile(r"(table|figure|fig\.?|scheme|box|equation|algorithm)\s*([0-9IVXivx]+[a-z]?)?\s*[.:—–-]?\s*(.*)$", re.I)
_NAMES = {"t": "Table", "f": "Figure", "e": "Equation"}
FLOAT = "struct<kind:string,label:string,caption:string,section:string,pos:int,code:string,image:string,link:string,note:string>"


def _label(text: str) -> tuple[str, str, str] | None:
    m = _LABEL.match(text.strip())
    name = _NAMES.get(m[1][0].lower()) if m else None
    return (name.lower(), " ".join(filter(None, (name, m[2]))), m[3].strip()) if name else None


def fold_floats(blocks) -> list[dict]:
    """Figures, tables and equations in order: content goes to the float heading (level 4 on) that is open."""
    found: list[dict] = []
    seen = {"table": 0, "equation": 0}
    section, open_ = "Overview", None

    def add(kind: str, pos: int, **more) -> dict:
        held = open_ if open_ and open_[0] == kind else None
        seen[kind] = seen.get(kind, 0) + 1
        row = dict.fromkeys(("code", "image", "link", "note")) | {"kind": kind, "label": held[1] if held else f"{kind.capitalize()} {seen[kind]}", "caption": held[2] if held else "", "section": section, "pos": pos}
        found.append(row | more)
        return found[-1]

    figure: dict | None = None
    for pos, b in enumerate(blocks):
        if len(b["path"]) > 1:
            continue
        kind, text = b["kind"], b["text"] or ""
        if kind == "heading":
            if b["depth"] >= 4:
                if label := _label(text):
                    open_ = label
                    figure = add("figure", pos) if label[0] == "figure" else figure
            else:
                section, open_ = text, None
        elif kind == "table":
            add("table", pos)
            open_ = None
        elif kind == "code" and (b["lang"] == "math" or (open_ and open_[0] == "equation")):
            add("equation", pos, code=text)
            open_ = None
        elif kind == "para" and open_ and open_[0] in ("figure", "table"):
            runs = list(b["inlines"])
            image, link = (next((r for r in runs if r["kind"] == k), None) for k in ("image", "link"))
            if open_[0] == "table":
                note = text.replace(link["text"], "", 1) if link else text
                add("table", pos, note=note.strip("_ \t\n"), link=link["href"] if link else None)
                open_ = None
                continue
            if image:
                figure["image"] = image["href"]
            elif link and not text.replace(link["text"], "", 1).strip():
                figure["link"] = link["href"]
            prose = "".join(r["text"] for r in runs if r["kind"] != "image").strip()
            if prose and not image:
                figure["caption"] = f"{figure['caption']} {prose}".strip()
            if not image and not link:
                open_ = None
    return found


def known_bold(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, pos, text) of bold runs that are a known term of their document: a semi-join on the normalised key."""
    runs = blocks.select("doc_id", "pos", F.explode(F.filter("inlines", lambda r: r["kind"] == "bold")).alias("r")).select("doc_id", "pos", "r.text")
    keys = terms.select("doc_id", T.normalize_key(F.col("term")).alias("_key"))
    return runs.withColumn("_key", T.normalize_key(F.col("text"))).join(keys, ["doc_id", "_key"], "left_semi").select("doc_id", "pos", "text")


def view_counts(floats_: DataFrame, supplements_: DataFrame, availability_: DataFrame) -> DataFrame:
    """How many items of each kind a document's data view has."""
    kinds = [floats_.select("doc_id", "kind"), supplements_.select("doc_id", F.lit("supplement").alias("kind")), availability_.select("doc_id", F.lit("availability").alias("kind"))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@vectorised(f"array<{FLOAT}>", FEW)
def floats_of(blocks: pd.Series) -> pd.Series:
    return blocks.map(fold_floats)


def floats(parsed: DataFrame) -> DataFrame:
    """(doc_id, kind, label, caption, section, pos, code, image, link, note) of parsed documents."""
    return parsed.select("doc_id", F.explode(floats_of(F.col("blocks"))).alias("f")).select("doc_id", "f.*")
