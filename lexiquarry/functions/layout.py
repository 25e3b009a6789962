"""Positioned spans of printed pages to lines and Markdown. A page, or a document of at most 80, is one group.

Thresholds are fixed values in units of the text's size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiquarry.functions.lazy import FEW, vectorised
from lexiquarry.functions.python import abbreviations

MAX_PAGES, SMALL_PRINT = 80, 0.62
#: Fixed list: what a section's heading may say.
SECTION_WORDS = frozenset(
    (
        "abstract|summary|introduction|background|method|methods|materials and methods|methods and materials|experimental|results|results and discussion|discussion|conclusion|conclusions|"
        "references|bibliography|acknowledgements|acknowledgments|funding|appendix|limitations|supplementary material|supporting information|data availability|code availability|related work|"
        "author contributions|competing interests|conflict of interest|ethics statement|abbreviations|keywords"
    ).split("|")
)
CAPTION = re.compile(r"(table|figure|fig\.?|scheme|box|algorithm)\s*(\d+[A-Za-z]?)\s*[.:|—–-]?\s*(.*)$", re.I)
NUMBERED = re.compile(r"(\d+(?:\.\d+){0,2})\.?\s+([A-Z].*)$")
LINE = "struct<text:string,x:double,right:double,y:double,size:double,bold:boolean,page:int,cells:array<string>,cell_stops:array<double>>"


def span_columns(transform: Column, height: Column, page_height: Column, family: Column) -> dict[str, Column]:
    """A span's size, place from the top and weight, from its 2 x 3 matrix and its font."""
    scale = F.hypot(transform[2], transform[3])
    size = F.when(scale > 0, scale).when(height > 0, height).otherwise(10.0)
    return {"height": size, "x": transform[4], "y": page_height - transform[5], "bold": F.coalesce(family.rlike("(?i)bold|black|heavy|semibold"), F.lit(False)), "italic": F.coalesce(family.rlike("(?i)italic|oblique"), F.lit(False))}


def squeeze(text: str) -> str:
    return " ".join(text.split())


def _line(spans: list[dict], page: int) -> dict:
    spans = sorted(spans, key=lambda s: s["x"])
    size = median(s["height"] for s in spans)
    text, cells, stops, right = "", [], [], spans[0]["x"]
    for i, s in enumerate(spans):
        gap = s["x"] - right
        if not i or gap > max(1.4 * size, 6):
            cells.append(s["text"])
            stops.append(float(s["x"]))
        else:
            cells[-1] += (" " if gap > 0.28 * size else "") + s["text"]
        text += (" " if i and gap > 0.28 * size else "") + s["text"]
        right = s["x"] + s["width"]
    letters = sum(len(s["text"]) for s in spans)
    bold = sum(len(s["text"]) for s in spans if s["bold"])
    return {"text": squeeze(text), "x": float(spans[0]["x"]), "right": float(right), "y": float(spans[0]["y"]), "size": float(size), "bold": bold > 0.6 * letters, "page": page, "cells": [c for c in map(squeeze, cells) if c], "cell_stops": stops}


def build_lines(spans: list[dict], page: int = 1) -> list[dict]:
    """Spans to lines, top to bottom: a span joins a line if it is near the line's first one."""
    spans = sorted((s for s in spans if s["text"].strip()), key=lambda s: (s["y"], s["x"]))
    if not spans:
        return []
    near = max(2.0, median(s["height"] for s in spans) / 2)
    groups: list[list[dict]] = []
    for s in spans:
        if groups and abs(groups[-1][0]["y"] - s["y"]) <= near:
            groups[-1].append(s)
        else:
            groups.append([s])
    return [_line(g, page) for g in groups]


def order_columns(lines: list[dict], width: float) -> list[dict]:
    """Lines of a page of two columns in reading order; other pages stay."""
    edge = lambda side: [side == "l" and x["right"] < 0.54 * width or side == "r" and x["x"] > 0.46 * width for x in lines]
    left, right = edge("l"), edge("r")
    if len(lines) < 8 or min(sum(left), sum(right)) < 4 or sum(left) + sum(right) < 0.7 * len(lines):
        return lines
    first = min(x["y"] for x, a, b in zip(lines, left, right) if a or b)
    rank = [1 if a else 2 if b else 0 if x["y"] <= first else 3 for x, a, b in zip(lines, left, right)]
    return [x for _, x in sorted(zip(rank, lines), key=lambda p: (p[0], p[1]["y"]))]


def masked(text: str) -> str:
    text = squeeze(text)
    return re.sub(r"\d+", "#", text).lower() if 4 <= len(text) <= 120 else ""


def running_lines(pages: list[list[dict]]) -> set[str]:
    """Masked lines at the edges of at least 3 pages and of two in five."""
    if len(pages) < 3:
        return set()
    seen: dict[str, int] = {}
    for lines in pages:
        for x in [*lines[:2], *lines[-2:]] if lines else []:
            seen[masked(x["text"])] = seen.get(masked(x["text"]), 0) + 1
    return {k for k, n in seen.items() if k and n >= max(3, math.floor(len(pages) * 0.4))}


def is_page_number(text: str) -> bool:
    return bool(re.fullmatch(r"[|\[(]?\s*(page\s*)?\d{1,4}\s*(of\s*\d{1,4})?\s*[)\]|]?", text.strip(), re.I))


def title_case(text: str) -> str:
    text = squeeze(text)
    if text != text.upper():
        return text
    return re.sub(r"\b(And|Of)\b", lambda m: m[1].lower(), re.sub(r"\b[a-z]", lambda m: m[0].upper(), text.lower()))


def heading(line: dict, body: float) -> tuple[int, str] | None:
    """(level, title) of a line that is a heading, by its words, its number, or its size and weight."""
    text = squeeze(line["text"])
    if not text or len(text) > 90 or CAPTION.match(text) or text[-1] in ";," or (text[-1] == "." and not re.search(r"\b(?:[A-Z]\.){1,3}$", text)):
        return None
    if squeeze(re.sub("[^a-z\\s]", " ", text.lower())) in SECTION_WORDS:
        return 2, title_case(text)
    large = line["size"] >= 0.98 * body
    if (m := NUMBERED.match(text)) and len(m[2]) <= 80 and not m[2].endswith(".") and (large or line["bold"]):
        return (2 if "." not in m[1] else 3), f"{m[1]} {m[2].strip()}"
    bigger = line["size"] > 1.12 * body
    if (bigger or (line["bold"] and large)) and len(text.split()) <= 9 and re.match("[A-Z0-9]", text) and text[-1] not in "()":
        return (2 if bigger else 3), text
    return None


def caption(text: str) -> tuple[str, str] | None:
    m = CAPTION.match(text.strip())
    kinds = {"t": "Table", "s": "Scheme", "b": "Box", "a": "Algorithm"}
    return (f"{kinds.get(m[1][0].lower(), 'Figure')} {m[2]}", m[3].strip()) if m else None


def join_lines(lines: list[str]) -> str:
    """Wrapped lines to a paragraph; a word hyphenated at a line's end is mended."""
    out = ""
    for piece in filter(None, map(str.strip, lines)):
        out = out[:-1] + piece if re.search("[A-Za-z]-$", out) and piece[0].islower() else f"{out} {piece}".strip()
    return squeeze(out)


def table_end(lines: list[dict], start: int) -> int:
    """Where a run of rows of several cells, aligned with its first, ends; start if it has fewer than two."""

    def aligned(a: dict, b: dict) -> bool:
        near = 1.6 * max(a["size"], b["size"])
        return sum(any(abs(x - y) <= near for x in a["cell_stops"]) for y in b["cell_stops"]) >= min(2, len(b["cell_stops"]))

    end = start
    while end < len(lines) and len(lines[end]["cells"]) >= 2 and (end == start or aligned(lines[start], lines[end])):
        end += 1
    return end if end - start >= 2 else start


def math_density(text: str) -> float:
    symbols, digits, letters = (len(re.findall(p, text)) for p in (r"[=≈≤≥<>±×÷∑∏∫√∞∂∇αβγδεζηθικλμνξπρστυφχψωΓΔΘΛΞΠΣΦΨΩ^_{}|+−*/]", r"\d", "[A-Za-z]"))
    return (2 * symbols + digits) / max(1, 2 * symbols + digits + letters)


def is_equation(text: str) -> bool:
    words = [w for w in text.split() if re.fullmatch("[A-Za-z]{3,}", w)]
    return 3 <= len(text) <= 200 and not re.match(r"[A-Z][a-z]+ \d", text) and bool(re.search("[=≈≤≥<>+−×÷∑∏∫]", text)) and len(words) <= 4 and math_density(text) > 0.35


def group_references(lines: list[str]) -> list[str]:
    """Lines to entries: a new one at a number in front or at ``Surname, X.``; entries of 12 characters or fewer go."""
    number = re.compile(r"\[?\d{1,3}[.)\]]\s+")
    entries: list[list[str]] = []
    for line in lines:
        if not entries or number.match(line) or re.match(r"[A-Z][A-Za-z'’-]+,\s+[A-Z]\.", line):
            entries.append([])
        entries[-1].append(number.sub("", line, count=1) if not entries[-1] else line)
    return [e for e in map(join_lines, entries) if len(e) > 12]


def to_markdown(lines: list[dict]) -> tuple[str, dict[str, int]]:
    """Lines in reading order to sections, captions with tables, equations, paragraphs and the reference list."""
    body = median(x["size"] for x in lines) if lines else 10.0
    out: list[str] = []
    counts = {"sections": 0, "tables": 0, "figures": 0, "equations": 0}
    held: list[str] = []
    references: list[str] = []
    listing, skip = False, 0

    def close() -> None:
        if len(text := join_lines(held)) > 1:
            out.append(text)
        held.clear()

    for i, line in enumerate(lines):
        text = line["text"].strip()
        if i < skip or not text or is_page_number(text):
            continue
        if found := heading(line, body):
            close()
            listing = found[1].strip().lower() in ("references", "bibliography")
            out.append(f"{'#' * found[0]} {found[1]}")
            counts["sections"] += 1
        elif listing:
            references.append(text)
        elif named := caption(text):
            close()
            out.append("#### " + ". ".join(filter(None, named)))
            counts["tables" if named[0].startswith("Table") else "figures"] += 1
            if (end := table_end(lines, i + 1)) > i + 1:
                out.append(_table([x["cells"] or [x["text"]] for x in lines[i + 1 : end]]))
                skip = end
        elif is_equation(text):
            close()
            out.append(f"```math\n{text}\n```")
            counts["equations"] += 1
        else:
            before = lines[i - 1] if i else None
            if held and before and (line["y"] - before["y"] > 2.1 * line["size"] or (before["page"] != line["page"] and before["text"][-1:] in (".", "!", "?"))):
                close()
            held.append(text)
    close()
    if references:
        entries = group_references(references)
        out.append(f"_This set lists {len(entries)} reference{'' if len(entries) == 1 else 's'} from the paper._")
        out.append("\n".join(f"{n}. {e}" for n, e in enumerate(entries[:60], 1)))
    return "\n\n".join(out), counts


def _table(rows: list[list[str]]) -> str:
    width = max(2, *map(len, rows))
    rows = [[c.replace("|", "\\|") for c in r] + [""] * (width - len(r)) for r in rows]
    head = [c or f"Column {i}" for i, c in enumerate(rows[0], 1)]
    return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * width, *rows[1:]])


def front_matter(lines: list[dict], fallback: str = "Untitled paper") -> dict:
    """Title: the largest print among the first 18 lines; authors: the next line with commas, at most 25."""
    first = lines[:18]
    if not first:
        return {"title": fallback, "authors": []}
    top = max(x["size"] for x in first)
    large = [i for i, x in enumerate(first) if x["size"] >= 0.98 * top]
    run = [large[0]]
    for i in large[1:]:
        if i != run[-1] + 1:
            break
        run.append(i)
    title = join_lines([first[i]["text"] for i in run])
    listed = next((x["text"] for x in first[run[-1] + 1 :] if "," in x["text"] and not x["text"].lower().startswith("abstract")), "")
    names = [re.sub(r"[\d*†‡§,]+$", "", n).strip() for n in re.split(r",|\band\b", listed)]
    return {"title": title if len(title) > 5 else fallback, "authors": [n for n in names if len(n.split()) > 1][:25]}


def glossary(text: str) -> str:
    """A section of the abbreviations that a text defines; empty if there are fewer than two."""
    found = abbreviations(text)
    return "## Glossary\n\n" + "\n".join(f"- **{x['abbreviation']}**: {x['expansion']}" for x in found) if len(found) >= 2 else ""


def convert(spans: pd.DataFrame | Iterable[dict]) -> dict:
    """One document's spans (page, text, x, y, width, height, bold, page_width) to Markdown, counts, title and authors."""
    by_page: dict[int, list[dict]] = {}
    for s in spans.to_dict("records") if isinstance(spans, pd.DataFrame) else spans:
        if s["page"] is not None and s["page"] <= MAX_PAGES:
            by_page.setdefault(int(s["page"]), []).append(s)
    pages = [order_columns(build_lines(rows, page), float(rows[0]["page_width"])) for page, rows in sorted(by_page.items())]
    heads = running_lines(pages)
    sizes = [x["size"] for p in pages for x in p]
    least = SMALL_PRINT * median(sizes) if sizes else 0
    lines = [x for p in pages for x in p if masked(x["text"]) not in heads and x["size"] >= least]
    text, counts = to_markdown(lines)
    text = "\n\n".join(filter(None, (text, glossary(text))))
    return {"markdown": text, **counts, **front_matter(lines)}


RESULT = "markdown string, sections int, tables int, figures int, equations int, title string, authors array<string>"


@vectorised("struct<" + ",".join(":".join(c.rsplit(" ", 1)) for c in RESULT.split(", ")) + ">", FEW)
def _converted(spans: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(list(map(convert, spans)), columns=[c.split(" ")[0] for c in RESULT.split(", ")])


def documents(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Spans to one row a document: Markdown, counts, title, authors. A document's spans are one array, so that documents
    come to Python in batches, not as a group and a frame each."""
    columns = ("page", "y", "x", "text", "width", "height", "bold", "page_width")
    named = spans.withColumnRenamed(id_col, "doc_id").where(F.col("page") <= MAX_PAGES)
    held = named.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("spans"))
    return held.select("doc_id", _converted(F.col("spans")).alias("d")).select("doc_id", "d.*")


def lines(spans: DataFrame) -> DataFrame:
    """Spans to lines: doc_id, page, n and the line's columns; pages are independent groups."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = order_columns(build_lines(rows.to_dict("records"), int(key[1])), float(rows["page_width"].iloc[0]))
        out = pd.DataFrame(found, columns=["text", "x", "right", "y", "size", "bold", "cells"])
        out.insert(0, "n", range(len(out)))
        out.insert(0, "page", int(key[1]))
        out.insert(0, "doc_id", key[0])
        return out

    kind = spans.schema["doc_id"].dataType.simpleString()
    return spans.where(F.col("page") <= MAX_PAGES).groupBy("doc_id", "page").applyInPandas(one, f"doc_id {kind}, page int, n int, text string, x double, right double, y double, size double, bold boolean, cells array<string>")
