"""Markdown to flat block rows: one pass over the lines, each kind of block a small reader.

Nested blocks (list items, what a quote holds) are rows of their own with a longer path; a list's or quote's own row
holds all of its text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column

from lexiquarry.functions.lazy import FEW, vectorised

from lexiquarry.functions.html import convert_outside_fences

# Fixed patterns of the dialect.
HEADING = re.compile(r" {0,3}(?P<marks>#{1,6})\s+(?P<text>.*?)\s*#*\s*$")
RULE = re.compile(r" {0,3}(?:-{3,}|\*{3,}|_{3,})\s*$")
FENCE = re.compile(r" {0,3}(?P<marks>`{3,}|~{3,})\s*(?P<lang>[^\s`]*)\s*$")
ITEM = re.compile(r"(?P<indent>\s*)(?P<mark>[-*+]|\d{1,3}[.)])\s+(?P<text>.*)$")
QUOTE = re.compile(r" {0,3}>\s?(?P<text>.*)$")
TABLE_RULE = re.compile(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)+\|?\s*$")
ESCAPABLE = "\\`*_{}[]()#+-.!|>~"

INLINE = "struct<kind:string,text:string,href:string>"
BLOCK = f"struct<path:array<int>,kind:string,depth:int,text:string,slug:string,lang:string,inlines:array<{INLINE}>,header:array<string>,rows:array<array<string>>,ordered:boolean>"
DOCUMENT = f"struct<title:string,meta:map<string,string>,blocks:array<{BLOCK}>>"


def squeeze(text: str) -> str:
    return " ".join(text.split())


def plain(inlines: list[dict]) -> str:
    return squeeze("".join(r["text"] for r in inlines))


def _label(text: str) -> str:
    text = re.sub(r"!?\[([^\]]*)\]\([^)]+\)", r"\1", text)
    return re.sub(r"\*\*|__|`", "", text)


def _link(text: str, at: int) -> tuple[str, str, int] | None:
    """A [label](target) at a place: label, target and what comes after; brackets in the label must balance."""
    depth = 0
    for j in range(at, len(text)):
        depth += (text[j] == "[") - (text[j] == "]")
        if not depth:
            break
    else:
        return None
    close = text.find(")", j + 2)
    if text[j + 1 : j + 2] != "(" or close < 0:
        return None
    target = text[j + 2 : close].split()
    return re.sub(r"[*_`]", "", text[at + 1 : j]), target[0] if target else "", close + 1


def _emphasis(text: str, at: int) -> int:
    """Where single emphasis that opens at a place closes; -1 if it doesn't."""
    mark = text[at]
    if mark == "_" and at and not re.match(r"[\s(\[{'\"“]", text[at - 1]):
        return -1
    end = text.find(mark, at + 1)
    while mark == "_" and end > 0 and re.match("[A-Za-z0-9]", text[end + 1 : end + 2]):
        end = text.find(mark, end + 1)
    return end if end > at + 1 and text[at + 1] != mark else -1


def inline(text: str) -> list[dict]:
    """Runs of text, bold, italic, code, link and image."""
    runs: list[dict] = []
    held: list[str] = []

    def put(kind: str, value: str, href: str | None = None) -> None:
        if held:
            runs.append({"kind": "text", "text": "".join(held), "href": None})
            held.clear()
        runs.append({"kind": kind, "text": value, "href": href})

    at = 0
    while at < len(text):
        c, pair = text[at], text[at : at + 2]
        if c == "\\" and len(pair) == 2 and pair[1] in ESCAPABLE:
            held.append(pair[1])
            at += 2
            continue
        if c == "`" and (end := text.find("`", at + 1)) > at + 1:
            put("code", text[at + 1 : end])
            at = end + 1
            continue
        if pair in ("**", "__") and (end := text.find(pair, at + 2)) > at + 2:
            put("bold", _label(text[at + 2 : end]))
            at = end + 2
            continue
        if c in "*_" and (end := _emphasis(text, at)) > 0:
            put("italic", text[at + 1 : end])
            at = end + 1
            continue
        image = pair == "!["
        if (image or c == "[") and (found := _link(text, at + image)):
            label, href, at = found
            if not image:
                put("link", label or href, href)
            elif href:
                put("image", label, href)
            elif label:
                put("text", label)
            continue
        held.append(c)
        at += 1
    if held:
        runs.append({"kind": "text", "text": "".join(held), "href": None})
    return runs


def cells(line: str) -> list[str]:
    line = line.strip()
    return [plain(inline(c.strip())) for c in line.removeprefix("|").removesuffix("|").split("|")]


def _indent(line: str) -> int:
    line = line.replace("\t", "  ")
    return len(line) - len(line.lstrip(" "))


@dataclass
class Reader:
    """Lines to block rows; slugs are counted over the whole document."""

    slugs: Counter = field(default_factory=Counter)

    def slug(self, text: str) -> str:
        base = re.sub(r"\s+", "-", re.sub(r"[^a-z0-9\s-]", "", text.lower()).strip()) or "section"
        self.slugs[base] += 1
        return base if self.slugs[base] == 1 else f"{base}-{self.slugs[base] - 1}"

    def row(self, path: tuple[int, ...], kind: str, **more) -> dict:
        return dict.fromkeys(("depth", "text", "slug", "lang", "inlines", "header", "rows", "ordered")) | {"path": list(path), "kind": kind} | more

    def starts(self, lines: list[str], i: int) -> str | None:
        """The kind of block that begins at a line; None for a paragraph."""
        line = lines[i]
        for kind, pattern in (("fence", FENCE), ("heading", HEADING), ("quote", QUOTE)):
            if pattern.match(line):
                return kind
        if "|" in line and i + 1 < len(lines) and TABLE_RULE.match(lines[i + 1]):
            return "table"
        return "rule" if RULE.match(line) else "item" if ITEM.match(line) else None

    def read(self, lines: list[str], path: tuple[int, ...] = ()) -> Iterator[dict]:
        i, n = 0, 0
        while i < len(lines):
            if not lines[i].strip():
                i += 1
                continue
            kind = self.starts(lines, i)
            i, rows = getattr(self, f"_{kind or 'para'}")(lines, i, (*path, n))
            yield from rows
            n += 1

    def _fence(self, lines, i, path):
        head = FENCE.match(lines[i])
        end = next((j for j in range(i + 1, len(lines)) if (m := FENCE.match(lines[j])) and m["marks"][0] == head["marks"][0]), len(lines))
        return end + 1, [self.row(path, "code", lang=head["lang"], text="\n".join(lines[i + 1 : end]))]

    def _heading(self, lines, i, path):
        m = HEADING.match(lines[i])
        runs = inline(m["text"])
        text = plain(runs)
        return i + 1, [self.row(path, "heading", depth=len(m["marks"]), inlines=runs, text=text, slug=self.slug(text))]

    def _quote(self, lines, i, path):
        end = next((j for j in range(i, len(lines)) if not QUOTE.match(lines[j]) and not lines[j].strip()), len(lines))
        inner = [m["text"] if (m := QUOTE.match(x)) else x.strip() for x in lines[i:end]]
        rows = list(self.read(inner, path))
        text = " ".join(r["text"] or "" for r in rows if len(r["path"]) == len(path) + 1)
        return end, [self.row(path, "quote", text=text), *rows]

    def _table(self, lines, i, path):
        header = cells(lines[i])
        end = next((j for j in range(i + 2, len(lines)) if "|" not in lines[j]), len(lines))
        width = max(len(header), 2)
        rows = [(c + [""] * (len(header) - len(c)))[:width] for c in map(cells, lines[i + 2 : end])]
        return end, [self.row(path, "table", header=header, rows=rows, text=" ".join(" ".join(r) for r in [header, *rows]))]

    def _rule(self, lines, i, path):
        return i + 1, [self.row(path, "rule")]

    def _item(self, lines, i, path):
        taken, j = [], i
        while j < len(lines):
            if not lines[j].strip():  # blank lines only between items
                j = next((k for k in range(j, len(lines)) if lines[k].strip()), len(lines))
                if j == len(lines) or not ITEM.match(lines[j]):
                    break
            elif taken and not ITEM.match(lines[j]) and _indent(lines[j]) < 2 and any(p.match(lines[j]) for p in (HEADING, QUOTE, FENCE, RULE)):
                break
            taken.append(lines[j])
            j += 1
        rows, ordered = self._items(taken, path)
        return j, [self.row(path, "list", ordered=ordered, text=" ".join(r["text"] for r in rows)), *rows]

    def _items(self, lines: list[str], path: tuple[int, ...]) -> tuple[list[dict], bool]:
        base = _indent(lines[0])
        own = [k for k, x in enumerate(lines) if ITEM.match(x) and _indent(x) <= base + 1]
        rows = []
        for n, (s, e) in enumerate(zip(own, [*own[1:], len(lines)])):
            nested = next((k for k in range(s + 1, e) if ITEM.match(lines[k])), e)
            text = re.sub(r"^\[[ xX]\]\s+", "", ITEM.match(lines[s])["text"].strip())
            runs = inline(" ".join([text, *(x.strip() for x in lines[s + 1 : nested])]))
            rows.append(self.row((*path, n), "item", inlines=runs, text=plain(runs)))
            if nested < e:
                rows += self._items(lines[nested:e], (*path, n))[0]
        return rows, bool(own) and lines[own[0]].lstrip()[:1].isdigit()

    def _para(self, lines, i, path):
        end = next((j for j in range(i + 1, len(lines)) if not lines[j].strip() or self.starts(lines, j)), len(lines))
        runs = inline(" ".join(x.strip() for x in lines[i:end]))
        return end, [self.row(path, "para", inlines=runs, text=plain(runs))]


def parse(source: str | None) -> dict:
    """Title, front matter (lower-case keys) and block rows of a document."""
    lines = convert_outside_fences(re.sub(r"\r\n?", "\n", source or "")).split("\n")
    meta: dict[str, str] = {}
    if lines[0].strip() == "---" and (end := next((j for j in range(1, len(lines)) if lines[j].strip() in ("---", "...")), 0)):
        pairs = (re.match(r"([A-Za-z][\w-]*):\s*(.*)$", x) for x in lines[1:end])
        meta = {m[1].lower(): v for m in pairs if m and (v := re.sub(r"^[\"']|[\"']$", "", m[2].strip()))}
        lines = lines[end + 1 :]
    blocks = list(Reader().read(lines))
    first = next((b["text"] for b in blocks if b["kind"] == "heading" and b["depth"] == 1 and len(b["path"]) == 1), None)
    return {"title": meta.get("title") or first, "meta": meta or None, "blocks": blocks}


@vectorised(DOCUMENT, FEW)
def _parsed(source: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(x) for x in source], columns=["title", "meta", "blocks"])


def parsed(c: Column) -> Column:
    """struct(title, meta, blocks) of Markdown; a null source is an empty document."""
    return _parsed(c)
