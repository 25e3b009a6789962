"""Scholarly article XML to sectioned Markdown.

A forgiving reader builds a small tree; a renderer walks it with a handler for each element.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column

from lexiquarry.functions.html import decode
from lexiquarry.functions.lazy import FEW, vectorised
from lexiquarry.functions.python import abbreviations

MAX_SPAN, MAX_REFERENCES = 24, 60
SITE = "https://www.ncbi.nlm.nih.gov/pmc/articles"
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|$)|<\?.*?(?:\?>|$)|<!DOCTYPE[^\[>]*(?:\[.*?\]\s*)?>|<(?P<close>/?)(?P<name>[A-Za-z_][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?P<empty>/?)>|(?P<text>[^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([^\s=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


@dataclass
class Node:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def all(self, *names: str) -> list[Node]:
        """Child elements, of these names if any are given."""
        return [c for c in self.children if isinstance(c, Node) and (not names or c.name in names)]

    def one(self, *names: str) -> Node | None:
        return next(iter(self.all(*names)), None)

    def deep(self, name: str) -> list[Node]:
        """Descendants of a name, in document order."""
        return [x for c in self.all() for x in ([c] if c.name == name else []) + c.deep(name)]

    def first(self, name: str) -> Node | None:
        return next(iter(self.deep(name)), None)

    def raw(self) -> str:
        return "".join(c if isinstance(c, str) else c.raw() for c in self.children)

    def link(self) -> str:
        return self.attrs.get("xlink:href") or self.attrs.get("href") or ""


def squeeze(text: str) -> str:
    return " ".join(text.split())


def text_of(node: Node | None) -> str:
    return squeeze(node.raw()) if node else ""


def parse(source: str | None) -> Node | None:
    """The root element; comments, instructions and the doctype are skipped, stray closing tags too. None if there is none."""
    top = Node("")
    open_ = [top]
    for m in TOKEN.finditer(source or ""):
        if m["text"] is not None:
            open_[-1].children.append(decode(m["text"]))
        elif m["data"] is not None:
            open_[-1].children.append(m["data"])
        elif m["name"]:
            name = m["name"].split(":")[-1]
            if m["close"]:
                at = next((i for i in range(len(open_) - 1, 0, -1) if open_[i].name == name), 0)
                if at:
                    del open_[at:]
                continue
            node = Node(name, {k: decode(a or b) for k, a, b in ATTRIBUTE.findall(m["attrs"])})
            open_[-1].children.append(node)
            if not m["empty"]:
                open_.append(node)
    return top.one()


def _long(text: str) -> str:
    return f"({text.strip()})" if len(text.strip()) > 1 else text.strip()


def math(node: Node) -> str:
    """MathML on one line."""
    kids = node.all()
    parts = [math(k) for k in kids]
    if node.name in ("mi", "mn", "mtext"):
        return text_of(node)
    if node.name == "mo":
        op = text_of(node)
        return op if re.fullmatch(r"[(){}\[\],.|]", op) else f" {op} "
    shapes = {
        "msup": (2, lambda a, b: f"{a}^{_long(b)}"), "msub": (2, lambda a, b: f"{a}_{_long(b)}"), "msubsup": (3, lambda a, b, c: f"{a}_{_long(b)}^{_long(c)}"),
        "mfrac": (2, lambda a, b: f"({a}) / ({b})"), "mroot": (2, lambda a, b: f"root_{b}({a})"), "mover": (2, lambda a, b: f"{a}^({b})"),
        "munder": (2, lambda a, b: f"{a}_({b})"), "munderover": (3, lambda a, b, c: f"{a}_({b})^({c})"),
    }
    if node.name in shapes and len(parts) >= shapes[node.name][0]:
        n, shape = shapes[node.name]
        return shape(*parts[:n])
    if node.name == "mfenced":
        return node.attrs.get("open", "(") + node.attrs.get("separators", ", ").join(parts) + node.attrs.get("close", ")")
    joined = {"mtable": "; ", "mtr": ", "}.get(node.name, "").join(parts)
    return {"msqrt": f"sqrt({joined})", "mspace": " "}.get(node.name, joined)


def formula(node: Node) -> str:
    if tex := node.first("tex-math"):
        text = re.sub(r"^\\documentclass.*?\\begin\{document\}|\\end\{document\}$", "", squeeze(tex.raw()))
        return re.sub(r"\\(?:begin|end)\{equation\*?\}", "", text).strip()
    found = node.first("math")
    return squeeze(math(found)) if found else ""


WRAPS = {"italic": "*{}*", "em": "*{}*", "bold": "**{}**", "strong": "**{}**", "monospace": "`{}`", "code": "`{}`", "sup": "^{}", "sub": "_{}"}


def inline(node: Node | str) -> str:
    if isinstance(node, str):
        return node
    inner = "".join(map(inline, node.children))
    if node.name in WRAPS:
        return WRAPS[node.name].format(squeeze(inner)) if squeeze(inner) else ""
    if node.name == "ext-link":
        label = squeeze(inner)
        return f"[{label}]({node.link()})" if label and node.link() else label or node.link()
    if node.name in ("inline-formula", "disp-formula"):
        return f"`{m}`" if (m := formula(node)) else ""
    if node.name in ("fn", "label") or (node.name == "xref" and node.attrs.get("ref-type") == "bibr"):
        return ""
    return " " if node.name == "break" else squeeze(inner) if node.name == "uri" else inner


def paragraph(node: Node) -> str:
    text = squeeze("".join(map(inline, node.children)))
    for pattern, to in ((r"(\d)\s*\^(st|nd|rd|th)\b", r"\1\2"), (r"\s+([),.;:%])", r"\1"), (r"\(\s*[,;]?\s*\)|\[\s*[,;]?\s*\]", "")):
        text = re.sub(pattern, to, text, flags=re.I)
    return squeeze(text)


def span(value: str | None) -> int:
    m = re.match(r"\s*(\d+)", value or "")
    return min(MAX_SPAN, max(1, int(m[1]))) if m else 1


def grid(table: Node) -> tuple[list[list[str]], list[list[str]]]:
    """Header and body rows of equal width; a cell that spans rows or columns is in every place it covers."""
    rows: list[tuple[bool, Node]] = []

    def walk(node: Node, head: bool) -> None:
        for c in node.all():
            if c.name in ("thead", "tbody", "tfoot"):
                walk(c, c.name == "thead")
            elif c.name == "tr" and c.all("td", "th"):
                rows.append((head or (not rows and not c.all("td")), c))

    walk(table, False)
    covered: dict[tuple[int, int], str] = {}
    for y, (_, row) in enumerate(rows):
        x = 0
        for c in row.all("td", "th"):
            while (y, x) in covered:
                x += 1
            text, wide, tall = paragraph(c).replace("|", "\\|"), span(c.attrs.get("colspan")), span(c.attrs.get("rowspan"))
            covered |= {(y + j, x + i): text for j in range(tall) for i in range(wide)}
            x += wide
    width = max([2, *(x + 1 for y, x in covered if y < len(rows))])
    lines = [[covered.get((y, x), "") for x in range(width)] for y in range(len(rows))]
    return [r for (h, _), r in zip(rows, lines) if h], [r for (h, _), r in zip(rows, lines) if not h]


def join_header(head: list[list[str]]) -> list[str]:
    return [" — ".join(dict.fromkeys(v for c in column if (v := c.strip()))) for column in zip(*head)]


@dataclass
class Article:
    pmcid: str | None = None
    out: list[str] = field(default_factory=list)
    supplements: list[str] = field(default_factory=list)
    pictures: int = 0
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("sections", "tables", "figures", "equations", "supplements", "references"), 0))

    def put(self, text: str) -> None:
        if text.strip():
            self.out.append(text.strip())

    def blocks(self, parent: Node, depth: int) -> None:
        for c in parent.all():
            self.block(c, depth)

    def block(self, c: Node, depth: int) -> None:
        if c.name in ("title", "graphic", "media", "label", "ref-list", "fn-group"):
            return
        handler = getattr(self, "_" + c.name.replace("-", "_"), None)
        if handler:
            handler(c, depth)
        elif c.all("sec", "p", "table-wrap", "fig"):
            self.blocks(c, depth)

    def _sec(self, c: Node, depth: int) -> None:
        title = text_of(c.one("title"))
        if c.attrs.get("sec-type") == "ref-list" or re.fullmatch("references|bibliography|literature cited", title, re.I):
            return
        level = min(6, max(2, depth + 1))
        if title:
            self.put(f"{'#' * level} {tidy(title)}")
            self.counts["sections"] += 1
        self.blocks(c, level)

    def _p(self, c: Node, depth: int) -> None:
        floats = c.all("table-wrap", "fig", "disp-formula", "supplementary-material", "list", "def-list", "boxed-text")
        bare = [k for k in c.children if not (isinstance(k, str) and not k.strip())]
        if not floats and bare and all(isinstance(k, Node) and k.name == "monospace" for k in bare):
            self.put(f"```\n{squeeze(c.raw())}\n```")
            return
        self.put(paragraph(Node("p", c.attrs, [k for k in c.children if not any(k is f for f in floats)])))
        for f in floats:
            self.block(f, depth)

    def _place(self, node: Node, kind: str) -> str | None:
        if not self.pmcid:
            return None
        return f"{SITE}/{self.pmcid}/{kind}/{node.attrs['id']}/" if node.attrs.get("id") else f"{SITE}/{self.pmcid}/"

    def _table_wrap(self, c: Node, depth: int) -> None:
        self.put("#### " + (" ".join(filter(None, (text_of(c.one("label")), text_of(c.one("caption"))))) or "Table"))
        self.counts["tables"] += 1
        table = c.first("table")
        head, body = grid(table) if table else ([], [])
        if not head:
            head, body = body[:1], body[1:]
        if not head:
            link = self._place(c, "table")
            self.put(f"_Table content is not in the machine-readable full text._ [View this table on PMC]({link})" if link else "_Table content is not available in the machine-readable full text._")
            return
        names = join_header(head)
        names = names if any(names) else [f"Column {i}" for i in range(1, len(names) + 1)]
        self.put("\n".join("| " + " | ".join(r) + " |" for r in [names, ["---"] * len(names), *body]))
        if foot := c.one("table-wrap-foot"):
            notes = [" ".join(filter(None, map(paragraph, f.all("p")))) or text_of(f) for f in foot.deep("fn")]
            self.put("  \n".join(f"_{n}_" for n in filter(None, notes or [paragraph(foot)])))

    def _fig(self, c: Node, depth: int) -> None:
        title, body = self._caption(c)
        name = " ".join(filter(None, (text_of(c.one("label")), title)))
        self.put(f"#### {name or 'Figure'}")
        graphic = c.first("graphic") or c.first("inline-graphic")
        file = graphic.link() if graphic else ""
        if self.pmcid and file:
            file = file if re.search(r"\.[a-z0-9]{3,4}$", file, re.I) else f"{file}.jpg"
            self.put(f"![{re.sub(r'[][]', '', name or 'Figure')}]({SITE}/{self.pmcid}/bin/{quote(file, safe='')})")
        self.put(body or ("" if name else "_Figure caption is not available._"))
        if not (self.pmcid and file) and (link := self._place(c, "figure")):
            self.put(f"[View this figure on PMC]({link})")
        self.counts["figures"] += 1

    def _caption(self, c: Node) -> tuple[str, str]:
        found = c.one("caption")
        return (text_of(found.one("title")), " ".join(filter(None, map(paragraph, found.all("p"))))) if found else ("", "")

    def _disp_formula(self, c: Node, depth: int) -> None:
        if not (text := formula(c)):
            self.pictures += 1
            return
        label = re.sub("[()]", "", text_of(c.one("label")))
        self.put(f"#### Equation {label}")
        self.put(f"```math\n{text}\n```")
        self.counts["equations"] += 1

    def _supplementary_material(self, c: Node, depth: int) -> None:
        title, body = self._caption(c)
        media = c.first("media")
        file = (media.link() if media else "") or c.link()
        name = text_of(c.one("label")) or title or file or "Supplementary file"
        about = " — ".join(filter(None, (title if title != name else "", body))) or "Supplementary file provided with the article."
        self.supplements.append(f"- **{re.sub('[.:]$', '', name)}**: {about}" + (f" (file: `{file}`)" if file else ""))
        self.counts["supplements"] += 1

    def _list(self, c: Node, depth: int) -> None:
        self.put("\n".join(self._items(c, 0)))

    def _items(self, c: Node, depth: int) -> list[str]:
        lines, ordered = [], c.attrs.get("list-type", "").startswith("order")
        for n, item in enumerate(c.all("list-item"), 1):
            if text := " ".join(filter(None, map(paragraph, item.all("p", "label")))):
                lines.append(f"{'  ' * depth}{f'{n}.' if ordered else '-'} {text}")
            lines += [x for nested in item.all("list") for x in self._items(nested, depth + 1)]
        return lines

    def _def_list(self, c: Node, depth: int) -> None:
        pairs = [(text_of(i.one("term")), paragraph(i.one("def") or i)) for i in c.deep("def-item")]
        self.put("\n".join(f"- **{t}**: {d}" if d else f"- **{t}**" for t, d in pairs if t))

    def _boxed_text(self, c: Node, depth: int) -> None:
        inner = Article(self.pmcid, [], self.supplements, 0, self.counts)
        inner.blocks(c, depth)
        self.pictures += inner.pictures
        self.put("\n".join(f"> {x}".rstrip() for x in "\n\n".join(inner.out).split("\n")) if inner.out else "")

    _statement = _boxed_text

    def _disp_quote(self, c: Node, depth: int) -> None:
        if text := " ".join(filter(None, map(paragraph, c.all("p")))):
            self.put(f"> {text}")

    def _code(self, c: Node, depth: int) -> None:
        if c.raw().strip():
            self.put("```\n" + c.raw().strip("\n") + "\n```")

    _preformat = _code


SMALL_WORDS = "And Of The For In On To A An With".split()


def tidy(title: str) -> str:
    title = re.sub(r"\s*\.$", "", squeeze(title))
    letters = re.sub("[^A-Za-z]", "", title)
    if len(letters) < 3 or letters != letters.upper():
        return title
    title = re.sub(r"(^|[\s(])([a-z])", lambda m: m[1] + m[2].upper(), title.lower())
    title = re.sub(rf"\b({'|'.join(SMALL_WORDS)})\b", lambda m: m[1].lower(), title)
    return title[:1].upper() + title[1:]


def licence(node: Node | None) -> str | None:
    if node is None:
        return None
    href, text = node.attrs.get("xlink:href", ""), text_of(node)
    has = lambda p: re.search(p, f"{href} {text}", re.I)
    if has(r"creative commons|creativecommons\.org"):
        if has("public domain|/zero/|cc0"):
            return "CC0"
        return "-".join(["CC BY"] + ["NC"] * bool(has("non-?commercial|/by-nc")) + (["ND"] if has("no-?derivatives|/by-nd|-nd/") else ["SA"] if has("share-?alike|-sa/") else []))
    return "Open access" if has("open access") else href or re.sub(r"\s+\S*$", "", text[:60]) or None


def metadata(article: Node) -> dict:
    front = article.one("front") or Node("front")
    meta, journal = front.one("article-meta") or Node("article-meta"), front.one("journal-meta")
    ids = {i.attrs.get("pub-id-type"): text_of(i) for i in reversed(meta.all("article-id"))}
    pmc = next((ids[k] for k in ("pmcid", "pmc", "pmcaid") if re.search(r"\d", ids.get(k, ""))), None)
    names = []
    for c in [c for g in meta.all("contrib-group") for c in g.all("contrib") if c.attrs.get("contrib-type", "author") == "author"]:
        name = c.one("name") or c.one("name-alternatives")
        shown = " ".join(filter(None, (text_of(name.one("given-names")), text_of(name.one("surname"))))) if name else text_of(c.one("collab"))
        names += [shown] if shown else []
    dates = meta.all("pub-date")
    date = next((d for d in dates if d.attrs.get("pub-type") == "epub" or d.attrs.get("date-type") == "pub"), dates[0] if dates else meta)
    title = (meta.one("title-group") or meta).one("article-title")
    permissions = meta.one("permissions")
    return {
        "title": re.sub(r"\s*\.$", "", squeeze(inline(title))) if title else "", "authors": names, "journal": text_of(journal.first("journal-title")) if journal else "", "year": text_of(date.one("year")),
        "doi": ids.get("doi"), "pmid": ids.get("pmid"), "pmcid": f"PMC{re.sub('^PMC', '', pmc, flags=re.I).strip()}" if pmc else None,
        "license": licence(permissions.one("license") if permissions else None), "keywords": [k for g in meta.all("kwd-group") for k in map(text_of, g.all("kwd")) if k],
    }


def abstract(node: Node | None) -> list[str]:
    if node is None:
        return []
    if sections := node.all("sec"):
        pairs = [(re.sub("[:.]$", "", text_of(s.one("title"))), " ".join(filter(None, map(paragraph, s.all("p"))))) for s in sections]
        return [f"- **{t}**: {b}" if t else b for t, b in pairs if b]
    return [p for p in map(paragraph, node.all("p")) if p] or [p for p in [paragraph(node)] if p]


def references(article: Node) -> list[str]:
    lines = []
    for ref in article.deep("ref")[:MAX_REFERENCES]:
        c = ref.one("element-citation", "mixed-citation", "citation")
        parts = []
        if c:
            surnames = [text_of(s) for s in c.deep("surname")]
            parts = [", ".join(surnames[:3]) + (" et al." if len(surnames) > 3 else ""), *(text_of(c.one(k)) for k in ("article-title", "source", "year"))]
        text = ". ".join(filter(None, parts)) or text_of(c.first("named-content") if c else None) or text_of(c or ref)
        lines += [text] if text else []
    return lines


def header(meta: dict, source: str) -> list[str]:
    """Front matter, title, citation and keywords."""
    shown = {k: ", ".join(meta[k]) if isinstance(meta[k], list) else meta[k] for k in ("title", "authors", "journal", "year", "doi", "pmid", "pmcid", "license", "keywords")} | {"source": source}
    clean = {k: squeeze(v).replace('"', "'") for k, v in shown.items() if v and v.strip()}
    lines = [f'{k}: "{v}"' if re.search(r"[:#\-\[\]{}&*!|>%@`]", v) else f"{k}: {v}" for k, v in clean.items()]
    authors = ", ".join(meta["authors"][:6]) + (", et al." if len(meta["authors"]) > 6 else "")
    where = " ".join(filter(None, (meta["journal"], f"({meta['year']})" if meta["year"] else "")))
    ids = " · ".join(filter(None, (f"DOI {meta['doi']}" if meta["doi"] else "", f"PMID {meta['pmid']}" if meta["pmid"] else "", meta["pmcid"])))
    out = ["\n".join(["---", *lines, "---"]), f"# {meta['title']}", "> " + " · ".join(filter(None, (where, authors, ids)))]
    return out + ([f"_This paper is indexed under {', '.join(meta['keywords'])}._"] if meta["keywords"] else [])


def convert(xml: str | None, source: str = "Europe PMC full text (JATS)") -> dict | None:
    """An article's Markdown, metadata and counts; None without a root element."""
    root = parse(xml)
    if root is None:
        return None
    article = root if root.name == "article" else root.first("article") or root
    meta = metadata(article)
    meta["title"] = meta["title"] or "Untitled paper"
    a = Article(meta["pmcid"])
    front = article.one("front")
    shown = []
    for line in abstract((front.one("article-meta") or Node("")).one("abstract") if front else None):
        if m := re.match(r"(?:\*\*Key\s?words?:?\*\*:?\s*|Key\s?words?:\s*)(.+)$", line, re.I):
            meta["keywords"] = list(dict.fromkeys(meta["keywords"] + [w for k in re.split("[,;·]", m[1]) if (w := re.sub(r"[*_.]+$", "", k).strip())]))
        else:
            shown.append(line)
    for line in ["## Abstract", *shown] if shown else []:
        a.put(line)
    if body := article.one("body"):
        a.blocks(body, 1)
    if back := article.one("back"):
        for s in back.deep("supplementary-material"):
            a._supplementary_material(s, 1)
        if (glossary := back.first("glossary")) and (lists := glossary.deep("def-list")):
            a.put("## Glossary")
            for d in lists:
                a._def_list(d, 1)
    if a.pictures:
        many = "" if a.pictures == 1 else "s"
        a.put("## Equations")
        a.put(f"This article publishes its {a.pictures} display equation{many} as images rather than as text, so the formulas themselves could not be imported. The surrounding explanations are all here; open the original article to read the derivations.")
    if a.supplements:
        a.put("## Supplementary material")
        a.put("\n".join(dict.fromkeys(a.supplements)))
    mined = abbreviations(" ".join(b for b in a.out if b[0] not in "#|"))
    if "## Glossary" not in a.out and len(mined) >= 2:
        a.put("## Glossary")
        a.put("\n".join(f"- **{m['abbreviation']}**: {m['expansion']}" for m in mined))
    if refs := references(article):
        a.counts["references"] = len(refs)
        a.put("## References")
        a.put("\n".join(f"{n}. {r}" for n, r in enumerate(refs, 1)))
    text = re.sub(r"\n{3,}", "\n\n", "\n\n".join([*header(meta, source), *a.out])).strip() + "\n"
    return {"markdown": text, "meta": meta, "counts": a.counts}


META = "struct<title:string,authors:array<string>,journal:string,year:string,doi:string,pmid:string,pmcid:string,license:string,keywords:array<string>>"


@vectorised(f"struct<markdown:string,meta:{META},counts:map<string,int>>", FEW)
def _converted(xml: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([convert(x) or dict.fromkeys(("markdown", "meta", "counts")) for x in xml], columns=["markdown", "meta", "counts"])


def converted(c: Column) -> Column:
    """struct(markdown, meta, counts) of article XML; nulls if there is no element in it."""
    return _converted(c)


def abstract_only(meta: dict, text: str, notice: str) -> str:
    """A document of an abstract alone."""
    return "\n\n".join([*header(meta, "Europe PMC abstract"), f"_{notice}_", "## Abstract", text.strip()]) + "\n"
