"""Scalar text functions as column expressions: identifiers, sentences, measurements, claims, questions.

All of them stay on the JVM. Null in, null out, unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
BLANK = "____"
NON_STUDY = "references?|bibliography|literature cited|works cited|acknowledgements?|acknowledgments?|funding(?: statement| information)?|competing interests?|conflicts? of interest|author contributions?|declarations?|data availability(?: statement)?|code availability|ethics(?: statement| approval)?"
NON_QUESTION = "contents?|glossary|index|abbreviations|supplementary material|supporting information|equations"
GENERIC_CLOZE = (
    "done state status update updated current currently important note result results yes no true false running finished gene genes slowest estimate estimates estimated fix fixes fixed"
).split()
NUMBERING = r"^\d+(?:\.\d+)*[.)]?\s*"
MEASUREMENTS = (
    r"\b[pP]\s*[<>=≤≥]\s*0?\.\d+",
    r"\b(?:aOR|aHR|OR|HR|RR|CI)\s*[=:]?\s*\d+(?:\.\d+)?",
    r"\b\d+(?:[.,]\d+)?\s*(?:%|‰)",
    r"\b\d+(?:\.\d+)?\s*(?:-fold|fold|×)\b",
    r"\b[nN]\s*=\s*\d[\d,]*",
    r"\b\d+/\d+\b",
    r"\b\d+(?:\.\d+)?\s*(?:mg|kg|µg|μg|ml|mL|µl|μl|nm|mm|cm|km|bp|kb|Mb|Gb|°C|hours?|hr|min|days?|weeks?|months?|years?)\b",
    r"\b\d{1,3}(?:[  ,]\d{3})+\b",
    r"\b\d+\.\d+\b",
    r"\b\d{3,}\b",
)
MEASUREMENT = "|".join(MEASUREMENTS)
#: Fixed values: (pattern, kind, base score); the highest base wins, the first of equals.
CLAIMS = (
    (r"\bwe (?:found|discovered|observed|identified|detected)\b", "finding", 10),
    (r"\bwe (?:show|showed|demonstrate[d]?|report|reveal(?:ed)?|establish(?:ed)?)\b", "finding", 10),
    (r"\b(?:here|in this (?:study|work|paper|analysis))\s*,?\s*we\b", "finding", 9),
    (r"\bour (?:results?|data|findings?|analysis|study|work)\s+(?:show|showed|suggest|suggests|indicate|indicates|demonstrate|demonstrates|reveal|reveals|support|supports|confirm|confirms)\b", "finding", 10),
    (r"\b(?:results?|findings?|data|analysis)\s+(?:show|showed|suggest|suggests|indicate|indicates|demonstrate|demonstrates|reveal|reveals)\s+that\b", "finding", 8),
    (r"\bwe (?:conclude|propose|argue|suggest|hypothesi[sz]e)\b", "conclusion", 9),
    (r"\b(?:these|our) (?:results?|findings?|data)\s+(?:support|suggest|imply|indicate|point to)\b", "conclusion", 9),
    (r"\b(?:taken together|altogether|in summary|in conclusion|overall)\b", "conclusion", 8),
    (r"\bthis (?:study|work|paper)\s+(?:shows|showed|demonstrates|reveals|provides|establishes)\b", "finding", 8),
    (r"\bwas (?:significantly|strongly|markedly)\b|\b(?:significantly|markedly)\s+(?:higher|lower|greater|increased|decreased|reduced|associated)\b", "quantified", 7),
    (r"\b(?:associated with|correlated with|predicted|risk of)\b", "quantified", 5),
)
#: Fixed value: words that make a claim weaker.
HEDGE = r"(?i)\b(?:may|might|could|would|remains? unclear|further (?:work|study|research)|future (?:work|studies))\b"
EXTENSIONS = "docx|txt|md|markdown|csv|tsv|nbib|ris|json"
ANY_HTML = r"(?i)</?(?:h[1-6]|p|br|div|ul|ol|li|blockquote|b|i|em|strong|sup|sub|code|a|span|abbr|small|u)\b[^>]*>"
BLOCK_HTML = r"(?i)</?(?:h[1-6]|p|br|div|ul|ol|li|blockquote|table|tr|td|th|section|article)\b[^>]*>"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, with c computed once however often f uses it: plans stay as long as the sum of their parts, not the product."""
    return F.transform(F.array(c), f)[0]


def squeeze(c: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def nonblank(c: Column) -> Column:
    return F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")


def study_sentences(c: Column) -> Column:
    """Split after . ! or ? before anything."""
    return nonblank(F.split(c, r"(?<=[.!?])\s+(?=\S)"))


def paper_sentences(c: Column) -> Column:
    """Split after . ! or ? only before a capital or digit, an opening quote or bracket allowed."""
    return nonblank(F.split(F.regexp_replace(c, r"\s+", " "), r"(?<=[.!?])\s+(?=[\"'“(]?[A-Z0-9])"))


def speech_sentences(c: Column, most: int = 240) -> Column:
    """Split as for papers and after an ellipsis; pieces of over ``most`` characters are packed anew from their clauses."""
    parts = nonblank(F.split(squeeze(c), r"(?<=[.!?…])\s+(?=[\"'“(\[A-Z0-9])"))

    def packed(part: Column) -> Column:
        def step(acc: Column, piece: Column) -> Column:
            full = (F.length(acc["open"]) + F.length(piece) > most) & (acc["open"] != "")
            return F.struct(
                F.when(full, F.concat(acc["done"], F.array(F.trim(acc["open"])))).otherwise(acc["done"]).alias("done"),
                F.when(full, F.concat(piece, F.lit(" "))).otherwise(F.concat(acc["open"], piece, F.lit(" "))).alias("open"),
            )

        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
        cut = F.aggregate(F.split(part, r"(?<=[,;:—-])\s+"), start, step, lambda acc: nonblank(F.concat(acc["done"], F.array(acc["open"]))))
        return F.when(F.length(part) > most, cut).otherwise(F.array(part))

    return F.flatten(F.transform(parts, packed))


def hash_id(c: Column) -> Column:
    """djb2 over UTF-16 units modulo 2**32, in base 36."""

    def step(units: Column) -> Column:
        unit = lambda i: F.conv(F.hex(F.substring(units, i * 2 + 1, F.lit(2))), 16, 10).cast("long")
        many = (F.octet_length(units) / 2).cast("int")
        places = F.when(many > 0, F.sequence(F.lit(0), many - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, F.lit(5381).cast("long"), lambda h, i: (h * 33 + unit(i)).bitwiseAND(F.lit(4294967295)))

    return F.when(c.isNotNull(), F.lower(F.conv(let(F.encode(c, "UTF-16BE"), step).cast("string"), 10, 36)))


#: Fixed table: accented Latin letters and what they are without the accents.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def normalize_key(c: Column) -> Column:
    """Lower case, accents of Latin letters off, all but ASCII letters and digits to blanks, squeezed.

    ``functions.python.normalize_key`` decomposes all of Unicode; the two agree on Latin text.
    """
    return squeeze(F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"[^a-z0-9\s]", " "))


def normalize_answer(c: Column) -> Column:
    return F.regexp_replace(normalize_key(c), r"^(a|an|the)\s+", "")


def bare_heading(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, NUMBERING, ""))


def is_non_study(section: Column) -> Column:
    return bare_heading(section).rlike(f"(?i)^(?:{NON_STUDY})$")


def is_non_question(section: Column) -> Column:
    return bare_heading(section).rlike(f"(?i)^(?:{NON_STUDY}|{NON_QUESTION})$")


def is_reasonable_term(c: Column) -> Column:
    def reasonable(c: Column) -> Column:
        short = F.length(c).between(2, 80) & (word_count(c) <= 8)
        return short & c.rlike(r"[a-zA-ZÀ-ɏͰ-῿぀-鿿]") & ~c.contains("://") & ~c.contains("|") & ~F.trim(c).rlike(r"[.!?]$")

    return let(c, reasonable)


def is_useful_cloze(target: Column, sentence: Column) -> Column:
    def useful(clean: Column) -> Column:
        n = word_count(clean)
        long = (n > 8) | (F.length(clean) > 72) | (F.length(clean) > F.length(sentence) * 0.48)
        weak = (n == 1) & (F.length(clean) < 5) & ~clean.rlike(r"[A-Z0-9ωχκ]")
        named = let(normalize_key(clean), lambda key: (key != "") & ~key.isin(*GENERIC_CLOZE))
        return named & ~long & ~clean.rlike(r"[.!?;:]$") & ~weak

    return let(squeeze(target), useful)


def concise(c: Column, most: int = 420) -> Column:
    """At most so many characters, cut at the last sentence end if that is past 55 %, else at a word, with an ellipsis."""

    def cut(clip: Column) -> Column:
        back = F.reverse(clip)
        last = lambda mark: F.when(F.instr(back, mark[::-1]) > 0, F.length(clip) - F.instr(back, mark[::-1]) - len(mark) + 1).otherwise(-1)
        sentence = F.greatest(last(". "), last("? "), last("! "))
        end = let(sentence, lambda s: F.when(s >= int(most * 0.55), s + 1).otherwise(last(" ")))
        return F.concat(F.trim(F.substring(clip, F.lit(1), F.greatest(F.lit(1), end))), F.lit("…"))

    return let(squeeze(c), lambda clean: F.when(F.length(clean) <= most, clean).otherwise(let(F.substring(clean, 1, most + 1), cut)))


def ensure_question_mark(c: Column) -> Column:
    return let(F.trim(c), lambda t: F.when(t.rlike("[?？]$"), t).otherwise(F.concat(t, F.lit("?"))))


def question_from_heading(c: Column) -> Column:
    """A heading as a question: questions stay, inverted and bare interrogatives are put right, else a fixed template."""
    return let(bare_heading(c), _question)


def _question(h: Column) -> Column:
    inverted = r"(?i)^(why|how)\s+(.+?)\s+(is|are|was|were|can|could|should|would|does|do|did)\s+(.+)$"
    rules = [
        (h.rlike("[?？]"), h),
        (h.rlike(inverted), F.regexp_replace(h, inverted, "$1 $3 $2 $4?")),
        (h.rlike(r"(?i)^why\s+a\s+posterior\s+and\s+not\s+a\s+point\s+estimate$"), F.lit("Why use a posterior rather than a point estimate?")),
        (h.rlike(r"(?i)^why\s+the\s+two\s+agree$"), F.lit("Why do the two methods agree?")),
        (h.rlike(r"(?i)^how\s+(?:these|those)\b"), F.concat(F.regexp_replace(h, r"(?i)^how\s+", "How do "), F.lit("?"))),
        (h.rlike(r"(?i)^what\s+it\s+is$"), F.lit("What is it?")),
        (h.rlike(r"(?i)^what\s+it\s+produces$"), F.lit("What does it produce?")),
        (h.rlike(r"(?i)^(?:why|how|what|when|where|which|who|can|does|do|is|are|should|could|would)\b"), F.concat(h, F.lit("?"))),
        (h.rlike("(?i)^the question$"), F.lit("What question is this analysis trying to answer?")),
    ]
    start = F.when(*rules[0])
    return reduce(lambda acc, r: acc.when(*r), rules[1:], start).otherwise(F.concat(F.lit("What is the key idea in “"), h, F.lit("”?")))


def strip_identifiers(c: Column) -> Column:
    c = F.regexp_replace(c, r"\b10\.\d{4,9}/\S+", " ")
    c = F.regexp_replace(c, r"(?i)\b(?:PMID|PMCID|PMC|DOI|ISBN|ISSN|accession(?: number)?)\s*:?\s*\S+", " ")
    return F.regexp_replace(c, r"https?://\S+", " ")


def find_numbers(c: Column) -> Column:
    """Measurements in a text, in order, each once; four-digit years are none."""
    found = F.transform(F.regexp_extract_all(strip_identifiers(c), F.lit(MEASUREMENT), F.lit(0)), lambda x: F.trim(x))
    year = lambda x: x.rlike(r"^\d{4}$") & (x > "1500") & (x < "2100")
    return F.array_distinct(F.filter(found, lambda x: ~year(x)))


def strongest_claim(sentence: Column) -> Column:
    """struct(base, kind, trigger) of a sentence that makes a claim, else null. Patterns are tried from the highest base down,
    the first of equals first, so that none is tried after the one that wins."""
    text = F.trim(sentence)
    best = F
    for p, kind, base in sorted(CLAIMS, key=lambda claim: -claim[2]):
        best = best.when(text.rlike(f"(?i){p}"), F.struct(F.lit(base).alias("base"), F.lit(kind).alias("kind"), F.regexp_extract(text, f"(?i){p}", 0).alias("trigger")))
    able = F.length(text).between(40, 400) & ~text.rlike(r"(?i)^(table|figure|fig\.|equation)\b")
    return F.when(able, best)


def score_claim(sentence: Column, section: Column) -> Column:
    """struct(kind, score, trigger) of a sentence that makes a claim, else null."""
    text = F.trim(sentence)
    more = F.least(F.lit(3), F.regexp_count(text, F.lit(MEASUREMENT))) - F.when(text.rlike(HEDGE), 3).otherwise(0)
    more = more + F.when(section.rlike("(?i)^(results|discussion|conclusion|abstract)"), 1).otherwise(0)
    return let(strongest_claim(sentence), lambda best: F.when(best.isNotNull(), F.struct(best["kind"].alias("kind"), (best["base"] + more).alias("score"), best["trigger"].alias("trigger"))))


def trim_doi(c: Column) -> Column:
    """Takes off what ends a sentence but not a DOI: . , ; : and brackets without a partner, until none is left."""

    count = lambda x, ch: F.length(x) - F.length(F.replace(x, F.lit(ch), F.lit("")))

    def bare(cut: Column, opening: str, closing: str) -> Column:
        lone = cut.endswith(closing) & (count(cut, closing) > count(cut, opening))
        return F.when(lone, F.substring(cut, F.lit(1), F.length(cut) - 1)).otherwise(cut)

    def step(acc: Column, _: Column) -> Column:
        cut = let(F.regexp_replace(acc, r"[.,;:]+$", ""), lambda x: let(bare(x, "(", ")"), lambda y: bare(y, "[", "]")))
        return F.when(acc.rlike(r"[.,;:)\]]$"), cut).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c))), F.trim(c), step)


def normalize_pmcid(c: Column) -> Column:
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(digits != "", F.concat(F.lit("PMC"), digits)).otherwise(F.upper(c))


def _identifier(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def parse_paper_id(c: Column) -> Column:
    """struct(kind, value) of what a person pastes: an id, a labelled id or a URL; null if it is none."""
    raw = F.trim(c)
    got = lambda p: F.regexp_extract(raw, p, 1)
    rules = [
        ("pmcid", r"(?i)(?:pmc/articles/|europepmc\.org/article/pmc/)\s*(PMC\d+|\d+)", normalize_pmcid),
        ("pmcid", r"(?i)^(pmc\s*\d+)$", normalize_pmcid),
        ("pmid", r"(?i)pubmed\.ncbi\.nlm\.nih\.gov/(\d{4,9})", None),
        ("pmid", r"(?i)\bpmid\s*[:#]?\s*(\d{4,9})\b", None),
        ("pmid", r"(?i)europepmc\.org/(?:article/med/|abstract/MED/)(\d{4,9})", None),
        ("doi", r"(?i)\b(10\.\d{4,9}/[^\s\"'<>]+)", trim_doi),
        ("pmid", r"^(\d{1,9})$", None),
    ]
    return F.coalesce(*(F.when(got(p) != "", _identifier(kind, f(got(p)) if f else got(p))) for kind, p, f in rules))


def parse_paper_ids(c: Column) -> Column:
    """All identifiers in free text, pass by pass: PMC, DOI, labelled PMID, bare 7 or 8 digits; each found once.

    What a pass has matched is out of the next ones' sight.
    """
    passes = [
        ("pmcid", r"(?i)\bPMC\s?(\d+)\b", normalize_pmcid),
        ("doi", r"\b(10\.\d{4,9}/[^\s,;\"'<>]+)", trim_doi),
        ("pmid", r"(?i)\bPMID\s*[:#]?\s*(\d{1,9})\b", lambda x: x),
        ("pmid", r"\b(\d{7,8})\b", lambda x: x),
    ]
    rest, found = c, []
    for kind, pattern, clean in passes:
        found.append(_passed(rest, kind, pattern, clean))
        rest = F.regexp_replace(rest, pattern, " ")
    every = F.concat(*found)
    keys = lambda x: F.concat(x["kind"], F.lit(":"), F.lower(x["value"]))
    first = F.aggregate(
        every,
        F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<struct<kind:string,value:string>>").alias("out")),
        lambda acc, x: F.struct(
            F.array_union(acc["seen"], F.array(keys(x))).alias("seen"),
            F.when(F.array_contains(acc["seen"], keys(x)), acc["out"]).otherwise(F.concat(acc["out"], F.array(x))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return first


def _passed(rest: Column, kind: str, pattern: str, clean) -> Column:
    def one(x: Column) -> Column:
        return _identifier(kind, clean(x))

    return F.transform(F.regexp_extract_all(rest, F.lit(pattern), F.lit(1)), one)


def lookup_query(kind: Column, value: Column) -> Column:
    pmid = F.concat(F.lit("EXT_ID:"), value, F.lit(" AND SRC:MED"))
    return F.when(kind == "pmid", pmid).when(kind == "pmcid", F.concat(F.lit("PMCID:"), normalize_pmcid(value))).when(kind == "doi", F.concat(F.lit('DOI:"'), value, F.lit('"')))


def describe_id(kind: Column, value: Column) -> Column:
    return F.when(kind == "pmid", F.concat(F.lit("PMID "), value)).when(kind == "pmcid", normalize_pmcid(value)).when(kind == "doi", F.concat(F.lit("DOI "), value))


def paper_identity(pmid: Column, pmcid: Column, doi: Column, title: Column) -> Column:
    there = lambda c: c.isNotNull() & (c != "")
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))
    return F.when(there(pmid), F.concat(F.lit("pmid:"), pmid)).when(there(pmcid), F.concat(F.lit("pmcid:"), F.upper(pmcid))).when(there(doi), F.concat(F.lit("doi:"), F.lower(doi))).otherwise(F.concat(F.lit("title:"), plain))


def paper_subtitle(journal: Column, year: Column, pmid: Column, doi: Column) -> Column:
    ident = F.when(F.coalesce(pmid, F.lit("")) != "", F.concat(F.lit("PMID "), pmid)).when(F.coalesce(doi, F.lit("")) != "", F.concat(F.lit("DOI "), doi))
    return F.concat_ws(" · ", F.nullif(journal, F.lit("")), F.nullif(year, F.lit("")), ident)


def tokenize(query: Column) -> Column:
    return F.filter(F.split(F.lower(query), r"[\s,;]+"), lambda t: F.length(t) > 1)


def strip_front_matter(c: Column) -> Column:
    end = F.locate("\n---", c, 4)
    return F.when(c.startswith("---") & (end > 0), F.substring(c, end + 4, F.length(c))).otherwise(c)


def snippet(body: Column, token: Column, before: int = 60, after: int = 90) -> Column:
    """A stretch of body around the first place of a lower-case token; null if there is none."""
    at = F.instr(F.lower(body), token) - 1
    start, end = F.greatest(F.lit(0), at - before), F.least(F.length(body), at + F.length(token) + after)
    cut = F.regexp_replace(F.substring(body, start + 1, end - start), r"\s+", " ")
    cut = F.trim(F.when(start > 0, F.regexp_replace(cut, r"^\S*\s", "")).otherwise(cut))
    return F.when(at >= 0, F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(end < F.length(body), "…").otherwise("")))


def match_ranges(text: Column, needle: Column, most: int = 50) -> Column:
    """Non-overlapping places [s, e) of a needle, whatever its case."""
    low, n = F.lower(text), F.length(needle)
    gaps = F.slice(F.split(low, F.concat(F.lit("\\Q"), F.lower(needle), F.lit("\\E")), -1), 1, most + 1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
    step = lambda acc, gap: F.struct((acc["at"] + F.length(gap) + n).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(gap)).alias("s"), (acc["at"] + F.length(gap) + n).alias("e")))).alias("out"))
    return F.when(F.size(gaps) > 1, F.aggregate(F.slice(gaps, F.lit(1), F.least(F.lit(most), F.size(gaps) - 1)), start, step, lambda acc: acc["out"])).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def slug_base(c: Column) -> Column:
    base = F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9\s-]", "")), r"\s+", "-")
    return F.when(base == "", "section").otherwise(base)


def float_label(heading: Column) -> Column:
    """struct(kind, label, caption) of a heading such as ``Table 2: caption``; null if it is none."""
    p = r"(?i)^(table|figure|fig\.?|scheme|box|equation|algorithm)\s*([0-9IVXivx]+[a-z]?)?\s*[.:—–-]?\s*(.*)$"
    part = lambda i: F.regexp_extract(F.trim(heading), p, i)
    word = F.lower(part(1))
    kind = F.when(word.startswith("t"), "table").when(word.startswith("e"), "equation").when(word.startswith("f"), "figure").otherwise("other")
    nice = F.when(kind == "other", part(1)).otherwise(F.initcap(kind))
    label = F.concat_ws(" ", nice, F.nullif(part(2), F.lit("")))
    return F.when(word != "", F.struct(kind.alias("kind"), label.alias("label"), F.trim(part(3)).alias("caption")))


def supplement(line: Column, pmcid: Column) -> Column:
    """struct(name, description, file, href) of a supplement's list item; null if it has no name."""
    text, tail = F.trim(line), r"(?i)\(file:\s*`?([^`)]+)`?\)\s*$"
    file = F.nullif(F.trim(F.regexp_extract(text, tail, 1)), F.lit(""))
    body, cut = F.trim(F.regexp_replace(text, tail, "")), r"(?s)^(.+?)(?::\s+|\s+[—–]\s+|\s+-\s+)(.*)$"
    bare = lambda c: F.trim(F.replace(c, F.lit("**"), F.lit("")))
    name = bare(F.when(body.rlike(cut), F.regexp_extract(body, cut, 1)).otherwise(body))
    url = F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/"), pmcid, F.lit("/bin/"), F.replace(F.url_encode(file), F.lit("+"), F.lit("%20")))
    href = F.when(file.isNull(), None).when(F.coalesce(pmcid, F.lit("")) != "", url).when(file.rlike("(?i)^https?://"), file)
    return F.when(name != "", F.struct(name.alias("name"), bare(F.regexp_extract(body, cut, 2)).alias("description"), file.alias("file"), href.alias("href")))


def tolerance(n: Column) -> Column:
    return F.when(n >= 14, 2).when(n >= 6, 1).otherwise(0)


def overlap_score(a: Column, b: Column) -> Column:
    """Different words of over two letters that two texts share."""
    long = lambda c: F.filter(F.split(normalize_key(c), " "), lambda w: F.length(w) > 2)
    return F.size(F.array_intersect(long(a), long(b)))


def yaml_escape(c: Column) -> Column:
    clean = F.replace(squeeze(c), F.lit('"'), F.lit("'"))
    return F.when(clean.rlike(r"[:#\-\[\]{}&*!|>%@`]"), F.concat(F.lit('"'), clean, F.lit('"'))).otherwise(clean)


def front_matter(*fields: tuple[str, Column]) -> Column:
    """The fields that aren't empty, in order, between rules."""
    lines = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), yaml_escape(v))) for k, v in fields]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))


def citation_line(journal: Column, year: Column, authors: Column, doi: Column, pmid: Column, pmcid: Column) -> Column:
    """A quoted line: journal and year, up to six authors, identifiers."""
    there = lambda c: F.nullif(c, F.lit(""))
    shown = F.concat(F.array_join(F.slice(authors, 1, 6), ", "), F.when(F.size(authors) > 6, ", et al.").otherwise(""))
    head = F.concat_ws(" ", there(journal), F.concat(F.lit("("), there(year), F.lit(")")))
    tail = F.concat_ws(" · ", F.concat(F.lit("DOI "), there(doi)), F.concat(F.lit("PMID "), there(pmid)), there(pmcid))
    return F.concat(F.lit("> "), F.concat_ws(" · ", there(head), there(shown), there(tail)))


def tidy_heading(c: Column) -> Column:
    """Squeezed, without a last full stop; headings in capitals only get title case, small words stay small."""
    clean = F.trim(F.regexp_replace(squeeze(c), r"\s*\.$", ""))
    letters = F.regexp_replace(clean, "[^A-Za-z]", "")
    titled = F.array_join(F.transform(F.split(F.lower(clean), "(?<=[ (])"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000))), "")
    for w in ("And", "Of", "The", "For", "In", "On", "To", "A", "An", "With"):
        titled = F.regexp_replace(titled, rf"\b{w}\b", w.lower())
    titled = F.concat(F.upper(F.substring(titled, 1, 1)), F.substring(titled, 2, 10_000))
    return F.when((F.length(letters) >= 3) & (F.upper(letters) == letters), titled).otherwise(clean)


def normalize_running(c: Column) -> Column:
    """A line as a running head: digits masked; null unless of 4 to 120 characters."""
    clean = squeeze(c)
    return F.when(F.length(clean).between(4, 120), F.regexp_replace(F.lower(clean), r"\d+", "#"))


def summarize_license(text: Column, href: Column) -> Column:
    """A short label for a licence's text and address; null if there is neither."""
    text, href = F.coalesce(text, F.lit("")), F.coalesce(href, F.lit(""))
    both = F.concat_ws(" ", href, text)
    has = lambda p: both.rlike(f"(?i){p}")
    last = F.when(has(r"no-?derivatives|/by-nd|-nd/"), "-ND").when(has("share-?alike|-sa/"), "-SA").otherwise("")
    commons = F.when(has("public domain|/zero/|cc0"), "CC0").otherwise(F.concat(F.lit("CC BY"), F.when(has("non-?commercial|/by-nc"), "-NC").otherwise(""), last))
    short = F.nullif(F.regexp_replace(F.substring(text, 1, 60), r"\s+\S*$", ""), F.lit(""))
    return F.when(has(r"creative commons|creativecommons\.org"), commons).when(has("open access"), "Open access").when(href != "", href).otherwise(short)


def abbreviation_signature(words_: Column) -> Column:
    """First letters; a word in capitals gives all of its letters."""
    letters = F.transform(words_, lambda w: F.regexp_replace(w, "[^A-Za-z]", ""))
    return F.array_join(F.transform(letters, lambda w: F.when((F.length(w) > 1) & (F.upper(w) == w), w).otherwise(F.substring(w, 1, 1))), "")


def auto_links(c: Column) -> Column:
    """array<struct(label, href)>: URLs, DOIs, PMCIDs and PMIDs of a text, without what ends a sentence."""
    p = r"(?i)https?://[^\s<>()\[\]]+|\b10\.\d{4,9}/[^\s<>()\[\],;]+|\bPMCID?\s*[:#]?\s*PMC\d+|\bPMC\d+\b|\bPMID\s*[:#]?\s*\d{1,9}\b"

    def link(token: Column) -> Column:
        t = F.regexp_replace(token, "[.,;]+$", "")
        article, entry = F.regexp_extract(t, r"(?i)PMC(\d+)", 1), F.regexp_extract(t, r"(?i)PMID\s*[:#]?\s*(\d{1,9})", 1)
        href = F.when(t.rlike("(?i)^https?://"), t).when(t.rlike(r"^10\.\d{4,9}/"), F.concat(F.lit("https://doi.org/"), t))
        href = href.when(article != "", F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/PMC"), article, F.lit("/")))
        return F.struct(t.alias("label"), href.when(entry != "", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), entry, F.lit("/"))).alias("href"))

    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(0)), link), lambda x: x["href"].isNotNull())


def has_article_body(xml: Column) -> Column:
    return xml.rlike(r"(?s)<body[\s>].{200,}?</body>")


def looks_like_html(c: Column) -> Column:
    return c.rlike(ANY_HTML)


def has_block_html(c: Column) -> Column:
    return c.rlike(BLOCK_HTML)


def is_reference_file(name: Column) -> Column:
    return name.rlike(rf"(?i)\.({EXTENSIONS})$")


def is_paper(set_id: Column) -> Column:
    return set_id.startswith("paper-")


def html_text(html: Column) -> Column:
    """Visible text of HTML by patterns alone: scripts, styles, comments and tags out, white space squeezed."""
    for p in (r"(?is)<script\b[^>]*>.*?</script>", r"(?is)<style\b[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"<[^>]*>"):
        html = F.regexp_replace(html, p, " ")
    return squeeze(html)


def heading_shift(html: Column) -> Column:
    levels = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<h([1-6])\b"), F.lit(1)), lambda x: x.cast("int"))
    return F.coalesce(F.array_min(levels) - 2, F.lit(0))


def format_ms(ms: Column) -> Column:
    seconds = F.floor(ms / 1000)
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))


def account_problem(email: Column, verified: Column) -> Column:
    """Why an account can't be synced; null if it can."""
    return F.when(F.trim(F.coalesce(email, F.lit(""))) == "", "missing-email").when(~F.coalesce(verified, F.lit(False)), "unverified-email")


def set_id(now_ms: Column, markdown: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.lower(F.conv(now_ms.cast("string"), 10, 36)), F.lit("-"), F.substring(hash_id(markdown), 1, 6))
