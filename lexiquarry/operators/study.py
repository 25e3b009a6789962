"""Term and cloze cards from block tables: candidates by rule, then windows for what comes first and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.functions import python
from lexiquarry.functions import text as T
from lexiquarry.operators import blocks as B

MAX_TERMS, MAX_CLOZES, MAX_SECTION_CARDS = 140, 60, 24
#: Fixed patterns of questions, answers and definitions.
MARK = r"\s*(?:\d+)?\s*[:.)\-–—]\s*"
QUESTION, ANSWER = rf"(?i)^(?:q|question){MARK}(.+)$", rf"(?i)^(?:a|answer){MARK}(.+)$"
BOTH = rf"(?i)^(.*?[?.!])\s+(?:a|answer){MARK}(.+)$"
SEPARATOR = r"^\s*(?:[:：]|[—–―]|::|[-=]{1,2})\s*"
CONNECTOR = r"(?i)^\s*(?:is|are|means?|refers? to|describes?|represents?|equals?|=)\s+"
IMPLICIT = r"(?i)^\s*(?:an?\s+|the\s+|how\s+|whether\s+|probability\b|ratio\b)"


def _card(term: Column, definition: Column, source: str) -> Column:
    return F.struct(term.alias("term"), definition.alias("definition"), F.lit(source).alias("source"))


def bold_term() -> Column:
    """A unit that begins in bold: the term; the rest defines it after a separator, a connector or an article."""
    first, rest = F.try_element_at("inlines", F.lit(1)), T.squeeze(F.array_join(F.transform(F.slice("inlines", 2, 10_000), lambda r: r["text"]), ""))
    term, colon = F.trim(first["text"]), r"[:：]\s*$"
    definition = (
        F.when(term.rlike(colon), F.trim(F.regexp_replace(rest, r"^\s*[—–\-]\s*", "")))
        .when(rest.rlike(SEPARATOR), F.trim(F.regexp_replace(rest, SEPARATOR, "")))
        .when(rest.rlike(CONNECTOR), F.trim(F.regexp_replace(rest, CONNECTOR, "")))
        .when(rest.rlike(IMPLICIT), rest)
    )
    name = F.trim(F.regexp_replace(term, colon, ""))
    good = (first["kind"] == "bold") & T.is_reasonable_term(name) & (F.length(definition) >= 4)
    return F.when(good, _card(name, definition, "bold"))


def colon_term() -> Column:
    """``Term: definition`` in a list item or a short paragraph."""
    kind = F.coalesce(F.try_element_at("inlines", F.lit(1))["kind"], F.lit(""))
    at = F.instr("text", ": ")
    term, definition = F.trim(F.substring("text", F.lit(1), at - 1)), F.trim(F.substring("text", at + 2, F.length("text")))
    good = ~kind.isin("bold", "link") & (F.col("is_item") | (F.length("text") <= 120)) & (at > 1) & T.is_reasonable_term(term) & (F.length(definition) >= 8)
    ratio = term.rlike(r"\d$") & definition.rlike(r"^\d")
    return F.when(good & ~ratio & ~F.col("text").rlike(QUESTION) & ~F.col("text").rlike(ANSWER), _card(term, definition, "colon"))


def unit_terms(units: DataFrame) -> DataFrame:
    """Units with a ``card`` where one of the rules gives one, and ``used`` where the unit went into a card."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    study = ~T.is_non_study(F.col("section"))
    question = F.regexp_extract("text", QUESTION, 1)
    rows = units.withColumns({"_q": F.when(study, question).otherwise(""), "_next": F.coalesce(F.lead("text").over(w), F.lit(""))})
    whole = F.col("_q").rlike(BOTH)
    pair = (F.col("_q") != "") & ~whole & F.col("_next").rlike(ANSWER)
    rows = rows.withColumn("_pair", pair).withColumn("_eaten", F.coalesce(F.lag("_pair").over(w), F.lit(False)))
    inline = _card(T.ensure_question_mark(F.regexp_extract("_q", BOTH, 1)), F.trim(F.regexp_extract("_q", BOTH, 2)), "qa")
    across = _card(T.ensure_question_mark(F.col("_q")), F.trim(F.regexp_extract("_next", ANSWER, 1)), "qa")
    card = F.when(~study | F.col("_eaten"), None).when((F.col("_q") != "") & whole, inline).when(F.col("_pair"), across).otherwise(F.coalesce(bold_term(), colon_term()))
    return B.once(rows, card=card).withColumn("used", F.col("card").isNotNull() | F.col("_eaten")).drop("_q", "_next", "_pair", "_eaten")


def table_terms(blocks: DataFrame) -> DataFrame:
    """Tables: the first cell is the term, the others define it, labelled if there are more than two columns.

    Empty cells are left out before the labels are counted, so labels move up; results depend on that.
    """
    rows = blocks.where((F.col("kind") == "table") & (F.size("header") >= 2) & ~T.is_non_study(F.col("section")))
    rows = rows.select("doc_id", "pos", "section", "header", F.posexplode("rows").alias("n", "row"))
    term, rest = F.trim(F.col("row")[0]), F.filter(F.slice("row", 2, 10_000), lambda c: F.trim(c) != "")

    def labelled(cell: Column, i: Column) -> Column:
        label = F.coalesce(F.trim(F.try_element_at("header", i + 2)), F.lit(""))
        return F.when(label != "", F.concat(label, F.lit(": "), cell)).otherwise(cell)

    definition = F.when(F.size("header") > 2, F.array_join(F.transform(rest, labelled), "; ")).otherwise(F.array_join(rest, "; "))
    return rows.where((term != "") & (F.size(rest) > 0) & T.is_reasonable_term(term)).select("doc_id", "pos", "n", "section", _card(term, definition, "table").alias("card"))


def _answer(parsed_blocks: Column, headings: Column, at: Column, depth: Column) -> Column:
    """What follows a heading up to the next of its level: paragraphs, or the first items or quote if there are none."""
    end = F.coalesce(F.array_min(F.transform(F.filter(headings, lambda h: (h["at"] > at) & (h["depth"] <= depth)), lambda h: h["at"])), F.size(parsed_blocks))

    def step(acc: Column, b: Column) -> Column:
        over = acc["over"] | (F.length(F.array_join(acc["parts"], " ")) >= 180)
        empty = F.size(acc["parts"]) == 0
        add = (
            F.when((b["kind"] == "para") & (F.length(b["text"]) >= 28), F.array(b["text"]))
            .when((b["kind"] == "list") & empty, F.array(b["lead"]))
            .when((b["kind"] == "quote") & empty & b["lead"].isNotNull(), F.array(b["lead"]))
            .otherwise(F.array().cast("array<string>"))
        )
        return F.struct(over.alias("over"), F.when(over, acc["parts"]).otherwise(F.concat(acc["parts"], add)).alias("parts"))

    start = F.struct(F.lit(False).alias("over"), F.array().cast("array<string>").alias("parts"))
    rest = F.slice(parsed_blocks, at + 2, F.greatest(end - at - 1, F.lit(0)))
    return T.concise(F.aggregate(rest, start, step, lambda acc: F.array_join(acc["parts"], " ")))


def section_terms(parsed: DataFrame) -> DataFrame:
    """A card for each heading of level 2 or 3 with enough under it; the first ``MAX_SECTION_CARDS`` of a document."""

    # what a block holds stands between it and the next at the top
    tops = F.filter(F.transform("blocks", lambda b, i: F.struct(b["kind"].alias("kind"), b["depth"].alias("depth"), b["text"].alias("text"), F.size(b["path"]).alias("level"), i.alias("i"))), lambda b: b["level"] == 1)
    rows = B.once(parsed.select("doc_id", "blocks"), tops=tops)

    def lead(b: Column, k: Column) -> Column:
        next_ = F.coalesce(F.try_element_at("tops", k + 2)["i"], F.size("blocks"))
        below = lambda kind: F.filter(F.slice("blocks", b["i"] + 2, next_ - b["i"] - 1), lambda x: (x["kind"] == kind) & (F.size(x["path"]) == 2))
        items = F.array_join(F.transform(F.slice(below("item"), 1, 3), lambda x: x["text"]), " ")
        return F.when(b["kind"] == "list", items).when(b["kind"] == "quote", F.try_element_at(below("para"), F.lit(1))["text"])

    top = F.transform("tops", lambda b, k: F.struct(b["kind"].alias("kind"), b["depth"].alias("depth"), b["text"].alias("text"), lead(b, k).alias("lead")))
    heads = F.filter(F.transform("tops", lambda b, k: F.struct(k.alias("at"), b["depth"].alias("depth"), b["kind"].alias("kind"), b["text"].alias("text"))), lambda h: h["kind"] == "heading")
    rows = B.once(rows.select("doc_id", "blocks", "tops"), top=top, heads=heads).select("doc_id", "top", "heads", F.explode("heads").alias("b")).where("b.depth between 2 and 3")
    heading = T.bare_heading(F.col("b.text"))
    rows = rows.where((heading != "") & ~T.is_non_question(heading)).select("doc_id", F.col("b.at").alias("pos"), "top", "heads", "b", heading.alias("section"))
    rows = B.once(rows, answer=_answer(F.col("top"), F.col("heads"), F.col("pos"), F.col("b.depth"))).select("doc_id", "pos", "section", "answer").where(F.length("answer") >= 35)
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return rows.withColumn("n", n).where(F.col("n") <= MAX_SECTION_CARDS).select("doc_id", "pos", "n", "section", _card(T.question_from_heading(F.col("section")), F.col("answer"), "section").alias("card"))


def dealt(rows: DataFrame, parts: int | None) -> DataFrame:
    """Rows by document in so many partitions, for all that follows by document; None leaves them to the session."""
    return rows.repartition(parts, "doc_id") if parts else rows


def terms(parsed: DataFrame, blocks: DataFrame, marked: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n, id, term, definition, section, source: one card a normalised term.

    The first candidate names the card, the longest definition (the first of equals) defines it. Candidates after the one
    that gave the last card under the cap don't count at all.
    """
    none = F.lit(0)
    every = marked.where("card is not null").select("doc_id", F.lit(1).alias("phase"), "pos", none.alias("n"), "section", "card")
    every = every.unionByName(table_terms(blocks).withColumn("phase", F.lit(2))).unionByName(section_terms(parsed).withColumn("phase", F.lit(3)))
    rows = every.select("doc_id", F.struct("phase", "pos", "n").alias("at"), "section", F.trim("card.term").alias("term"), T.concise(F.col("card.definition")).alias("definition"), "card.source")
    rows = rows.withColumns({"key": python.normalize_key(F.col("term")), "sense": python.normalize_key(F.col("definition"))})
    rows = dealt(rows.where((F.col("key") != "") & (F.length("definition") >= 4)), parts)
    new = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("at")) == 1
    order = Window.partitionBy("doc_id").orderBy("at")
    rows = rows.withColumn("new", new).withColumn("before", F.sum(F.col("new").cast("int")).over(order) - F.col("new").cast("int")).where(F.col("before") < MAX_TERMS)
    first = F.min_by(F.struct("term", "section", "source", "sense"), "at")
    best = F.max_by("definition", F.struct(F.length("definition").alias("l"), (-F.col("at.phase")).alias("p"), (-F.col("at.pos")).alias("q"), (-F.col("at.n")).alias("r")))
    cards = rows.groupBy("doc_id", "key").agg(F.min("at").alias("at"), first.alias("f"), best.alias("definition"))
    ident = T.hash_id(F.concat_ws("|", F.lit("term"), "key", F.substring("f.sense", 1, 40)))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1
    return cards.select("doc_id", n.alias("n"), ident.alias("id"), "f.term", "definition", "f.section", "f.source", F.split("key", " ")[0].alias("token"))


def _quoted(term: Column) -> Column:
    return F.concat(F.lit("\\Q"), term, F.lit("\\E"))


def clozes(marked: DataFrame, cards: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n, id, prompt, answer, section: prose sentences with a bold span or else the longest known term blanked, then
    definitions; each prompt once, the first ``MAX_CLOZES``. A document's cards, at most ``MAX_TERMS``, go along with it as
    one array, so that they are made once and sentences meet them where they are."""
    used = F.max("used").over(Window.partitionBy("doc_id", "text"))
    prose = marked.withColumn("used", used).where(~F.col("used") & ~T.is_non_study(F.col("section")))
    prose = prose.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "section", "inlines", "text")).alias("prose"))
    known = cards.where("source <> 'section'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "term", "definition", "section", "token"))).alias("cards"))
    both = prose.hint("merge").join(known, "doc_id", "full_outer")
    none, text = F.array(), F.lit(None).cast("string")
    row = lambda phase, pos, section, inlines, passage, term, definition: F.struct(F.lit(phase).alias("phase"), pos.alias("pos"), section.alias("section"), inlines.alias("inlines"), passage.alias("text"), term.alias("term"), definition.alias("definition"))
    units = F.transform("prose", lambda u: row(1, u["pos"], u["section"], u["inlines"], u["text"], text, text))
    defined = F.transform("cards", lambda c: row(2, c["n"], c["section"], F.lit(None).cast(marked.schema["inlines"].dataType), text, c["term"], c["definition"]))
    terms_ = F.filter(F.transform("cards", lambda c: F.struct(c["n"].alias("tn"), c["term"].alias("term"), c["token"].alias("token"))), lambda c: (F.length(c["term"]) >= 3) & ~c["term"].rlike("[?？]$"))
    rows = both.select("doc_id", F.coalesce(terms_, none).alias("known"), F.explode(F.concat(F.coalesce(units, none), F.coalesce(defined, none))).alias("u")).select("doc_id", "known", "u.*")
    said = F.when(F.col("phase") == 1, T.study_sentences(F.col("text"))).otherwise(F.array(F.col("definition")))
    rows = rows.select("doc_id", "known", "phase", "pos", "section", "inlines", "term", F.posexplode(said).alias("s", "sentence"))
    rows = rows.withColumn("words", F.split(python.normalize_key(F.when(F.col("phase") == 1, F.col("sentence"))), " "))
    bold = F.filter(F.transform(F.filter("inlines", lambda r: r["kind"] == "bold"), lambda r: F.trim(r["text"])), lambda b: (b != "") & F.lower("sentence").contains(F.lower(b)) & T.is_useful_cloze(b, F.col("sentence")))
    longest = F.aggregate(bold, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    short = lambda x: F.when((x != "") & (F.length(x) < F.length("sentence") * 0.8), x)
    # a term can only stand in a sentence that has its first word: that first, then the pattern
    stands = F.filter("known", lambda k: F.array_contains("words", k["token"]) & F.rlike(F.col("sentence"), F.concat(F.lit(r"(?i)\b"), _quoted(k["term"]), F.lit(r"\b"))))
    found = F.array_max(F.transform(stands, lambda k: F.struct(F.length(k["term"]).alias("l"), (-k["tn"]).alias("o"), k["term"].alias("term"))))["term"]
    usable = lambda x: F.when((F.length(x) < F.length("sentence") * 0.8) & T.is_useful_cloze(x, F.col("sentence")), x)
    answer = F.coalesce(T.let(longest, short), T.let(found, usable))
    blanked = lambda x, edge: F.regexp_replace(x, F.concat(F.lit(rf"(?i){edge}"), _quoted(F.col("answer")), F.lit(edge)), F.lit(T.BLANK))
    clean = T.squeeze(F.col("sentence"))
    asked = B.once(rows, answer=F.when(F.col("phase") == 1, answer).otherwise(F.col("term"))).where("answer is not null")
    asked = asked.select("doc_id", "phase", "pos", "s", "section", "answer", F.when(F.col("phase") == 1, clean).otherwise(F.col("sentence")).alias("sentence"))
    asked = B.once(asked, prompt=F.when(F.col("phase") == 1, blanked("sentence", "")).otherwise(F.concat(F.lit(f"{T.BLANK} — "), blanked("sentence", r"\b"))))
    whole = F.length("sentence").between(30, 280) & F.length("answer").between(2, 60) & F.col("answer").rlike("[a-zA-Z0-9]") & F.col("prompt").contains(T.BLANK) & (F.length(F.trim(F.regexp_replace("prompt", "_", ""))) >= 15)
    line = F.concat("answer", F.lit(" — "), "sentence")
    good = (F.length("sentence") >= 12) & ~F.col("answer").rlike("[?？]$") & ~F.col("answer").rlike(r"(?i)^(?:update|note|caveat)\b") & T.is_useful_cloze(F.col("answer"), line)
    every = asked.where(F.when(F.col("phase") == 1, whole).otherwise(good)).select("doc_id", F.struct("phase", "pos", "s").alias("at"), "section", "answer", "prompt")
    every = dealt(every.withColumn("key", python.normalize_key(F.col("prompt"))), parts)
    first = every.groupBy("doc_id", "key").agg(F.min_by(F.struct("at", "prompt", "answer", "section"), "at").alias("f")).select("doc_id", "key", "f.*")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1
    ident = T.hash_id(F.concat_ws("|", F.lit("cloze"), "key", python.normalize_key(F.col("answer"))))
    return first.withColumn("n", n).where(F.col("n") < MAX_CLOZES).select("doc_id", "n", ident.alias("id"), "prompt", "answer", "section")


def study(df: DataFrame, id_col: str = "doc_id", markdown_col: str = "markdown", parts: int | None = None) -> dict[str, DataFrame]:
    """All study material of Markdown documents: blocks, terms, clozes, outline, stats; and ``parsed``, which is cached for
    them all, to be unpersisted when they have been read. Tables are dealt by document to ``parts`` partitions, if given.
    Counts are joined by merges: a table of all documents isn't broadcast."""
    parsed = dealt(B.parse_documents(df, id_col, markdown_col), parts).cache()  # five tables derive from it; the parser is Python
    table = B.block_table(parsed)
    marked = unit_terms(B.units(table))
    cards = terms(parsed, table, marked, parts)
    gaps = clozes(marked, cards, parts)
    outline = B.outline(table)
    count = lambda t, name: t.groupBy("doc_id").agg(F.count("*").alias(name)).hint("merge")
    stats = parsed.select("doc_id").join(B.document_words(table).hint("merge"), "doc_id", "left")
    for t, name in ((outline, "sections"), (cards, "terms"), (gaps, "clozes")):
        stats = stats.join(count(t, name), "doc_id", "left")
    stats = stats.fillna(0).withColumn("minutes", F.greatest(F.lit(1), F.floor(F.col("words") / 200 + 0.5)).cast("long"))
    return {"parsed": parsed, "blocks": table, "terms": cards.drop("token"), "clozes": gaps, "outline": outline, "stats": stats}
