"""Personal data found by patterns and by information-theoretic sanitisation, in DataFrame operations alone.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers. The corpus then tells which of the other
words give protected entities away, as pointwise mutual information against the entity's own information content: a term
t discloses c if log2(p(t, c) / (p(t) p(c))) reaches ``DISCLOSES`` of log2(1 / p(c)). Probabilities are shares of all
documents of the corpus, and all words of whole documents are counted. Entities are of two kinds:

* Values: one address or number. A term must stand with it in at least ``SUPPORT`` different texts; each place of it in
  a document that holds the value is a span of kind ``term``.
* Classes: documents with any e-mail address, IP address, card, phone number or *code*, a word of at least ``CODE``
  letters and digits mixed, as keys and passwords are. Chance makes rare words fall into a class's documents alone, so
  p(t, c) is Wilson's lower bound at ``SURE`` deviations. A disclosing term is a span where it stands at most ``REACH``
  words before an entity of its class; a code so introduced is no more a chance string, but a secret, and a span as well.

A value in fewer than ``SUPPORT`` texts can have no disclosing term, so only its class tells something about it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.common import WORD, materialise, texts

SUPPORT, DISCLOSES = 3, 0.8
KINDS = ("email", "ip", "card", "phone")
CLASSES = (*KINDS, "code")
#: Characters that a code has at least, deviations of the lower bound, and words between a disclosing term and its entity.
CODE, SURE, REACH = 16, 3.0, 4
#: Fixed patterns of the base kinds. The look-behinds only keep the search linear: a match always begins its run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a kind's pattern to be worth a run.
NEEDS = {"email": "[A-Za-z0-9._%+-]@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"(?:[0-9][\x20-]?+){12}[0-9]", "phone": r"\+[0-9][\x20().0-9-]"}
#: A code: letters and digits mixed. Signs that keys are written with may stand between them.
CODES = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])(?=[0-9_+/=-]*+[A-Za-z])[A-Za-z0-9_+/=-]{%d,}+" % CODE
#: The last words of a text, ``REACH`` at most.
TAIL = rf"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){{0,{REACH}}}+$"
#: Stand for the characters of an entity, and for its last, where a text's other words are read.
HOLE, LAST = "\uffff", "\ufffe"
SPAN = "array<struct<start:int,end:int,value:string>>"


def _all(value: Column) -> Column:
    return F.lit(True)


def matches(text: Column, pattern: str, wanted: Callable[[Column], Column] = _all) -> Column:
    """Leftmost non-overlapping matches whose value is wanted as (start, end, value), in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    lens = F.transform(found, F.length)
    spans = F.arrays_zip(gaps.alias("gap"), lens.alias("len"), found.alias("value"))
    return F.aggregate(
        F.filter(spans, lambda x: x["value"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["len"]).alias("at"),
            F.when(wanted(x["value"]), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["len"]).alias("end"), x["value"].alias("value"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn sum that ends in 0."""
    each = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda d, i: d.cast("int") * (F.lit(1) + i % 2))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.lpad(F.regexp_replace(p, "^0+", ""), 3, "0") <= "255"))
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _valid_span(kind: str, span: Column) -> Column:
    return valid(kind, span["value"])


def _ends(span: Column) -> Column:
    return F.struct(span["start"].alias("start"), span["end"].alias("end"))


def entities(df: DataFrame) -> DataFrame:
    """Adds an array column of spans for each class to rows with a text that isn't null; codes touch no base span."""
    none = F.array().cast(SPAN)
    found = {k: F.when(F.rlike("text", F.lit(NEEDS[k])), F.filter(matches(F.col("text"), PATTERNS[k]), partial(_valid_span, k))).otherwise(none) for k in KINDS}
    code = F.when(F.rlike("text", F.lit(CODES)), matches(_holed(*KINDS), CODES)).otherwise(none)
    # every class but the first needs a digit: most texts of prose are settled by one look
    empty = F.struct(*(none.alias(k) for k in KINDS[1:]))
    digits = F.when(F.rlike("text", F.lit("[0-9]")), F.struct(*(found[k].alias(k) for k in KINDS[1:]))).otherwise(empty)
    df = df.withColumn("digits", digits).withColumn("email", F.when(F.contains("text", F.lit("@")), found["email"]).otherwise(none))
    df = df.withColumns({k: F.col("digits")[k] for k in KINDS[1:]})
    return df.withColumn("code", F.when(F.rlike("text", F.lit("[0-9]")), code).otherwise(none)).drop("digits")


def _any(kinds: tuple[str, ...]) -> Column:
    return sum((F.size(k) for k in kinds), F.lit(0)) > 0


def _key(kind: str, value: Column) -> Column:
    """The protected value as an entity: spelling doesn't matter."""
    plain = F.lower(value) if kind in ("email", "ip") else F.regexp_replace(value, "[^0-9]", "")
    return F.concat(F.lit(kind + ":"), plain)


def bare(word: Column) -> Column:
    """A word as a term: lower case, without punctuation at its ends."""
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def _hole(span: Column) -> Column:
    return F.struct(span["start"].alias("start"), span["end"].alias("end"), F.concat(F.repeat(F.lit(HOLE), span["end"] - span["start"] - 1), F.lit(LAST)).alias("mark"))


def _holed(*kinds: str) -> Column:
    """The text with its entities blanked; all else stays in place."""
    return _replaced(F.concat(*(F.transform(kind, _hole) for kind in kinds)))


def _whole(word: Column) -> Column:
    return ~word.contains(LAST)


def terms() -> Column:
    """The different terms of a row with spans: words with a letter that touch no entity."""
    words = F.filter(F.regexp_extract_all(_holed(*CLASSES), F.lit(WORD), F.lit(0)), _whole)
    return F.filter(F.array_distinct(F.transform(words, bare)), lambda t: t.rlike(r"\p{L}"))


def places(flagged: Column) -> Column:
    """The places of a row's flagged terms that touch no base span."""
    found = matches(_holed(*KINDS), WORD, lambda w: _whole(w) & F.array_contains(flagged, bare(w)))
    return F.transform(found, _ends)


def _entity(kind: str, span: Column) -> Column:
    return _key(kind, span["value"])


def _of_class(kind: str, span: Column) -> Column:
    value = span["value"] if kind == "code" else _key(kind, span["value"])
    return F.struct(span["start"].alias("start"), span["end"].alias("end"), F.lit(kind).alias("kind"), value.alias("key"))


def _apart(acc: Column, span: Column) -> Column:
    fresh = span["start"] >= acc["at"]
    return F.struct(F.greatest(acc["at"], span["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))


def introduced() -> Column:
    """A row's entities, those aside that begin in another, as (start, end, kind, key, tail): the words that stand before
    each, up to the entity before it. A text that holds the marks themselves has none."""
    kind = "array<struct<start:int,end:int,kind:string,key:string>>"
    every = F.array_sort(F.concat(*(F.transform(k, partial(_of_class, k)) for k in CLASSES)))
    outer = F.aggregate(every, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), _apart, lambda acc: acc["out"])
    gaps = F.split(_holed(*CLASSES), HOLE + "*" + LAST, -1)
    tails = F.transform(gaps, lambda g: F.regexp_extract(g, TAIL, 0))
    both = F.filter(F.transform(F.arrays_zip(outer.alias("e"), tails.alias("tail")), _with_tail), lambda x: x["start"].isNotNull())
    return F.when(F.rlike("text", F.lit(f"[{HOLE}{LAST}]")), F.slice(both, 1, 0)).otherwise(both)


def _with_tail(x: Column) -> Column:
    return F.struct(*(x["e"][f].alias(f) for f in ("start", "end", "kind", "key")), x["tail"].alias("tail"))


def _words_of(tail: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(tail, F.lit(WORD), F.lit(0)), bare), lambda t: t.rlike(r"\p{L}"))


def _introductions(flagged: Column, x: Column) -> Column:
    """Spans of the flagged terms before an entity and, if it is a code that has some, of the code."""
    before = x["start"] - F.length(x["tail"])
    known = lambda w: F.array_contains(flagged, F.concat(x["kind"], F.lit(":"), bare(w)))
    found = F.transform(matches(x["tail"], WORD, known), lambda y: F.struct((before + y["start"]).alias("start"), (before + y["end"]).alias("end")))
    return F.when((x["kind"] == "code") & (F.size(found) > 0), F.concat(found, F.array(_ends(x)))).otherwise(found)


def _marked(kind: str, span: Column) -> Column:
    return F.struct(span["start"].alias("start"), span["end"].alias("end"), F.lit(f"<{kind.upper()}>").alias("mark"))


def _sewn(acc: Column, span: Column) -> Column:
    fresh = span["start"] >= acc["at"]
    before = F.substring(F.col("text"), acc["at"] + 1, F.greatest(span["start"] - acc["at"], F.lit(0)))
    return F.struct(F.greatest(acc["at"], span["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], before, span["mark"])).otherwise(acc["out"]).alias("out"))


def _replaced(spans: Column) -> Column:
    every = F.array_sort(spans)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    sewn = F.aggregate(every, start, _sewn, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return F.when(F.size(every) == 0, F.col("text")).otherwise(sewn)


def redacted() -> Column:
    """The text of a row that ``find`` gave, its spans replaced by their kinds; a span that begins in another goes with it."""
    return _replaced(F.concat(*(F.transform(kind, partial(_marked, kind)) for kind in (*KINDS, "term"))))


def lower_bound(share: Column, cases: Column, sure: float = SURE) -> Column:
    """Wilson's lower bound of a share that so many independent cases show."""
    z2, n = F.lit(sure * sure), cases.cast("double")
    return (share + z2 / (2 * n) - F.lit(sure) * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def _disclosing(joint: DataFrame, of_term: DataFrame, n: int, share: Column, discloses: float) -> DataFrame:
    """(entity, term) whose information about the entity reaches its part of the entity's own."""
    whole = F.lit(float(max(n, 1)))
    gives = F.log2(whole * share / F.col("n_entity")) >= F.lit(discloses) * F.log2(whole / F.col("n_entity"))
    return joint.join(of_term, "term").where(gives & (F.col("n_entity") < whole)).select("entity", "term")


def _of_values(held: DataFrame, of_term: DataFrame, n: int, support: int, discloses: float) -> DataFrame:
    """(at, flagged): the terms that give away a value of the text."""
    named = F.concat(*(F.transform(kind, partial(_entity, kind)) for kind in KINDS))
    each = held.where(_any(KINDS)).select("at", F.explode(F.array_distinct(named)).alias("entity")).groupBy("entity", "at").agg(F.count("*").alias("copies"))
    of_entity = each.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("texts")).where(F.col("texts") >= support)
    shared = materialise(each.join(of_entity.drop("texts"), "entity"), "entities")
    known = held.select("at", "text", *CLASSES).join(shared.select("at").distinct(), "at", "left_semi").dropDuplicates(["at"]).select("at", terms().alias("terms"))
    beside = materialise(shared.join(known, "at").select("entity", "at", "copies", "n_entity", F.explode("terms").alias("term")), "beside")
    joint = beside.groupBy("entity", "term").agg(F.sum("copies").alias("both"), F.count("*").alias("texts"), F.first("n_entity").alias("n_entity")).where(F.col("texts") >= support)
    flagged = _disclosing(joint, of_term, n, F.col("both") / F.col("n_term"), discloses)
    return beside.join(flagged, ["entity", "term"]).groupBy("at").agg(F.collect_set("term").alias("flagged"))


def introducers(held: DataFrame, of_term: DataFrame, n: int, support: int, discloses: float) -> DataFrame:
    """(entity, term): for each class, the terms that disclose it. They stand before ``support`` different values at least."""
    met = held.select(F.explode("introduced").alias("x")).select(F.col("x.kind").alias("entity"), F.col("x.key").alias("key"), F.explode(_words_of(F.col("x.tail"))).alias("term"))
    before = materialise(met.groupBy("entity", "term").agg(F.count_distinct("key").alias("values")).where(F.col("values") >= support), "before")
    classes = F.filter(F.array(*(F.when(F.size(k) > 0, F.lit(k)) for k in CLASSES)), lambda c: c.isNotNull())
    of_class = held.select(F.explode(classes).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    asked = before.select("term").distinct()
    together = held.select(classes.alias("classes"), F.explode(terms()).alias("term")).join(asked, "term", "left_semi")
    both = together.select("term", F.explode("classes").alias("entity")).groupBy("entity", "term").agg(F.count("*").alias("both"))
    joint = before.join(both, ["entity", "term"]).join(of_class, "entity")
    return _disclosing(joint, of_term, n, lower_bound(F.col("both") / F.col("n_term"), F.col("values")), discloses)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, discloses: float = DISCLOSES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of df: doc_id, text, the columns to keep, an array of spans for each base kind, and ``term`` spans.

    Null and empty texts have no spans. Repeated rows each get a row with the same spans; null ids are kept. Terms are
    judged over the whole corpus, so equal texts have equal spans. No rows give no rows; other columns aren't read.
    """
    rows = entities(texts(df, id_col, text_col, keep).withColumn("at", F.xxhash64("text")))
    held = materialise(rows.where(_any(CLASSES)).withColumn("introduced", introduced()), "private")
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), bare))
    counted = texts(df, id_col, text_col).select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    n = df.count()
    of_term = materialise(counted.where(F.col("n_term") >= support), "terms") if not held.isEmpty() else counted
    values = _of_values(held, of_term, n, support, discloses)
    named = introducers(held, of_term, n, support, discloses)
    met = held.select("at", F.explode("introduced").alias("x")).select("at", F.col("x.kind").alias("entity"), F.explode(_words_of(F.col("x.tail"))).alias("term"))
    leads = met.distinct().join(named, ["entity", "term"]).groupBy("at").agg(F.collect_set(F.concat_ws(":", "entity", "term")).alias("leads"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    told = held.join(values, "at", "left").join(leads, "at", "left")
    by_value = F.when(F.col("flagged").isNull(), none).otherwise(places(F.col("flagged")))
    by_class = F.when(F.col("leads").isNull(), none).otherwise(F.flatten(F.transform("introduced", partial(_introductions, F.col("leads")))))
    told = told.select("doc_id", "text", *keep, *KINDS, F.array_sort(F.array_distinct(F.concat(by_value, by_class))).alias("term"))
    clear = rows.where(~_any(CLASSES)).select("doc_id", "text", *keep, *(F.array().cast(SPAN).alias(k) for k in KINDS), none.alias("term"))
    return told.unionByName(clear)
