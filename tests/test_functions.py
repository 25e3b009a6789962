"""Literal cases of the scalar functions and parsers."""

import re

import pytest
from lexiquarry.functions import html, markdown, python
from lexiquarry.functions import text as T
from pyspark.sql import functions as F


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "given, expected, correct, close",
    [("The Ribosome!", "ribosome", True, False), ("chloropalst", "chloroplast", True, False), ("cap", "cat", False, True), ("GDP", "GDP (gross domestic product)", True, False), ("  ", "anything", False, False), (None, "x", False, False), ("x", None, False, False)],
)
def test_answers(given, expected, correct, close):
    assert python.check(given, expected) == {"correct": correct, "close": close}


def test_osa_is_not_damerau():
    assert python.osa_distance("ab", "ba") == 1
    assert python.osa_distance("ca", "abc") == 3
    assert python.osa_distance("", "abc") == 3


@pytest.mark.parametrize(
    "text, found",
    [
        ("31000001\nPMC400002\n10.1234/abc.5", ["pmcid PMC400002", "doi 10.1234/abc.5", "pmid 31000001"]),
        ("J Test. 2019;12(4):133-148. PMID: 31000003.", ["pmid 31000003"]),
        ("(see 10.1234/S1473(09)7)", ["doi 10.1234/S1473(09)7"]),
        ("31000001 again PMID 31000001", ["pmid 31000001"]),
        ("papers printed in 2011 and 2014", []),
    ],
)
def test_identifiers(spark, text, found):
    assert [f"{x.kind} {x.value}" for x in value(spark, T.parse_paper_ids(F.lit(text)))] == found


@pytest.mark.parametrize(
    "sentence, section, result",
    [
        ("We observed that yield rose by 12% across all of the plots (p < 0.02).", "Results", ("finding", 13)),
        ("Our analysis suggests the new rule might help, but future work must test it.", "Discussion", ("finding", 8)),
        ("Plots were watered every second morning by the same two workers.", "Methods", None),
        ("We found it.", "Results", None),
    ],
)
def test_claims(spark, sentence, section, result):
    got = value(spark, T.score_claim(F.lit(sentence), F.lit(section)))
    assert (got and (got.kind, got.score)) == result


def test_strongest_claim(spark):
    """Of all pairs of patterns the highest base wins, whatever the order of the words; of equals, the first pattern."""
    said = (
        "we detected,we showed,in this study we,our work confirms,data reveal that,we argue,these findings imply,taken together,this paper provides,was markedly,risk of".split(",")
    )
    pairs = [(a, b, f"  So {said[a]} one part, and then {said[b]} all of the others.") for a in range(len(said)) for b in range(len(said))]
    pairs += [(0, 0, None), (0, 0, "We found it."), (0, 0, "Figure 1 is of what we found in all of the twelve plots."), (0, 0, "We found " + "x" * 400)]
    rows = spark.createDataFrame(pairs, "a int, b int, s string")
    got = {(r.a, r.b, r.s): r.c for r in rows.withColumn("c", T.score_claim(F.col("s"), F.lit("Methods"))).collect()}
    for a, b, s in pairs:
        text = (s or "").strip()
        best = None
        for p, kind, base in T.CLAIMS if 40 <= len(text) <= 400 and not text.startswith("Figure") else ():
            found = re.search(p, text, re.I)
            if found and (best is None or base > best[1]):
                best = (kind, base, found[0])
        assert (got[a, b, s] and tuple(got[a, b, s])) == best
        assert best or s is None or not s.startswith("  So")
    assert {c.trigger for c in got.values() if c} == set(said)


def test_numbers(spark):
    assert value(spark, T.find_numbers(F.lit("See DOI 10.5555/x1 and PMID 31000009."))) == []
    assert value(spark, T.find_numbers(F.lit("Sampling ran in 2017 and 2018."))) == []
    assert value(spark, T.find_numbers(F.lit("It was 10.0 and 12% of 300, then 12% (p < 0.01)."))) == ["10.0", "12%", "300", "p < 0.01"]


def test_hash_id(spark):
    assert value(spark, T.hash_id(F.lit("hello"))) == "4bj995"
    assert value(spark, T.hash_id(F.lit(""))) == "45h"


def test_questions(spark):
    for heading, question in (("2.1 Albedo", "What is the key idea in “Albedo”?"), ("Why light is fast", "Why is light fast?"), ("How these work", "How do these work?"), ("What it is", "What is it?"), ("Who pays?", "Who pays?"), ("When to stop", "When to stop?")):
        assert value(spark, T.question_from_heading(F.lit(heading))) == question


def test_concise(spark):
    long = "word " * 120
    out = value(spark, T.concise(F.lit(long)))
    assert len(out) <= 421 and out.endswith("…") and value(spark, T.concise(F.lit(" a  b "))) == "a b"


def test_speech(spark):
    parts = value(spark, T.speech_sentences(F.lit("One. Two! A" + ", ".join(["a clause of some words"] * 15) + ".")))
    assert parts[:2] == ["One.", "Two!"] and all(len(p) <= 245 for p in parts) and len(parts) == 4


def test_trim_doi(spark):
    for raw, clean in (("10.1/a(b).", "10.1/a(b)"), ("10.1/a).,", "10.1/a"), ("10.1/[x]]", "10.1/[x]")):
        assert value(spark, T.trim_doi(F.lit(raw))) == clean


def test_supplement_and_license(spark):
    s = value(spark, T.supplement(F.lit("**S1 Fig**: growth (file: `a b.pdf`)"), F.lit("PMC7")))
    assert (s.name, s.description, s.file) == ("S1 Fig", "growth", "a b.pdf") and s.href.endswith("/PMC7/bin/a%20b.pdf")
    assert value(spark, T.summarize_license(F.lit("Creative Commons Attribution Non-Commercial"), F.lit(""))) == "CC BY-NC"
    assert value(spark, T.summarize_license(F.lit(None).cast("string"), F.lit("http://creativecommons.org/licenses/by-sa/4.0"))) == "CC BY-SA"


def test_headings(spark):
    assert value(spark, T.tidy_heading(F.lit("MATERIALS AND METHODS."))) == "Materials and Methods"
    assert value(spark, T.tidy_heading(F.lit("Mixed Case"))) == "Mixed Case"
    label = value(spark, T.float_label(F.lit("Fig. 2b: growth")))
    assert (label.kind, label.label, label.caption) == ("figure", "Figure 2b", "growth")
    assert value(spark, T.float_label(F.lit("Growth"))) is None


def test_predicates(spark):
    yes = [T.is_non_study(F.lit("7. References")), T.is_reference_file(F.lit("a.RIS")), T.looks_like_html(F.lit("a <b>x</b>"))]
    no = [T.is_non_study(F.lit("Methods")), T.is_reasonable_term(F.lit("a | b")), T.has_block_html(F.lit("a <b>x</b>"))]
    assert all(value(spark, c) for c in yes) and not any(value(spark, c) for c in no)


def test_markdown_blocks():
    doc = markdown.parse("---\ntitle: 'T'\n---\n# A\n\n- **E**: x\n  - y\n- [x] z\n\n> q\n> ## in\n\n| a | b |\n|---|---|\n| 1 |\n\n```py\nx\n```\n\n# A\n\n***\n\nend `c` ![i](u) [l](v)")
    kinds = [(b["kind"], tuple(b["path"]), b["text"]) for b in doc["blocks"]]
    assert doc["title"] == "T" and doc["meta"] == {"title": "T"}
    assert kinds[:5] == [("heading", (0,), "A"), ("list", (1,), "E: x y z"), ("item", (1, 0), "E: x"), ("item", (1, 0, 0), "y"), ("item", (1, 1), "z")]
    assert [b["rows"] for b in doc["blocks"] if b["kind"] == "table"] == [[["1", ""]]]
    assert [b["slug"] for b in doc["blocks"] if b["kind"] == "heading"] == ["a", "in", "a-1"]
    assert [r["kind"] for r in doc["blocks"][-1]["inlines"]] == ["text", "code", "text", "image", "text", "link"]
    assert markdown.parse(None)["blocks"] == [] and markdown.parse("")["title"] is None


def test_html():
    assert html.to_markdown("<h4>One</h4><p>a <b>b</b> &amp; <i>c</i></p><ol><li>x<li>y</ol><a href='u'>l</a><script>no</script>") == "## One\n\na **b** & *c*\n\n1. x\n2. y\n\n[l](u)"
    nested = "<h2>T</h2>\n<ul><li>one <b> </b><ol><li>x</li><li>y</li></ol></li><li>two</li></ul><blockquote>q<br>r</blockquote><table><tr><td>1</td><td>2<sup>3</sup></td></tr></table><a>no</a> <a href=v>v</a>   end"
    assert html.to_markdown(nested) == "## T\n\n- one\n\n1. x\n2. y\n\n- two\n\n> q\nr\n\n 1 2^3\n\nno [v](v) end"
    assert [p["label"] for p in html.abstract_parts("BACKGROUND: a b. METHODS: c d.")] == ["Background", "Methods"]
    assert html.abstract_parts("no labels") == [] and html.to_markdown(None) == ""


def test_abbreviations():
    assert python.abbreviations("the gross domestic product (GDP) and ribosomal RNA (rRNA), (see)") == [{"abbreviation": "GDP", "expansion": "gross domestic product"}, {"abbreviation": "rRNA", "expansion": "ribosomal RNA"}]
