"""Operators on literal rows: merges, search, study material, quizzes, storage, streams."""

import json
import re
import zipfile

import pytest
from lexiquarry.operators import blocks, library, progress, quiz, search, study, sync, views
from lexiquarry.sources import readers, writers
from lexiquarry.streaming import feeds
from pyspark.sql import functions as F

SETS = "id string, title string, markdown string, created_at bigint, updated_at bigint"
NOTE = """---
title: Light
---
# Light

## Terms

- **Albedo**: share of light a surface reflects
- Photon: a packet of light energy
- **Albedo**: the share of all of the light that a surface reflects back
- https://example.com: no

Q: What melts?

A: The ice does melt.

| Term | Meaning | Year |
|---|---|---|
| Lux | light on a surface | 1889 |
| Nit | | 1948 |

## 2. Why snow is bright

The **albedo** of fresh snow is far above that of the open sea in summer. A photon meets many grains there.

> ## Aside
> Many grains scatter a photon again and again in the snow.

## References

- Someone: a paper about snow
"""


def note(spark, text=NOTE):
    return study.study(spark.createDataFrame([(1, text)], "doc_id int, markdown string"))


def test_terms(spark):
    rows = note(spark)["terms"].orderBy("n").collect()
    got = [(r.term, r.definition, r.section, r.source) for r in rows]
    assert got[:6] == [
        ("Albedo", "the share of all of the light that a surface reflects back", "Terms", "bold"),
        ("Photon", "a packet of light energy", "Terms", "colon"),
        ("What melts?", "The ice does melt.", "Terms", "qa"),
        ("Lux", "Meaning: light on a surface; Year: 1889", "Terms", "table"),
        ("Nit", "Meaning: 1948", "Terms", "table"),
        ("What is the key idea in “Terms”?", got[5][1], "Terms", "section"),
    ]
    assert got[6][0] == "Why is snow bright?" and len(got) == 7


def test_clozes_and_stats(spark):
    made = note(spark)
    rows = made["clozes"].orderBy("n").collect()
    assert rows[0].prompt == "The ____ of fresh snow is far above that of the open sea in summer." and rows[0].answer == "albedo"
    assert {"Photon"} < {r.answer for r in rows} and all("____" in r.prompt for r in rows)
    stats = made["stats"].first()
    assert (stats.sections, stats.terms, stats.minutes) == (4, 7, 1) and stats.words > 80
    assert [r.title for r in made["outline"].orderBy("pos").collect()] == ["Light", "Terms", "2. Why snow is bright", "References"]


def test_empty_notes(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "plain")], "doc_id int, markdown string")
    made = study.study(df)
    assert made["terms"].count() == 0 and made["clozes"].count() == 0
    assert {r.doc_id: r.words for r in made["stats"].collect()} == {1: 0, 2: 0, 3: 1}


def test_quiz_is_reproducible(spark):
    draw = quiz.generator(42)
    assert [round(draw(), 6) for _ in range(3)] == [0.601104, 0.448291, 0.852466]
    terms = [{"id": str(i), "term": f"term {w}", "definition": f"the {w} thing", "section": "s", "source": "bold"} for i, w in enumerate("one two three four five".split())]
    a, b, c = quiz.build(terms, [], 3, 7), quiz.build(terms, [], 3, 7), quiz.build(terms, [], 3, 8)
    assert a == b and a != c and len(a) == 3
    assert all(q["options"][q["answer"]] in [t["term"] for t in terms] + [t["definition"] for t in terms] and len(set(q["options"])) == len(q["options"]) for q in a)
    assert quiz.build(terms[:3], [], 3, 7) == []


PAPER = """# P

## Results

We found that the yield rose by 12% across all of the plots (p < 0.02). It was so.

#### Table 1. Sizes

| a | b |
|---|---|
| 1 | 2 |

#### Figure 2. Growth

![x](u.png)

It grew over time.

```math
x = 1
```

## Data availability

All of the data are in a public archive that anyone can use.

## Supplementary material

- **S1 Fig**: growth (file: `s1.pdf`)
"""


def test_views(spark):
    parsed = blocks.parse_documents(spark.createDataFrame([(1, PAPER)], "doc_id int, markdown string"))
    table = blocks.block_table(parsed)
    rows = {(r.kind, r.label): r for r in views.floats(parsed).collect()}
    assert set(rows) == {("table", "Table 1"), ("figure", "Figure 2"), ("equation", "Equation 1")}
    figure = rows["figure", "Figure 2"]
    assert figure.image == "u.png" and figure.caption == "Growth It grew over time." and rows["table", "Table 1"].caption == "Sizes"
    claim = views.claims(views.sentences(table)).first()
    assert (claim.kind, claim.score, claim.rank) == ("finding", 13, 1)
    assert [r.value for r in views.numbers(views.sentences(table)).orderBy("n").collect()] == ["12%", "p < 0.02"]
    assert views.availability(table).first().title == "Data availability" and views.supplements(table).first().file == "s1.pdf"
    skim = {r.title: r for r in views.skim(table).collect()}
    assert skim["Results"].gist.startswith("We found") and skim["Results"].numbers == ["12%", "p < 0.02"] and "P" not in skim
    found = search.in_document(table, "GREW")
    hits = found.collect()
    assert len(hits) == 1 and [(r.s, r.e) for r in hits[0].ranges] == [(3, 7)]
    parts = hits[0].text
    marked = found.select(search.highlight(F.col("text"), F.col("ranges")).alias("h")).first().h
    assert "".join(p.text for p in marked) == parts and [p.text for p in marked if p.marked] == ["grew"]


def test_mastery(spark):
    answers = [("a", 1, True), ("b", 1, True), ("b", 2, True), ("b", 3, True), ("c", 1, True), ("c", 2, True), ("c", 3, False), ("d", 1, False), ("d", 2, True)]
    events = spark.createDataFrame(answers, "card_id string, ts int, correct boolean")
    got = {r.card_id: (r.box, r.seen) for r in progress.boxes(events, ["card_id"]).collect()}
    assert got == {"a": (2, 1), "b": (3, 3), "c": (1, 3), "d": (2, 2)}
    cards = spark.createDataFrame([("s", "b"), ("s", "c"), ("s", "none")], "set_id string, card_id string")
    assert progress.mastery_percent(cards, progress.boxes(events, ["card_id"]), ["card_id"], ["set_id"]).first().percent == 44
    last = progress.trajectory(events, ["card_id"], ["ts"]).groupBy("card_id").agg(F.max_by("box", "ts").alias("box"))
    assert {r.card_id: r.box for r in last.collect()} == {k: v[0] for k, v in got.items()}


def rows(spark, data, schema=SETS):
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize(
    "local, tomb, remote, alive, updated, tombstone",
    [
        ((10,), None, (20, False, None), True, 20, None),
        ((30,), None, (20, False, None), True, 30, None),
        ((20,), None, (20, False, None), True, 20, None),
        ((30,), None, (20, True, 20), True, 30, None),
        ((10,), None, (20, True, None), False, None, 20),
        (None, 50, (40, False, None), False, None, 50),
        (None, 50, (60, False, None), True, 60, None),
        (None, 10, (5, True, 30), False, None, 30),
    ],
)
def test_merge_truth_table(spark, local, tomb, remote, alive, updated, tombstone):
    sets = rows(spark, [("x", "t", "m", 1, local[0])] if local else [])
    tombs = spark.createDataFrame([("x", tomb)] if tomb else [], "id string, deleted_at bigint")
    far = spark.createDataFrame([("x", "t2", "m2", 1, remote[0], remote[1], remote[2])], feeds.CHANGE)
    once = sync.merge_sets(sets, tombs, far).first()
    assert (once.alive, once.updated_at, once.deleted_at) == (alive, updated, tombstone)


def test_push(spark):
    sets = rows(spark, [("new", "t", "m", 1, 9), ("old", "t", "m", 1, 5), ("big", "t", "x" * 600_001, 1, 9)])
    tombs = spark.createDataFrame([("gone", 50), ("later", 50)], "id string, deleted_at bigint")
    index = spark.createDataFrame([("old", 1, 5, False, None), ("later", 1, 60, False, None)], "id string, created_at bigint, updated_at bigint, deleted boolean, deleted_at bigint")
    assert {(r.kind, r.id) for r in sync.plan_push(sets, tombs, index).collect()} == {("set", "new"), ("oversized", "big"), ("tombstone", "gone")}


def test_cards(spark):
    schema = "set_id string, card_id string, box int, seen bigint, correct bigint, wrong bigint, starred boolean, last bigint"
    a = spark.createDataFrame([("s", "a", 1, 1, 1, 0, False, 200), ("s", "b", 1, 1, 1, 0, False, 200)], schema)
    b = spark.createDataFrame([("s", "a", 3, 2, 2, 0, True, 300), ("s", "b", 3, 2, 2, 0, True, 200), ("s", "c", 2, 1, 1, 0, False, 1)], schema)
    assert {r.card_id: r.box for r in sync.merge_cards(a, b).collect()} == {"a": 3, "b": 1, "c": 2}
    best = spark.range(1).select(progress.best_time(F.lit(9000), F.lit(7000)).alias("x"), progress.best_time(F.lit(None).cast("int"), F.lit(-1)).alias("y")).first()
    assert (best.x, best.y) == (7000, None)


def test_violations(spark):
    new = spark.createDataFrame([("ok", "t", "m", 1, 2, False, None), ("bad id!", "", "m", 5, 2, True, None)], feeds.CHANGE)
    old = spark.createDataFrame([("ok", 2, 9)], "id string, created_at bigint, updated_at bigint")
    got = {r.id: r.violations for r in sync.violations(new, old).collect()}
    assert got == {"ok": ["created_at changes", "updated_at goes back"], "bad id!": ["id", "title", "updated_at", "tombstone"]}


def test_search(spark):
    papers = spark.createDataFrame(
        [("1", "Snow and ice", "Roe A", "J Cold", "2020", "31000001", None, None, "---\nx\n---\nAbout glaciers"), ("2", "Ice", None, None, None, None, None, None, "snow is in the text only, far " + "on " * 60 + "glaciers")],
        "id string, title string, authors string, journal string, year string, pmid string, pmcid string, doi string, body string",
    )
    found = {r.id: r for r in search.search(papers, ["ice", "snow"]).collect()}
    assert found["1"].score == 20 + 30 and found["2"].score == 30 + 3 and found["2"].fields == ["title", "text"] and found["2"].snippet.startswith("snow is in")
    assert [r.id for r in search.ranked(search.search(papers, ["31000001"])).collect()] == ["1"] and search.search(papers, ["31000001"]).first().score == 100
    assert search.search(papers, ["snow", "nowhere"]).count() == 0 and search.search(papers, []).count() == 2


def test_library_json(spark):
    data = {"sets": [{"id": "a", "title": " ", "markdown": "m"}, {"id": "a", "title": "second", "markdown": "n"}, {"id": "b"}], "progress": {"a": {"cards": {"c": {"box": 7, "seen": 2}}, "bestMatchMs": -1}}, "tombstones": {"z": 5, "y": 0}}
    tables = library.load_library(spark.createDataFrame([(json.dumps(data),), ("{broken",)], "json string"))
    assert [(r.id, r.title, r.markdown, r.updated_at) for r in tables["sets"].collect()] == [("a", "Untitled set", "m", 0)]
    assert [(r.box, r.seen) for r in tables["cards"].collect()] == [(0, 2)] and tables["best"].count() == 0 and [r.id for r in tables["tombstones"].collect()] == ["z"]


def test_storage(spark, tmp_path):
    sets = rows(spark, [("a", "Título: one", "# x", 1, 2)])
    writers.export_sets(sets, str(tmp_path / "out"))
    good, bad = library.parse_exports(spark.read.text(str(tmp_path / "out"), wholetext=True).withColumnRenamed("value", "json"))
    assert good.first().markdown == "# x" and bad.count() == 0
    assert sets.select(writers.file_name(F.col("title")).alias("f")).first().f == "t-tulo-one.md"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# Head\ntext")
    (tmp_path / "in" / "b.txt").write_text("no heading")
    with zipfile.ZipFile(tmp_path / "in" / "c.docx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<w:p><w:r><w:t>One &amp;</w:t></w:r><w:r><w:t xml:space='preserve'> two</w:t></w:r></w:p><w:p></w:p>")
    (tmp_path / "in" / "d.docx").write_bytes(b"broken")
    assert {r.path[-4:]: r.title for r in readers.markdown_files(spark, str(tmp_path / "in")).collect()} == {"a.md": "Head", ".txt": "Untitled set"}
    lists = {r.path[-6:]: (r.text, r.error) for r in readers.reference_lists(spark, str(tmp_path / "in")).collect()}
    assert lists["c.docx"] == ("One & two", None) and lists["d.docx"] == (None, "no readable document")
    parts = spark.createDataFrame([("u 1", "x"), ("u2", "y")], "uid string, id string")
    writers.save_account(parts, str(tmp_path / "acc"))
    writers.save_account(parts.where("uid = 'u2'").withColumn("id", F.lit("z")), str(tmp_path / "acc"))
    assert readers.account_library(spark, str(tmp_path / "acc"), "u 1").first().id == "x" and readers.account_library(spark, str(tmp_path / "acc"), "u2").first().id == "z"


def test_stream_equals_batch(spark, tmp_path):
    changes = [("a", "t1", "m", 1, 10, False, None), ("b", "t", "m", 1, 10, False, None), ("a", "t2", "m", 1, 20, False, None), ("b", "t", "", 1, 30, True, 30), ("a", "old", "m", 1, 5, False, None)]
    source = tmp_path / "changes"
    source.mkdir()
    names = feeds.CHANGE.replace(" bigint", "").replace(" string", "").replace(" boolean", "").split(", ")
    store = feeds.SetStore(spark, str(tmp_path / "state"))
    for i, change in enumerate(changes):
        (source / f"{i}.json").write_text(json.dumps(dict(zip(names, change))))
        feeds.fold_changes(spark, str(source), store, str(tmp_path / "ck"), {"availableNow": True}).awaitTermination()
    state = {r.id: (r.alive, r.title, r.deleted_at) for r in store.read().collect()}
    assert state == {"a": (True, "t2", None), "b": (False, None, 30)}


def test_mastery_stream(spark, tmp_path):
    (tmp_path / "answers").mkdir()
    data = [("s", "c", True, 1), ("s", "c", True, 2), ("s", "c", False, 3), ("s", "c", True, 4)]
    for i, row in enumerate(data):
        (tmp_path / "answers" / f"{i}.json").write_text(json.dumps(dict(zip(("set_id", "card_id", "correct", "ts"), row))))
    stream = spark.readStream.schema(feeds.ANSWER).option("maxFilesPerTrigger", 4).json(str(tmp_path / "answers"))
    query = feeds.mastery(stream).writeStream.format("memory").queryName("mastery").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.table("mastery").orderBy(F.desc("seen")).first()
    batch = progress.boxes(spark.createDataFrame(data, feeds.ANSWER), ["set_id", "card_id"]).first()
    assert (last.box, last.seen, last.correct, last.wrong, last.last) == (batch.box, batch.seen, batch.correct, batch.wrong, batch.last) == (2, 4, 3, 1, 4)


def test_small_operators(spark):
    made = note(spark)
    assert {r.text for r in views.known_bold(made["blocks"], made["terms"]).collect()} == {"Albedo", "albedo"}
    routes = library.route_imports(spark.createDataFrame([("nothing",), ("PMID: 31000001",), ("31000001 and PMC400002",), ("12",)], "text string"))
    assert [r.route for r in routes.collect()] == ["error", "lookup", "bulk", "lookup"]
    record = spark.createDataFrame([("1", None, None, "A title.", "Roe A, Doe B.", "J", 2020)], "pmid string, pmcid string, doi string, title string, author_string string, journal string, pub_year int")
    meta = library.record_meta(record).first()
    assert (meta.title, meta.authors, meta.year) == ("A title", ["Roe A", "Doe B"], "2020")
    given = spark.createDataFrame([("s", "c", "ribosme", "ribosome", 5)], "set_id string, card_id string, given string, expected string, ts bigint")
    assert library.answer_events(given).first().correct
    abstract = "Author information: " + "x " * 200 + "\n\n" + "A long paragraph. " * 15 + "\n\nShort."
    assert spark.range(1).select(readers.best_abstract(F.lit(abstract)).alias("a")).first().a.startswith("A long paragraph.")
    a, b = (spark.createDataFrame(rows, "id string, x string, y string") for rows in ([("1", None, "a")], [("1", "b", "c"), ("2", "d", None)]))
    assert {tuple(r) for r in readers.prefer(a, b, "id").collect()} == {("1", "b", "a"), ("2", "d", None)}
    drafts = spark.createDataFrame([(0, " ", "# x"), (1, "T", "# y")], "pos int, title string, markdown string")
    sets = library.create_sets(drafts, 1_700_000_000_000)
    assert {r.title for r in sets.collect()} == {"Untitled set", "T"} and sets.select("id").distinct().count() == 2
    kept = library.refresh(spark.createDataFrame([("a", "full", True), ("b", "abs", False)], "id string, markdown string, full boolean"), spark.createDataFrame([("a", "abs", False), ("b", "full", True)], "id string, markdown string, full boolean"))
    assert {r.id: (r.markdown, r.changed) for r in kept.collect()} == {"a": ("full", False), "b": ("full", True)}
    rounds = spark.createDataFrame([(1, "p", "term"), (2, "p", "term")], "round int, pair_id string, side string"), spark.createDataFrame([(1, "p", "definition"), (2, "p", "term")], "round int, pair_id string, side string")
    assert {r.round: r.matched for r in quiz.clicks(*rounds).collect()} == {1: True, 2: False}


def test_notes_hold_every_part(spark):
    from lexiquarry.plans import papers

    made = [r.markdown for r in papers.notes(spark, "/root/testdata/sf0.01").collect()]
    keys = [int(k) for m in made for k in re.findall(r"^- Part (\d+):", m, re.M)]
    assert sorted(keys) == sorted(r.p_partkey for r in spark.read.parquet("/root/testdata/sf0.01/part.parquet").select("p_partkey").collect())
    assert max(m.count("\n- Part ") for m in made) <= papers.NOTE_KEYS


def test_searches_leave_no_row_out(spark, tmp_path):
    from lexiquarry.plans import documents

    rows = [(1, "see src3 in the text", None), (2, "all the rest", "src30"), (3, "the " * 100_001, "src3")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in documents.library_search(spark, str(tmp_path)).collect()} == {1, 2, 3}
    assert {r.doc_id: (r.hits, r.first_at) for r in documents.text_hits(spark, str(tmp_path)).collect()} == {1: (1, 12), 2: (1, 4), 3: (100_001, 0)}


@pytest.mark.parametrize(("frequent", "combined"), [(64, 8), (3, 8), (3, 2)])
def test_overlaps_by_definition(spark, frequent, combined):
    """Common words, equal options and ties: the same six as by comparing all pairs of a group."""
    import random

    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(12)]
    rows = [(g, i, " ".join(rng.choices(vocabulary, [2.0 ** -k for k in range(12)], k=rng.randint(0, 6)))) for g in ("a", "b") for i in range(40)]
    sets = {(g, i): set(t.split()) for g, i, t in rows}
    want = set()
    for g, i, _ in rows:
        near = sorted((-len(sets[g, i] & w), j) for (h, j), w in sets.items() if h == g and j != i and sets[g, i] & w)[:6]
        want |= {(g, i, j, -n, rank) for rank, (n, j) in enumerate(near, 1)}
    got = quiz.overlaps(spark.createDataFrame(rows, "grp string, id int, text string"), ["grp"], frequent=frequent, combined=combined)
    assert {tuple(r) for r in got.select("grp", "id", "other", "shared", "rank").collect()} == want


def test_overlaps_broadcast_nothing(spark, tmp_path):
    """Sizes that are guessed from small files must not make the driver hold whole tables."""
    rows = [("a", i, f"red{i % 3} blue{i % 5}") for i in range(200)]
    spark.createDataFrame(rows, "grp string, id int, text string").write.parquet(str(tmp_path / "t"))
    made = quiz.overlaps(spark.read.parquet(str(tmp_path / "t")), ["grp"], frequent=3)
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_rows_are_spread_by_number_not_bytes(spark, tmp_path):
    """A table of few bytes whose rows are much work goes to as many tasks as its rows ask for."""
    from lexiquarry.plans import registry

    spark.range(100_000).selectExpr("id as p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    table = registry.read(spark, str(tmp_path), "part")
    assert registry.pieces(table) == 13
    assert registry.spread(table, "p_partkey").rdd.getNumPartitions() == 13


def test_results_are_made_a_few_rows_at_a_time():
    """Python holds the results of some rows, not of a whole batch."""
    import pandas as pd

    from lexiquarry.functions import lazy

    seen = []
    run = lazy.sliced(lambda c: seen.append(len(c)) or c, "string", 1, 4)
    out = list(run(iter([pd.Series(list("abcdefghij")), pd.Series([], dtype=object)])))
    assert seen == [4, 4, 2] and "".join(pd.concat(out)) == "abcdefghij"


def test_columns_made_once_stay_below_no_filter(spark):
    """A filter takes no copy of a column that is made once."""
    from pyspark.sql import functions as F

    from lexiquarry.operators import blocks as B

    made = B.once(spark.range(9), x=F.sha2(F.col("id").cast("string"), 256)).where("x > 'a'")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1


@pytest.mark.parametrize("name", ["claim_counts", "claims_top40"])
def test_claims_are_looked_for_once(spark, name):
    """A pattern of claims is tried once a sentence and read once where it wins, not in each place that uses the claim."""
    from lexiquarry.functions import text as T
    from lexiquarry.plans import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert {plan.count(pattern) for pattern, _, _ in T.CLAIMS} == {2}


def test_hash_of_long_texts():
    from lexiquarry.functions.python import djb2

    for text in ("", "a", "x\U0001f600é", "lorem ipsum " * 20_000):
        h, raw = 5381, text.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h * 33 + int.from_bytes(raw[i : i + 2], "big")) & 0xFFFFFFFF
        assert int(djb2(text), 36) == h


def test_layout_takes_no_group_of_pandas(spark):
    from pyspark.sql import functions as F

    from lexiquarry.functions import layout

    rows = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("A Title of it").alias("text"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(10.0).alias("height"), F.lit(False).alias("bold"), F.lit(60.0).alias("width"), F.lit(1).alias("page"), F.lit(600.0).alias("page_width"))
    made = layout.documents(rows)
    assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()
    assert {r["title"] for r in made.collect()} == {"A Title of it"}
