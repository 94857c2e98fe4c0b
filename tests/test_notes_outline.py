from pyspark.sql import functions as F

from tidemark.functions import records as R
from tidemark.operators import outline as O
from tidemark.functions.citations import citation_only
from tidemark.operators.notes import document_blocks, place_notes, place_notes_udf, plain_blocks
from tidemark.sources.pages import html_blocks, page_blocks

FLAT = "1.1 Opening\nThe word3 stands here\n1\nand goes on. Then it ends (see note 2).\n\nNext one.\n\nNotes\nBefore.\n1. He changed his mind in the end.\n2. Longer prose about what happened then.\n3\n. Glued note of prose is here.\n9. Never called by anyone at all.\n9. See Marx, Capital (Oxford University Press), p. 3\nReferences\nx\n"


def test_plain_blocks():
    out = plain_blocks(FLAT)
    kinds = [(b["kind"], b["note_number"], b["parent_id"]) for b in out]
    assert kinds[0] == ("heading", None, None) and ("footnote", "1", "b2") in kinds and ("footnote", "2", "b2") in kinds and kinds[-1] == ("footnote", "9", None)
    assert [b["text"] for b in out if b["note_number"] == "9"] == ["Never called by anyone at all."]
    assert out[1]["note_refs"][0] == "fn:3" and "x" not in [b["text"] for b in out] and plain_blocks("") == []


def test_place_notes(spark):
    placed = place_notes(FLAT)
    assert placed.index("He changed") < placed.index("and goes on") and "see note" not in placed and placed.endswith("Never called by anyone at all.")
    assert place_notes(placed) == placed and place_notes("a (see note 3) b\n7\nc") == "a b\n7\nc"
    assert [r[0] for r in spark.createDataFrame([("x",), (None,)], "t string").select(place_notes_udf("t")).collect()] == ["x", None]
    rows = spark.createDataFrame([(1, 0, FLAT, 1), (1, 1, None, 1), (1, 2, " ", 1)], "book_id bigint, chapter_index int, text string, kind int")
    assert document_blocks(rows).where("kind = 'footnote'").count() == 4 and document_blocks(rows.limit(0)).count() == 0
    assert citation_only("") and not citation_only("He changed his mind about it.")


def test_page_blocks(spark):
    html = '<body><h1>T</h1><p>Said so<a href="#n1">1</a> there.</p><ul><li>item</li></ul><table><caption>Cap</caption><tr><td>1</td></tr></table><figure><img alt="Alt"></figure><h2>Notes</h2><p id="n1">1. The note <a href="#r1">1</a></p><p id="n2">2. Not called</p></body>'
    out = page_blocks(html)
    assert [(b["kind"], b["text"]) for b in out][:3] == [("heading", "T"), ("paragraph", "Said so there."), ("footnote", "The note")]
    assert out[2]["parent_id"] == "b2" and out[1]["note_refs"] == ["fn:n1"] and ("table", "Cap") in [(b["kind"], b["text"]) for b in out] and ("figure", "Alt") in [(b["kind"], b["text"]) for b in out]
    assert html_blocks(spark.createDataFrame([("a", html), ("b", None)], "path string, html string")).count() == len(out)


def test_outlines(spark):
    o = spark.createDataFrame([("d", 0, "A", 0), ("d", 0, "B", 5), ("d", 1, "Chapter 1", 1), ("d", 1, "Chapter 2", 3), ("d", 2, "1. x", 1), ("d", 2, "2. y", 2), ("d", 2, "3. z", 3), ("e", 0, "Intro", 0)], "doc string, depth int, title string, page int")
    assert {(r.doc, r.depth) for r in O.best_depth(o).collect()} == {("d", 1), ("e", 0)}
    assert O.merge_outlines(o, "doc", "page", ["depth"]).where("doc = 'd' AND page = 1").first().title == "Chapter 1"
    pages = spark.createDataFrame([("d", i, f"p{i}") for i in range(6)], "doc string, page int, text string")
    got = {(r.title, r.text) for r in O.outline_sections(o.where("depth = 1"), pages).collect()}
    assert got == {("Chapter 1", "p1\n\np2"), ("Chapter 2", "p3\n\np4\n\np5")}
    heads = O.heading_sections(pages, F.when(F.col("page").isin(2, 4), F.col("text"))).orderBy("section").collect()
    assert [(r.title, r.text) for r in heads] == [("p2", "p2\n\np3"), ("p4", "p4\n\np5")]
    assert O.enough_text(pages).count() == 0 and O.enough_text(pages, least=6).count() == 1


def test_marks_and_pool(spark):
    parts = spark.createDataFrame([("b", i, 100) for i in range(3)], "book string, pos int, ms int")
    assert [(r.start, r.end) for r in O.chapter_marks(parts, "book", "pos", "ms", 10).orderBy("pos").collect()] == [(0, 110), (110, 220), (220, 320)]
    assert [r.done for r in O.progress(parts, "book", "pos", F.col("pos") != 1).orderBy("pos").collect()] == [1, 1, 2]
    pool = spark.createDataFrame([(v,) for v in "xyz"], "voice string")
    got = O.assign_without_repeat(spark.createDataFrame([("g", i) for i in range(6)], "group string, pos int"), "pos", pool, "voice", 1).orderBy("pos").collect()
    assert {r.voice for r in got[:3]} == set("xyz") == {r.voice for r in got[3:]}


def test_records(spark):
    rows = [(1, 3, None, 1200.0), (1, 1, "1K", 200.0), (1, 7, None, 32100.0), (1, 12, "Longest Ride", 9.0), (1, None, "15K Best", 4000.0), (1, None, "25K", 1.0), (1, None, "longest ride", 1.0), (1, 4, None, None)]
    out = R.personal_records(spark.createDataFrame(rows, "user_id int, type_id int, name string, value double").withColumn("day", F.lit("2026-01-01"))).orderBy("place").collect()
    assert [(r.label, r.display_value) for r in out] == [("5K", "20:00"), ("10K", "—"), ("15K Best", "1:06:40"), ("Longest Run", "32.10 km")]
    g = spark.createDataFrame([("a b c", "x " * 9, '"Calm."'), ("a b c", " ", "a b"), ("a b c", "c", "[sad] low"), ("", "q", None)], "raw string, cleaned string, hint string")
    assert [r[0] for r in g.select(R.guarded_answer(F.col("raw"), F.col("cleaned"))).collect()] == ["a b c", "a b c", "c", "q"]
    assert [r[0] for r in g.select(R.guarded_hint(F.col("hint"), F.col("raw"))).collect()] == ["Calm.", None, None, None]
    e = spark.createDataFrame([("CUDA out of memory",), ("404 Not Found, connection reset",), ("Connection timed out",), ("?",)], "m string").select(R.error_kind(F.col("m"))).collect()
    assert [r[0] for r in e] == ["memory", "permanent", "transient", "other"]
    b = spark.createDataFrame([(bytearray(b"\xff\xd8\xff" + b"0" * 10_000),), (bytearray(b"\xff\xd8\xff"),)], "b binary").select(R.is_cover(F.col("b"))).collect()
    assert [r[0] for r in b] == [True, False]
