from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import documents as D


def test_packing():
    text = "One two three. Four five six seven eight nine ten. Eleven."
    assert all(len(p.split()) <= 5 for p in D.pack_words(text, 5)) and " ".join(D.pack_words(text, 5)).split() == text.split()
    assert all(len(p) <= 40 for p in D.pack_chars(text, 20, 40))


@given(st.lists(st.sampled_from(["Aa bb.", "Cc, dd; ee", "f" * 9, "Gg!"]), max_size=30), st.integers(10, 60))
def test_packing_keeps_words(parts, most):
    text = " ".join(parts)
    assert " ".join(D.pack_chars(text, most // 2, most)).split() == text.split()
    assert all(len(p) <= most for p in D.pack_chars(text, most // 2, most))


def test_batches(spark):
    units = spark.createDataFrame([("b", i, n) for i, n in enumerate([2, 3, 1, 8, 2, 2])], "book string, pos int, n int")
    got = {}
    for r in D.batches(units, ["book"], "pos", F.col("n"), max_chars=5, max_items=3).collect():
        got.setdefault(r.batch, []).append(r.n)
    assert [sorted(v, reverse=True) for _, v in sorted(got.items())] == [[8], [3, 2], [2, 2, 1]]
    five = spark.createDataFrame([("b", i, 700) for i in range(5)], "book string, pos int, n int")
    sizes = D.batches(five, ["book"], "pos", F.col("n"), budget=2800).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in sizes] == [4, 1]


def test_capacity(spark):
    points = spark.createDataFrame([(n, 3000 // (n + 100)) for n in range(20, 420, 40)], "length int, n int")
    r = D.fit_capacity(points).first()
    assert 50 <= r.overhead <= 150 and 2300 <= r.budget <= 3000
    assert tuple(D.fit_capacity(points.limit(0)).first()) == (2800, 0)


def test_intervals_and_slugs(spark):
    out = spark.createDataFrame([("d", 10, 40), ("d", 20, 40), ("d", 30, 40)], "d string, page int, pages int")
    assert [r.end_page for r in D.page_ranges(out, "d", "page", "pages").orderBy("page").collect()] == [19, 29, 39]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(["A", "A", "A 2", None, "A"])], "b int, pos int, t string")
    got = [r.slug for r in D.unique_slugs(rows, "b", "pos", "t").orderBy("pos").collect()]
    assert len(set(got)) == 5 and got[0] == "a" and got[3] == "untitled"


def test_markdown_and_references(spark):
    text = "intro words\n# One\n" + "w " * 30 + "\n```\n# no heading\n```\n## Two\n" + "v " * 31
    df = D.markdown_sections(D.text_lines(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]), ["id"])
    assert [r.title for r in df.orderBy("section").collect()] == ["One", "Two"]
    lines = D.text_lines(spark.createDataFrame([(1, "a\nReferences\nx\ny\nAppendix\nb")], "id int, text string"), ["id"])
    assert [r.line for r in D.drop_references(lines, ["id"], "pos", "line").orderBy("pos").collect()] == ["a", "Appendix", "b"]


def test_windows_stale_notes(spark):
    blocks = spark.createDataFrame([(1, 0, 0, "p", "paragraph", "body", None), (1, 0, 0, "p", "paragraph", "body", None), (1, 0, 1, "n", "footnote", "note", "p"), (1, 0, 2, "m", "footnote", "lost", "zz"), (1, 0, 3, "q", None, None, None)], "book_id int, chapter_index int, block_pos int, block_id string, kind string, text string, parent_id string")
    assert {(r.block_pos, tuple(r.notes)) for r in D.linked_windows(blocks).collect()} == {(0, ("note",)), (2, ())}
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, text string")
    cache = rows.where("id < 3").select("id", F.sha2(F.when(F.col("id") == 1, F.lit("a")).otherwise("old").cast("binary"), 256).alias("hash"))
    assert {r.id for r in D.stale(rows, cache, ["id"], "text").collect()} == {2, 3}
    notes = spark.createDataFrame([(1, 0, "See Marx, Capital (Oxford University Press), p. 3"), (1, 1, "He changed his mind.")], "k int, pos int, body string")
    assert D.prefer_notes(notes, ["k"], "body", "pos").first().body == "He changed his mind."


def test_headers_merge_decisions(spark):
    lines = spark.createDataFrame([(1, "The Long Road 12"), (1, "the long road 13"), (1, "Chapter 1"), (1, "text")], "doc int, line string")
    assert [(r.stem, r.times) for r in D.running_headers(lines, "doc").collect()] == [("the long road", 2)]
    rows = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "d int, pos int, t string")
    assert D.merge_text(rows, ["d"], "pos", "t").first().t == "a\n\nb"
    chapters = spark.createDataFrame([(1, i) for i in range(4)], "book_id int, chapter_index int")
    keep = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True)], "book_id int, chapter_index int, keep boolean")
    assert [r.chapter_index for r in D.apply_decisions(chapters, keep, 1).collect()] == [1]


def test_markdown_of_short_sections(spark):
    rows = [(1, "# One\n" + "w " * 20 + "\n## Two\n" + "v " * 20), (2, "# One\nshort"), (3, "# One\n" + "w " * 30 + "\n# Two\nshort"), (None, "u " * 20 + "\n# One\n" + "w " * 20)]
    df = D.markdown_sections(D.text_lines(spark.createDataFrame(rows, "id int, text string"), ["id"]), ["id"])
    got = {r.id: (r.section, r.title, r.text.split()) for r in df.collect()}
    assert set(got) == {1, 3, None} and got[3] == (1, "One", ["w"] * 30)
    assert got[1] == (0, None, ["One", *["w"] * 20, "Two", *["v"] * 20]) and got[None][2] == ["u"] * 20 + ["One"] + ["w"] * 20


def test_selection_rendering_and_splits(spark):
    from tidemark.operators import documents as D

    chapters = spark.createDataFrame([(b, i, "Contents" if i == 0 else "C", "a b c") for b in (1, 2, 3) for i in range(3)], "book_id bigint, chapter_index int, chapter_title string, text string")
    said = lambda rows, name: spark.createDataFrame(rows, f"book_id bigint, chapter_index int, {name} boolean")
    kept = D.select_chapters(chapters, said([(1, 0, True)], "x"), said([(2, 1, True), (2, 2, False)], "keep"), said([(3, 2, True)], "narratively_important"), said([(b, i, True) for b in (1, 2, 3) for i in range(3)], "keep"))
    assert sorted((r.book_id, r.chapter_index) for r in kept.collect()) == [(1, 0), (2, 1), (3, 1), (3, 2)]
    assert sorted(r.chapter_index for r in D.select_chapters(chapters, None, None, said([(3, 2, True)], "narratively_important"), said([(3, 1, True)], "keep"), most=2).collect()) == [2]
    block = "book_id bigint, chapter_index int, block_pos int, kind string, text string, note_number string, block_id string, parent_id string"
    blocks = spark.createDataFrame([(1, 0, 0, "heading", " T ", None, "b1", None), (1, 0, 1, "paragraph", "Said.", None, "b2", None), (1, 0, 2, "footnote", "A note.", "4", "fn:4", "b2"), (1, 0, 3, "heading", "References", None, "b3", None), (1, 0, 4, "paragraph", "x", None, "b4", None), (1, 0, 5, "heading", "Appendix A", None, "b5", None), (1, 0, 5, "heading", "Appendix A", None, "b5", None), (1, 0, 6, "paragraph", None, None, "b6", None)], block)
    assert D.render_blocks(blocks).first().text == "T\n\nSaid.\n\nReferences\n\nx\n\nAppendix A\n\nNotes\n4\n. A note."
    assert [(r.section_index, r.text) for r in D.number_sections(blocks).orderBy("section_index").collect()] == [(0, "T"), (1, "Said."), (2, "A note."), (3, "Appendix A")]
    units = spark.createDataFrame([(1, 0, 0, "One two. " * 12, "calm"), (1, 0, 1, " short ", None), (1, 0, 2, "  ", "x")], "book_id bigint, chapter_index int, chunk_index int, text string, instruct string")
    split = D.further_split(units, "text", 60, 40, ["book_id", "chapter_index"], ["chunk_index"]).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in split] == list(range(len(split))) and {r.instruct for r in split[:-1]} == {"calm"} and split[-1].instruct is None and len(split) > 2
    assert D.speak_units(units, "text", 60, 40, ["book_id", "chapter_index"], ["chunk_index"]).where("text = 'short'").count() == 1
    lines = spark.createDataFrame([(1, p, t) for p, t in enumerate(["The Long Walk 12", "a b", "THE LONG WALK | 13", "Chapter 1", "On the way 9"])], "doc int, pos int, line string")
    assert [r.line for r in D.drop_running_headers(lines, "doc").orderBy("pos").collect()] == ["a b", "Chapter 1", "On the way 9"]
