import pytest

from tidemark.llm.markup import Reading, clean_markup, dom, induce_wrappers, languages, markup_found, simple_tree_matching, without_chrome

PLAIN = ["The file lives in C:\\new\\chapter next to old_chapter_copy.", "For once a < b held & R&D went from $72 to $89, item #94.", "She worked out 3 * 24 * 93 [sic].", "* one\n* two\n1. three\n• four", "adapter | 3:17 | -\nvoice | 2 | 3", "", None, "~?=. ~~ *, !*; ^ '", "_" * 80]


@pytest.mark.parametrize("text", PLAIN)
def test_plain(text):
    assert languages(text) == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a <b>c</b>", ["html"]), ("x &nbsp; y", ["html"]), ("<!-- a --> b", ["html"]), ("<pre><code># **x** $y_1$</code></pre>", ["html"]),
        ("**a** b", ["markdown"]), ("# Head\ntext", ["markdown"]), ("Head\n====", ["markdown"]), ("[a](https://x.y)", ["markdown"]), ("```\n<b> \\cite{x}\n```", ["markdown"]), ("a `<b>` c", ["markdown"]), ("a <code>**x**</code> c", ["html"]), ("> quoted", ["markdown"]),
        ("| a | b |\n|---|--:|\n| 1 | 2 |", ["markdown"]), ("[a][5]\n\n[5]: https://x.y", ["markdown"]), ("'''b''' and ''i''", ["wiki"]), ("[[A|b]] {{x}}", ["wiki"]), ("== H ==", ["wiki"]), ("{|\n| a || b\n|}", ["wiki"]), ("[https://x.y z]", ["wiki"]), ("__TOC__", ["wiki"]),
        ("\\section{A} b", ["latex"]), ("$x_1 = 2$", ["latex"]), ("92\\% of \\$40", ["latex"]), ("``a''\\ldots", ["latex"]), ("\\begin{verbatim}\n# <b>\n\\end{verbatim}", ["latex"]), ("<p>a</p> '''b'''", ["html", "wiki"]),
    ],
)
def test_marked(text, want):
    assert languages(text) == want


def test_parts():
    assert Reading("## A **b** <i>c</i> `<d>`\n\nx").parts() == [("heading", "A b c <d>"), ("paragraph", "x")] and languages("## A <i>c</i>") == ["html", "markdown"]
    assert Reading("say `x < 1` and <tt>y</tt> now").parts() == [("paragraph", "say x < 1 and y now")]
    text = "<h2>Head &amp; more</h2><ul><li>one</li><li>two</li></ul><pre><code>x &lt; 1</code></pre> A <em>word</em>.<table><tr><td>a</td><td>1</td></tr></table>\n$$y = 2$$\n"
    assert Reading(text).parts() == [("heading", "Head & more"), ("list_item", "one"), ("list_item", "two"), ("code", "x < 1"), ("paragraph", "A word."), ("table", "a | 1"), ("formula", "y = 2")]


def test_trees():
    a, b = dom("<div><p>same</p><p>one</p></div>"), dom("<div><p>same</p><p>two</p><hr></div>")
    size, pairs = simple_tree_matching(a, b)
    assert size == 6 and ("#text", "same", "same") in [(x[0], x[1], y[1]) for x, y in pairs]


def test_queries(spark):
    schema = "book_id bigint, chapter_index int, block_pos int, text string"
    blocks = spark.createDataFrame([(1, 0, 0, "<p>nav</p>a"), (1, 0, 0, "<p>nav</p>a"), (1, 0, 1, "<p>nav</p>b"), (1, 0, 2, None), (2, 0, 0, "plain"), (None, None, None, "**x**")], schema)
    chapters = spark.createDataFrame([(1, 0, "**in blocks**", 1), (3, 0, "''own'' text", 1), (3, 1, None, 1)], "book_id bigint, chapter_index int, text string, markup int")
    assert {tuple(r) for r in markup_found(blocks, chapters).collect()} == {(1, 0, 0, "html"), (1, 0, 1, "html"), (None, None, None, "markdown"), (3, 0, -1, "wiki")}
    clean = {(r.book_id, r.block_pos): r.clean_text for r in clean_markup(blocks, chapters).collect()}
    assert clean[2, 0] == "plain" and clean[3, -1] == "own text"
    roles = {(r.content, r.role) for r in induce_wrappers(blocks, chapters).collect() if r.node == "#text"}
    assert ("nav", "template") in roles and (None, "slot") in roles
    assert markup_found(blocks.limit(0), chapters.limit(0)).count() == 0


def test_wrappers_across_chapters(spark):
    schema = "book_id bigint, chapter_index int, block_pos int, text string"
    rows = [(b, c, 0, f"<p>nav</p><b>{c}</b>") for b in (1, None) for c in (0, 7, 8, 40)] + [(2, 3, 0, "<p>alone</p>"), (3, 0, 0, "<i>a</i>"), (4, 9, 0, "<i>a</i>")]
    chapters = spark.createDataFrame([], "book_id bigint, chapter_index int, text string")
    got = {(r.book_id, r.node, r.content): (r.aligned, r.role) for r in induce_wrappers(spark.createDataFrame(rows, schema), chapters).collect()}
    assert {k[0] for k in got} == {1, None}
    assert all(got[b, "#text", "nav"] == (3, "template") and got[b, "#text", None] == (3, "slot") for b in (1, None))


def test_chrome_is_dropped(spark):
    schema = "book_id bigint, chapter_index int, block_pos int, text string"
    body = lambda i: f"<ul><li><a href='/'>Home</a></li></ul><p>Text <b>Home</b> number {i}.</p>"
    rows = [(b, c, 0, body(c)) for b in (1, None) for c in range(4)] + [(1, 9, 0, "Home"), (1, 9, 1, "<p>once</p>"), (1, 9, 2, "<p>once</p><p>more</p>"), (1, 9, 3, "<p>Text</p>")]
    rows += [(2, 0, i, "<p>copied text</p>") for i in range(3)] + [(2, 0, 9, "<p>other</p>")]
    blocks, chapters = spark.createDataFrame(rows, schema), spark.createDataFrame([], "book_id bigint, chapter_index int, text string")
    clean = {(r.book_id, r.chapter_index, r.block_pos): r for r in clean_markup(blocks, chapters).collect()}
    assert len(clean) == len(rows)
    assert all(clean[b, c, 0].clean_text == f"Text Home number {c}." and clean[b, c, 0].markup == ["html"] for b in (1, None) for c in range(4))
    assert clean[1, 9, 0].clean_text == "Home" and clean[1, 9, 1].clean_text == "once" and clean[2, 0, 1].clean_text == "copied text"
    roles = {(r.content, r.role) for r in induce_wrappers(blocks, chapters).where("book_id = 1").collect()}
    assert ("Home", "template") in roles and ("once", "template") not in roles
    assert without_chrome("<p>a</p><p>b <i>a</i></p>", {"a"}) == "<p></p><p>b <i>a</i></p>"


def test_what_is_no_markup_and_what_nests():
    assert languages("Let a[i] = b[j](x) be, and __init__ too") == [] and languages("see b[j](https://x.test/a)") == ["markdown"]
    assert [t for t in Reading("| a | b |\n|-|-|\n| 1 | - |").parts()] == [("table", "a | b\n1 | -")] and languages("| a | b |\n| 1 | - |") == []
    assert Reading("x\n\\begin{tabular}{ll}\\hline a & b \\\\ \\emph{c} & d \\\\ \\end{tabular}").parts()[-1] == ("table", "a | b\nc | d")
    deep = "core"
    for _ in range(9):
        deep = "\\emph{" + deep + "}"
    assert "".join(t for _, t in Reading(deep + " {{a{{b{{c{{d{{e}}}}}}}}}}").parts()) == "core"
    assert "\ue000" in "".join(t for _, t in Reading("a \ue000 **b**").parts())
    label = "a long label of many words that goes on for more than forty letters"
    assert languages(f"[text][{label}]") == ["markdown"]
