from tidemark.llm.scan_noise import best_path, clean_scans, confusions, noise_found, paragraphs, repair, skeleton

BLOCK = "book_id bigint, chapter_index int, block_pos int, text string"


def test_confusions(spark):
    pairs = [("w!ndow", "window", 1), ("agalnst", "agalnst", 0), ("c|own", "down", 2), ("rnoon", "moon", 1), ("6ouse", "house", 2), ("dean", "clean", -1), ("5oon", "soon", 1), ("iiii", "uu", 2), ("xy", "xz", -1), ("he", "he", 0)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    same = [r[0] == r[1] for r in df.select(skeleton(df.a), skeleton(df.b)).collect()]
    assert [confusions(a, b) for a, b, _ in pairs] == [n for *_, n in pairs]
    assert all(s for s, (*_, n) in zip(same, pairs, strict=True) if n >= 0) and not same[8] and same[5]


def test_best_path():
    e = lambda pos, surface, gain: {"pos": pos, "surface": surface, "gain": gain}
    found = [e(0, "a b", 3.0), e(1, "b c", 4.0), e(2, "c d", 3.0), e(7, "x", 1.0)]
    assert best_path(found) == [found[0], found[2], found[3]] and best_path(found[1:2]) == [found[1]] and best_path([]) == []


def test_paragraphs():
    assert paragraphs(["One two three four five six,", "seven eight nine ten eleven twelve.", "", "New one here."]) == ["One two three four five six, seven eight nine ten eleven twelve.", "New one here."]
    assert paragraphs([]) == [] and paragraphs(["- a", "- b"]) == ["- a", "- b"]
    path = [{"pos": 1, "surface": "w!ndow", "word": "window"}, {"pos": 2, "surface": "w as", "word": "was"}]
    assert repair("The W!ndow w\nas\nopen.", path) == "The Window was open." and repair("The\nx", []) == "The x"
    assert repair("A thunder-\nstorm came", []) == "A thunder-\nstorm came"


def test_found(spark):
    line = "the window was open and another guest of the house came in"
    rows = [(1, 0, i, line) for i in range(30)]
    rows += [
        (1, 0, 50, "the w!ndow was open and the\nguest came in"), (1, 0, 51, "the window was open and anot-\n\n12\n\nher guest of the house came"), (1, 0, 52, "and the guest\nTHE BIG BOOK | 7\ncame in"),
        (1, 0, 53, "1937\nthe guest came in and left"), (1, 0, 54, "and the guest\nxiv\ncame in"), (1, 0, 55, "The Big Book"), (1, 0, 56, "Pre-\nand post-house guest of the window"), (1, 0, 57, None), (1, 0, 58, ""),
        (1, 0, 59, "qz w!ndow kk\nzzq"), (1, 0, 61, "qz gucst kk\nzzq"), (1, 0, 50, "the w!ndow was open and the\nguest came in"), (None, None, 60, "and the guest\n— 9 —\nof the house"),
    ]
    blocks = spark.createDataFrame(rows, BLOCK)
    chapters = spark.createDataFrame([(1, 0, "x", "A Chapter"), (2, 0, "A Chapter\n\nthe guest came in and\nA  C H A P T E R\nleft", "A Chapter")], "book_id bigint, chapter_index int, text string, chapter_title string")
    books = spark.createDataFrame([(1, "The Big Book", "Ann Au"), (2, None, None)], "book_id bigint, title string, author string")
    words = spark.createDataFrame([("en", w) for w in ("the", "and", "was", "of", "in")], "lang string, word string")
    got = {tuple(r) for r in noise_found(blocks, chapters, books, words).collect()}
    assert got == {(1, 0, 50, "misread"), (1, 0, 51, "hyphen"), (1, 0, 51, "page_number"), (1, 0, 52, "header"), (1, 0, 54, "page_number"), (None, None, 60, "page_number"), (2, 0, -1, "header"), (1, 0, 59, "misread")}
    clean = {(r.block_pos, r.book_id): r.clean_text for r in clean_scans(blocks, chapters, books, words).collect()}
    assert clean[50, 1] == "the window was open and the guest came in" and clean[51, 1].startswith("the window was open and another guest")
    assert noise_found(*[d.limit(0) for d in (blocks, chapters, books, words)]).count() == 0


def test_splits_merges_and_breaks(spark):
    line = "the window was open and the quiet harbour of the house came in"
    cases = {
        900: ("the windowopen was of the house in the anotherword", "the window open was of the house in the anotherword", set()),
        901: ("the guests of the har bour came in", "the guests of the harbour came in", set()),
        902: ("the har b0ur was open and", "the harbour was open and", {"misread"}),
        903: ("Theharbour was open and came in", "The harbour was open and came in", set()),
        904: ("Quiet har-\nbour lights", "Quiet harbour lights", {"hyphen"}),
        905: ("and the thunder-\n" + " " * 80 + "storm came in", "and the thunderstorm came in", {"hyphen"}),
        906: ("the house-\u00a0\nof the har\u00ad \u00a0\nbour", "the house-\nof the harbour", {"hyphen"}),
        907: ("the thunderstorm of the house", "the thunderstorm of the house", set()),
        908: ("the vv!ncl0vv was open and in", "the window was open and in", {"misread"}),
    }
    rows = [(1, 0, i, line) for i in range(120)] + [(1, 0, k, t) for k, (t, *_) in cases.items()]
    blocks = spark.createDataFrame(rows, BLOCK)
    chapters = spark.createDataFrame([], "book_id bigint, chapter_index int, text string, chapter_title string")
    books = spark.createDataFrame([], "book_id bigint, title string, author string")
    words = spark.createDataFrame([("en", w) for w in ("the", "and", "was", "of", "in")], "lang string, word string")
    clean = {r.block_pos: r.clean_text for r in clean_scans(blocks, chapters, books, words).collect()}
    assert {k: clean.get(k, t) for k, (t, *_) in cases.items()} == {k: want for k, (_, want, _) in cases.items()}
    found: dict[int, set] = {}
    for r in noise_found(blocks, chapters, books, words).collect():
        found.setdefault(r.block_pos, set()).add(r.noise)
    assert {k: found.get(k, set()) for k in cases} == {k: kinds for k, (*_, kinds) in cases.items()} and set(found) <= set(cases)


def test_long_paragraph_of_blank_lines():
    lines = [x for i in range(100) for x in (f"and line {i} goes on,", "")]
    assert paragraphs(lines) == [" ".join(lines[::2])]
