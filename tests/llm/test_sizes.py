"""Beyond the limits of what is broadcast other plans run; the results are the same."""

from tidemark import tables
from tidemark.llm import repetition, scan_noise

LINE = "the window was open and the quiet harbour of the house came in"


def test_scan_noise_beyond_the_limits(spark, monkeypatch):
    rows = [(1, 0, i, LINE) for i in range(60)] + [(1, 0, 90, "the har b0ur was open and in"), (1, 0, 91, "and the har-\nbour\nTHE BOOK 7\nof the house"), (2, 0, 92, "the vvindow was open and in")]
    blocks = spark.createDataFrame(rows, "book_id bigint, chapter_index int, block_pos int, text string")
    chapters = spark.createDataFrame([(1, 0, None, "A"), (2, 0, None, "B")], "book_id bigint, chapter_index int, text string, chapter_title string")
    books = spark.createDataFrame([(1, "The Book", "Ann"), (2, None, None)], "book_id bigint, title string, author string")
    words = spark.createDataFrame([("en", w) for w in ("the", "and", "was", "of", "in")], "lang string, word string")
    run = lambda: ({tuple(r) for r in scan_noise.noise_found(blocks, chapters, books, words).collect()}, {tuple(r) for r in scan_noise.clean_scans(blocks, chapters, books, words).collect()})
    broadcast = run()
    assert {r[3] for r in broadcast[0]} == {"misread", "hyphen", "header"}
    monkeypatch.setattr(tables, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(scan_noise, "BROADCAST_EDGES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert run() == broadcast
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_beyond_the_limit(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"Same line here\nown words {chr(97 + i % 26) * (i + 1)}", "S") for i in range(40)] + [(90, None, "S"), (91, "Same line, here!", None)], "doc_id bigint, text string, source string")
    run = lambda: (sorted(map(tuple, repetition.depleted(docs).collect())), sorted(map(str, repetition.drop_frequent_lines(docs).collect())))
    broadcast = run()
    monkeypatch.setattr(tables, "BROADCAST_BYTES", -1)
    assert run() == broadcast and any(k < n for _, n, k, _ in broadcast[0])
