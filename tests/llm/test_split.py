import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.split import _atoms, cut_kind, oversized_items, room_for, split_items, split_text


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["Aa bb. ", "word ", "x, y; ", "\n\n", "\n", "u" * 25, "Ende! "]), max_size=60).map("".join), st.integers(12, 60), st.integers(0, 20))
def test_pieces(text, limit, overlap):
    parts = split_text(text, limit, overlap)
    overlap = min(overlap, limit // 2)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    for (_, e, forced), (s, _, _) in zip(parts, parts[1:], strict=False):
        assert s == max(0, e - overlap)
        if not forced:
            assert text[e - 1].isspace() or text[e].isspace() or text[e - 1] in "。！？"
    assert all(e - s <= limit for s, e, _ in parts)
    assert cut_kind(text, limit, _atoms(text, room_for(limit, overlap))) == ("forced" if re.search(rf"\S{{{limit + 1}}}", text) else "natural")
    if not re.search(rf"\S{{{limit - overlap - 1},}}", text):
        assert not any(f for _, _, f in parts)


def test_items(spark):
    limits = spark.createDataFrame([("chapter", "ebook", 50, 5), ("chapter", "page", 30, 5), ("chunk", "ebook", 20, 4), ("chunk", "page", None, 4)], "item_kind string, source_kind string, max_chars int, overlap_chars int")
    books = spark.createDataFrame([(1, None), (2, "Page ")], "book_id bigint, source_kind string")
    long = "Ten letters and more words here. " * 3
    chapters = spark.createDataFrame([(1, 0, long, 1), (2, 0, "a b c d " * 4 + "z" * 31, 1), (2, 1, "short", 1), (1, 1, None, 1), (None, 3, long, 1), (1, 4, "", 1)], "book_id bigint, chapter_index int, text string, n int")
    chunks = spark.createDataFrame([(1, 0, 0, long, None), (1, 0, 0, long, None), (1, 0, 1, "x" * 20, "ebook"), (1, 0, 2, "x" * 21, "ebook"), (1, 0, 3, long, "page")], "book_id bigint, chapter_index int, chunk_index int, text string, source_kind string")
    found = {tuple(r) for r in oversized_items(chapters, chunks, books, limits).collect()}
    assert found == {("chapter", 1, 0, -1, "natural"), ("chapter", 2, 0, -1, "forced"), ("chapter", None, 3, -1, "natural"), ("chunk", 1, 0, 0, "natural"), ("chunk", 1, 0, 2, "forced")}
    pieces = [r for r in split_items(chapters, chunks, books, limits).collect() if r.item_kind == "chapter" and r.book_id == 1]
    text = "".join(p.text if i == 0 else p.text[5:] for i, p in enumerate(sorted(pieces, key=lambda r: r.piece)))
    assert text == long and all(len(p.text) <= 50 for p in pieces)
    assert oversized_items(chapters.limit(0), chunks.limit(0), books.limit(0), limits.limit(0)).count() == 0
