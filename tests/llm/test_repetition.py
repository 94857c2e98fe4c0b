import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.repetition import count_repeated, depleted, drop_frequent_lines, line_frequency, repeated_words, repetitive


def brute(text, window=5):
    words = re.findall(r"\w+", (text or "").replace("İ", "i").lower())
    seen, covered = set(), [False] * len(words)
    for i in range(len(words) - window + 1):
        k = tuple(words[i : i + window])
        if k in seen:
            covered[i : i + window] = [True] * window
        seen.add(k)
    return len(words), sum(covered)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from("a B b, c_1 İ é".split()), max_size=40).map(" ".join)), max_size=8))
def test_against_brute_force(texts):
    n, r = count_repeated(texts)
    assert [(int(a), int(b)) for a, b in zip(n, r, strict=True)] == [brute(t) for t in texts]


def test_share(spark):
    rows = [(1, "one two three four five six " * 3), (2, None), (3, ""), (4, "a b c d"), (5, "A b c d e x A B C D E"), (6, "word " * 200_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, n_words int, key int")
    out = {r.doc_id: r for r in repeated_words(df).collect()}
    assert out[1].repeated_words == 12 and out[2].repeated_share == 0 and out[5].repeated_words == 5 and out[6].repeated_words == 199_999
    assert {r.doc_id for r in repetitive(df).collect()} == {1, 5, 6}
    assert repetitive(df.limit(0)).count() == 0


def test_lines(spark):
    docs = spark.createDataFrame([(i, f"Footer, 12!\nown line {'x' * i}", "S") for i in range(1, 6)] + [(9, "footer 7\nFOOTER", "s"), (10, None, None), (11, "footer", None)], "doc_id bigint, text string, source string")
    top = {(r.host, r.documents) for r in line_frequency(docs).collect()}
    assert ("s", 6) in top and ("", 1) in top
    out = {r.doc_id: r for r in depleted(docs).collect()}
    assert out[9].rejected and out[9].kept_chars == 0 and not out[5].rejected and not out[11].rejected and 10 not in out


def test_frequent_lines_are_dropped(spark):
    rows = [(i, f"Footer, {i}!\r\n\r\n12\nown line {'x' * i}", "S") for i in range(1, 6)] + [(9, "footer 7\nFOOTER", "s"), (10, None, None), (None, "footer\rshort but more than the half", "s"), (12, "footer\r\nb", "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = {r.doc_id: (r.text, r.dropped) for r in drop_frequent_lines(docs).collect()}
    assert out == {**{i: (f"\n12\nown line {'x' * i}", 1) for i in range(1, 6)}, 10: (None, 0), None: ("short but more than the half", 1), 12: ("footer\r\nb", 0)}
    many = spark.range(1000).selectExpr("id AS doc_id", "concat('line ', repeat('x', int(id)), IF(id < 8, '\nseen by eight', ''), IF(id < 20, '\nseen by twenty', '')) AS text", "'s' AS source")
    assert {r.text.count("eight") * 10 + r.text.count("twenty") for r in drop_frequent_lines(many, keep=0.0).where("doc_id < 8").collect()} == {10}
    lost = {r.doc_id: r.n_chars - r.kept_chars for r in depleted(many).where("doc_id < 21").collect()}
    assert lost[0] == lost[19] == len("seen by twenty") and lost[20] == 0
