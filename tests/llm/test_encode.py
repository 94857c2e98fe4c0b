from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm.encode import cut_pieces, decode_ids, encode, encode_text, round_trip

TEXTS = ["9" * 7000, "x" * 600 + " " + "7" * 900 + " end", None, "", "   ", "Hello world", "<|endoftext|> x", "naïve 😀 e\u0301\r\n\tzz", "a" * 5000, "word " * 5000, "x  y\n\n z" * 900]


def test_every_text(spark):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in encode(df, piece=512, overlap=32).collect()}
    assert got == {i: encode_text(t) for i, t in enumerate(TEXTS)}
    assert got[2] == got[3] == [] and got[4] != []
    counts = {r.doc_id: r.n_tokens for r in encode(df, piece=512, overlap=32, counts=True).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert all(r.same for r in round_trip(encode(df.select("doc_id", "text")), df).collect())
    assert encode(df.limit(0)).count() == 0


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(alphabet="ab'sté 1\n\t,.!日\u00a0\x1c", max_size=400), st.text(alphabet="ab  \n\r1.", max_size=400)), st.integers(3, 40), st.integers(1, 20))
def test_pieces_encode_as_the_whole(text, piece, overlap):
    parts = cut_pieces(text, piece, overlap)
    assert "".join(parts) == text
    assert [i for p in parts for i in encode_text(p)] == encode_text(text)
    assert decode_ids(encode_text(text)) == text


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id bigint, text string")
    assert encode(df.withColumn("n_tokens", F.lit(1))).count() == 2


def test_kept_columns(spark):
    df = spark.createDataFrame([(1, "a b " * 900, "s", 5), (2, None, None, 6)], "doc_id bigint, text string, source string, part int")
    got = {r.doc_id: (r.source, r.n_tokens) for r in encode(df, piece=512, overlap=64, counts=True, keep=("source",)).collect()}
    assert got == {1: ("s", len(encode_text("a b " * 900))), 2: (None, 0)}
