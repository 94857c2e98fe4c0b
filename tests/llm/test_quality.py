import numpy as np

from tidemark.llm import quality as Q
from tidemark.llm.quality_holdout import HOLDOUT

COMMON = {"en": frozenset("the of and to in a is that it was for on are as with this one their our every another under an but".split()), "de": frozenset("der die das und den dem ein oder".split())}


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 5))
    y = (x[:, 0] > 0).astype(int) + 2 * (x[:, 1] > 0)
    m = Q.Trees().fit(x[:600], y[:600]).calibrate(x[600:700], y[600:700])
    p = m.probabilities(x[700:])
    assert (p.argmax(1) == y[700:]).mean() > 0.9 and np.allclose(p.sum(1), 1)


def test_statistics():
    assert Q.statistics("", Q.Common(COMMON)) == [0.0] * len(Q.FEATURES)
    v = dict(zip(Q.FEATURES, Q.statistics("The cat was here.\nIt is on a mat,", Q.Common(COMMON)), strict=True))
    assert v["punct_line_share"] == 1.0 and 0.5 < v["common_share"] < 0.9
    assert Q.passages("My Title\n\na b\n\n\nc", "my title") == ["a b", "c"] and Q.passages("x", None) == ["x"]
    assert Q.words_of("?! ;;") == 2 and Q.words_of("a - b") == 2


def test_chapters(spark):
    prose = "Every cottage was on the hill. The baker of the village went to it and slept.\n\n" * 6
    table = "name,a,b\n" + "\n".join(f"row,{i},{i * 7}.5" for i in range(20))
    items = "\n".join(f"{i}. The House Of The Hill" for i in range(1, 20))
    junk = "\n".join("btc djftlg nzbggcj gcmbdn sgmbkfzw bkgl szhlx" for _ in range(9))
    texts = [prose, table, items, junk, None, "  ", prose + "\n\n" + table[:60], prose]
    chapters = spark.createDataFrame([(1, i, "T", t, 3, "x", 1) for i, t in enumerate(texts)] + [(1, 7, "T", prose, 3, "x", 1)], "book_id bigint, chapter_index int, chapter_title string, text string, word_count int, preview string, kind int")
    words = spark.createDataFrame([(k, w) for k, ws in COMMON.items() for w in ws] + [(None, "x"), ("en", None)], "lang string, word string")
    assert {(r.chapter_index, r.kind) for r in Q.not_prose(chapters, words).collect()} == {(1, "table"), (2, "list"), (3, "junk")}
    full = Q.with_catalog(chapters, words).collect()
    assert {r.chapter_index for r in full} == {0, 1, 2, 3, 6, 7} and not any(r.count_fits for r in full)
    assert Q.not_prose(chapters.limit(0), words.limit(0)).count() == 0


def test_holdout_is_sound():
    assert {k for _, k in HOLDOUT} == set(Q.KINDS) and len(HOLDOUT) == len({t for t, _ in HOLDOUT})


def test_kinds_without_examples(spark):
    """Lists with roman numbers and prose of a language without common words, of which no passage was trained on."""
    prose = "Every cottage was on the hill. The baker of the village went to it and slept.\n\n" * 6
    roman = "\n".join(f"{r}. The {a} Of The {b}" for r, a, b in zip("I II III IV V VI VII VIII".split(), "House River Bell Hill Road Mill Coast Barn".split(), "North South East West Moor Fen Dale Glen".split(), strict=True))
    latin = "Lorem ipsum dolor sit amet, consectetur adipiscing elit. Sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris."
    items = "\n".join(f"{i}. The House Of The Hill {i}" for i in range(1, 20))
    texts = [prose + str(i) for i in range(40)] + [items + "\n- more" * i for i in range(12)] + [roman, latin]
    chapters = spark.createDataFrame([(1, i, "T", t) for i, t in enumerate(texts)], "book_id bigint, chapter_index int, chapter_title string, text string")
    words = spark.createDataFrame([(k, w) for k, ws in COMMON.items() for w in ws], "lang string, word string")
    assert {(r.chapter_index, r.kind) for r in Q.not_prose(chapters, words).collect()} == {(i, "list") for i in range(40, 53)}
