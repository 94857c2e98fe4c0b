import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import citations as C
from tidemark.functions import dates, nested, units
from tidemark.functions import text as T


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(column).first()[0]


@pytest.mark.parametrize(("score", "label"), [(0, "Very weak"), (25, "Weak"), (50, "Normal"), (75, "Strong"), (100, "Very strong"), (70, "Strong"), (None, None)])
def test_feeling(spark, score, label):
    assert one(spark, units.feeling(F.lit(score).cast("double"))) == label


@pytest.mark.parametrize(("raw", "want"), [(60.0, 6.0), (6.0, 6.0), (10.0, 1.0), (100.0, 10.0), (0.0, None)])
def test_effort(spark, raw, want):
    assert one(spark, units.effort(F.lit(raw))) == want


def test_units(spark):
    assert one(spark, units.pace(F.lit(2.5))) == 6.67 and one(spark, units.pace(F.lit(0.0))) is None
    assert one(spark, units.clock(F.lit(1200.0))) == "20:00" and one(spark, units.clock(F.lit(3725.5))) == "1:02:06" and one(spark, units.clock(F.lit(-5.0))) == "-5.0"
    assert one(spark, units.load_ratio(F.lit(600.0), F.lit(500.0))) == 1.2 and one(spark, units.load_ratio(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, units.is_run(F.lit(None).cast("string"))) is False
    assert one(spark, units.weather_text(F.lit(95))) == "Thunderstorm" and one(spark, units.weather_text(F.lit(7))) == "Unknown"
    assert one(spark, units.age_on(F.lit(dt.date(1990, 6, 17)), F.lit(dt.date(2026, 6, 16)))) == 35
    assert one(spark, units.source_kind(F.lit("/a/b.HTM"))) == "page" and one(spark, units.slug(F.lit("  The Rhythm: A-B  "))) == "the_rhythm_a_b" and one(spark, units.slug(F.lit("?!"))) == "untitled"


def test_dates(spark):
    assert one(spark, dates.anchor(F.lit(dt.date(2026, 6, 17)))) == dt.date(2026, 6, 16)
    assert one(spark, dates.block_number(F.lit(dt.date(2026, 6, 10)), F.lit(dt.date(2026, 6, 16)))) == 0
    assert one(spark, dates.block_number(F.lit(dt.date(2026, 6, 9)), F.lit(dt.date(2026, 6, 16)))) == 1
    assert one(spark, dates.weeks_until(F.lit(dt.date(2026, 6, 1)), F.lit(dt.date(2026, 6, 2)))) is None
    assert one(spark, dates.months_around(F.lit(dt.date(2026, 1, 15)), 2))[-1] == dt.date(2025, 11, 1)
    assert one(spark, dates.strict_day(F.lit("2026-02-30"))) is None and one(spark, dates.days_between(F.lit(dt.date(2026, 1, 2)), F.lit(dt.date(2026, 1, 1)))) == []
    with pytest.raises(ValueError):
        dates.anchor(F.lit(None), -1)


def test_text(spark):
    f = lambda c: one(spark, c)
    assert f(T.expand_symbols(F.lit("#Tag a & b 35%"))) == "Tag a and b 35 percent"
    assert f(T.expand_abbreviations(F.lit("e.g. this, i.e. that, pp. 3-4 and p. 5 etc."))) == "for example this, in other words that, pages 3-4 and page 5 et cetera"
    assert f(T.expand_sections(F.lit("§ 3.741"))) == "section 3.741"
    assert f(T.strip_urls(F.lit("a <https://x.y/z> b www.q.r c"))) == "a  b  c"
    assert f(C.say_examples_column(F.lit("films such as (Jaws, Alien)"))) == "films for example Jaws, Alien" and f(C.say_examples_column(F.lit("others (Marx, Engels)"))) == "others (Marx, Engels)"
    assert f(T.note_numbers(F.lit("3-1, 7"))) == [1, 2, 3, 7]
    assert f(T.first_words(F.lit("a b c"), 2)) == "a b…" and f(T.word_count(F.lit(None).cast("string"))) == 0
    assert f(T.is_contents(F.lit("Contents"), F.lit("a b"))) and not f(T.is_contents(F.lit("x"), F.lit("word " * 501)))
    assert f(C.citation_only_column(F.lit("See Marx, Capital (Oxford University Press), p. 3"))) and not f(C.citation_only_column(F.lit("This matters because the author changed his mind later on.")))
    assert f(C.opens_references_column(F.lit("## Works Cited:"))) and f(C.resumes_column(F.lit("Appendix A")))
    assert f(T.markdown_to_text(F.lit("# H\n\n**a** `b` [c](d)\n---\n```\nx\n```"))) == "H\na b c"
    dated = spark.createDataFrame([("on 03/09/2026.",), ("29/02/2021",), ("29/02/2020",), ("32/01/2020",), (None,)], "t string").select(T.expand_dates("t")).collect()
    assert [r[0] for r in dated] == ["on the third of September twenty twenty-six.", "29/02/2021", "the twenty-ninth of February twenty twenty", "32/01/2020", None]
    assert [T.year_words(y) for y in (2012, 2026, 2008, 1907, 2000, 1900)] == ["twenty twelve", "twenty twenty-six", "two thousand eight", "nineteen oh seven", "two thousand", "nineteen hundred"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab#&%1. pe.g\n[]", max_size=40), min_size=1, max_size=20))
def test_narration_is_idempotent(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.speak(T.expand_sections(T.strip_urls("t"))).alias("a"))
    assert all(r.a == r.b for r in df.select("a", T.speak(T.expand_sections(T.strip_urls("a"))).alias("b")).collect())


def test_nested(spark):
    zones = F.from_json(F.lit('[{"zoneNumber":1,"secsInZone":600},{"secsInZone":5},{"zoneNumber":2},{"zoneNumber":1,"secsInZone":300}]'), nested.ZONES)
    assert one(spark, nested.zone_seconds(zones)) == {1: 300.0, 2: 0.0}
    assert one(spark, nested.zone_minutes(F.create_map(F.lit(1), F.lit(600.0), F.lit(2), F.lit(300.0)))) == [10.0, 5.0, 0.0, 0.0, 0.0]
    assert one(spark, nested.zone_minutes(F.lit(None).cast("map<int,double>"))) == [None] * 5
    assert one(spark, nested.joined_notes(F.lit(" a "), F.lit(""), F.lit("a"), F.lit("b"))) == "a\nb"
    days = one(spark, nested.daily_weather(F.lit('{"daily":{"time":["2026-06-16","2026-06-17"],"temperature_2m_max":[31.44],"weather_code":[0,95]}}')))
    assert [(str(d.day), d.temp_c, d.weather_code) for d in days] == [("2026-06-16", 31.4, 0), ("2026-06-17", None, 95)]
    steps = F.from_json(F.lit('[{"seconds":30},{"iterations":3,"steps":[{"seconds":20},{"seconds":10}]}]'), "array<struct<seconds:double,metres:double,iterations:int,steps:array<struct<seconds:double,metres:double>>>>")
    assert one(spark, nested.step_seconds(steps)) == 120
    assert one(spark, nested.insert_cues(*[F.array(*map(F.lit, x)) for x in ("wxyz", "b", "m", "a")])) == list("bwxmyza")
    assert one(spark, nested.json_in_text(F.lit('so:\n```json\n[{"i":1}]\n```'), "array<struct<i:int>>"))[0].i == 1


@pytest.mark.parametrize(("text", "want"), [
    ("He said so [12, 14-16].", "He said so."), ("A [...] b […] c", "A b c"), ("It is known (Van der Berg et al., 1985, pp. 20-21).", "It is known."),
    ("Ann Lee (1999). The Long Walk, Harbour Press, p. 342. Next.", "Wrote Ann Lee in nineteen ninety-nine. Next."), ("Ann Lee (2012). He later appeared in The Paper.", "Ann Lee (2012). He later appeared in The Paper."),
    ("So it goes (see especially Lee, The Long Walk [London: Harbour Press, 1999], 53–58; and others).", "So it goes (Lee in The Long Walk)."), ("a (short) b (1937) c", "a (short) b (1937) c"), ("nothing [sic] and (no", "nothing [sic] and (no"),
])
def test_citations(text, want):
    assert C.simplify(text, T.year_words) == want


def test_text_rules():
    assert T.say_visuals("a\n| Name | Size |\n|---|---|\n| x | 1 |\nb ![The map](m.png)", "page") == "a\nSee the table Name, Size on the original page.\nb See the figure The map on the original page."
    assert T.say_visuals('<table><tr><th>Cost</th></tr></table><img src="a" alt="A cat"> | x', None) == "See the table Cost in this chapter of the ebook.See the figure A cat in this chapter of the ebook. | x"
    assert C.without_callouts("a\n12\nb (see note 3).\n 7\nx see notes 1-3, 5 below") == "a\n\nb.\n 7\nx"
    assert T.say_dates("1.2.2020, v1.2.3.2020 and 1/2/2020/3 or 31.4.2021") == "the first of February twenty twenty, v1.2.3.2020 and 1/2/2020/3 or 31.4.2021"
    assert C.resumes("## Appendix B:") and not C.resumes("Appendix to the whole") and C.opens_references("**Works  Cited**")


def test_note_markers(spark):
    assert one(spark, T.note_markers(T.note_markers(F.lit(" a b ")))) == "Footnote.\na b\nEnd of footnote." and one(spark, T.note_markers(F.lit("Footnote.\nx"), False)) == "x"


def test_json_answers(spark):
    f = lambda c: one(spark, c)
    answer = F.lit('so: [{"index":1,"keep":true},{"keep":true},{"index":2,"reason":"r"}]')
    assert [tuple(d) for d in f(nested.decisions(answer))] == [(1, True, ""), (2, False, "r")]
    opened = nested.opening_analyses(F.lit('[{"index":3,"narratively_important":true},{"index":4,"section_type":"index"}]'))
    assert [tuple(d) for d in f(nested.opening_decisions(opened))] == [(3, True, "unclear"), (4, False, "index")]
    with pytest.raises(Exception, match="nothing valid"):
        f(nested.decisions(F.lit("no array"), strict=True))
    assert f(nested.last_event_day(F.lit('{"latest_event":{"date":"2026-03-01T10:00"}}'))) == dt.date(2026, 3, 1) and f(nested.last_event_day(F.lit('{"latest_event":{"date":"soon"}}'))) is None
    assert f(nested.item_workout(F.lit('{"workout":{"workoutId":7}}'))) == 7 and f(nested.uploaded_workout(F.lit('{"id":"8"}'))) == 8 and f(nested.item_day(F.lit('{"calendarDate":"2026-03-01 x"}'))) == "2026-03-01"
    assert len(f(nested.record_items(F.lit('{"prList":[{"v":1},{"v":2}]}'), "array<struct<v:int>>"))) == 2 and len(f(nested.record_items(F.lit(' [{"v":1}]'), "array<struct<v:int>>"))) == 1
    assert f(nested.joined_words(F.lit(" a "), F.lit(None), F.lit(" "), F.lit("b c"))) == "a b c" and f(nested.joined_words(F.lit(""))) is None
    assert tuple(map(list, f(nested.halves(F.array(*map(F.lit, range(5))))))) == ([0, 1], [2, 3, 4])
    rows = F.array(F.struct(F.lit(1).alias("i"), F.lit(None).cast("string").alias("t")))
    assert [tuple(r) for r in f(nested.from_payload(nested.to_payload(rows), "array<struct<i:int,t:string>>"))] == [(1, None)]
    steps = F.from_json(F.lit('[{"metres":600},{"seconds":30}]'), "array<struct<seconds:double,metres:double,iterations:int,steps:array<struct<seconds:double,metres:double>>>>")
    assert f(nested.step_seconds(steps, F.lit(3.0))) == 230


def test_more_units(spark):
    f = lambda c: one(spark, c)
    assert f(units.positive_rate(F.lit("61"))) == 61 and f(units.positive_rate(F.lit("0"))) is None and f(units.positive_rate(F.lit("x"))) is None
    assert f(units.zone_of_workout(F.lit("sprint"))) == 5 and f(units.zone_of_workout(F.lit(None).cast("string"))) == 2
    d = lambda n: F.lit(dt.date(2026, 3, n))
    assert f(dates.contains_day(d(1), d(7), d(7))) and not f(dates.contains_day(d(1), d(7), F.lit(None).cast("date")))
    assert [f(dates.first_recovery(d(8), d(14), d(n))) for n in (1, 7, 13, 14)] == [True, True, True, False] and not f(dates.first_recovery(d(9), d(15), d(1)))
