import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark import api
from tidemark.functions import nested, units
from tidemark.plans.stages import PartialProgress, Pool, StageStore, canonical_stages, deep_merge, reusable, settings_hash, with_cache


def test_parameters():
    assert api.parse_days("") == 28 and api.parse_days("7") == 7 and api.parse_flag(" Yes ") and not api.parse_flag("off")
    for bad in (lambda: api.parse_days(0), lambda: api.parse_days("x"), lambda: api.parse_flag("maybe"), lambda: api.parse_day("2026-02-30"), lambda: api.parse_day(None)):
        with pytest.raises(api.ParameterError) as e:
            bad()
        assert api.http_status(e.value) == 400
    assert canonical_stages(["b", "a"], ["a", "b", "c"]) == ["a", "b"] and deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}
    assert settings_hash({"a": 1, "b": 2}) == settings_hash({"b": 2, "a": 1})
    with pytest.raises(ValueError):
        canonical_stages(["x"], ["a"])


def test_small_functions(spark):
    df = spark.createDataFrame([("n12a", [1, 2, 3, 4, 5, 6, 7], ["calm"])], "t string, xs array<int>, h array<string>")
    r = df.select(nested.numeric_part(F.col("t")), nested.with_rest(F.col("xs"), 5), nested.repeated_hint(F.col("h"), F.lit(3)), units.template_minutes(F.lit(59)), units.audio_ms(F.lit(22050), F.lit(44100)), units.percent_text(F.lit(1), F.lit(3)), nested.decisions(F.lit('ok [{"index":1,"keep":true},{"keep":false},{"index":2,"keep":false}]'))).first()
    assert r[0] == 12 and (r[1].first, r[1].more) == ([1, 2, 3, 4, 5], 2) and r[2] == ["calm"] * 3 and r[3] == 1 and r[4] == 500 and r[5] == "1/3 (33%)"
    assert [tuple(d)[:2] for d in r[6]] == [(1, True), (2, False)]


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data here")
def test_engine(spark):
    e = api.Engine(spark, "/root/testdata/sf0.001")
    assert e.activities("2025-03-01", 30).columns[-1] == "zone_5_min" and e.activities("2025-03-01", 30, "no").count() > 0
    assert e.baseline("2025-04-01").count() > 0 and e.events("2024-06-01").count() >= 0
    assert e.page(spark.range(50), ["id"], 10, 5).collect()[0].id == 10
    people = spark.createDataFrame([(1, dt.date(1990, 1, 1), None, 50), (2, None, 170, None)], "user_id int, birth date, threshold int, rest int")
    got = {r.user_id: r for r in e.heart_rate_zones(people, "2026-06-16").collect()}
    assert got[1].max_rate == 184 and got[2].max_rate == 200 and got[1].zones[4].max_bpm == 184
    with pytest.raises(api.ParameterError):
        e.page(spark.range(1), ["id"], -1)


def test_stages(spark, tmp_path):
    store = StageStore(spark, f"file://{tmp_path}", "doc")
    docs = lambda *p: spark.createDataFrame(list(p), "doc int, fingerprint string")
    work = lambda d: d.select("doc", F.upper("fingerprint").alias("out"))
    assert store.run("clean", docs((1, "a"), (2, "b")), work) == 2 and store.run("clean", docs((1, "a"), (2, "b")), work) == 0
    with pytest.raises(Exception, match="boom"):
        store.run("clean", docs((1, "a"), (2, "c")), lambda d: d.select("doc", F.raise_error(F.lit("boom")).cast("string").alias("out")))
    assert store.run("clean", docs((1, "a"), (2, "c"), (3, "d")), work) == 2
    assert {(r.doc, r.out) for r in store.output("clean").collect()} == {(1, "A"), (2, "C"), (3, "D")}
    nothing = lambda d: work(d).where("doc <> 2")
    assert store.run("clean", docs((2, "e")), nothing) == 1 and {(r.doc, r.out) for r in store.output("clean").collect()} == {(1, "A"), (3, "D")}
    store.compact("clean")
    assert {(r.doc, r.out) for r in store.output("clean").collect()} == {(1, "A"), (3, "D")} and store.run("clean", docs((2, "e"), (3, "d")), work) == 0
    assert store.run("clean", docs((3, "x")), work) == 1 and {(r.doc, r.out) for r in store.output("clean").collect()} == {(1, "A"), (3, "X")}


def test_partial_progress(spark, tmp_path):
    at = f"file://{tmp_path}/partial"
    rows = spark.createDataFrame([(1, "h1", None), (2, "h2", "calm"), (2, "h2", "calm")], "k int, h string, i string")
    first = PartialProgress(spark, at, {"model": "a", "content": 1}, loose=["content"])
    assert first.rows() is None
    first.add(rows)
    again = PartialProgress(spark, at, {"model": "a", "content": 2}, loose=["content"]).rows()
    units = spark.createDataFrame([(1, "h1", None), (2, "h2", None), (3, "h3", None), (None, "h", None)], "k int, h string, i string")
    assert [r.reuse for r in reusable(units, again, ["k"], "h", ["i"]).orderBy("k").collect()] == [False, True, False, False]
    assert PartialProgress(spark, at, {"model": "b", "content": 2}, loose=["content"]).rows() is None


def test_cache_and_pool(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, h string")
    cache = spark.createDataFrame([(1, "a", "old"), (2, "x", "old")], "k int, h string, out string")
    got = with_cache(rows, cache, ["k"], "h", ["out"], lambda d: d.withColumn("out", F.concat(F.lit("new "), "h")))
    assert sorted(map(tuple, got.collect())) == [(1, "a", "old"), (2, "b", "new b")]
    pool = lambda: Pool(spark, f"file://{tmp_path}/pool", ["x", "y", "z"], 3)
    names = lambda *n: spark.createDataFrame([(v,) for v in n], "name string")
    first = [r.member for r in pool().assign(names("a", "b", "a", None), "name").orderBy("name").collect()]
    second = [r.member for r in pool().assign(names("c", "d"), "name").orderBy("name").collect()]
    assert len(set(first + second[:1])) == 3 and second[1] == first[0]
    with pytest.raises(ValueError):
        Pool(spark, f"file://{tmp_path}/none", [])
