import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators.incremental import CommitLog, SectionFeed, canonical_path, due_sections, recorded_sections, successful_runs

T0 = dt.datetime(2025, 1, 1)
at = lambda n: T0 + dt.timedelta(hours=n)
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
SECTIONS = "book_id bigint, chapter_index int, section_index int, text string, text_hash string, updated_at timestamp_ntz, received_at timestamp_ntz"
STATE = "run_id string, book_id bigint, chapter_index int, section_index int, text_hash string, written_at timestamp_ntz"
RUNS = "run_id string, source_path string, status string, started_at timestamp_ntz, logged_at timestamp_ntz"
BOOKS = "book_id bigint, source_path string"


def frames(spark, sections, state, runs, books=((1, "/lib/a b.md"),)):
    return [spark.createDataFrame(list(r), s) for r, s in ((sections, SECTIONS), (state, STATE), (runs, RUNS), (books, BOOKS))]


def keys(df):
    return {tuple(r[:3]) for r in df.collect()}


def test_paths(spark):
    same = ["/lib/a b.md", "/lib/./a b.md", "/lib//a b.md", "/lib/tmp/../a b.md", "file:///lib/a%20b.md", " /lib/a b.md "]
    out = spark.createDataFrame([(p,) for p in [*same, "/lib/a+b.md", "/lib/100%.md", None]], "p string").select(canonical_path(F.col("p"))).collect()
    assert [r[0] for r in out] == ["/lib/a b.md"] * 6 + ["/lib/a+b.md", "/lib/100%.md", None]


def test_due(spark):
    sections = [
        (1, 0, 0, "same", None, at(1), at(1)), (1, 0, 1, "old", "x", at(1), at(9)), (1, 0, 1, "new", "x", at(2), at(2)), (1, 0, 1, "new", "x", at(2), at(2)),
        (1, 0, 2, "never", sha("never"), at(1), at(1)), (1, 0, 3, "failed only", None, at(1), at(1)), (1, 0, 4, None, None, at(2), at(2)), (None, None, None, "t", None, at(1), at(1)),
    ]
    state = [
        ("r1", 1, 0, 0, sha("same").upper(), at(2)), ("r1", 1, 0, 0, sha("same"), at(2)), ("r1", 1, 0, 1, sha("old"), at(2)), ("r2", 1, 0, 1, sha("new"), at(5)),
        ("r2", 1, 0, 3, sha("failed only"), at(5)), ("r1", 1, 0, 4, sha("gone"), at(5)), (None, 1, 0, 2, sha("never"), at(5)),
    ]
    runs = [
        ("r1", "/lib/a b.md", "running", at(1), at(1)), ("r1", "file:///lib/a%20b.md", " OK", at(1), at(2)), ("r1", "file:///lib/a%20b.md", " OK", at(1), at(2)),
        ("r2", "/lib/./a b.md", "ok", at(4), at(4)), ("r2", "/lib/a b.md", "Failed", at(4), at(6)), ("r3", None, "ok", at(4), at(6)),
    ]
    f = frames(spark, sections, state, runs)
    assert [(r.run_id, r.book_id) for r in successful_runs(f[2], f[3]).collect()] == [("r1", 1)]
    assert keys(due_sections(*f)) == {(1, 0, 1), (1, 0, 2), (1, 0, 3), (1, 0, 4), (None, None, None)}


def test_empty_and_clashing_columns(spark):
    assert due_sections(*frames(spark, [], [], [], [])).count() == 0
    f = frames(spark, [(1, 0, 0, "a", None, at(1), at(1))], [("r1", 1, 0, 0, sha("a"), at(1))], [("r1", "/lib/a b.md", "ok", at(1), at(1))])
    clash = [d.withColumn("started_at_", F.lit(1)).withColumn("feed", F.lit(1)).withColumn("path", F.lit(2)) for d in f]
    clash[1] = clash[1].withColumn("started_at", F.lit("x"))
    assert due_sections(*clash).count() == 0


def test_commit_log(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log", "seq")
    source = lambda n: spark.range(n).selectExpr("id AS seq", "id * 10 AS v")
    assert not log.run(source(0), lambda d: d)
    assert log.run(source(5), lambda d: d)
    with pytest.raises(Exception, match="(?i)boom|divide|error"):
        log.run(source(8), lambda d: d.select(F.raise_error(F.lit("boom")).cast("bigint").alias("seq"), "v"))
    assert log.watermark() == "4"
    assert log.run(source(8), lambda d: d) and not log.run(source(8), lambda d: d)
    assert sorted(r.seq for r in log.output().collect()) == list(range(8))
    with pytest.raises(RuntimeError, match="taken"):
        log.publish(0, {"upper": "1"})


def test_failure_between_write_and_publish(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log", "seq")
    source = lambda n: spark.range(n).selectExpr("id AS seq")
    log.run(source(3), lambda d: d)
    publish, log.publish = log.publish, lambda *_: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        log.run(source(6), lambda d: d)
    assert log.watermark() == "2" and log.output().count() == 3
    log.publish = publish
    assert log.run(source(6), lambda d: d) and sorted(r.seq for r in log.output().collect()) == list(range(6))


def test_ties_at_the_limit(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log", "seq")
    rows = lambda *r: spark.createDataFrame(list(r), "seq int, v string, m map<string,int>")
    a, b, c, d = (1, "a", None), (2, "b", {"x": 1}), (2, "b", {"x": 2}), (3, "d", None)
    assert log.run(rows(a, b, b), lambda d: d) and not log.run(rows(a, b, b), lambda d: d)
    assert log.run(rows(a, b, b, b, c), lambda d: d)  # more rows under the committed limit, one an exact copy
    assert log.run(rows(a, b, b, b, c, d, (None, "n", None)), lambda d: d)
    got = [(r.seq, r.v, r.m) for r in log.output().collect()]
    assert len(got) == 6 and all(got.count(x) == n for x, n in ((a, 1), (b, 3), (c, 1), (d, 1)))


def test_section_feed(spark, tmp_path):
    v = lambda section, text, updated, received: (1, 0, section, text, None, at(updated), received and at(received))
    feed = SectionFeed(spark, f"file://{tmp_path}/feed")
    feed.FOLDERS = 2
    first = [v(0, "a", 1, 1), v(1, "b", 1, 1), v(2, "c", 1, None)]
    f = frames(spark, first, [("r1", 1, 0, 0, sha("a"), at(1))], [("r1", "/lib/a b.md", "ok", at(1), at(1))])
    runs = [(first, {1, 2}), (first, set())]
    later = [*first, v(1, "b", 1, 2), v(0, "a", 2, 3), v(3, "d", 1, 3)]  # a redelivery, a newer version with the same text, a new section
    runs += [(later, {3}), ([*later, v(4, "e", 1, 3), v(0, "older", 0, 4)], {4}), ([*later, v(4, "e", 1, 3), v(0, "new", 5, 5)], {0})]  # a tie at the limit, a late old version
    for rows, want in runs:
        n = feed.run(spark.createDataFrame(rows, SECTIONS), recorded_sections(*f[1:]))
        assert {k[2] for k in keys(feed.output(n))} == want
    assert len(feed.last()[1]["states"]) == 1 or len(feed.last()[1]["states"]) <= 3
    assert sorted(k.section_index for k in feed.output().collect()) == [0, 1, 2, 3, 4]
    assert SectionFeed(spark, f"file://{tmp_path}/other").run(f[0].limit(0)) == 0
