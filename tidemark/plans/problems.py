"""Queries of the general problems: p1 (changed records) and p5 (trailing totals)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.incremental import SectionFeed, recorded_sections, successful_runs
from tidemark.operators.trailing import resting_days, trailing_totals
from tidemark.tables import read, scratch


def p1_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The committed output of a run of the section feed that takes over the ledger's successful runs."""
    sections, *ledger = [read(spark, sf_dir, t) for t in ("sections", "section_state", "book_runs", "books")]
    feed = SectionFeed(spark, scratch(spark, "sections"))
    feed.run(sections, recorded_sections(*ledger))
    return feed.output()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_due(spark, sf_dir).select("book_id", "chapter_index", "section_index")


def p1_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return successful_runs(read(spark, sf_dir, "book_runs"), read(spark, sf_dir, "books"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resting_days(read(spark, sf_dir, "actuals"))


def p5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trailing_totals(read(spark, sf_dir, "actuals"))
    numbers = [F.round(c, 4).alias(c) for c in rows.columns[2:]]
    return rows.select("user_id", F.date_format("obs_date", "yyyy-MM-dd").alias("obs_date"), *numbers)


QUERIES = {"p1_found": p1_found, "p1_due": p1_due, "p1_runs": p1_runs, "p5_found": p5_found, "p5_totals": p5_totals}

_PATH = r"""regexp_replace(regexp_replace(regexp_replace(
  replace(regexp_replace({0}, '^file://', ''), '%20', ' '), '/[^/]+/\.\./', '/', 'g'), '/\./', '/', 'g'), '/+', '/', 'g')"""

_P1 = rf"""WITH l AS (
  SELECT run_id, url_decode(replace({_PATH.format("source_path")}, '+', '%2B')) AS path, logged_at, started_at, lower(trim(status)) AS status FROM book_runs),
r AS (SELECT run_id, path, arg_max(status, logged_at) AS status, arg_max(started_at, logged_at) AS started_at FROM l GROUP BY ALL),
runs AS (SELECT run_id, book_id, max(started_at) AS started_at FROM r JOIN books ON books.source_path = r.path WHERE status = 'ok' GROUP BY ALL),
d AS (SELECT book_id, chapter_index, section_index, arg_max(lower(trim(text_hash)), started_at) AS recorded_hash
  FROM section_state JOIN runs USING (run_id, book_id) GROUP BY ALL),
n AS (SELECT book_id, chapter_index, section_index, arg_max(sha256(text), updated_at) AS text_hash FROM sections GROUP BY ALL)
"""
_DUE = "FROM n LEFT JOIN d USING (book_id, chapter_index, section_index) WHERE recorded_hash IS NULL OR recorded_hash <> text_hash"

_P5 = """WITH v AS (SELECT record_id, arg_max(struct_pack(u := user_id, s := start_time_local, z := total_zone_min, d := distance_km, a := acute_load, c := chronic_load), received_at) AS r
  FROM actuals GROUP BY record_id),
p AS (SELECT r.u AS user_id, TRY_CAST(substr(r.s, 1, 10) AS DATE) AS day, coalesce(r.z, 0) AS z, coalesce(r.d, 0) AS d, coalesce(r.a, 0) AS a, coalesce(r.c, 0) AS c FROM v
  WHERE regexp_matches(r.s, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')),
t AS (SELECT user_id, day, sum(z) AS z, sum(d) AS d, sum(a) AS a, sum(c) AS c FROM p WHERE day IS NOT NULL GROUP BY ALL),
s AS (SELECT user_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM t GROUP BY user_id),
f AS (SELECT s.user_id, s.day, coalesce(z, 0) AS z, coalesce(d, 0) AS d, coalesce(a, 0) AS a, coalesce(c, 0) AS c FROM s LEFT JOIN t USING (user_id, day)),
w AS (SELECT user_id, strftime(day, '%Y-%m-%d') AS obs_date, {sums} FROM f
  WINDOW w7 AS (PARTITION BY user_id ORDER BY day ROWS 6 PRECEDING), w30 AS (PARTITION BY user_id ORDER BY day ROWS 29 PRECEDING))
"""
_NAMES = {"z": "total_zone_min", "d": "distance_km", "a": "acute_load", "c": "chronic_load"}
_SUMS = ", ".join(f"round(sum({k}) OVER w{n}, 4) AS {m}_{n}d, round(sum({k}) OVER w{n} / {n}, 4) AS {m}_{n}d_avg" for n in (7, 30) for k, m in _NAMES.items())

ORACLE = {
    "p1_found": f"{_P1} SELECT book_id, chapter_index, section_index {_DUE}",
    "p1_due": f"{_P1} SELECT book_id, chapter_index, section_index, text_hash, recorded_hash {_DUE}",
    "p1_runs": f"{_P1} SELECT run_id, book_id, started_at FROM runs",
    "p5_found": _P5.format(sums="sum(z) OVER w7 AS z7, sum(z) OVER w30 AS z30") + " SELECT user_id, obs_date FROM w WHERE round(z7, 4) = 0 AND round(z30, 4) > 0",
    "p5_totals": _P5.format(sums=_SUMS) + " SELECT * FROM w",
}
