"""Queries of the activity operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, units
from tidemark.operators import activities as A
from tidemark.tables import read

#: The as-of day of all queries.
AS_OF = "2025-04-01"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.activities(read(spark, sf_dir, "actuals"))


def _text(df: DataFrame) -> DataFrame:
    return df.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])


def activity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Converted rows of a date range."""
    rows = _rows(spark, sf_dir).where(F.col("day").between(F.lit("2025-02-01").cast("date"), F.lit("2025-02-28").cast("date")))
    return _text(rows.select("user_id", "activity_id", "day", units.kilometres(F.col("distance_m")).alias("km"), units.pace(F.col("distance_m") / F.nullif(F.col("total_s"), F.lit(0))).alias("pace"), units.is_run(F.col("type_key")).alias("is_run"), units.clock(F.col("total_s")).alias("clock"), units.load_ratio(F.col("acute_load"), F.col("chronic_load")).alias("ratio")))


def zone_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivot of zone seconds."""
    rows = _rows(spark, sf_dir)
    return A.zone_minutes(rows, A.zone_rows(rows))


def weekly_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven-day blocks."""
    rows = _rows(spark, sf_dir)
    return _text(A.weekly_stats(rows, A.zone_rows(rows), AS_OF, 8))


def chronic_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median with outliers dropped."""
    rows = _rows(spark, sf_dir)
    out = A.chronic_minutes(A.weekly_stats(rows, A.zone_rows(rows), AS_OF))
    return out.select("user_id", F.round("chronic_min", 4).alias("chronic_min"), "weeks_used", F.size("dropped").alias("n_dropped"))


def peak_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest and latest block of each user."""
    rows = _rows(spark, sf_dir)
    weeks = A.weekly_stats(rows, A.zone_rows(rows), AS_OF, 8)
    return _text(weeks.groupBy("user_id").agg(F.max("total_zone_min").alias("peak_min"), F.max("block_end").alias("latest_end"), F.max_by("total_zone_min", "block_end").alias("latest_min")))


def recent_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last ten of each user."""
    return A.recent_activities(_rows(spark, sf_dir)).select("user_id", "activity_id", "start_time_local", "rank")


def loads_at_week_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load snapshot of the block's last day."""
    rows = _rows(spark, sf_dir)
    loads = rows.groupBy("user_id", "day").agg(F.max("acute_load").alias("acute"), F.max("chronic_load").alias("chronic"))
    weeks = A.weekly_stats(rows, A.zone_rows(rows), AS_OF).select("user_id", "block_end")
    return _text(A.load_on(weeks, loads))


def weekly_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: the blocks without distance."""
    rows = _rows(spark, sf_dir)
    return _text(A.weekly_stats(rows, A.zone_rows(rows), AS_OF, 4)).select("user_id", "block_end", "total_zone_min", *[f"zone_{z}_min" for z in range(1, 6)])


def month_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the months around a day that have a line shipped in the same month."""
    months = dates.months_around(F.lit("1996-01-15").cast("date"), 12)
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.trunc("o_orderdate", "MM").alias("month"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.trunc("l_shipdate", "MM").alias("month"))
    near = orders.where(F.array_contains(months, F.col("month")))
    return _text(near.join(lines, ["o_orderkey", "month"], "left_semi"))


def first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a table in a total order."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rows.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with customer and nation, missing ones kept."""
    orders, customers, nations = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey, "left").join(F.broadcast(nations), customers.c_nationkey == nations.n_nationkey, "left")  # 25 nations
    return rows.groupBy("n_name", "o_orderstatus").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("title"), F.col("ts").cast("date").alias("day"))


def distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event of each title and day."""
    return _text(A.dedupe_events(_events(spark, sf_dir), "title", F.col("day"), ["event_id"]).select("event_id", "title", "day"))


def _middle(events: DataFrame) -> str:
    return str(events.agg(F.date_add(F.min("day"), (F.datediff(F.max("day"), F.min("day")) / 2).cast("int"))).first()[0])


def next_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event after the middle day of the table, weeks until it."""
    events = _events(spark, sf_dir)
    day = _middle(events)
    out = A.next_event(events, "user_id", "day", "title", "event_id", day)
    return _text(out.withColumn("weeks", dates.weeks_until(F.col("day"), F.lit(day).cast("date"))))


def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last event in the 28 days before the middle day."""
    events = _events(spark, sf_dir)
    return _text(A.latest_event(events, "user_id", "day", "title", "event_id", _middle(events)))


def duration_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range join of durations to buckets."""
    buckets = spark.createDataFrame([("short", 0.0, 44.99), ("medium", 45.0, 74.99), ("long", 75.0, 119.99), ("very_long", 120.0, None)], "bucket string, low double, high double")
    rows = _rows(spark, sf_dir).select("activity_id", F.bround(F.col("total_s") / 60, 2).alias("min"))
    return A.bucket_of(rows.where("min IS NOT NULL"), buckets, "min").groupBy("bucket").agg(F.count("*").alias("n"))


def feelings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scales and zones from whole numbers."""
    parts = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 2).alias("score"), F.col("p_size").cast("double").alias("raw"))
    zones = units.zone_bounds(F.lit(120) + F.col("raw").cast("int"), F.lit(50))
    return parts.select("p_partkey", units.feeling(F.col("score")).alias("feeling"), units.effort(F.col("raw")).alias("effort"), F.element_at(zones, 3).min_bpm.alias("zone_3_min"))


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-family: JSON properties of events by type."""
    rows = read(spark, sf_dir, "events").select("event_type", F.map_keys(F.from_json("props", "map<string,string>")).alias("keys"))
    return rows.select("event_type", F.explode("keys").alias("key")).groupBy("event_type", "key").agg(F.count("*").alias("n"))


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kilometres of each user's days, by week and position in it."""
    rows = _rows(spark, sf_dir).where("user_id IS NOT NULL AND day IS NOT NULL").groupBy("user_id", "day").agg(F.round(F.sum("distance_m"), 3).alias("metres"))
    return rows.select("user_id", F.trunc("day", "week").alias("week"), F.weekday("day").alias("position"), "metres")


def rest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two days of a week with the greatest value."""
    return _text(A.parted_by_heat(_days(spark, sf_dir), ["user_id", "week"], "metres", "position").where("rest").select("user_id", "week", "position"))


def coolest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day of a week with the least value, and the one nearest to its middle."""
    days = _days(spark, sf_dir)
    middle = A.coolest_day(days, ["user_id", "week"], "metres", "position", 3).withColumnRenamed("day", "middle")
    return _text(A.coolest_day(days, ["user_id", "week"], "metres", "position").join(middle, ["user_id", "week"]))


def peak_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: greatest minutes of the weeks with running, else of all."""
    rows = _rows(spark, sf_dir)
    weeks = A.weekly_stats(rows, A.zone_rows(rows), AS_OF, 8)
    return A.peak_minutes(weeks, "user_id", "total_zone_min", F.col("distance_km") > 0)


def recovery_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: weeks that hold an event of the user, and first weeks after one; blocks end the day before as_of."""
    rows = _rows(spark, sf_dir)
    weeks = A.weekly_stats(rows, A.zone_rows(rows), AS_OF, 8).select("user_id", "block_start", "block_end")
    days = rows.where("type_key = 'trail_running' AND day IS NOT NULL").groupBy("user_id").agg(F.max("day").alias("event"))
    held = weeks.join(days, "user_id", "left")
    return _text(held.select("user_id", "block_end", dates.contains_day(F.col("block_start"), F.col("block_end"), F.col("event")).alias("holds"), dates.first_recovery(F.col("block_start"), F.col("block_end"), F.col("event")).alias("recovers")))


QUERIES = {f"ref_{f.__name__}": f for f in (activity_rows, zone_minutes, weekly_stats, chronic_minutes, peak_week, recent_activities, loads_at_week_end, distinct_events, next_events, latest_events, duration_buckets, feelings, event_values, weekly_zones, month_scan, first_page, enriched, rest_days, coolest_days, peak_minutes, recovery_weeks)}

_BASE = """WITH v AS (SELECT record_id, arg_max(struct_pack(u := user_id, s := start_time_local, z := total_zone_min, d := distance_km, a := acute_load, c := chronic_load, t := type_key), received_at) AS r FROM actuals GROUP BY record_id),
a AS (SELECT r.u AS user_id, record_id AS activity_id, CASE WHEN regexp_matches(r.s, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(substr(r.s, 1, 10) AS DATE) END AS day,
  r.s AS start_time_local, r.t AS type_key, r.d * 1000 AS distance_m, CAST(floor(r.z * 60) AS BIGINT) AS total_s, r.a AS acute_load, r.c AS chronic_load FROM v),
z AS (SELECT activity_id, zone, CAST(floor(total_s * ((activity_id + zone) % 5 + 1) / 15) AS BIGINT) AS secs FROM a, (SELECT unnest([1, 2, 3, 4, 5]) AS zone) WHERE total_s IS NOT NULL)
"""
_RUN = "('running', 'trail_running', 'treadmill_running', 'track_running', 'virtual_run', 'indoor_running', 'ultramarathon')"
_WEEKS = (
    _BASE
    + """, b AS (SELECT *, CAST(floor(date_diff('day', day, DATE '2025-03-31') / 7) AS INT) AS block FROM a WHERE day <= DATE '2025-03-31'),
di AS (SELECT user_id, block, sum(CASE WHEN type_key IN """
    + _RUN
    + """ THEN coalesce(distance_m, 0) END) AS run_m FROM b WHERE block BETWEEN 0 AND {last} GROUP BY ALL),
tr AS (SELECT user_id, block, {sums} FROM b JOIN z USING (activity_id) WHERE block BETWEEN 0 AND {last} GROUP BY ALL),
sp AS (SELECT DISTINCT user_id, block FROM a, (SELECT unnest(range(0, {last} + 1)) AS block) WHERE user_id IS NOT NULL),
w AS (SELECT sp.user_id, strftime(DATE '2025-03-31' - CAST(sp.block * 7 + 6 AS INT), '%Y-%m-%d') AS block_start, strftime(DATE '2025-03-31' - CAST(sp.block * 7 AS INT), '%Y-%m-%d') AS block_end,
  round_even(coalesce(run_m, 0) / 1000, 2) AS distance_km, {mins} FROM sp LEFT JOIN di USING (user_id, block) LEFT JOIN tr USING (user_id, block))
"""
)


def _weeks(blocks: int) -> str:
    sums = ", ".join(f"sum(CASE WHEN zone = {k} THEN secs END) AS s{k}" for k in range(1, 6))
    c = {k: f"coalesce(s{k}, 0)" for k in range(1, 6)}
    total = " + ".join(c.values())
    groups = {"easy": f"({c[1]} + {c[2]})", "medium": c[3], "hard": f"({c[4]} + {c[5]})", "zone_4": c[4], "zone_5": c[5]}
    mins = [f"round_even({' + '.join(f'round_even({x} / 60, 2)' for x in c.values())}, 2) AS total_zone_min"]
    mins += [f"round_even({x} / 60, 2) AS zone_{k}_min" for k, x in c.items()]
    mins += [f"round_even({groups[g]} / 60, 2) AS {g}_min" for g in A.SHARES[:3]]
    mins += [f"round_even(100 * {groups[g]} / nullif({total}, 0), 1) AS {g}_pct" for g in A.SHARES]
    return _WEEKS.replace("{last}", str(blocks - 1)).replace("{sums}", sums).replace("{mins}", ", ".join(mins))


_EVENTS = "e AS (SELECT event_id, user_id, event_type AS title, CAST(ts AS DATE) AS day FROM events), m AS (SELECT min(day) + CAST(floor(date_diff('day', min(day), max(day)) / 2) AS INT) AS mid FROM e)"

_DAYS = _BASE + """, d AS (SELECT user_id, strftime(date_trunc('week', day), '%Y-%m-%d') AS week, CAST(isodow(day) - 1 AS INT) AS position, round(sum(distance_m), 3) AS metres FROM a WHERE user_id IS NOT NULL AND day IS NOT NULL GROUP BY ALL)
"""

ORACLE = {
    "ref_rest_days": _DAYS + "SELECT user_id, week, position FROM d QUALIFY row_number() OVER (PARTITION BY user_id, week ORDER BY coalesce(metres, 20) DESC, position) <= 2",
    "ref_coolest_days": _DAYS + "SELECT user_id, week, arg_min(position, (coalesce(metres, 20), position)) AS day, arg_min(position, (abs(position - 3), coalesce(metres, 20), position)) AS middle FROM d GROUP BY ALL",
    "ref_peak_minutes": _weeks(8) + "SELECT user_id, coalesce(max(total_zone_min) FILTER (distance_km > 0), max(total_zone_min), 0) AS peak FROM w GROUP BY user_id",
    "ref_recovery_weeks": _weeks(8)
    + """, e AS (SELECT user_id, max(day) AS event FROM a WHERE type_key = 'trail_running' GROUP BY user_id), k AS (SELECT w.user_id, CAST(block_start AS DATE) AS s, CAST(block_end AS DATE) AS t, block_end, event FROM w LEFT JOIN e USING (user_id))
SELECT user_id, block_end, coalesce(event >= s AND event <= t, false) AS holds, coalesce(event < t AND s <= event + 7, false) AS recovers FROM k""",
    "ref_activity_rows": _BASE
    + f"""SELECT user_id, activity_id, strftime(day, '%Y-%m-%d') AS day, round_even(distance_m / 1000, 2) AS km,
  CASE WHEN distance_m <> 0 THEN round_even(1000 / (distance_m / nullif(total_s, 0)) / 60, 2) END AS pace, coalesce(type_key IN {_RUN}, false) AS is_run,
  CASE WHEN total_s >= 3600 THEN (total_s // 3600) || ':' || lpad(CAST(total_s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(total_s % 60 AS VARCHAR), 2, '0')
    ELSE (total_s // 60) || ':' || lpad(CAST(total_s % 60 AS VARCHAR), 2, '0') END AS clock, round_even(acute_load / nullif(chronic_load, 0), 2) AS ratio
  FROM a WHERE day BETWEEN DATE '2025-02-01' AND DATE '2025-02-28'""",
    "ref_zone_minutes": _BASE + "SELECT a.activity_id, " + ", ".join(f"round_even(sum(CASE WHEN zone = {k} THEN secs END) / 60, 2) AS zone_{k}_min" for k in range(1, 6)) + " FROM a LEFT JOIN z USING (activity_id) GROUP BY a.activity_id",
    "ref_weekly_stats": _weeks(8) + "SELECT * FROM w",
    "ref_chronic_minutes": _weeks(4)
    + """, r AS (SELECT user_id, total_zone_min AS t, median(total_zone_min) OVER (PARTITION BY user_id) AS mid FROM w WHERE total_zone_min > 0)
SELECT user_id, round(coalesce(avg(t) FILTER (abs(t - mid) / mid <= 0.5), any_value(mid)), 4) AS chronic_min, count(*) FILTER (abs(t - mid) / mid <= 0.5) AS weeks_used,
  CAST(count(*) FILTER (abs(t - mid) / mid > 0.5) AS INT) AS n_dropped FROM r GROUP BY user_id""",
    "ref_peak_week": _weeks(8) + "SELECT user_id, max(total_zone_min) AS peak_min, max(block_end) AS latest_end, arg_max(total_zone_min, block_end) AS latest_min FROM w GROUP BY user_id",
    "ref_recent_activities": _BASE + "SELECT user_id, activity_id, start_time_local, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start_time_local DESC, activity_id DESC) AS INT) AS rank FROM a WHERE start_time_local IS NOT NULL QUALIFY rank <= 10",
    "ref_loads_at_week_end": _weeks(4)
    + """, l AS (SELECT user_id, strftime(day, '%Y-%m-%d') AS block_end, max(acute_load) AS acute, max(chronic_load) AS chronic FROM a GROUP BY ALL)
SELECT w.user_id, w.block_end, acute, chronic, round_even(acute / nullif(chronic, 0), 2) AS ratio FROM w LEFT JOIN l ON w.user_id = l.user_id AND w.block_end = l.block_end""",
    "ref_distinct_events": f"WITH {_EVENTS} SELECT event_id, title, strftime(day, '%Y-%m-%d') AS day FROM e QUALIFY row_number() OVER (PARTITION BY lower(trim(title)), day ORDER BY event_id) = 1",
    "ref_next_events": f"WITH {_EVENTS} SELECT user_id, strftime(day, '%Y-%m-%d') AS day, title, CAST(date_diff('day', mid, day) // 7 AS INT) AS weeks FROM e, m WHERE day > mid QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day, event_id) = 1",
    "ref_latest_events": f"WITH {_EVENTS} SELECT user_id, strftime(day, '%Y-%m-%d') AS day, title FROM e, m WHERE day < mid AND day >= mid - 28 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC, event_id) = 1",
    "ref_duration_buckets": _BASE
    + """, d AS (SELECT round_even(total_s / 60, 2) AS m FROM a WHERE total_s IS NOT NULL)
SELECT CASE WHEN m >= 0 AND m <= 44.99 THEN 'short' WHEN m >= 45 AND m <= 74.99 THEN 'medium' WHEN m >= 75 AND m <= 119.99 THEN 'long' WHEN m >= 120 THEN 'very_long' END AS bucket, count(*) AS n FROM d GROUP BY ALL""",
    "ref_feelings": """SELECT p_partkey, CASE WHEN p_size * 2 <= 12.5 THEN 'Very weak' WHEN p_size * 2 <= 37.5 THEN 'Weak' WHEN p_size * 2 <= 62.5 THEN 'Normal' WHEN p_size * 2 <= 87.5 THEN 'Strong' ELSE 'Very strong' END AS feeling,
  CASE WHEN p_size >= 10 THEN round_even(p_size / 10, 1) WHEN p_size > 0 THEN CAST(p_size AS DOUBLE) END AS effort, CAST(round_even((70 + p_size) * 0.75 + 50, 0) AS INT) AS zone_3_min FROM part""",
    "ref_weekly_zones": _weeks(4) + "SELECT user_id, block_end, total_zone_min, zone_1_min, zone_2_min, zone_3_min, zone_4_min, zone_5_min FROM w",
    "ref_month_scan": """WITH o AS (SELECT o_orderkey, date_trunc('month', o_orderdate) AS month FROM orders WHERE o_orderdate >= DATE '1995-11-01' AND o_orderdate < DATE '1997-01-01')
SELECT o_orderkey, strftime(month, '%Y-%m-%d') AS month FROM o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND date_trunc('month', l_shipdate) = month)""",
    "ref_first_page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40",
    "ref_enriched": "SELECT n_name, o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
    "ref_event_values": "SELECT event_type, key, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events) GROUP BY ALL",
}
