"""Activity analytics for many users at once: rolling blocks, robust baselines, event choice.

Range joins of activities to seven-day blocks are rewritten to an equi-key, the block
number; every aggregate is partial before it is shuffled, and what is kept per user (blocks,
weeks) is bounded by the calendar and not by the user's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dates, units
from tidemark.operators.trailing import iso_day, newest_records

#: A week further from the median than this share of it is no baseline.
OUTLIER = 0.5
SHARES = ("easy", "medium", "hard", "zone_4", "zone_5")


def activities(actuals: DataFrame) -> DataFrame:
    """Counting records in the shape of activities: user_id, activity_id, day, type_key, distance_m, total_s."""
    rows = newest_records(actuals, ("total_zone_min", "distance_km", "acute_load", "chronic_load", "type_key"))
    return rows.select(
        "user_id", F.col("record_id").alias("activity_id"), iso_day(F.col("start_time_local")).alias("day"), "start_time_local", "type_key",
        (F.col("distance_km") * 1000).alias("distance_m"), F.floor(F.col("total_zone_min") * 60).alias("total_s"), "acute_load", "chronic_load",
    )


def zone_rows(rows: DataFrame) -> DataFrame:
    """(activity_id, zone, secs): the tracked seconds of an activity over zones 1 to 5 by a fixed rule of its id."""
    weight = F.pmod(F.col("activity_id") + F.col("zone"), F.lit(5)) + 1
    each = rows.where("total_s IS NOT NULL AND activity_id IS NOT NULL").select("activity_id", "total_s", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("zone"))
    return each.select("activity_id", "zone", F.floor(F.col("total_s") * weight / 15).alias("secs"))


def zone_minutes(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """Five minute columns for each activity: all NULL without zone rows, 0 for a zone that has none."""
    wide = zones.where("zone BETWEEN 1 AND 5").groupBy("activity_id").pivot("zone", [1, 2, 3, 4, 5]).agg(F.sum("secs"))
    columns = [F.bround(F.coalesce(F.col(str(z)), F.lit(0)) / 60, 2).alias(f"zone_{z}_min") for z in range(1, 6)]
    return rows.select("activity_id").join(wide.select("activity_id", *columns), "activity_id", "left")


def weekly_stats(rows: DataFrame, zones: DataFrame, as_of: str, blocks: int = 4) -> DataFrame:
    """Dense seven-day blocks of every user, the last ending the day before ``as_of``.

    Distance sums run-like sports only, zone minutes all sports; total_zone_min adds the
    five rounded minutes; shares are NULL in a block without tracked time.  Blocks without
    activity are kept as zero rows.  Activities without a readable day fall in no block.
    """
    end = dates.anchor(F.lit(as_of).cast("date"))
    block = dates.block_number(F.col("day"), end)
    inside = rows.withColumn("block", block).where(F.col("block").between(0, blocks - 1))
    run_m = F.sum(F.when(units.is_run(F.col("type_key")), F.coalesce("distance_m", F.lit(0.0)))).alias("run_m")
    distance = inside.groupBy("user_id", "block").agg(run_m)
    secs = [F.sum(F.when(F.col("zone") == z, F.col("secs"))).alias(f"s{z}") for z in range(1, 6)]
    tracked = inside.select("user_id", "block", "activity_id").join(zones, "activity_id").groupBy("user_id", "block").agg(*secs)
    spine = rows.where("user_id IS NOT NULL").select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    wide = spine.join(distance, ["user_id", "block"], "left").join(tracked, ["user_id", "block"], "left").na.fill(0)
    s = [F.col(f"s{z}") for z in range(1, 6)]
    groups = {"easy": s[0] + s[1], "medium": s[2], "hard": s[3] + s[4], "zone_4": s[3], "zone_5": s[4]}
    total = sum(s[1:], s[0])
    mins = [F.bround(c / 60, 2) for c in s]
    return wide.select(
        "user_id",
        F.date_sub(end, F.col("block") * 7 + 6).alias("block_start"),
        F.date_sub(end, F.col("block") * 7).alias("block_end"),
        F.bround(F.col("run_m") / 1000, 2).alias("distance_km"),
        F.bround(sum(mins[1:], mins[0]), 2).alias("total_zone_min"),
        *[m.alias(f"zone_{z}_min") for z, m in enumerate(mins, 1)],
        *[F.bround(groups[g] / 60, 2).alias(f"{g}_min") for g in SHARES[:3]],
        *[F.bround(100 * groups[g] / F.nullif(total, F.lit(0)), 1).alias(f"{g}_pct") for g in SHARES],
    )


def chronic_minutes(weeks: DataFrame, lookback: int = 4) -> DataFrame:
    """(user_id, chronic_min, weeks_used, dropped): mean of the last weeks' minutes near their median.

    Weeks without minutes are no samples; a sample further than OUTLIER of the median away is
    dropped and listed; with all dropped the median stands.
    """
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("block_end")))
    recent = weeks.withColumn("n", last).where((F.col("n") <= lookback) & (F.col("total_zone_min") > 0))
    mid = F.expr("percentile(total_zone_min, 0.5)").over(Window.partitionBy("user_id"))
    rated = recent.withColumn("mid", mid).withColumn("near", F.abs(F.col("total_zone_min") - F.col("mid")) / F.col("mid") <= OUTLIER)
    kept = F.avg(F.when(F.col("near"), F.col("total_zone_min")))
    return rated.groupBy("user_id").agg(
        F.coalesce(kept, F.first("mid")).alias("chronic_min"),
        F.count_if("near").alias("weeks_used"),
        F.sort_array(F.collect_list(F.when(~F.col("near"), F.col("total_zone_min")))).alias("dropped"),
    )


def recent_activities(rows: DataFrame, limit: int = 10) -> DataFrame:
    """The last activities of each user by start text, then id; ranked, at most ``limit``."""
    order = Window.partitionBy("user_id").orderBy(F.desc("start_time_local"), F.desc("activity_id"))
    return rows.where("start_time_local IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def dedupe_events(events: DataFrame, title: str, day: Column, order: list[str]) -> DataFrame:
    """One event of each title (trimmed, any case) and day: the first in scan order."""
    key = Window.partitionBy(F.lower(F.trim(title)), day).orderBy(*order)
    return events.withColumn("n", F.row_number().over(key)).where("n = 1").drop("n")


def next_event(events: DataFrame, key: str, day: str, title: str, order: str, as_of: str) -> DataFrame:
    """(key, day, title) of the first event after as_of; ties to the first in scan order."""
    ahead = events.where(F.col(day) > F.lit(as_of).cast("date"))
    return ahead.groupBy(key).agg(F.min(F.struct(day, order, title)).alias("e")).select(key, f"e.{day}", f"e.{title}")


def latest_event(events: DataFrame, key: str, day: str, title: str, order: str, as_of: str, days: int = 28) -> DataFrame:
    """(key, day, title) of the last event within the days before as_of."""
    at = F.lit(as_of).cast("date")
    behind = events.where((F.col(day) < at) & (F.col(day) >= F.date_sub(at, days)))
    newest = F.max_by(F.struct(day, title), F.struct(F.col(day), -F.col(order)))
    return behind.groupBy(key).agg(newest.alias("e")).select(key, f"e.{day}", f"e.{title}")


def with_weather(spans: DataFrame, weather: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (start, end) with the mean of the known daily temperatures, one place, and their days' rows."""
    each = spans.select(*keys, F.explode_outer(dates.days_between(F.col("start"), F.col("end"))).alias("day"))
    named = each.join(weather, "day", "left").withColumn("description", units.weather_text(F.col("weather_code")))
    day = F.sort_array(F.collect_list(F.struct("day", "temp_c", "weather_code", "description")))
    return named.groupBy(*keys).agg(F.bround(F.avg("temp_c"), 1).alias("average_temp"), day.alias("days"))


def load_on(weeks: DataFrame, loads: DataFrame) -> DataFrame:
    """Weeks with the load snapshot of their last day, NULL where that day has none, and the ratio."""
    snapshot = loads.select("user_id", F.col("day").alias("block_end"), "acute", "chronic")
    return weeks.join(snapshot, ["user_id", "block_end"], "left").withColumn("ratio", units.load_ratio(F.col("acute"), F.col("chronic")))


def bucket_of(values: DataFrame, buckets: DataFrame, value: str) -> DataFrame:
    """Range join to a small table of (bucket, low, high), high NULL for open; the table is broadcast as it has few rows by its kind."""
    inside = (F.col(value) >= F.col("low")) & (F.col("high").isNull() | (F.col(value) <= F.col("high")))
    return values.join(F.broadcast(buckets), inside, "left")


def detail_columns(rows: DataFrame) -> DataFrame:
    """Rows of the activity service in their units: kilometres, minutes, pace, heart rates, training effects 0 unless known."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return rows.select(
        "user_id", "activity_id", "name", "type_key", units.kilometres(zero("distance_m")).alias("distance_km"), units.minutes(zero("moving_s")).alias("moving_min"),
        units.pace(F.col("avg_speed_mps")).alias("avg_pace"), units.pace(F.col("max_speed_mps")).alias("max_pace"), "max_hr", "avg_hr",
        F.bround(zero("aerobic_te"), 2).alias("aerobic_te"), F.bround(zero("anaerobic_te"), 2).alias("anaerobic_te"), "te_label",
    )


def profiles(rows: DataFrame) -> DataFrame:
    """Profiles in their units: weight in kilograms, threshold speed in metres a minute, lists never NULL."""
    days = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c)
    speed = F.bround(F.coalesce(F.col("threshold_speed"), F.lit(0.0)) * 1000 / 60, 2)
    return rows.select("user_id", units.kilograms(F.coalesce(F.col("weight_g"), F.lit(0.0))).alias("weight_kg"), "height", "birth_date", "vo2max", speed.alias("threshold_speed"), "threshold_rate", days("training_days"), days("long_days"))


def race_predictions(rows: DataFrame) -> DataFrame:
    """Predicted times: minutes for 5 and 10 kilometres, hours for half and full marathon, 0 for none."""
    return rows.select("user_id", units.race_minutes(F.col("s_5k")).alias("min_5k"), units.race_minutes(F.col("s_10k")).alias("min_10k"), units.race_hours(F.col("s_half")).alias("h_half"), units.race_hours(F.col("s_full")).alias("h_full"))


def peak_minutes(weeks: DataFrame, by: str, minutes: str, preferred: Column) -> DataFrame:
    """(by, peak): the greatest minutes of the preferred weeks, of all if there are none, 0 at least."""
    best = F.coalesce(F.max(F.when(preferred, F.coalesce(F.col(minutes), F.lit(0.0)))), F.max(minutes), F.lit(0.0))
    return weeks.groupBy(by).agg(best.alias("peak"))


def parted_by_heat(days: DataFrame, by: list[str], temp: str, order: str, hottest: int = 2) -> DataFrame:
    """Days of a group with ``rest``: whether it is one of the hottest; an unknown temperature is 20 degrees, ties go to
    the earlier day."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.coalesce(F.col(temp), F.lit(20.0))), order)
    return days.withColumn("rest", F.row_number().over(w) <= hottest)


def coolest_day(days: DataFrame, by: list[str], temp: str, order: str, middle: int | None = None) -> DataFrame:
    """(by, day): the coolest day of a group, ties to the earlier one; with ``middle`` the day nearest to that
    position, then the coolest."""
    known = F.coalesce(F.col(temp), F.lit(20.0)).alias("t")
    rank = F.struct(known, order) if middle is None else F.struct(F.abs(F.col(order) - middle).alias("m"), known, order)
    return days.groupBy(*by).agg(F.min_by(order, rank).alias("day"))


def joined_lists(rows: DataFrame, by: list[str], order: str, items: str) -> DataFrame:
    """The arrays of a group as one, in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(items), F.array().cast(dict(rows.dtypes)[items])).alias("x"))))
    return rows.groupBy(*by).agg(F.flatten(F.transform(ordered, lambda r: r.x)).alias(items))
