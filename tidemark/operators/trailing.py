"""Rolling totals over trailing periods (problem 5).

Cumulative prefix sums per entity, carried forward over the days without activity; a
trailing total is the difference of two prefix values.  Everything stays JVM-side.

Plan: one shuffle by record id (newest version), one by (entity, day) after a map-side
partial sum, one by entity over rows that are by then at most one per calendar day, so
that an entity holding a third of all raw rows costs no more than its days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEASURES = ("total_zone_min", "distance_km", "acute_load", "chronic_load")
PERIODS = (7, 30)
#: Measures are summed as whole millionths, so that differences of prefix sums are exact.
SCALE = 1_000_000


def iso_day(text: Column) -> Column:
    """The day in the first ten characters; NULL when they are no day of the calendar."""
    head = F.substring(text, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(head, F.lit("yyyy-MM-dd")).cast("date"))


def newest_records(actuals: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """The newest version of every record: greatest received_at, ties by the greatest values.

    A row without record_id stands for itself; exact copies of it count once.
    """
    version = F.struct("received_at", "start_time_local", "user_id", *measures)
    key = F.when(F.col("record_id").isNull(), F.xxhash64("user_id", "start_time_local", "received_at", *measures))
    newest = actuals.groupBy("record_id", key.alias("copy_key")).agg(F.max(version).alias("v"))
    return newest.select("record_id", "v.*")


def daily_totals(records: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """(user_id, day, scaled totals); NULL, NaN and infinite measures add nothing."""
    whole = [
        F.coalesce(F.sum(F.when(~F.isnan(m) & (F.abs(m) < 1e12), F.round(F.col(m) * SCALE).cast("long"))), F.lit(0).cast("long")).alias(m)
        for m in measures
    ]
    days = records.select("user_id", iso_day(F.col("start_time_local")).alias("day"), *measures)
    return days.where("user_id IS NOT NULL AND day IS NOT NULL").groupBy("user_id", "day").agg(*whole)


def trailing_totals(actuals: DataFrame, measures: Sequence[str] = MEASURES, periods: Sequence[int] = PERIODS) -> DataFrame:
    """One row per user_id and obs_date from the entity's first to its last readable day.

    Columns ``<measure>_<n>d`` (total of the n days that end with the day) and
    ``<measure>_<n>d_avg`` (total / n, days without activity and days before the first
    one count as zero).  Rows without user or readable day have no day and drop out;
    further input columns are ignored; an empty table gives an empty result.
    """
    records = newest_records(actuals, measures)
    by_user = Window.partitionBy("user_id").orderBy("day")
    prefix = daily_totals(records, measures).select(
        "user_id",
        "day",
        F.lead("day").over(by_user).alias("next_day"),
        *[F.sum(m).over(by_user.rowsBetween(Window.unboundedPreceding, 0)).alias(m) for m in measures],
    )
    until = F.coalesce(F.date_sub("next_day", 1), F.col("day"))
    dense = prefix.select("user_id", F.explode(F.sequence("day", until)).alias("obs_date"), *measures)
    order = Window.partitionBy("user_id").orderBy("obs_date")
    out = [F.col("user_id"), F.col("obs_date")]
    for n in periods:
        for m in measures:
            total = (F.col(m) - F.coalesce(F.lag(m, n).over(order), F.lit(0))) / F.lit(float(SCALE))
            out += [total.alias(f"{m}_{n}d"), (total / n).alias(f"{m}_{n}d_avg")]
    return dense.select(*out)


def resting_days(actuals: DataFrame) -> DataFrame:
    """Days with no zone minutes in seven days but some in thirty (query p5_found)."""
    totals = trailing_totals(actuals, ("total_zone_min",))
    idle = totals.where("total_zone_min_7d = 0 AND total_zone_min_30d > 0")
    return idle.select("user_id", F.date_format("obs_date", "yyyy-MM-dd").alias("obs_date"))
