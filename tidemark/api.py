"""The callable surface: validated parameters in, DataFrames out; every date is explicit."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, records, units
from tidemark.operators import activities as A
from tidemark.tables import read

_WORDS = {"true": True, "1": True, "yes": True, "on": True, "false": False, "0": False, "no": False, "off": False}


class ParameterError(ValueError):
    """A parameter out of its range; ``code`` and ``retryable`` as errors are reported."""

    code, retryable = "invalid_parameter", False


def parse_days(value: object, default: int = 28, most: int = 90) -> int:
    """A number of days from 1 to ``most``; blank is the default."""
    if value in (None, ""):
        return default
    try:
        days = int(str(value))
    except ValueError:
        raise ParameterError(f"not a number of days: {value!r}") from None
    if not 1 <= days <= most:
        raise ParameterError(f"days must be from 1 to {most}: {days}")
    return days


def parse_flag(value: object, default: bool = False) -> bool:
    """A boolean word."""
    if value in (None, ""):
        return default
    try:
        return _WORDS[str(value).strip().lower()]
    except KeyError:
        raise ParameterError(f"not a yes or no: {value!r}") from None


def parse_day(value: str) -> dt.date:
    """A day written yyyy-MM-dd."""
    try:
        return dt.date.fromisoformat(value)
    except (TypeError, ValueError):
        raise ParameterError(f"not a day: {value!r}") from None


def http_status(error: Exception) -> int:
    return 400 if isinstance(error, ParameterError) else 404 if isinstance(error, FileNotFoundError) else 500


class Engine:
    """Reads of the activity service over a data folder, for all users at once."""

    def __init__(self, spark: SparkSession, data: str) -> None:
        self.spark, self.data = spark, data

    def _rows(self) -> DataFrame:
        return A.activities(read(self.spark, self.data, "actuals"))

    def activities(self, as_of: str, days_back: object = None, zones: object = True) -> DataFrame:
        """Rows of the days before as_of, with minutes by zone unless ``zones`` is off."""
        days, end = parse_days(days_back), parse_day(as_of)
        last = dates.anchor(F.lit(end))
        rows = self._rows().where(F.col("day").between(dates.window_start(last, days), last))
        out = rows.select("user_id", "activity_id", "day", "type_key", units.kilometres(F.col("distance_m")).alias("distance_km"), units.minutes(F.col("total_s")).alias("moving_min"))
        return out.join(A.zone_minutes(rows, A.zone_rows(rows)), "activity_id") if parse_flag(zones, True) else out

    def weekly_stats(self, as_of: str, blocks: int = 4) -> DataFrame:
        if not 1 <= blocks <= 520:
            raise ParameterError("blocks must be from 1 to 520")
        rows = self._rows()
        return A.weekly_stats(rows, A.zone_rows(rows), str(parse_day(as_of)), blocks)

    def baseline(self, as_of: str) -> DataFrame:
        return A.chronic_minutes(self.weekly_stats(as_of))

    def events(self, as_of: str, months_ahead: int = 12, months_back: int = 2) -> DataFrame:
        """Events of the months around as_of, one of a title and day, in order."""
        at = F.lit(parse_day(as_of))
        rows = read(self.spark, self.data, "events").select("event_id", "user_id", F.col("event_type").alias("title"), F.col("ts").cast("date").alias("day"))
        near = rows.where(F.array_contains(dates.months_around(at, months_ahead, months_back), F.trunc("day", "MM")))
        return A.dedupe_events(near, "title", F.col("day"), ["event_id"]).orderBy("day", "event_id")

    def page(self, table: DataFrame, order: list[str], offset: int = 0, limit: int = 20) -> DataFrame:
        """A page of a table in a total order."""
        if offset < 0 or not 1 <= limit <= 1000:
            raise ParameterError("offset must be 0 or more, limit from 1 to 1000")
        return table.orderBy(*order).offset(offset).limit(limit)

    def personal_records(self, items: DataFrame) -> DataFrame:
        return records.personal_records(items)

    def heart_rate_zones(self, people: DataFrame, as_of: str) -> DataFrame:
        """People (user_id, birth, threshold, rest) with greatest rate and zones."""
        age = units.age_on(F.col("birth"), F.lit(parse_day(as_of)))
        top = units.max_heart_rate(age, F.col("threshold"))
        return people.select("user_id", top.alias("max_rate"), units.zone_bounds(top, F.col("rest")).alias("zones"))
