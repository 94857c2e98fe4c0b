"""Unit conversions and lookups as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sports whose distance counts, labels of the feeling scale, heart-rate zones, weather codes.
RUN_TYPES = ("running", "trail_running", "treadmill_running", "track_running", "virtual_run", "indoor_running", "ultramarathon")
FEELINGS = ((0, "Very weak"), (25, "Weak"), (50, "Normal"), (75, "Strong"), (100, "Very strong"))
HEART_ZONES = ((1, 0.55, 0.65, "Recovery"), (2, 0.55, 0.78, "Easy / long run"), (3, 0.75, 0.80, "Steady state / tempo"), (4, 0.80, 0.85, "Lactate threshold"), (5, 0.90, 1.00, "Speed / VO2max / sprints"))
WORKOUT_ZONES = {"recovery": 1, "base": 2, "long_run": 2, "weighted_pack": 2, "threshold": 4, "sprint": 5, "hill_repeats": 5, "interval_recovery": 1, "warmup": 2, "cooldown": 1}
WEATHER = {
    0: "Clear sky", 1: "Mainly clear", 2: "Partly cloudy", 3: "Overcast", 45: "Fog", 48: "Rime fog",
    51: "Light drizzle", 53: "Drizzle", 55: "Dense drizzle", 56: "Light freezing drizzle", 57: "Freezing drizzle",
    61: "Light rain", 63: "Rain", 65: "Heavy rain", 66: "Light freezing rain", 67: "Freezing rain",
    71: "Light snow", 73: "Snow", 75: "Heavy snow", 77: "Snow grains",
    80: "Light rain showers", 81: "Rain showers", 82: "Violent rain showers", 85: "Light snow showers", 86: "Snow showers",
    95: "Thunderstorm", 96: "Thunderstorm with hail", 99: "Thunderstorm with heavy hail",
}


def kilometres(metres: Column) -> Column:
    return F.bround(metres / 1000, 2)


def minutes(seconds: Column, places: int = 2) -> Column:
    return F.bround(seconds / 60, places)


def pace(metres_per_second: Column) -> Column:
    """Minutes a kilometre; NULL for no speed or zero."""
    return F.bround(F.when(metres_per_second != 0, 1000 / metres_per_second / 60), 2)


def race_minutes(seconds: Column) -> Column:
    """Predicted short-race time in minutes, 0 for NULL."""
    return F.bround(F.coalesce(seconds, F.lit(0)) / 60, 2)


def race_hours(seconds: Column) -> Column:
    """Predicted long-race time in hours, 0 for NULL."""
    return F.bround(F.coalesce(seconds, F.lit(0)) / 3600, 2)


def kilograms(grams: Column) -> Column:
    return F.bround(grams / 1000, 2)


def is_run(type_key: Column) -> Column:
    """Whether distance of this sport counts; an unknown sport's does not."""
    return F.coalesce(type_key.isin(*RUN_TYPES), F.lit(False))


def clock(seconds: Column) -> Column:
    """H:MM:SS or M:SS of half-even rounded seconds; a negative number as it is."""
    s = F.bround(seconds, 0).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours, rest = F.floor(s / 3600), s % 3600
    short = F.concat(F.floor(rest / 60).cast("string"), F.lit(":"), two(rest % 60))
    long = F.concat(hours.cast("string"), F.lit(":"), two(F.floor(rest / 60)), F.lit(":"), two(rest % 60))
    return F.when(s < 0, seconds.cast("string")).when(hours > 0, long).otherwise(short)


def feeling(score: Column) -> Column:
    """Label of the nearest step of the scale, the lower one on ties."""
    step = F.least(F.greatest(F.ceil(score / 25 - 0.5), F.lit(0)), F.lit(4)) * 25
    names = F.create_map(*[F.lit(x) for pair in FEELINGS for x in pair])
    return F.when(score.isNotNull(), F.element_at(names, step.cast("int")))


def effort(raw: Column) -> Column:
    """Perceived effort on the scale of ten; values of 10 and more are tenfold."""
    return F.when(raw >= 10, F.bround(raw / 10, 1)).when(raw > 0, F.bround(raw, 1))


def load_ratio(acute: Column, chronic: Column) -> Column:
    return F.bround(acute / F.nullif(chronic, F.lit(0.0)), 2)


def weather_text(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in WEATHER.items() for x in pair])
    return F.coalesce(F.element_at(names, code.cast("int")), F.lit("Unknown"))


def age_on(birth: Column, day: Column) -> Column:
    """Completed years; a birthday not yet reached in the year counts one less."""
    return F.year(day) - F.year(birth) - (F.date_format(day, "MMdd") < F.date_format(birth, "MMdd")).cast("int")


def max_heart_rate(age: Column, threshold: Column) -> Column:
    """220 less the age, 120 at least; else from the threshold; else 185."""
    return F.when(age.isNotNull(), F.greatest(F.lit(120), 220 - age)).when(threshold > 0, (threshold / 0.85).cast("int")).otherwise(F.lit(185))


def positive_rate(rate: Column) -> Column:
    """A rate as a whole number, NULL unless positive."""
    whole = rate.try_cast("int")
    return F.when(whole > 0, whole)


def lookup(key: Column, values: dict, default: object = None) -> Column:
    """The value of a key in a small fixed dictionary, ``default`` for other keys and NULL."""
    pairs = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def zone_of_workout(kind: Column) -> Column:
    return lookup(kind, WORKOUT_ZONES, 2)


def zone_bounds(max_rate: Column, rest_rate: Column) -> Column:
    """Array of (zone, label, min_bpm, max_bpm) by heart-rate reserve; rest 55 if not known, reserve at least 1."""
    rest = F.coalesce(F.when(rest_rate > 0, rest_rate), F.lit(55))
    reserve = F.greatest(max_rate - rest, F.lit(1))
    bpm = lambda share: F.bround(reserve * F.lit(share) + rest, 0).cast("int")
    return F.array(*[F.struct(F.lit(z).alias("zone"), F.lit(name).alias("label"), bpm(a).alias("min_bpm"), bpm(b).alias("max_bpm")) for z, a, b, name in HEART_ZONES])


def source_kind(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    return F.when(suffix.isin(".html", ".htm", ".url"), "page").otherwise("ebook")


def slug(title: Column) -> Column:
    """Lower case, runs of spaces and hyphens as one underscore, other marks dropped, 80 characters at most."""
    plain = F.regexp_replace(F.lower(F.trim(title)), r"(?U)[^\w\s-]", "")
    joined = F.substring(F.regexp_replace(plain, r"(?U)[\s_-]+", "_"), 1, 80)
    return F.coalesce(F.nullif(F.regexp_replace(joined, "^_+|_+$", ""), F.lit("")), F.lit("untitled"))


def audio_ms(frames: Column, rate: Column) -> Column:
    """Milliseconds of audio, half-even."""
    return F.bround(frames / rate * 1000, 0).cast("long")


def template_minutes(seconds: Column) -> Column:
    """Whole minutes, at least one."""
    return F.greatest(F.floor(seconds / 60).cast("int"), F.lit(1))


def percent_text(done: Column, of: Column) -> Column:
    """Progress as text, 0 % of nothing."""
    return F.format_string("%d/%d (%d%%)", done, of, F.coalesce(F.floor(100 * done / F.nullif(of, F.lit(0))), F.lit(0)))
