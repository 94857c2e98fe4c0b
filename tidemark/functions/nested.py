"""Functions on JSON, arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONES = "array<struct<zoneNumber:int,secsInZone:double>>"


def zone_seconds(zones: Column) -> Column:
    """Array of (zoneNumber, secsInZone) to a map; entries without number dropped, the last of duplicates wins."""
    kept = F.filter(zones, lambda z: z.zoneNumber.isNotNull())
    placed = F.transform(kept, lambda z, i: F.struct(z.zoneNumber.alias("k"), F.coalesce(z.secsInZone, F.lit(0.0)).alias("v"), i.alias("i")))
    newest = F.filter(placed, lambda z: ~F.exists(placed, lambda o: (o.k == z.k) & (o.i > z.i)))
    return F.map_from_entries(F.transform(newest, lambda z: F.struct(z.k, z.v)))


def zone_minutes(seconds: Column) -> Column:
    """Five minute values of a zone map; all NULL when it is empty or NULL, 0 for a zone it lacks."""
    some = F.size(F.coalesce(seconds, F.create_map().cast("map<int,double>"))) > 0
    return F.array(*[F.when(some, F.bround(F.coalesce(F.try_element_at(seconds, F.lit(z)), F.lit(0.0)) / 60, 2)) for z in range(1, 6)])


def primary_or_first(devices: Column) -> Column:
    """The first map value marked primary, else the first value."""
    values = F.map_values(devices)
    return F.coalesce(F.try_element_at(F.filter(values, lambda v: v.primary), F.lit(1)), F.try_element_at(values, F.lit(1)))


def json_in_text(text: Column, schema: str) -> Column:
    """The array of a JSON answer, fenced or in free text; NULL when there is none."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), schema)


def joined_notes(*parts: Column) -> Column:
    """Trimmed parts without empty and repeated ones, a line each; NULL when nothing is left."""
    clean = F.array_distinct(F.array_compact(F.array(*[F.nullif(F.trim(p), F.lit("")) for p in parts])))
    return F.when(F.size(clean) > 0, F.array_join(clean, "\n"))


def daily_weather(payload: Column) -> Column:
    """Array of (day, temp_c, weather_code) from three parallel JSON arrays, short ones padded with NULL."""
    p = F.from_json(payload, "daily struct<time:array<string>,temperature_2m_max:array<double>,weather_code:array<int>>").daily
    zipped = F.arrays_zip(p.time.alias("time"), p.temperature_2m_max.alias("temp"), p.weather_code.alias("code"))
    return F.transform(zipped, lambda z: F.struct(F.try_to_timestamp(z.time, F.lit("yyyy-MM-dd")).cast("date").alias("day"), F.bround(z.temp, 1).alias("temp_c"), z.code.alias("weather_code")))


def insert_cues(steps: Column, before: Column, middle: Column, after: Column) -> Column:
    """Arrays of steps put before, at the midpoint of and after a list of steps."""
    half = F.floor(F.size(steps) / 2).cast("int")
    return F.concat(before, F.slice(steps, F.lit(1), half), middle, F.slice(steps, half + 1, F.size(steps)), after)


def step_seconds(steps: Column, metres_per_second: Column | None = None) -> Column:
    """Seconds of a list of (seconds, metres, iterations, steps) with one level of repeats; a distance step takes its
    metres at the mean speed; whole seconds, 60 at least."""
    speed = F.lit(None).cast("double") if metres_per_second is None else F.nullif(metres_per_second, F.lit(0.0))
    own = lambda s: F.coalesce(s.seconds, s.metres / speed, F.lit(0.0))
    inner = lambda s: F.aggregate(F.coalesce(s.steps, F.array().cast("array<struct<seconds:double,metres:double>>")), F.lit(0.0), lambda a, x: a + own(x))
    total = F.aggregate(steps, F.lit(0.0), lambda a, s: a + F.when(s.iterations.isNotNull(), s.iterations * inner(s)).otherwise(own(s)))
    return F.greatest(total.cast("int"), F.lit(60))


def with_rest(items: Column, n: int) -> Column:
    """The first n of an array and how many more there are."""
    return F.struct(F.slice(items, 1, n).alias("first"), F.greatest(F.size(items) - n, F.lit(0)).alias("more"))


def numeric_part(text: Column) -> Column:
    """The digits of a text as a number to sort by, 0 without digits."""
    return F.coalesce(F.nullif(F.regexp_replace(text, r"\D", ""), F.lit("")).try_cast("bigint"), F.lit(0))


def repeated_hint(hint: Column, size: Column) -> Column:
    """A hint for each of a batch: one is repeated, a list of another length is an error."""
    n = F.size(hint)
    return F.when(n == size, hint).when(n == 1, F.array_repeat(F.element_at(hint, 1), size)).otherwise(F.raise_error(F.lit("hints do not fit the batch")))


def halves(items: Column) -> Column:
    """The two halves of an array, cut at its midpoint."""
    half = F.floor(F.size(items) / 2).cast("int")
    return F.struct(F.slice(items, F.lit(1), half).alias("first"), F.slice(items, half + 1, F.size(items)).alias("second"))


def _valid(found: Column, strict: bool) -> Column:
    kept = F.filter(found, lambda d: d.index.isNotNull())
    if not strict:
        return kept
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(F.raise_error(F.lit("the answer holds nothing valid")))


def decisions(answer: Column, strict: bool = False) -> Column:
    """Array of (index, keep, reason) of a model's answer; entries without index drop out, keep is false unless told
    otherwise; with ``strict`` an answer without any is an error."""
    found = _valid(json_in_text(answer, "array<struct<index:int,keep:boolean,reason:string>>"), strict)
    return F.transform(found, lambda d: F.struct(d.index.alias("index"), F.coalesce(d.keep, F.lit(False)).alias("keep"), F.coalesce(d.reason, F.lit("")).alias("reason")))


def opening_analyses(answer: Column, strict: bool = False) -> Column:
    """Array of (index, section_type, narratively_important, reason), with their defaults; see ``decisions``."""
    found = _valid(json_in_text(answer, "array<struct<index:int,section_type:string,narratively_important:boolean,reason:string>>"), strict)
    return F.transform(found, lambda d: F.struct(d.index.alias("index"), F.coalesce(d.section_type, F.lit("unclear")).alias("section_type"), F.coalesce(d.narratively_important, F.lit(False)).alias("narratively_important"), F.coalesce(d.reason, F.lit("")).alias("reason")))


def opening_decisions(analyses: Column) -> Column:
    """Opening analyses as decisions: what is important is kept, the type stands for a missing reason."""
    return F.transform(analyses, lambda a: F.struct(a.index.alias("index"), a.narratively_important.alias("keep"), F.coalesce(F.nullif(a.reason, F.lit("")), a.section_type).alias("reason")))


def _first_of(payload: Column, *paths: str) -> Column:
    return F.coalesce(*[F.get_json_object(payload, p) for p in paths])


def last_event_day(payload: Column) -> Column:
    """The day of the latest event of an events answer, NULL if there is none or it cannot be read."""
    return F.substring(F.get_json_object(payload, "$.latest_event.date"), 1, 10).try_cast("date")


def item_day(payload: Column) -> Column:
    """The day of a calendar item, as text."""
    return F.substring(_first_of(payload, "$.date", "$.calendarDate"), 1, 10)


def item_workout(payload: Column) -> Column:
    """The workout of a calendar item."""
    return _first_of(payload, "$.workoutId", "$.workoutTemplateId", "$.workout.workoutId").try_cast("bigint")


def uploaded_workout(payload: Column) -> Column:
    """The workout an upload answer names."""
    return _first_of(payload, "$.workoutId", "$.id", "$.workout.workoutId").try_cast("bigint")


def record_items(payload: Column, schema: str) -> Column:
    """The array of records of an answer that is the array itself or holds it under one of four keys."""
    inner = _first_of(payload, *[f"$.{k}" for k in ("personalRecords", "records", "prList", "itemList")])
    return F.from_json(F.when(F.ltrim(payload).startswith("["), payload).otherwise(inner), schema)


def to_payload(rows: Column) -> Column:
    """Chapters with their blocks as one JSON text; ``from_payload`` gives them back, NULLs included."""
    return F.to_json(rows, {"ignoreNullFields": "false"})


def from_payload(payload: Column, schema: str) -> Column:
    return F.from_json(payload, schema)


def joined_words(*parts: Column) -> Column:
    """Parts without blank ones, trimmed, a space between them; NULL when nothing is left."""
    clean = F.array_compact(F.array(*[F.nullif(F.trim(p), F.lit("")) for p in parts]))
    return F.when(F.size(clean) > 0, F.array_join(clean, " "))
