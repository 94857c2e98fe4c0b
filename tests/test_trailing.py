import datetime as dt
import random

from tidemark.operators.trailing import resting_days, trailing_totals

SCHEMA = "record_id bigint, user_id bigint, start_time_local string, type_key string, distance_km double, total_zone_min double, acute_load double, chronic_load double, received_at timestamp_ntz"


def row(record, user, day, minutes, at=0, km=1.0):
    return (record, user, day, "running", km, minutes, 1.5, None, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=at))


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [row(i, rng.choice([1, 1, 1, 2]), str(dt.date(2025, 1, 1) + dt.timedelta(days=rng.randrange(90))) + " 08:00", round(rng.random() * 99, 2)) for i in range(60)]
    got = {(r.user_id, r.obs_date): r for r in trailing_totals(spark.createDataFrame(rows, SCHEMA)).collect()}
    for user in (1, 2):
        days = {}
        for r in rows:
            if r[1] == user:
                days.setdefault(dt.date.fromisoformat(r[2][:10]), []).append(r[5])
        first, last = min(days), max(days)
        day = first
        while day <= last:
            for n in (7, 30):
                want = sum(sum(days.get(day - dt.timedelta(days=k), [])) for k in range(n))
                assert abs(got[user, day][f"total_zone_min_{n}d"] - want) < 1e-6
                assert abs(got[user, day][f"total_zone_min_{n}d_avg"] - want / n) < 1e-6
            day += dt.timedelta(days=1)
    assert len(got) == sum((max(d) - min(d)).days + 1 for d in ([dt.date.fromisoformat(r[2][:10]) for r in rows if r[1] == u] for u in (1, 2)))


def test_versions_nulls_and_bad_days(spark):
    rows = [
        row(1, 1, "2025-01-01", 10.0), row(1, 1, "2025-01-01T07:00:00.5", 20.0, at=5), row(1, 1, "2025-01-01", 20.0, at=5),
        row(2, 1, "2025-02-30", 99.0), row(3, 1, "n/a", 99.0), row(4, 1, None, 99.0), row(5, None, "2025-01-02", 99.0),
        row(6, 1, "2025-01-10", None), row(7, 1, "2025-01-12", float("nan")), row(8, 2, "2025-01-01", 0.0),
        row(None, 3, "2025-01-01", 4.0), row(None, 3, "2025-01-01", 4.0), row(None, 3, "2025-01-01", 5.0, km=2.0),
    ]
    out = {(r.user_id, str(r.obs_date)): r for r in trailing_totals(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len([k for k in out if k[0] == 1]) == 12
    assert out[1, "2025-01-01"].total_zone_min_7d == 20.0
    assert out[1, "2025-01-12"].total_zone_min_7d == 0.0 and out[1, "2025-01-12"].total_zone_min_30d == 20.0
    assert out[2, "2025-01-01"].total_zone_min_30d == 0.0
    assert out[3, "2025-01-01"].total_zone_min_7d == 9.0
    idle = {(r.user_id, r.obs_date) for r in resting_days(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert idle == {(1, f"2025-01-{d:02d}") for d in range(8, 13)}


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trailing_totals(empty).count() == 0 and resting_days(empty).count() == 0
    more = spark.createDataFrame([(*row(1, 1, "2025-01-01", 3.0), 7, 8, 9)], SCHEMA + ", day int, v int, next_day int")
    assert trailing_totals(more).first().total_zone_min_7d == 3.0
