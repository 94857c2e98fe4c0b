import datetime as dt

from tidemark.operators import activities as A

ROWS = "user_id bigint, activity_id bigint, day date, type_key string, distance_m double, start_time_local string"
D = dt.date


def test_blocks(spark):
    rows = spark.createDataFrame([(1, 1, D(2026, 6, 16), "running", 8000.0, "a"), (1, 2, D(2026, 6, 10), "cycling", 20000.0, "b"), (1, 3, D(2026, 6, 11), None, 12000.0, "c"), (1, 4, None, "running", 1.0, "d"), (2, 5, D(2020, 1, 1), "running", 5.0, "e")], ROWS)
    zones = spark.createDataFrame([(1, 1, 600), (2, 3, 1200), (3, 2, 1800), (3, 9, 77)], "activity_id bigint, zone int, secs bigint")
    out = {(r.user_id, str(r.block_end)): r for r in A.weekly_stats(rows, zones, "2026-06-17", 2).collect()}
    w = out[1, "2026-06-16"]
    assert len(out) == 4 and (w.distance_km, w.total_zone_min, w.easy_min, w.medium_min, w.easy_pct) == (8.0, 60.0, 40.0, 20.0, 66.7)
    assert str(w.block_start) == "2026-06-10" and out[2, "2026-06-09"].total_zone_min == 0.0 and out[2, "2026-06-09"].easy_pct is None
    assert A.weekly_stats(rows.limit(0), zones, "2026-06-17").count() == 0


def test_chronic(spark):
    weeks = spark.createDataFrame([(1, D(2026, 5, 1 + 7 * i), float(m)) for i, m in enumerate([300, 320, 280, 90])] + [(2, D(2026, 5, 1), 0.0)], "user_id bigint, block_end date, total_zone_min double")
    r = A.chronic_minutes(weeks).collect()
    assert [(x.user_id, x.chronic_min, x.weeks_used, x.dropped) for x in r] == [(1, 300.0, 3, [90.0])]


def test_events(spark):
    ev = spark.createDataFrame([(1, " Race ", D(2026, 8, 1), 1), (1, "race", D(2026, 8, 1), 0), (1, "b", D(2026, 7, 1), 2), (1, "c", D(2026, 7, 1), 3)], "u bigint, title string, day date, pos int")
    assert {r.pos for r in A.dedupe_events(ev, "title", ev.day, ["pos"]).collect()} == {0, 2, 3}
    assert A.next_event(ev, "u", "day", "title", "pos", "2026-06-01").first().title == "b"
    assert A.latest_event(ev, "u", "day", "title", "pos", "2026-07-15").first().title == "b"
    assert A.latest_event(ev, "u", "day", "title", "pos", "2026-10-15").count() == 0


def test_weather_and_buckets(spark):
    weather = spark.createDataFrame([(D(2026, 6, 1), 20.0, 0), (D(2026, 6, 2), 22.0, 3), (D(2026, 6, 3), None, 95)], "day date, temp_c double, weather_code int")
    spans = spark.createDataFrame([("w", D(2026, 6, 1), D(2026, 6, 4))], "k string, start date, end date")
    r = A.with_weather(spans, weather, ["k"]).first()
    assert r.average_temp == 21.0 and [d.description for d in r.days] == ["Clear sky", "Overcast", "Thunderstorm", "Unknown"]
    buckets = spark.createDataFrame([("s", 0.0, 44.9), ("l", 45.0, None)], "bucket string, low double, high double")
    got = A.bucket_of(spark.createDataFrame([(10.0,), (500.0,)], "m double"), buckets, "m").collect()
    assert {(x.m, x.bucket) for x in got} == {(10.0, "s"), (500.0, "l")}


def test_zone_minutes(spark):
    rows = spark.createDataFrame([(1,), (2,)], "activity_id bigint")
    zones = spark.createDataFrame([(1, 1, 600), (1, 2, 300)], "activity_id bigint, zone int, secs bigint")
    out = {r.activity_id: tuple(r[1:]) for r in A.zone_minutes(rows, zones).collect()}
    assert out == {1: (10.0, 5.0, 0.0, 0.0, 0.0), 2: (None,) * 5}


def test_service_rows(spark):
    rows = spark.createDataFrame([(1, 1, "n", "running", 5000.0, 1500.0, 2.5, 0.0, 150.0, 170.0, 3.456, None, "BASE")], "user_id bigint, activity_id bigint, name string, type_key string, distance_m double, moving_s double, avg_speed_mps double, max_speed_mps double, avg_hr double, max_hr double, aerobic_te double, anaerobic_te double, te_label string")
    r = A.detail_columns(rows).first()
    assert (r.distance_km, r.moving_min, r.avg_pace, r.max_pace, r.aerobic_te, r.anaerobic_te) == (5.0, 25.0, 6.67, None, 3.46, 0.0)
    people = spark.createDataFrame([(1, 70550.0, 180.0, None, 50.0, 0.35, 170, None, ["MONDAY"])], "user_id bigint, weight_g double, height double, birth_date date, vo2max double, threshold_speed double, threshold_rate int, training_days array<string>, long_days array<string>")
    p = A.profiles(people).first()
    assert (p.weight_kg, p.threshold_speed, p.training_days, p.long_days) == (70.55, 5.83, [], ["MONDAY"])
    assert tuple(A.race_predictions(spark.createDataFrame([(1, 1500, None, 5400, 12600)], "user_id int, s_5k int, s_10k int, s_half int, s_full int")).first())[1:] == (25.0, 0.0, 1.5, 3.5)


def test_choices_of_days(spark):
    days = spark.createDataFrame([("w", i, t) for i, t in enumerate([30.0, 20.0, None, 31.0, 18.0, 30.0, 25.0])] + [("v", 0, None)], "week string, i int, t double")
    assert {(r.week, r.i) for r in A.parted_by_heat(days, ["week"], "t", "i").where("rest").collect()} == {("w", 3), ("w", 0), ("v", 0)}
    assert {(r.week, r.day) for r in A.coolest_day(days, ["week"], "t", "i").collect()} == {("w", 4), ("v", 0)} and {(r.week, r.day) for r in A.coolest_day(days, ["week"], "t", "i", 3).collect()} == {("w", 3), ("v", 0)}
    lists = spark.createDataFrame([(1, 2, ["c"]), (1, 1, ["a", "b"]), (1, 3, None)], "k int, o int, x array<string>")
    assert A.joined_lists(lists, ["k"], "o", "x").first().x == ["a", "b", "c"]
    weeks = spark.createDataFrame([(1, 50.0, "build"), (1, 90.0, "race"), (2, 30.0, "race"), (3, None, "race")], "u int, m double, kind string")
    assert {(r.u, r.peak) for r in A.peak_minutes(weeks, "u", "m", weeks.kind == "build").collect()} == {(1, 50.0), (2, 30.0), (3, 0.0)}
