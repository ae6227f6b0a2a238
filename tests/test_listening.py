from datetime import UTC, datetime

from pyspark.sql import functions as F

from setlight.operators import listening as L

NOW = round(datetime(2027, 7, 16, 12, tzinfo=UTC).timestamp() * 1000)
COLUMNS = "ord long, ms long, band_id long, release_title string, duration_ms long, recording_title string, recording_id string, track_id string"


def frame(spark, rows):
    return spark.createDataFrame([r + (None,) * (8 - len(r)) for r in rows], COLUMNS)


def ords(df):
    return sorted(r.ord for r in df.collect())


def test_window_start_and_now_are_inside(spark):
    span = L.resolve_window("twoWeeks", NOW)
    rows = frame(spark, [(1, span.start), (2, span.start - 1), (3, NOW), (4, NOW + 1)])
    assert ords(L.in_window(rows, span.start, span.end)) == [1, 3]
    assert ords(L.in_window(rows, span.previous, span.start)) == [2]


def test_month_shift_clamps_the_day():
    span = L.resolve_window("threeMonths", round(datetime(2027, 5, 31, 12, tzinfo=UTC).timestamp() * 1000))
    assert datetime.fromtimestamp(span.start / 1000, UTC) == datetime(2027, 2, 28, 12, tzinfo=UTC)
    assert L.resolve_window("allTime", NOW).previous is None


def test_unknown_durations_are_valid_and_zero(spark):
    rows = frame(spark, [(1, NOW, 7, "a", None), (2, NOW, 7, "a", 0), (3, NOW, 7, "a", 1000), (4, None, 7, "a", 1000)])
    got = L.totals(rows).first()
    assert (got.duration_ms, got.listen_count, got.unknown_count, got.first_listen, got.last_listen) == (1000, 2, 1, 1, 1)


def test_rankings_leave_out_unknown_bands_and_break_ties(spark):
    bands = spark.createDataFrame([(1,), (2,)], "band_id long")
    rows = frame(spark, [(1, NOW - 5, 1, "a", 10), (2, NOW, 2, "a", 10), (3, NOW, 3, "a", 99)])
    assert [(r.band_id, r["rank"]) for r in L.top_bands(rows, bands).orderBy("rank").collect()] == [(2, 1), (1, 2)]


def test_movement(spark):
    old = spark.createDataFrame([(1, 2), (2, 1), (3, 3)], "band_id long, rank long")
    new = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4)], "band_id long, rank long")
    got = {r.band_id: (r.movement, r.delta) for r in L.movement(new, old, "band_id").collect()}
    assert got == {1: ("up", 1), 2: ("down", 1), 3: (None, None), 4: ("new", None)}
    assert L.movement(new, None, "band_id").where("movement is not null").count() == 0


def test_albums_split_only_where_editions_disagree(spark):
    rows = frame(spark, [(1, NOW, 1, "A", 10, "t", "e1"), (2, NOW, 1, "a ", 10, "t", "e2"), (3, NOW, 1, "A", 10, "t"), (4, NOW, 2, "B", 10, "t", "e1"), (5, NOW, 2, "B", 10, "t")])
    got = {r.key: r.listen_count for r in L.edition_albums(rows, "recording_id").collect()}
    assert got == {"1|a#e1": 1, "1|a#e2": 1, "1|a": 1, "2|b": 2}


def test_conflicting_ids_are_dropped(spark):
    rows = frame(spark, [(1, NOW, 1, "A", 10, "t", "r1", "s1"), (2, NOW, 1, "A", 10, "t", "r1", "s2"), (3, NOW, 1, "A", 10, "t")])
    got = {r.key: (r.track_id, r.conflict, r.trusted) for r in L.rank_recordings(rows).collect()}
    assert got == {"recording:r1": (None, True, True), "event:3": (None, False, False)}


def test_buckets_are_zero_filled_and_empty_input_works(spark):
    span = L.resolve_window("twoWeeks", NOW)
    assert L.time_buckets(frame(spark, [(1, NOW, 1, "A", 10)]), span).count() == 15
    empty = frame(spark, [])
    assert L.time_buckets(empty, span).where("listen_count = 0").count() == 15
    bands = spark.createDataFrame([], "band_id long, genre_raw string")
    assert L.top_bands(empty, bands).count() == 0
    assert L.totals(empty).first().listen_count == 0
    assert L.genre_by_year(empty, bands, F.lit("Rock")).count() == 0
    assert L.yearly(empty, bands, 2027, None, F.lit("Rock")).count() == 0
    assert L.band_activity(empty, bands, NOW).count() == 0


def test_concert_window_matches_a_plain_count(spark):
    base = round(datetime(2024, 6, 1, tzinfo=UTC).timestamp() * 1000)
    listens = frame(spark, [(i, base + i * 86_400_000 * 10, i % 2, "A", 1 + i) for i in range(60)])
    shows = spark.createDataFrame([(1, 0, "2024-09-01"), (2, 1, "2025-01-31"), (3, 0, "2030-01-01"), (4, 9, "2024-09-01")], "ord long, band_id long, d string").withColumn("d", F.col("d").cast("date"))
    now = base + 86_400_000 * 400
    got = {r.concert: r.listen_count for r in L.concert_listening(shows, listens, "2025-07-06", now).collect()}
    day = lambda y, m, d: round(datetime(y, m, d, tzinfo=UTC).timestamp() * 1000)
    windows = {1: (0, day(2024, 6, 1), day(2024, 12, 2)), 2: (1, day(2024, 10, 31), day(2025, 5, 1)), 3: (0, round(datetime(2025, 1, 6, tzinfo=UTC).timestamp() * 1000), now + 1)}
    rows = [(r.band_id, r.ms) for r in listens.collect()]
    for k, (band, low, high) in windows.items():
        assert got[k] == sum(b == band and low <= ms < high for b, ms in rows), k
    assert got[4] == 0
