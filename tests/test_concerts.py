from pyspark.sql import functions as F

from setlight.operators import concerts as C

COLUMNS = "ord long, band_id long, d string, venue string, city string, typ string, attending boolean, price_cents long, quantity long, distance_km long, rating long, country string"


def frame(spark, rows):
    return spark.createDataFrame([r + (None,) * (12 - len(r)) for r in rows], COLUMNS).withColumn("d", F.col("d").cast("date"))


def visits(spark, rows):
    return sorted((r.visit, r.n, r.festival) for r in C.venue_visits(frame(spark, rows)).collect())


def test_same_day_bill_is_one_visit(spark):
    assert visits(spark, [(1, 1, "2024-01-01", "v", "c", "concert"), (2, 2, "2024-01-01", "v", "c", "festival")]) == [(1, 2, False)]


def test_only_festival_days_in_a_row_are_one_visit(spark):
    assert visits(spark, [(1, 1, "2024-01-01", "v", "c", "festival"), (2, 2, "2024-01-02", "v", "c", "festival")]) == [(1, 2, True)]
    assert visits(spark, [(1, 1, "2024-01-01", "v", "c", "concert"), (2, 2, "2024-01-02", "v", "c", "concert")]) == [(1, 1, False), (2, 1, False)]


def test_undated_rows_stand_alone(spark):
    assert visits(spark, [(1, 1, None, "v", "c", "concert"), (2, 2, None, "v", "c", "concert")]) == [(1, 1, False), (2, 1, False)]


def test_free_tickets_are_known_but_not_cheapest(spark):
    rows = frame(spark, [(1, 1, "2024-01-01", "v", "c", "concert", True, 0, 1), (2, 1, "2024-01-02", "v", "c", "concert", True, 500, 2)])
    assert C.extremes(rows).first().cheapest == 2
    got = C.spending(rows, rows.where("false")).first()
    assert (got.total_cents, got.known, got.average_price, got.priced_pct) == (1000, 2, 3, 100)


def test_one_spend_year_has_no_lowest(spark):
    rows = frame(spark, [(1, 1, "2024-01-01", "v", "c", "concert", True, 100, 1)])
    got = C.spend_years(rows, rows.where("false")).first()
    assert (got.highest_year, got.lowest_year) == (2024, None)


def test_nearest_prefers_attended_and_puts_undated_last(spark):
    rows = frame(spark, [(1, 1, "2024-02-01", "v", "c", "concert", False), (2, 1, "2024-03-01", "v", "c", "concert", True), (3, 2, None, "v", "c", "concert", False), (4, 2, "2024-05-01", "v", "c", "concert", False)])
    assert {r.band_id: r.ord for r in C.nearest_per_band(rows, "2024-01-01").collect()} == {1: 2, 2: 4}


def test_activity(spark):
    last = spark.createDataFrame([(1, None), (2, "2020-01-01"), (3, "2030-01-01")], "band_id long, last_date string").withColumn("last_date", F.col("last_date").cast("date"))
    assert {r.band_id: r.status for r in C.activity(last, 3, "2024-01-01").collect()} == {1: "unknown", 2: "inactive", 3: "active"}


def test_empty(spark):
    rows = frame(spark, [])
    assert C.venue_visits(rows).count() == 0
    assert C.counts(rows, C.venue_visits(rows)).first().shows == 0
    assert C.busiest(C.venue_visits(rows)).count() == 0
    assert C.longest_gap(rows, "2024-01-01").first().days is None
