from setlight.operators import planning as P
from setlight.streaming import ingest, timers

DAY = P.DAY_MS


def batches(spark, tmp_path, schema, parts, make):
    """Feed one file a run and return what has come out."""
    session = timers.stateful_session(spark)
    folder = f"file://{tmp_path}/in"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        ingest.append_to(make(session.readStream.schema(schema).parquet(folder)), f"file://{tmp_path}/out", f"file://{tmp_path}/marks").awaitTermination()
    return spark.read.parquet(f"file://{tmp_path}/out").collect()


def test_bands_become_due_without_a_row_of_their_own(spark, tmp_path):
    look = lambda band, day, found=False, kind="look": (band, day, day * DAY, kind, found)
    parts = [
        [look(1, 1), look(2, 1, True), look(3, 1, kind="trusted"), look(4, 1)],
        [look(1, 20, kind="trusted"), look(4, 31)],  # band 2 is due on day 29, band 4 on day 31 by its own row
        [look(9, 60)],  # only another band's row: the time of band 1 (day 48) and of band 2 has passed
        [look(9, 130), look(2, 100)],
    ]
    got = batches(spark, tmp_path, "band_id long, ord long, ms long, kind string, found boolean", parts, lambda s: timers.due_stream(s, "0 seconds"))
    wanted = [(1, 48, "ticketmaster_activity_reset", 0), (2, 29, "supplemental_concert_check", 0), (4, 31, "inactive_backoff_due", 1), (4, 91, "inactive_backoff_due", 2), (9, 90, "inactive_backoff_due", 1), (2, 130, "inactive_backoff_due", 1)]
    assert sorted((r.band_id, r.due_ms // DAY, r.reason, r.empty) for r in got) == sorted(wanted)


def test_trailing_sums_equal_the_batch_ones(spark, tmp_path):
    rows = [(i, i * 700 + (i % 3) * 50_000 if i < 50 else i * 9_000, i % 2, i) for i in range(90)]
    rows.sort(key=lambda r: r[1])
    parts = [rows[:30], rows[30:31], rows[31:80], rows[80:]]
    got = batches(spark, tmp_path, "ord long, ms long, band_id long, tokens long", parts, lambda s: timers.trailing_stream(s, "band_id", 60_000))
    whole = P.trailing_sum(spark.createDataFrame(rows, "ord long, ms long, band_id long, tokens long"), "ms", "tokens", 60_000, "band_id").select("ord", "used").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole))
