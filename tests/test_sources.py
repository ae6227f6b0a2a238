import pytest
from pyspark.sql import functions as F

from setlight.functions import numbers as N
from setlight.functions import text as T
from setlight.sources import documents as S
from setlight.streaming import ingest


def test_versions_compare_and_swap(spark, tmp_path):
    table = S.VersionedTable(spark, f"file://{tmp_path}/t", "id long, a string")
    df = lambda rows: spark.createDataFrame(rows, "id long, a string")
    one = table.write_if_current(df([(1, "x")]), None)
    two = table.write_if_current(df([(1, "y")]), one)
    with pytest.raises(S.StaleVersion):
        table.write_if_current(df([(1, "z")]), one)
    assert table.read().collect()[0].a == "y"
    table.write_merging(df([(1, "x"), (2, "n")]), one, lambda base, mine, theirs: theirs.unionByName(mine.join(theirs, "id", "left_anti")))
    assert sorted((r.id, r.a) for r in table.read().collect()) == [(1, "y"), (2, "n")]
    assert two


def test_archive_detects_changes(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1_700_000_000_000), (2, 1_706_000_000_000)], "ord long, ms long")
    listed = S.store_months(rows, f"file://{tmp_path}/a", ["ord", "ms"])
    assert S.restore_months(spark, f"file://{tmp_path}/a", listed, ["ord", "ms"]).count() == 2
    with pytest.raises(ValueError, match="2023-11"):
        S.restore_months(spark, f"file://{tmp_path}/a", listed.withColumn("n", F.lit(9).cast("long")), ["ord", "ms"])


def test_missing_json_is_empty(spark, tmp_path):
    assert S.read_json(spark, f"file://{tmp_path}/none.json", "a long").count() == 0


def test_csv_cells(spark):
    df = spark.createDataFrame([('a"b', [1], None)], "s string, l array<long>, n long")
    assert S.csv_lines(df).first().line == '"a""b",[1],'


def test_homepage():
    html = "<title>A &amp; B</title><meta name=description content=d><meta property='og:image' content=i><script>x</script><p>Hi <b>you</b></p><a href='https://instagram.com/z'>"
    assert S.page_parts(html, 600) == ("A & B", "d", "i", "https://instagram.com/z", "", "Hi you")
    assert S.page_parts(None, 600) == ("", "", "", "", "", "")


def test_texts(spark):
    df = spark.createDataFrame([("  The Ünï  ﬁ!  ",), ("!!",), (None,)], "t string")
    rows = df.select(T.norm_spaces(F.col("t")).alias("a"), T.norm_artist(F.col("t")).alias("b"), T.slug(F.col("t")).alias("c")).collect()
    assert tuple(rows[0]) == ("the uni fi!", "uni fi", "the-uni-fi")
    assert tuple(rows[1]) == ("!!", "symbols-2121", "")
    assert tuple(rows[2]) == ("", "", "")


def test_hash_and_dates(spark):
    df = spark.createDataFrame([("a", "31-02-2024"), ("foobar", "29-02-2024")], "t string, d string")
    rows = df.select(T.stable_hash(F.col("t")).alias("h"), N.event_date(F.col("d")).cast("string").alias("d")).collect()
    assert [r.h for r in rows] == ["e40c292c", "bf9cf968"] and [r.d for r in rows] == [None, "2024-02-29"]


def test_stream_drops_repeats_and_keeps_state(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    spark.createDataFrame([(1, 1_700_000_000_000), (1, 1_700_000_000_000), (2, 1_700_000_100_000)], "ord long, ms long").write.parquet(folder)
    stream = ingest.fresh(ingest.listen_stream(spark, folder, "ord long, ms long"), "ord", "1 day").select("ord")
    ingest.append_to(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/marks").awaitTermination()
    assert sorted(r.ord for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [1, 2]


def test_windowed_stream(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    spark.createDataFrame([(1, 86_400_000, 1, 5), (2, 86_400_001, 1, None), (3, 86_400_000 * 9, 1, 7)], "ord long, ms long, band_id long, duration_ms long").write.parquet(folder)
    stream = ingest.windowed(ingest.listen_stream(spark, folder, "ord long, ms long, band_id long, duration_ms long"), "1 day", "1 day")
    ingest.append_to(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/marks").awaitTermination()
    got = [(r.band_id, r.duration_ms, r.listen_count) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()]
    assert (1, 5, 2) in got
