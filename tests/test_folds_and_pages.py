import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from setlight.operators import planning as P
from setlight.operators.folds import global_rank, ordered_fold
from setlight.sources import pages
from setlight.streaming import ingest


def test_fold_keeps_order_and_state_of_a_key_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(500).select((F.col("id") % 3).alias("k"), (500 - F.col("id")).alias("o"), F.when(F.col("id") % 50 > 0, F.col("id")).alias("v"))
        step = lambda state, row: (state.append(row["o"]), [])[1]
        done = lambda state: [{"n": len(state), "sorted": state == sorted(state)}]
        got = ordered_fold(rows, ["k"], ["o"], list, step, "n long, sorted boolean", done).collect()
        assert sorted(tuple(r) for r in got) == [(166, True), (167, True), (167, True)]
        assert ordered_fold(rows.where("false"), ["k"], ["o"], list, step, "n long, sorted boolean", done).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_global_rank_is_the_place_in_the_whole_order(spark):
    rows = [(i, None if i % 7 == 0 else (i * 37) % 11) for i in range(300)]
    got = global_rank(spark.createDataFrame(rows, "id long, v long").repartition(5), [F.desc_nulls_last("v"), F.asc("id")]).collect()
    wanted = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == [i for i, _ in wanted]
    assert sorted(r.place for r in got) == list(range(1, 301))
    assert global_rank(spark.createDataFrame([], "id long"), [F.asc("id")]).count() == 0


def test_reservations_in_the_future_are_refused(spark):
    rows = spark.createDataFrame([(1, 10, 3), (1, 20, 4), (2, 10, 50), (3, -99_999_999, 1)], "k long, at_ms long, n long")
    assert sorted(tuple(r) for r in P.remaining_budget(rows, "k", 20, 40).collect()) == [(1, 7, 33), (2, 50, 0)]
    with pytest.raises(PySparkException, match="in the future"):
        P.remaining_budget(rows, "k", 15, 40).collect()


def raw(second, n):
    return {"listened_at": second, "recording_msid": f"id{n}", "track_metadata": {"artist_name": "Ä", "track_name": f" t{n}", "additional_info": {"duration": 3}}}


def write(folder, name, account, listens, size):
    folder.mkdir(exist_ok=True)
    with open(folder / name, "a") as f:
        for p in range(0, max(1, len(listens)), size):
            f.write(json.dumps({"account": account, "page": p // size, "listens": listens[p : p + size]}) + "\n")


def test_pull_is_strict_and_fails_whole(spark, tmp_path):
    folder = tmp_path / "pages"
    write(folder, "a.json", "one", [raw(1000 - i, i) for i in range(25)], 10)
    write(folder, "a.json", "two", [raw(1000, 1), raw(1000, 1), {"listened_at": None}, raw(5, 2)], 10)
    write(folder, "b.json", "three", [], 10)
    got = lambda after, **k: sorted((r.account, r.id, r.ms) for r in pages.pull(spark, f"file://{folder}", after, page_size=10, **k).collect())
    assert got(990_000) == sorted([("one", f"id{i}", (1000 - i) * 1000) for i in range(10)] + [("two", "id1", 1_000_000)])
    assert len(got(0)) == 27
    assert len(got(990_000, max_pages=2)) == 11  # the second page reaches the cutoff
    with pytest.raises(PySparkException, match="nothing was saved"):
        got(0, max_pages=2)
    assert pages.pull(spark, f"file://{tmp_path}/none").count() == 0


def test_page_stream_resumes_at_its_offset(spark, tmp_path):
    folder, out, marks = tmp_path / "pages", f"file://{tmp_path}/out", f"file://{tmp_path}/marks"

    def run():
        stream = ingest.fresh(pages.pull_stream(spark, f"file://{folder}", 2000), "id", "1 day").select("account", "id", "ms")
        running = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).start()
        running.processAllAvailable()
        running.stop()
        return sorted((r.id, r.ms) for r in spark.read.parquet(out).collect())

    write(folder, "0001.json", "one", [raw(3, 3), raw(2, 2)], 10)
    assert run() == [("id3", 3000)]
    write(folder, "0002.json", "one", [raw(5, 5), raw(3, 3)], 10)
    write(folder, "0003.json", "two", [raw(6, 6)], 10)
    assert run() == [("id3", 3000), ("id5", 5000), ("id6", 6000)]
    assert run() == [("id3", 3000), ("id5", 5000), ("id6", 6000)]
