"""Every query of the analytics part against its SQL."""

import pytest

from setlight.plans import catalog
from tests.compare import connect, rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    found = catalog.QUERIES[name](spark, FOLDER).toPandas()
    if name in catalog.ORACLES:
        wanted = con.execute(catalog.ORACLES[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", ["l19_reconcile", "m1_unknown_fields", "r3_lifecycle_alerts", "r5_merged_releases"])
def test_order_dependent_query_on_more_rows(spark, name):
    folder = "/root/testdata/sf0.01"
    wanted = connect(folder).execute(catalog.ORACLES[name]).df()
    assert rows(catalog.QUERIES[name](spark, folder).toPandas()) == rows(wanted)


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def changed_copy(con, tmp_path, table, sql):
    """The small folder with one table made anew, and a connection to it."""
    import os

    for name in os.listdir(FOLDER):
        if name != f"{table}.parquet":
            os.symlink(f"{FOLDER}/{name}", tmp_path / name)
    con.execute(f"copy ({sql}) to '{tmp_path}/{table}.parquet' (format parquet)")
    return str(tmp_path), connect(str(tmp_path))


def same_as_sql(spark, folder, con, name):
    found = rows(catalog.QUERIES[name](spark, folder).toPandas())
    assert found and found == rows(con.execute(catalog.ORACLES[name]).df())


def test_listens_after_now_are_no_reservations(spark, con, tmp_path):
    folder, other = changed_copy(con, tmp_path, "events", "select * replace (case when event_id % 9 = 0 then ts + interval 2 hour else ts end as ts) from events")
    same_as_sql(spark, folder, other, "x30_remaining_budget")


@pytest.mark.parametrize("name", ["a9_maintained_days", "a2_a20_maintained_activity"])
def test_duplicates_far_from_their_originals(spark, con, tmp_path, name):
    folder, other = changed_copy(con, tmp_path, "events", "select e.* replace (event_id + c * 1000000 as event_id, ts + c * interval 5 day as ts) from events e, (select unnest(range(0, 12)) as c) where event_id % 8 > 0")
    same_as_sql(spark, folder, other, name)


@pytest.mark.parametrize("name", ["a9_maintained_days", "a2_a20_maintained_activity"])
def test_values_of_ids_that_come_more_than_once(spark, con, tmp_path, name):
    # ord + 1000000 is the id of another event as well, so an id has several durations until an earlier one comes with a later batch
    folder, other = changed_copy(con, tmp_path, "events", "select * replace (event_id % 32 * 16 + event_id // 32 * 1000000 as event_id, case when event_id < 48 then 'error' else event_type end as event_type) from events")
    same_as_sql(spark, folder, other, name)


def test_titles_cut_inside_a_reference(spark, con, tmp_path):
    folder, other = changed_copy(con, tmp_path, "pages", "select * replace (replace(html, '</title>', ' &amp; x&amp</title>') as html) from pages")
    same_as_sql(spark, folder, other, "s21_homepage_titles")


def test_titles_of_many_tracks_are_split(spark, con, tmp_path, monkeypatch):
    from setlight.operators import setlists

    monkeypatch.setattr(setlists, "PAIRS_A_TASK", 50)
    folder, other = changed_copy(con, tmp_path, "part", "select p.* replace (p_partkey + c * 2000 as p_partkey) from part p, (select unnest(range(0, 12)) as c)")
    same_as_sql(spark, folder, other, "x23_fitting_tracks")
    assert catalog.QUERIES["x23_fitting_tracks"](spark, folder).rdd.getNumPartitions() > 4


def test_insights_are_dealt_by_their_plays(spark, con, tmp_path, monkeypatch):
    from setlight.operators import setlists
    from setlight.sources import standins

    monkeypatch.setattr(setlists, "PLAYS_A_TASK", 500, raising=False)
    monkeypatch.setattr(standins, "LINES_A_TASK", 500, raising=False)
    # few bands with many sets of a day, so that places among a day's sets decide what lies in reach
    folder, other = changed_copy(con, tmp_path, "orders", "select * replace (o_custkey % 30 as o_custkey, date_trunc('quarter', o_orderdate) as o_orderdate) from orders")
    same_as_sql(spark, folder, other, "p3_p4_insights")
    assert catalog.QUERIES["p3_p4_insights"](spark, folder).rdd.getNumPartitions() > 4
    assert standins.songs(spark, folder).select("setlist", "name").rdd.getNumPartitions() > 4


@pytest.mark.parametrize("name", ["d2_candidate_pairs", "d13_page_pairs"])
def test_pairs_of_a_time_are_split(spark, con, tmp_path, monkeypatch, name):
    from setlight.operators import dedupe

    monkeypatch.setattr(dedupe, "PAIRS_A_TASK", 2000, raising=False)
    folder, other = changed_copy(con, tmp_path, "events", "select * replace (date_trunc('day', ts) + (event_id % 700) * interval 1 second as ts) from events")
    same_as_sql(spark, folder, other, name)
    assert catalog.QUERIES[name](spark, folder).rdd.getNumPartitions() > 4


def test_crowded_times_are_not_copied_to_every_task(spark, con, tmp_path, monkeypatch):
    from setlight.operators import dedupe

    monkeypatch.setattr(dedupe, "PAIRS_A_TASK", 1000)
    monkeypatch.setattr(dedupe, "CELL_ROWS", 20, raising=False)
    # three seconds hold all listens, so a bucket has far more pairs than a task may look at
    folder, other = changed_copy(con, tmp_path, "events", "select * replace (timestamp '2024-01-02 00:04:59' + (event_id % 3) * interval 1 second as ts) from events where event_id < 700")
    found = catalog.QUERIES["d13_page_pairs"](spark, folder)
    executor = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0)
    before = executor().totalShuffleWrite()
    got = rows(found.toPandas())
    assert got and got == rows(other.execute(catalog.ORACLES["d13_page_pairs"]).df())
    assert executor().totalShuffleWrite() - before < 2_000_000
