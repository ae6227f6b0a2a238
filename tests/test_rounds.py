import random

import pytest
from pyspark.sql import functions as F

from setlight.operators import dedupe as D
from setlight.operators import linking as K
from setlight.operators import planning as P
from setlight.operators.rounds import components, first_come


def test_first_come_equals_the_sequential_pass(spark):
    rng = random.Random(5)
    rows = [(i, [f"a{rng.randrange(12)}", f"b{rng.randrange(12)}"]) for i in range(60)]
    taken, wanted = set(), []
    for i, tokens in rows:
        if not taken & set(tokens):
            wanted.append(i)
            taken |= set(tokens)
    got = first_come(spark.createDataFrame(rows, "ord long, tokens array<string>"), "ord", "ord", "tokens")
    assert sorted(r.ord for r in got.collect()) == wanted


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}


def test_greedy_conflict_rejects_the_weaker_pair(spark):
    pairs = spark.createDataFrame([(1, 2, 2, True), (2, 3, 3, True), (4, 5, 5, False), (3, 4, 5, False), (1, 9, 5, False)], "a long, b long, tier long, automatic boolean")
    got = {(r.a, r.b): r.outcome for r in D.assign_one_to_one(pairs).collect()}
    assert got == {(1, 2): "automatic", (2, 3): "rejected", (4, 5): "review", (3, 4): "review", (1, 9): "rejected"}
    groups = D.review_groups(D.assign_one_to_one(pairs)).collect()
    assert [(g.group_id, g.pairs, g.last_member) for g in groups] == [(3, 2, 5)]
    assert {r.ord: r.duplicate_of for r in D.canonical_rows(D.assign_one_to_one(pairs)).collect()} == {1: None, 2: 1}


def test_merge_claims_both_keys_only_when_accepted(spark):
    existing = spark.createDataFrame([], "id string, fp string")
    merge = lambda rows: sorted(r.ord for r in D.merge_new(spark.createDataFrame(rows, "ord long, id string, fp string"), existing).collect())
    assert merge([(1, "A", "X"), (2, "A", "Y"), (3, "B", "Y")]) == [1, 3]
    assert merge([(1, "A", "X"), (2, "B", "X"), (3, "B", "Y")]) == [1, 3]


def test_candidates_near_bucket_borders(spark):
    rows = spark.createDataFrame([(1, 1000, "a"), (2, 2000, "b"), (3, 3001, "a"), (4, 2000, "b")], "ord long, ms long, source string")
    full = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in ("recording_title", "release_title", "recording_id", "track_id")], F.lit(1).cast("long").alias("band_id"), F.lit(None).cast("long").alias("duration_ms"))
    got = sorted((r.l_ord, r.r_ord) for r in D.candidate_pairs(full, 1000).collect())
    assert got == [(1, 2), (1, 4)]


def test_canonical_rows_fill_from_duplicates(spark):
    listens = spark.createDataFrame([(1, 5, None, None, "s"), (2, 5, 300, "r", None), (3, 9, None, None, None)], "ord long, ms long, duration_ms long, recording_id string, track_id string")
    canonical = spark.createDataFrame([(1, 1, None), (2, 1, 1)], "ord long, canonical long, duplicate_of long")
    got = sorted(tuple(r) for r in D.canonicalize(listens, canonical).fillna("", ["recording_id", "track_id"]).fillna(0).collect())
    assert got == [(1, 5, 300, "r", "s"), (3, 9, 0, "", "")]
    assert D.broken_rows(canonical).count() == 0


@pytest.mark.parametrize("last", [False, True])
def test_of_values_of_one_id_the_smallest_is_taken(spark, last):
    rows = [(1, 5, None, None, None), (2, 5, 300, "x", "t"), (2, 6, 200, "y", "s")]
    listens = spark.createDataFrame(rows[::-1] if last else rows, "ord long, ms long, duration_ms long, recording_id string, track_id string").coalesce(1)
    assert [tuple(r) for r in D.canonicalize(listens, spark.createDataFrame([(2, 1, 1)], "ord long, canonical long, duplicate_of long")).collect()] == [(1, 5, 200, "x", "s")]


def test_shared_alias_links_to_no_band(spark):
    bands = spark.createDataFrame([(1, "A", ["x"]), (2, "B", ["x", "B"])], "band_id long, name string, aliases array<string>")
    assert {r.name: r.band_id for r in K.unique_names(bands).collect()} == {"A": 1, "B": 2}


def test_roll_back(spark):
    current = spark.createDataFrame([(1, 3, "c", False), (2, 3, "c", False), (3, 3, "c", True), (4, 1, "c", False)], "id long, version long, value string, reviewed boolean")
    history = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "z")], "id long, version long, value string")
    assert {r.id: (r.version, r.value) for r in P.roll_back(current, history, "id", 3).collect()} == {1: (2, "b"), 3: (3, "c"), 4: (1, "c")}


def test_three_way_merge(spark):
    df = lambda rows: spark.createDataFrame(rows, "id long, a string")
    got = P.three_way(df([(1, "x"), (2, "x"), (3, "x"), (4, "x"), (6, "x")]), df([(1, "mine"), (2, "x"), (5, "new"), (6, "x")]), df([(1, "theirs"), (2, "theirs"), (3, "edited"), (4, "x")]), "id", ["a"])
    assert {r.id: r.a for r in got.collect()} == {1: "mine", 2: "theirs", 3: "edited", 5: "new", 6: "x"}


def test_three_way_merge_goes_into_structs_and_keeps_their_order(spark):
    df = lambda rows: spark.createDataFrame(rows, "id long, ord long, s struct<a: string, t: struct<b: string, c: string>>")
    base, mine, theirs = [(1, 0, ("x", ("x", "x")))], [(1, 0, ("mine", ("mine", "x"))), (9, 1, ("new", None))], [(2, 0, ("added", None)), (1, 1, ("x", ("theirs", "theirs")))]
    got = P.three_way(df(base), df(mine), df(theirs), "id", ["s"], order="ord").orderBy("place").collect()
    assert [r.id for r in got] == [2, 1, 9]
    assert (got[1].s.a, got[1].s.t.b, got[1].s.t.c) == ("mine", "mine", "theirs")


def test_long_chains_of_claims_take_few_rounds(spark):
    rows = spark.createDataFrame([(i, i, [f"t{i}", f"t{i + 1}"]) for i in range(1000)], "k long, o long, t array<string>")
    assert sorted(r.k for r in first_come(rows, "k", "o", "t").collect()) == list(range(0, 1000, 2))


def test_fair_plan_takes_turns(spark):
    tasks = spark.createDataFrame([(1, "m", 0, 1, 0), (1, "r", 0, 2, 0), (2, "m", 0, 9, 0)], "band_id long, kind string, priority long, due long, activity long")
    assert [(r.band_id, r.kind) for r in P.fair_pick(tasks, 3).orderBy("place").collect()] == [(1, "m"), (2, "m"), (1, "r")]


def test_listens_meet_by_evidence_not_by_time_alone(spark):
    rng = random.Random(3)
    pick = lambda *xs: rng.choice([None, *xs])
    rows = [(i, rng.randrange(40_000), pick(1, 2), pick("A", " a", "B"), pick("R", "S"), pick(30_000, 31_000, 40_000), pick("x", "y"), pick("r1", "r2", "r3"), pick("s1", "s2")) for i in range(120)]
    listens = spark.createDataFrame(rows, "ord long, ms long, band_id long, recording_title string, release_title string, duration_ms long, source string, recording_id string, track_id string")
    plain = D.candidate_pairs(listens, 1000).withColumn("tier", D.evidence()).where("tier is not null").select(F.least("l_ord", "r_ord"), F.greatest("l_ord", "r_ord"), "tier", F.col("tier") <= 3)
    found = D.candidates(listens, 1000)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) != []
    assert "mark" in next(line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)


def test_of_equal_pairs_one_is_taken(spark):
    pairs = spark.createDataFrame([(1, 2, 2, True), (1, 2, 2, True), (7, 7, 3, True)], "a long, b long, tier long, automatic boolean")
    assigned = D.assign_one_to_one(pairs)
    assert sorted((r.a, r.b, r.outcome) for r in assigned.collect()) == [(1, 2, "automatic"), (1, 2, "rejected"), (7, 7, "automatic")]
    assert sorted((r.ord, r.canonical, r.duplicate_of or 0) for r in D.canonical_rows(assigned).collect()) == [(1, 1, 0), (2, 1, 1), (7, 7, 0), (7, 7, 7)]


def test_dense_claims_are_passed_over_by_components(spark, monkeypatch):
    from setlight.operators import rounds

    rows = spark.createDataFrame([(100 * i + j, 100 * i + j, [f"a{i}", f"b{j}"]) for i in range(12) for j in range(12)], "k long, o long, t array<string>")
    split = []
    monkeypatch.setattr(rounds, "_small_components", lambda left, real=rounds._small_components: split.append(left.count()) or real(left))
    assert sorted(r.k for r in first_come(rows, "k", "o", "t").collect()) == [101 * i for i in range(12)]
    assert split == [288]
