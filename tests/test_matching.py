import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from setlight.operators import dedupe as D
from setlight.operators import matching as M
from setlight.operators.preparation import STAGED


def listens(spark, seed, n, ids, span):
    r = random.Random(seed)
    pick = lambda *x: r.choice([None, *x])
    rows = [(r.randrange(ids), r.randrange(span), pick(1, 2), pick("A", " a", "B"), pick("R", "S"), pick(30_000, 31_000, 40_000), pick("x", "y", "y"), pick("r1", "r2"), pick("s1", "s2", "s3")) for _ in range(n)]
    return spark.createDataFrame(rows, STAGED)


@pytest.mark.parametrize("seed, n, ids, span, one_pass", [(2, 150, 60, 60_000, 2_000_000), (4, 100, 100, 300_000, 5)])
def test_matching_of_listens_equals_that_of_their_pairs(spark, monkeypatch, seed, n, ids, span, one_pass):
    monkeypatch.setattr(M, "ONE_PASS", one_pass)
    rows = listens(spark, seed, n, ids, span)
    wanted = sorted(map(tuple, D.assign_one_to_one(D.candidates(rows, 1000)).collect()))
    assert sorted(map(tuple, D.assign_listens(rows, 1000).collect())) == wanted != []
    won = [x for x in wanted if x[3] == "automatic"]
    assert sorted(map(tuple, D.matched_listens(rows, 1000).collect())) == won != []


def test_a_pass_of_nothing():
    none = np.empty(0, np.int64)
    assert M.pass_over(none, none, none, none, none, 5) == []


def test_an_id_is_taken_with_all_its_listens():
    ids, ms, mark, source = np.array([1, 2, 2, 3, 1]), np.array([0, 1, 100, 101, 0]), np.array([0, 0, 1, 1, 0]), np.array([0, 1, 0, 1, 1])
    assert [(ids[i], ids[j]) for i, j in M.pass_over(ids, ms, mark, source, np.full(5, -1), 5)] == [(1, 2)]


def test_pairs_are_neither_written_nor_shuffled(spark):
    """1,200 listens of one recording in a second have 360,000 pairs."""
    rows = spark.range(1200).selectExpr("id as ord", "id % 1000 as ms", "1L as band_id", "'T' as recording_title", "'R' as release_title", "40000L as duration_ms", "if(id % 2 = 0, 'x', 'y') as source", "'r' as recording_id", "'t' as track_id")
    executor = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0)
    before = executor().totalShuffleWrite()
    got = {(r.tier, r.outcome): r.n for r in D.audit(D.assign_listens(rows, 5000)).collect()}
    assert got == {(2, "automatic"): 600, (2, "rejected"): 359_400}
    assert D.canonical_rows(D.matched_listens(rows, 5000)).where(F.col("duplicate_of").isNotNull()).count() == 600
    assert executor().totalShuffleWrite() - before < 300_000
