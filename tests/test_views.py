import random

import pytest
from pyspark.sql import functions as F

from setlight.operators import views as V

DAY = 86_400_000


def batches(seed):
    r = random.Random(seed)
    rows, declared, reps, out = {}, {}, [], []
    for b in range(4):
        new, says = [], []
        for _ in range(r.randint(0, 60)):
            o = len(rows)
            near = r.choice(reps) if reps and r.random() < 0.4 else None
            ms = rows[near][1] + r.randint(-2000, 2000) if near is not None else 1_706_572_800_000 + r.randint(0, 5 * DAY)
            rows[o] = (o, ms, near if near is None else rows[near][2], None if r.random() < 0.4 else r.randint(-5, 500), None, None)
            if near is None:
                rows[o] = (o, ms, r.randint(0, 3), *rows[o][3:])
                reps.append(o)
            else:
                declared[o] = near
            new.append(rows[o])
        for o, rep in list(declared.items()):
            if o not in {x for batch in out for x, *_ in batch[1]} and r.random() < 0.6:
                says.append((o, rep, rows[o][1]))
        out.append((new, says))
    return out


def full(spark, done):
    listens = spark.createDataFrame([x for new, _ in done for x in new], V.LISTEN)
    declared = spark.createDataFrame([x for _, says in done for x in says], V.DECLARED)
    return sorted(tuple(r) for r in V.sums(V.canonical_of(listens, declared.select("ord", "duplicate_of"))).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_view_equals_full_recomputation(spark, tmp_path, seed):
    view, done = V.MaintainedSums(spark, f"file://{tmp_path}/v", compact_every=2), []
    for b, (new, says) in enumerate(batches(seed)):
        done.append((new, says))
        listens, declared = spark.createDataFrame(new, V.LISTEN), spark.createDataFrame(says, V.DECLARED)
        view.apply(b, listens, declared)
        if b == 1:  # a batch that is run again overwrites itself
            view.apply(b, listens, declared)
        assert sorted(tuple(r) for r in view.read().collect()) == full(spark, done)
    assert sorted(tuple(r) for r in view.read(1).collect()) == full(spark, done[:2])
    assert V.top_bands(view.read(), "2024-01-01", "2024-12-31").agg(F.sum("listens")).first()[0] == sum(r[3] for r in full(spark, done))


def test_only_months_of_changes_are_read(spark, tmp_path):
    view = V.MaintainedSums(spark, f"file://{tmp_path}/v")
    old = [(1, 1_600_000_000_000, 1, 10, None, None), (2, 1_706_572_800_000, 1, None, None, None)]
    view.apply(0, spark.createDataFrame(old, V.LISTEN), spark.createDataFrame([], V.DECLARED))
    known = view._numbered("listens", V.LISTEN, 1, ["2024-01", "2024-02"])
    assert [r.ord for r in known.collect()] == [2]
    assert "PartitionFilters: [" in known._jdf.queryExecution().toString() and "month" in known._jdf.queryExecution().executedPlan().toString()
