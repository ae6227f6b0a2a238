"""Queries of views that are kept up to date."""

from __future__ import annotations

from pyspark.sql import functions as F

from setlight.operators import views as V
from setlight.sources.standins import relistens

from .q_sources import folder_of
from .registry import query

#: Listens arrive in three batches by ord; a repeat is declared a duplicate as soon as it and its original are there, every fourth one a batch later.
ARRIVAL = "select ord, ms, band_id, duration_ms, recording_id, track_id, ord % 1000000 as origin, cast(ord % 3 as int) as b, cast(ord % 1000000 % 3 as int) as origin_b from relistens"
FULL = f"""ar as ({ARRIVAL}), dp as (select origin as rep, arg_min(duration_ms, ord) filter (duration_ms is not null) as dd from ar where ord <> origin group by origin),
  ca as (select ar.ord, ms, band_id, coalesce(duration_ms, dd) as duration_ms from ar left join dp on dp.rep = ar.ord where ar.ord = ar.origin),
  vw as (select strftime(make_timestamp(ms * 1000), '%Y-%m') as month, cast(make_timestamp(ms * 1000) as date) as d, band_id, count(*) as n, cast(sum(case when duration_ms > 0 then duration_ms else 0 end) as bigint) as duration_ms from ca group by 1, 2, 3)"""


def maintained(spark, d):
    rows = relistens(spark, d)
    rows.createOrReplaceTempView("relistens")
    arrival = spark.sql(ARRIVAL)
    late = F.greatest("b", "origin_b") + F.when(F.floor(F.col("ord") / 16) % 4 == 0, 1).otherwise(0)
    declared = arrival.where("ord <> origin").select("ord", F.col("origin").alias("duplicate_of"), "ms", F.least(late, F.lit(2)).alias("b"))
    view = V.MaintainedSums(spark, folder_of(spark, "view"), compact_every=2)
    for b in range(3):
        view.apply(b, arrival.where(F.col("b") == b), declared.where(F.col("b") == b))
    return view.read()


@query("a9_maintained_days", f"with {FULL} select d, cast(sum(n) as bigint) as listen_count, cast(sum(duration_ms) as bigint) as duration_ms from vw group by d")
def maintained_days(spark, d):
    """Daily sums of canonical listens after three batches with duplicates taken back."""
    return V.days(maintained(spark, d))


@query("a2_a20_maintained_activity", f"with {FULL} select band_id, month, count(*) as active_days, cast(sum(n) as bigint) as listens, cast(sum(duration_ms) as bigint) as duration_ms from vw group by 1, 2")
def maintained_activity(spark, d):
    return V.activity(maintained(spark, d))
