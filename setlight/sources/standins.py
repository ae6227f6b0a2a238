"""The driver's tables read as listens, bands, concerts, setlist songs and releases.

Every adapter has a twin in ``SQL`` with the same columns. Listens of every tenth user point to a band that
does not exist; no table is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The clocks of the queries: listens end in January 2024, concerts run from 1995 to 2001.
NOW_MS = 1706659199000
TODAY = "1999-07-01"

#: Lines that a task joins with their parts.
LINES_A_TASK = 1_000_000

GENRES = "case c_custkey % 8 when 0 then 'Rock, alternative rock' when 1 then 'Synth-pop / Electronic' when 2 then 'Hip-hop' when 3 then 'Black metal; Rock' when 4 then 'Folk|Pop' when 5 then 'Punk rock' when 6 then 'Jazz' else '' end"

SQL = {
    "listens": """
      select event_id as ord, cast(epoch_us(cast(ts as timestamp)) // 1000 as bigint) as ms, case when user_id % 10 = 0 then -user_id else user_id end as band_id, event_type as release_title,
        case when event_type = 'error' then null else cast(floor(value * 1000 + 0.5) as bigint) end as duration_ms,
        concat('Track ', json_extract_string(props, '$.k')) as recording_title,
        case when event_id % 2 = 0 then 'spotify_import' else 'listenbrainz' end as source,
        case when event_id % 3 = 0 then concat('r', json_extract_string(props, '$.k')) end as recording_id,
        case when event_id % 4 = 0 then concat('s', json_extract_string(props, '$.k')) end as track_id
      from events""",
    "relistens": """
      select * from listens
      union all select ord + 1000000, ms + (ord % 5) * 1000 - 2000, band_id, release_title, duration_ms, recording_title, case when source = 'listenbrainz' then 'spotify_import' else 'listenbrainz' end,
        case when ord % 3 = 0 then recording_id end, case when ord % 48 > 0 then track_id end from listens where ord % 16 = 0
      union all select ord + 2000000, ms + 1500, band_id, release_title, duration_ms + 10, recording_title, source, recording_id, track_id from listens where ord % 32 = 0""",
    "bands": f"""
      select c_custkey as band_id, c_name as name, {GENRES} as genre_raw, c_acctbal > 5000 as favorite, c_custkey % 11 = 0 as muted,
        case c_custkey % 5 when 0 then '1999' when 1 then '2001-06-15' end as last_known
      from customer""",
    "concerts": """
      select o_orderkey as ord, o_custkey as band_id, cast(o_orderdate as date) as d, cast(o_custkey % 12 as bigint) as venue, cast(o_custkey % 5 as bigint) as city,
        case cast(o_custkey % 6 as bigint) when 0 then 'Sweden' when 1 then ' denmark' when 2 then 'USA' when 3 then 'Germany' when 4 then 'UK' end as country,
        case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'festival' else 'concert' end as typ,
        o_orderstatus = 'F' as attending, case when o_orderkey % 9 = 0 then null when o_orderkey % 13 = 0 then 0 else cast(floor(o_totalprice * 100 + 0.5) as bigint) end as price_cents,
        cast(1 + o_orderkey % 3 as bigint) as quantity, case when o_orderkey % 7 = 0 then null else cast((o_custkey % 40) * 25 as bigint) end as distance_km,
        case when o_orderkey % 4 = 0 then null else cast(o_orderkey % 5 + 1 as bigint) end as rating
      from orders""",
    "songs": """
      select l_orderkey as setlist, p_name as name, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as bigint) as idx,
        l_returnflag = 'R' as is_encore, l_linestatus = 'O' as is_cover
      from lineitem join part on l_partkey = p_partkey""",
    "releases": """
      select p_partkey as release_id, p_partkey % 1000 as band_id, p_name as title,
        case p_size % 4 when 0 then 'Album' when 1 then 'EP' when 2 then 'Single' else 'Broadcast' end as type,
        case when p_partkey % 17 = 0 then null else cast(date '2024-01-01' + cast(p_partkey % 60 as integer) as date) end as release_date,
        case when p_partkey % 3 = 0 then concat('sp', p_partkey) end as provider_id, p_brand as brand
      from part""",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        F.when(F.col("user_id") % 10 == 0, -F.col("user_id")).otherwise(F.col("user_id")).alias("band_id"),
        F.col("event_type").alias("release_title"),
        F.when(F.col("event_type") != "error", F.floor(F.col("value") * 1000 + 0.5)).alias("duration_ms"),
        F.concat(F.lit("Track "), k).alias("recording_title"),
        F.when(F.col("event_id") % 2 == 0, "spotify_import").otherwise("listenbrainz").alias("source"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("r"), k)).alias("recording_id"),
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("s"), k)).alias("track_id"),
    )


def relistens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listens, of which some came a second time from the other source and a third time from their own."""
    rows = listens(spark, sf_dir)
    other = rows.where("ord % 16 = 0").withColumns(
        {
            "ms": F.expr("ms + (ord % 5) * 1000 - 2000"),
            "source": F.when(F.col("source") == "listenbrainz", "spotify_import").otherwise("listenbrainz"),
            "recording_id": F.expr("case when ord % 3 = 0 then recording_id end"),
            "track_id": F.expr("case when ord % 48 > 0 then track_id end"),
        }
    )
    again = rows.where("ord % 32 = 0").withColumns({"ms": F.expr("ms + 1500"), "duration_ms": F.expr("duration_ms + 10")})
    return rows.unionByName(other.withColumn("ord", F.col("ord") + 1000000)).unionByName(again.withColumn("ord", F.col("ord") + 2000000))


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr(
        "c_custkey as band_id",
        "c_name as name",
        f"{GENRES} as genre_raw",
        "c_acctbal > 5000 as favorite",
        "c_custkey % 11 = 0 as muted",
        "case c_custkey % 5 when 0 then '1999' when 1 then '2001-06-15' end as last_known",
    )


def concerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as ord",
        "o_custkey as band_id",
        "cast(o_orderdate as date) as d",
        "cast(o_custkey % 12 as bigint) as venue",
        "cast(o_custkey % 5 as bigint) as city",
        "case cast(o_custkey % 6 as bigint) when 0 then 'Sweden' when 1 then ' denmark' when 2 then 'USA' when 3 then 'Germany' when 4 then 'UK' end as country",
        "case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'festival' else 'concert' end as typ",
        "o_orderstatus = 'F' as attending",
        "case when o_orderkey % 9 = 0 then null when o_orderkey % 13 = 0 then 0 else cast(floor(o_totalprice * 100 + 0.5) as bigint) end as price_cents",
        "cast(1 + o_orderkey % 3 as bigint) as quantity",
        "case when o_orderkey % 7 = 0 then null else cast((o_custkey % 40) * 25 as bigint) end as distance_km",
        "case when o_orderkey % 4 = 0 then null else cast(o_orderkey % 5 + 1 as bigint) end as rating",
    )


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    n = -(-lines.count() // LINES_A_TASK)
    if n > spark.sparkContext.defaultParallelism:  # else all tasks together hold fewer anyway
        lines, parts = lines.repartition(n, "l_partkey"), parts.repartition(n, "p_partkey")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        "l_orderkey as setlist",
        "p_name as name",
        "cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as bigint) as idx",
        "l_returnflag = 'R' as is_encore",
        "l_linestatus = 'O' as is_cover",
    )


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr(
        "p_partkey as release_id",
        "p_partkey % 1000 as band_id",
        "p_name as title",
        "case p_size % 4 when 0 then 'Album' when 1 then 'EP' when 2 then 'Single' else 'Broadcast' end as type",
        "case when p_partkey % 17 = 0 then null else date_add(date '2024-01-01', cast(p_partkey % 60 as int)) end as release_date",
        "case when p_partkey % 3 = 0 then concat('sp', p_partkey) end as provider_id",
        "p_brand as brand",
    )
