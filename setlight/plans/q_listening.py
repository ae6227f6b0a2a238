"""Queries of the listening part."""

from __future__ import annotations

from pyspark.sql import functions as F

from setlight.functions import genres
from setlight.operators import listening as L
from setlight.sources.standins import NOW_MS, bands, concerts, listens

from .registry import query

VALID = "(duration_ms is null or duration_ms > 0)"
DUR = "case when duration_ms > 0 then duration_ms else 0 end"
SUMS = f"cast(sum({DUR}) as bigint) as duration_ms, count(*) as listen_count, max(ms) as last_ms"
TWO_WEEKS = 14 * L.DAY


def ranking(low, high, limit=100):
    return f"select band_id, {SUMS} from listens where {VALID} and ms >= {low} and ms < {high} and band_id in (select band_id from bands) group by band_id order by duration_ms desc, listen_count desc, last_ms desc, band_id limit {limit}"


RANKED = "select *, row_number() over (order by duration_ms desc, listen_count desc, last_ms desc, band_id) as rank from"


@query(
    "a2_top_artists",
    f"""with c as ({RANKED} ({ranking(NOW_MS - TWO_WEEKS, NOW_MS + 1)})), p as ({RANKED} ({ranking(NOW_MS - 2 * TWO_WEEKS, NOW_MS - TWO_WEEKS)}))
    select c.*, case when p.rank is null then 'new' when p.rank > c.rank then 'up' when p.rank < c.rank then 'down' end as movement,
      case when p.rank <> c.rank then abs(p.rank - c.rank) end as delta from c left join p using (band_id)""",
)
def top_artists(spark, d):
    return L.top_bands_moving(listens(spark, d), bands(spark, d), "twoWeeks", NOW_MS)


def _artists(timeframe, start):
    @query(f"a2_top_artists_{timeframe.lower()}", f"with c as ({ranking(start, NOW_MS + 1)}) {RANKED} c")
    def run(spark, d):
        span = L.resolve_window(timeframe, NOW_MS)
        return L.top_bands(L.in_window(listens(spark, d), span.start, span.end), bands(spark, d))


_artists("threeMonths", f"epoch_ms(make_timestamp({NOW_MS} * 1000) - interval 3 month)")
_artists("oneYear", f"epoch_ms(make_timestamp({NOW_MS} * 1000) - interval 1 year)")
_artists("allTime", "0")

LAST3 = "order by listen_count desc, duration_ms desc, last_ms desc, key"


def items_sql(key, title, group_filter, limit):
    return f"""with k as (select *, {key} as key, {title} as title from listens where {VALID} and {group_filter}),
    g as (select key, arg_min(title, ord) as title, arg_min(band_id, ord) as band_id, count(*) as listen_count, cast(sum({DUR}) as bigint) as duration_ms, max(ms) as last_ms from k group by key {LAST3} limit {limit})
    select *, row_number() over ({LAST3}) as rank from g"""


TRACK_TEXT = "concat_ws('|', cast(band_id as varchar), lower(trim(recording_title)), lower(trim(release_title)))"


@query("a3_top_tracks", items_sql(f"coalesce('stable:' || recording_id, {TRACK_TEXT})", "trim(recording_title)", "trim(recording_title) <> ''", 50))
def top_tracks(spark, d):
    return L.top_items(listens(spark, d), "track", 50)


@query("a3_top_albums", items_sql("concat_ws('|', cast(band_id as varchar), lower(trim(release_title)))", "trim(release_title)", "trim(release_title) <> ''", 50))
def top_albums(spark, d):
    return L.top_items(listens(spark, d), "album", 50)


REC = "coalesce('recording:' || recording_id, 'spotify:' || track_id, 'event:' || ord)"


def recordings_sql(where, limit=100):
    return f"""select {REC} as key, coalesce(recording_id, track_id) is not null as trusted, arg_min(recording_title, ord) as title, count(*) as listen_count, cast(sum({DUR}) as bigint) as duration_ms, max(ms) as last_ms,
      case when count(distinct track_id) = 1 then min(track_id) end as track_id, count(distinct track_id) > 1 as conflict
      from listens where {VALID} and trim(recording_title) <> '' and {where} group by 1, 2 {LAST3} limit {limit}"""


@query("a4_a5_toplist_recordings", f"with g as ({recordings_sql('true')}) select *, row_number() over ({LAST3}) as rank from g")
def toplist(spark, d):
    return L.rank_recordings(listens(spark, d))


@query(
    "a8_toplist_movement",
    f"""with c as (select *, row_number() over ({LAST3}) as rank from ({recordings_sql(f'ms >= {NOW_MS - TWO_WEEKS} and ms < {NOW_MS + 1}')})),
    p as (select *, row_number() over ({LAST3}) as rank from ({recordings_sql(f'ms >= {NOW_MS - 2 * TWO_WEEKS} and ms < {NOW_MS - TWO_WEEKS}')}))
    select c.*, case when not c.trusted then null when p.rank is null then 'new' when p.rank > c.rank then 'up' when p.rank < c.rank then 'down' end as movement,
      case when c.trusted and p.rank <> c.rank then abs(p.rank - c.rank) end as delta from c left join p on p.key = c.key and p.trusted""",
)
def toplist_movement(spark, d):
    span, rows = L.resolve_window("twoWeeks", NOW_MS), listens(spark, d)
    return L.movement(L.rank_recordings(L.in_window(rows, span.start, span.end)), L.rank_recordings(L.in_window(rows, span.previous, span.start)), "key", "trusted")


@query(
    "a6_edition_albums",
    f"""with r as (select *, concat_ws('|', cast(band_id as varchar), lower(trim(release_title))) as text_key from listens where {VALID} and trim(release_title) <> ''),
    s as (select text_key, count(distinct recording_id) > 1 as split from r group by 1),
    k as (select *, case when split and recording_id is not null then concat_ws('#', text_key, recording_id) else text_key end as key from r join s using (text_key)),
    g as (select key, {SUMS} from k group by key {LAST3} limit 50) select *, row_number() over ({LAST3}) as rank from g""",
)
def edition_albums(spark, d):
    return L.edition_albums(listens(spark, d), "recording_id", 50)


def buckets_sql(kind, low, high):
    b = f"cast(date_trunc('{kind}', make_timestamp(cast(ms as bigint) * 1000)) as date)"
    first = f"date_trunc('{kind}', make_timestamp({low} * 1000))"
    return f"""with r as (select *, {b} as bucket_at from listens where {VALID} and ms >= {low} and ms < {high}),
    spine as (select cast(unnest(generate_series({first}, date_trunc('{kind}', make_timestamp({high - 1} * 1000)), interval 1 {kind})) as date) as start_at)
    select start_at, cast(coalesce(sum({DUR}), 0) as bigint) as duration_ms, count(ord) as listen_count, count(ord) filter (duration_ms is null) as unknown_count from spine left join r on bucket_at = start_at group by start_at"""


for _tf in ("twoWeeks", "threeMonths", "oneYear"):
    _span = L.resolve_window(_tf, NOW_MS)

    @query(f"a9_buckets_{_span.bucket}", buckets_sql(_span.bucket, _span.start, _span.end))
    def _buckets(spark, d, span=_span):
        return L.time_buckets(listens(spark, d), span)


_span = L.resolve_window("twoWeeks", NOW_MS)


@query("a10_a17_daily_buckets_linked", buckets_sql("day", _span.start, _span.end).replace(f"from listens where {VALID}", f"from listens where band_id in (select band_id from bands) and {VALID}"))
def daily(spark, d):
    return L.time_buckets(L.linked(listens(spark, d), bands(spark, d)), _span, "day")


@query("a11_most_active_bucket", f"select * from ({buckets_sql('day', _span.start, _span.end)}) order by duration_ms desc, listen_count desc, start_at limit 1")
def most_active(spark, d):
    return L.most_active(L.time_buckets(listens(spark, d), _span))


FIVE_SQL = "case when regexp_matches({x}, 'rock|metal|punk|grunge') then 'Rock' when regexp_matches({x}, 'pop') then 'Pop' when regexp_matches({x}, 'hip.?hop|rap|r&b|rhythm and blues') then 'Hip-hop/R&B' when regexp_matches({x}, 'electronic|dance|house|techno|ambient|synth') then 'Electronic' else 'Other' end"
BAND_GROUP = f"coalesce(list_filter(list_transform(regexp_split_to_array(genre_raw, '[,;/|]'), lambda v: {FIVE_SQL.format(x='lower(trim(v))')}), lambda g: g <> 'Other')[1], 'Other')"
GENRE_ROWS = f"select year(make_timestamp(cast(ms as bigint) * 1000)) as year, {BAND_GROUP} as grp, {DUR} as dur, ms, ord from listens join bands using (band_id) where {VALID}"


def genre_sql(extra=""):
    parts, pct = [], []
    for i, g in enumerate(L.GROUPS):
        parts.append(f"cast(coalesce(sum(dur) filter (grp = '{g}'), 0) as bigint) as g{i}_ms, count(*) filter (grp = '{g}') as g{i}_n, count(*) filter (grp = '{g}' and dur = 0) as g{i}_unknown")
        pct.append(f"case when total_ms > 0 then floor(g{i}_ms / total_ms * 1000 + 0.5) / 10 else 0 end as g{i}_pct, case when total_n > 0 then floor(g{i}_n / total_n * 1000 + 0.5) / 10 else 0 end as g{i}_listen_pct")
    return f"""with r as ({GENRE_ROWS} {extra}), s as (select year, cast(sum(dur) as bigint) as total_ms, count(*) as total_n, count(*) filter (dur = 0) as total_unknown, {', '.join(parts)} from r group by year)
    select *, {', '.join(pct)} from s"""


@query("a12_genre_by_year", genre_sql())
def genre_by_year(spark, d):
    return L.genre_by_year(listens(spark, d), bands(spark, d), genres.band_group(F.col("genre_raw")))


@query("a13_genre_by_year_residual", f"select year, total_ms, g0_pct, g1_pct, g2_pct, g3_pct, floor((100 - (0 + g0_pct + g1_pct + g2_pct + g3_pct)) * 10 + 0.5) / 10 as g4_pct from ({genre_sql('and duration_ms > 0')})")
def genre_residual(spark, d):
    return L.genre_by_year_residual(listens(spark, d), bands(spark, d), genres.band_group(F.col("genre_raw")))


@query(
    "a14_dominant_genre",
    f"""with y as ({genre_sql()}), w as ({' union all '.join(f"select {i} as i, '{g}' as grp, sum(total_ms * g{i}_pct / 100) as w from y" for i, g in enumerate(L.GROUPS))})
    select grp, cast(floor(w / (select sum(w) from w) * 100 + 0.5) as bigint) as pct from w order by w desc, i limit 1""",
)
def dominant(spark, d):
    return L.dominant_genre(L.genre_by_year(listens(spark, d), bands(spark, d), genres.band_group(F.col("genre_raw"))))


def yearly_sql(genre):
    return f"""with r as ({GENRE_ROWS}), spine as (select unnest(generate_series((select min(year) from r), 2026)) as y)
    select y as year, cast(coalesce(sum(dur), 0) as bigint) as duration_ms, count(ord) as listen_count, count(ord) filter (dur = 0) as unknown_count, y = 2026 as is_current
    from spine left join r on r.year = y {f"and grp = '{genre}'" if genre else ''} group by y"""


@query("a15_yearly", yearly_sql(None))
def yearly(spark, d):
    return L.yearly(listens(spark, d), bands(spark, d), 2026, None, genres.band_group(F.col("genre_raw")))


@query("a15_yearly_rock", yearly_sql("Rock"))
def yearly_rock(spark, d):
    return L.yearly(listens(spark, d), bands(spark, d), 2026, "Rock", genres.band_group(F.col("genre_raw")))


TOTALS = f"select cast(coalesce(sum({DUR}), 0) as bigint) as duration_ms, count(*) as listen_count, count(*) filter (duration_ms is null) as unknown_count, arg_min(ord, (ms, ord)) as first_listen, arg_max(ord, (ms, -ord)) as last_listen from listens where {VALID}"


@query("a18_a19_totals", TOTALS)
def totals(spark, d):
    return L.totals(listens(spark, d))


@query("a16_selected_stats_totals", TOTALS + f" and ms >= {_span.start} and ms < {_span.end} and band_id in (select band_id from bands)")
def selected_totals(spark, d):
    return L.totals(L.in_window(L.linked(listens(spark, d), bands(spark, d)), _span.start, _span.end))


LINKED = f"ms >= {_span.start} and ms < {_span.end} and band_id in (select band_id from bands)"
_buckets_linked = buckets_sql("day", _span.start, _span.end).replace(f"from listens where {VALID}", f"from listens where band_id in (select band_id from bands) and {VALID}")


@query(
    "a16_selected_stats",
    f"""with tt as ({TOTALS} and {LINKED}), bc as ({RANKED} ({ranking(NOW_MS - TWO_WEEKS, NOW_MS + 1)})), bp as ({RANKED} ({ranking(NOW_MS - 2 * TWO_WEEKS, NOW_MS - TWO_WEEKS)})), bu as ({_buckets_linked})
    select 'total' as section, 0 as place, cast(null as varchar) as key, duration_ms, listen_count, cast(null as varchar) as movement from tt union all select 'unknown', 0, null, 0, unknown_count, null from tt union all select 'first', 0, cast(first_listen as varchar), 0, 0, null from tt union all select 'last', 0, cast(last_listen as varchar), 0, 0, null from tt
    union all select 'distinct_bands', 0, null, 0, count(distinct band_id), null from listens where {VALID} and {LINKED}
    union all select 'band', bc.rank, cast(bc.band_id as varchar), bc.duration_ms, bc.listen_count, case when bp.rank is null then 'new' when bp.rank > bc.rank then 'up' when bp.rank < bc.rank then 'down' end from bc left join bp using (band_id)
    union all select 'track', rank, key, duration_ms, listen_count, null from ({items_sql(f"coalesce('stable:' || recording_id, {TRACK_TEXT})", "trim(recording_title)", f"trim(recording_title) <> '' and {LINKED}", 10)})
    union all select 'album', rank, key, duration_ms, listen_count, null from ({items_sql("concat_ws('|', cast(band_id as varchar), lower(trim(release_title)))", "trim(release_title)", f"trim(release_title) <> '' and {LINKED}", 10)})
    union all select 'bucket', 0, cast(start_at as varchar), duration_ms, listen_count, null from bu union all select * from (select 'most_active', 0, cast(start_at as varchar), duration_ms, listen_count, null from bu order by duration_ms desc, listen_count desc, start_at limit 1)""",
)
def selected_stats(spark, d):
    return L.selected_stats(listens(spark, d), bands(spark, d), "twoWeeks", NOW_MS)


NAMES = ["fourteen_days", "three_months", "one_year", "all_time"]


@query(
    "a20_band_activity",
    f"""with b as (select band_id, ms, case when ms >= {NOW_MS - TWO_WEEKS} then 'fourteen_days' when ms >= epoch_ms(make_timestamp({NOW_MS} * 1000) - interval 3 month) then 'three_months'
      when ms >= epoch_ms(make_timestamp({NOW_MS} * 1000) - interval 12 month) then 'one_year' else 'all_time' end as bucket from listens where ms <= {NOW_MS} and band_id in (select band_id from bands)),
    g as (select band_id, bucket, count(*) as n, max(ms) as last_ms from b group by 1, 2), r as (select *, row_number() over (partition by bucket order by last_ms desc, band_id) as rank from g)
    select bands.band_id, {', '.join(f"coalesce(max(n) filter (bucket = '{x}'), 0) as {x}_n, max(rank) filter (bucket = '{x}') as {x}_rank" for x in NAMES)} from bands left join r on r.band_id = bands.band_id group by bands.band_id""",
)
def band_activity(spark, d):
    return L.band_activity(listens(spark, d), bands(spark, d), NOW_MS)


@query("a21_activity_invariants", f"select 4 as buckets, true as dense, count(*) as mapped from listens where ms <= {NOW_MS} and band_id in (select band_id from bands) having count(*) > 0")
def activity_invariants(spark, d):
    """Ranks run from 1 without holes in each bucket, and counts add up."""
    rows = L.band_activity(listens(spark, d), bands(spark, d), NOW_MS)
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(x).alias("b"), F.col(f"{x}_n").alias("n"), F.col(f"{x}_rank").alias("r")) for x in NAMES])).alias("x")).select("x.*")
    per = long.groupBy("b").agg(F.coalesce(F.max("r"), F.lit(0)).alias("top"), F.count("r").alias("ranked"), F.countDistinct("r").alias("distinct"), F.sum("n").alias("n"))
    return per.agg(F.count("*").cast("int").alias("buckets"), F.bool_and((F.col("top") == F.col("ranked")) & (F.col("ranked") == F.col("distinct"))).alias("dense"), F.sum("n").alias("mapped"))


@query("a23_band_slice", f"select band_id, {SUMS} from listens where {VALID} and band_id = 11 and ms >= {_span.start} and ms < {_span.end} group by band_id")
def band_slice(spark, d):
    """One band's window, with the predicate pushed to the scan."""
    rows = listens(spark, d).where("band_id = 11")
    return L.in_window(rows, _span.start, _span.end).groupBy("band_id").agg(*L.measures())


@query(
    "l12_a22_concert_listening",
    f"""with c as (select ord as concert, band_id, date '2024-01-01' + cast(ord % 120 as integer) as d from concerts),
    w as (select concert, band_id, case when d < date '2024-01-31' then epoch_ms(d - interval 3 month) else epoch_ms(make_timestamp({NOW_MS} * 1000) - interval 6 month) end as low,
      case when d < date '2024-01-31' then least(epoch_ms(cast(d + interval 3 month as date) + interval 1 day), {NOW_MS + 1}) else {NOW_MS + 1} end as high from c)
    select concert, cast(coalesce(sum({DUR}), 0) as bigint) as duration_ms, count(l.ord) as listen_count
    from w left join (select * from listens where {VALID}) l on l.band_id = w.band_id and ms >= low and ms < high group by concert""",
)
def concert_listening(spark, d):
    shows = concerts(spark, d).select("ord", "band_id", F.expr("date_add(date '2024-01-01', cast(ord % 120 as int))").alias("d"))
    return L.concert_listening(shows, listens(spark, d), "2024-01-31", NOW_MS)


@query("l1_l5_linked_window", f"select ord, band_id, ms from listens where {VALID} and ms >= {_span.start} and ms < {_span.end} and band_id in (select band_id from bands)")
def linked_window(spark, d):
    return L.in_window(L.linked(listens(spark, d), bands(spark, d)), _span.start, _span.end).select("ord", "band_id", "ms")
