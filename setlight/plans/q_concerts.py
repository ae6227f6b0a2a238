"""Queries of the concert part."""

from __future__ import annotations

from pyspark.sql import functions as F

from setlight.functions import genres
from setlight.operators import concerts as C
from setlight.sources.standins import TODAY, bands, concerts

from .registry import query

T = f"date '{TODAY}'"
PAST = f"attending and d < {T}"
GOING = f"attending and d >= {T}"


def split(spark, d):
    mine = concerts(spark, d).where("attending")
    return mine.where(~C.upcoming(F.col("d"), TODAY)), mine.where(C.upcoming(F.col("d"), TODAY))


# rows of orders that count as attended lie before and after the clock, so the whole attended set serves as "past" for visits
def attended(spark, d):
    return concerts(spark, d).where("attending")


@query("c1_nearest_per_band", f"select band_id, ord, d, attending from (select *, row_number() over (partition by band_id order by attending desc, d nulls last, ord) as rn from concerts where d is null or d >= {T}) where rn = 1")
def nearest(spark, d):
    return C.nearest_per_band(concerts(spark, d), TODAY).select("band_id", "ord", "d", "attending")


@query("c2_venue_groups", "select venue, city, count(*) as n, arg_min(country, ord) filter (country is not null and country <> '') as country from concerts group by venue, city")
def venues(spark, d):
    return C.venue_groups(concerts(spark, d))


LAST = "select b.band_id, greatest(try_cast(case when length(last_known) = 4 then last_known || '-01-01' else last_known end as date), latest) as last_date from bands b left join (select band_id, max(d) as latest from concerts group by band_id) c on c.band_id = b.band_id"


@query("c3_c10_last_show", LAST)
def last_show(spark, d):
    return C.last_show(bands(spark, d), concerts(spark, d))


@query(
    "c4_band_activity",
    f"select band_id, last_date, year(last_date) as last_year, case when last_date is null then 'unknown' when last_date < date '2004-01-01' and (date '2004-01-01' - last_date) / 365.25 >= 3 then 'inactive' else 'active' end as status from ({LAST})",
)
def activity(spark, d):
    return C.activity(C.last_show(bands(spark, d), concerts(spark, d)), 3, "2004-01-01")


VISITS = """with o as (select *, lag(d) over w as pd, lag(typ) over w as pt from concerts where attending window w as (partition by venue, city order by d, ord)),
  i as (select *, sum(case when d - pd = 0 or (d - pd = 1 and typ = 'festival' and pt = 'festival') then 0 else 1 end) over (partition by venue, city order by d, ord) as island from o),
  visits as (select venue, city, count(*) as n, max(d) as last_date, min(ord) as visit, bool_and(typ = 'festival') as festival, arg_min(distance_km, (d, ord)) filter (distance_km is not null) as km from i group by venue, city, island)"""


@query("c5_venue_visits", f"{VISITS} select * from visits")
def visits(spark, d):
    return C.venue_visits(attended(spark, d))


@query(
    "c6_counts",
    f"""{VISITS}, a as (select count(*) as shows, count(distinct lower(trim(country))) as countries, count(distinct (venue, city)) as venues, count(distinct city) as cities, count(distinct band_id) as artists,
      count(distance_km) as known_distances, count(rating) as rated, floor(avg(rating) * 10 + 0.5) / 10 as average_rating from concerts where attending),
    b as (select cast(coalesce(sum(2 * km), 0) as bigint) as km_traveled, count(*) as visits, count(*) filter (festival) as festivals from visits) select * from a, b""",
)
def stats_counts(spark, d):
    rows = attended(spark, d)
    return C.counts(rows, C.venue_visits(rows))


@query(
    "c6_spending",
    f"""select cast(coalesce(sum(price_cents * quantity), 0) as bigint) as total_cents, count(price_cents) as known, count(price_cents) filter (d < {T}) as known_past,
      cast(floor(sum(price_cents * quantity) / sum(quantity) filter (price_cents is not null) / 100 + 0.5) as bigint) as average_price,
      cast(floor(count(price_cents) filter (d < {T}) / count(*) filter (d < {T}) * 100 + 0.5) as bigint) as priced_pct from concerts where attending""",
)
def stats_spending(spark, d):
    return C.spending(*split(spark, d))


@query(
    "c6_spend_years",
    """with y as (select year(d) as year, cast(sum(price_cents * quantity) as bigint) as cents from concerts where attending and price_cents is not null group by 1)
    select arg_max(year, (cents, -year)) as highest_year, max(cents) as highest_cents, case when count(*) > 1 then arg_min(year, (cents, year)) end as lowest_year, case when count(*) > 1 then min(cents) end as lowest_cents from y""",
)
def stats_years(spark, d):
    return C.spend_years(*split(spark, d))


@query(
    "c6_busiest",
    f"""{VISITS} select * from (select 'year' as what, year(last_date) as k, count(*) as count from visits group by 2 order by 3 desc, 2 desc limit 1)
    union all select * from (select 'month', month(last_date), count(*) from visits group by 2 order by 3 desc, 2 limit 1)
    union all select what, k, n from (select 'city' as what, city as k, count(*) as n, max(last_date) as last from visits group by 2 order by n desc, last desc, k limit 1)""",
)
def stats_busiest(spark, d):
    return C.busiest(C.venue_visits(attended(spark, d)))


@query(
    "c6_longest_gap",
    f"""with days as (select distinct d from concerts where {PAST}), g as (select d, lag(d) over (order by d) as before from days)
    select max(d - before) as days, arg_min(before, (-(d - before), d)) filter (before is not null) as from_date, min(d) as first_show, max(d) as last_show, {T} - max(d) as days_since from g""",
)
def stats_gap(spark, d):
    return C.longest_gap(split(spark, d)[0], TODAY)


@query("c6_top_artists", "select band_id, count(*) as n, max(d) as last_date from concerts where attending group by band_id having count(*) >= 2 order by n desc, last_date desc, band_id limit 3")
def stats_artists(spark, d):
    return C.top_artists(attended(spark, d))


@query("c6_top_venues", f"{VISITS} select venue, city, count(*) as n, max(last_date) as last_date from visits group by venue, city order by n desc, last_date desc, venue, city limit 5")
def stats_venues(spark, d):
    return C.top_venues(C.venue_visits(attended(spark, d)))


@query("c6_top_rated", "select ord, d from concerts where attending and rating = 5")
def stats_rated(spark, d):
    return attended(spark, d).where("rating = 5").select("ord", "d")


@query(
    "c6_extremes",
    """select arg_min(ord, (-distance_km, ord)) filter (distance_km is not null) as farthest, arg_min(ord, (distance_km, ord)) filter (distance_km is not null) as closest,
      arg_min(ord, (price_cents, ord)) filter (price_cents > 0) as cheapest, arg_min(ord, (-price_cents, ord)) filter (price_cents is not null) as priciest from concerts where attending""",
)
def stats_extremes(spark, d):
    return C.extremes(attended(spark, d))


_PRIMARY = {
    "metal": "metal|hardcore|thrash", "folk": "\\bfolk\\b|singer[\\s-]?songwriter|americana", "hiphop_rnb": "\\bhip[\\s-]?hop\\b|\\brap\\b|r ?& ?b|\\brnb\\b|g-?funk",
    "electronic": "electro|techno|\\bhouse\\b|\\bedm\\b|\\bdance\\b|synth", "pop": "\\bpop\\b", "rock": "rock|new wave|britpop|post[\\s-]?punk|psych|grunge|power pop",
}
TOKENS = "list_filter(list_transform(regexp_split_to_array(genre_raw, '[,/]'), lambda t: lower(trim(t))), lambda t: t <> '')"


def has(group):
    if group == "punk":
        return f"len(list_filter({TOKENS}, lambda t: regexp_matches(t, 'punk|noise rock') and not regexp_matches(t, 'post[\\s-]?punk'))) > 0"
    return f"len(list_filter({TOKENS}, lambda t: regexp_matches(t, '{_PRIMARY[group]}'))) > 0"


PRIMARY = "case " + " ".join(f"when {has(g)} then '{g}'" for g in genres.PRIORITY) + " else 'other' end"


@query("c6_genre_breakdown", f"with g as (select coalesce(b.grp, 'other') as grp, count(*) as n from concerts c left join (select band_id, {PRIMARY} as grp from bands) b on b.band_id = c.band_id where attending group by 1) select grp, n, cast(floor(n / (select sum(n) from g) * 100 + 0.5) as bigint) as pct from g")
def stats_genres(spark, d):
    return C.genre_breakdown(attended(spark, d), bands(spark, d), genres.primary_group(F.col("genre_raw")))


@query("c6_longest_setlist", "with n as (select setlist, count(*) as songs from songs group by setlist) select setlist, songs from n order by songs desc, setlist limit 1")
def longest_setlist(spark, d):
    from setlight.sources.standins import songs

    return songs(spark, d).groupBy("setlist").agg(F.count("*").alias("songs")).orderBy(F.desc("songs"), "setlist").limit(1)


@query(
    "c7_c8_alert_batches",
    """with n as (select *, d as found from concerts where d >= date '2001-05-01' and band_id in (select band_id from bands where not muted))
    select band_id, found, count(*) as n, min(d) as first_date, max(d) as last_date, case when count(*) = 1 then min(ord) end as concert, count(*) filter (attending) as attending, case when count(*) = 1 then 'concert' else 'summary' end as kind from n group by 1, 2""",
)
def alerts(spark, d):
    return C.alert_batches(concerts(spark, d).withColumn("found", F.col("d")), bands(spark, d), "2001-05-01")


@query("c9_year_sections", "select ord, year(d) as year, count(*) over (partition by year(d)) as in_year from concerts")
def sections(spark, d):
    return C.year_sections(concerts(spark, d))


IDS = "select band_id, case when band_id % 4 = 0 then null else band_id % 500 end as provider_id, case band_id % 3 when 0 then 'confirmed' when 1 then 'needs_review' else 'no_match' end as status from bands"


def identities(spark, d):
    return bands(spark, d).selectExpr("band_id", "case when band_id % 4 = 0 then null else band_id % 500 end as provider_id", "case band_id % 3 when 0 then 'confirmed' when 1 then 'needs_review' else 'no_match' end as status")


@query(
    "c11_identity_summary",
    "with s as (select case band_id % 9 when 0 then 'auto_confirmed' when 1 then 'manual_confirmed' when 2 then 'needs_review' when 3 then 'no_match' when 4 then 'error' when 5 then 'manual_rejected' when 6 then 'pending' when 7 then 'odd' end as status from bands) select count(*) as total, count(*) filter (status = 'auto_confirmed') as auto_confirmed, count(*) filter (status = 'manual_confirmed') as manual_confirmed, count(*) filter (status = 'needs_review') as awaiting_review, count(*) filter (status = 'no_match') as no_match, count(*) filter (status = 'error') as errors, count(*) filter (status = 'manual_rejected') as manually_rejected, count(*) filter (status is null or status in ('pending', 'odd')) as not_checked_yet from s",
)
def identity_summary(spark, d):
    status = F.get(F.array(*[F.lit(s) for s in (*C.IDENTITY_STATES, "pending", "odd")]), (F.col("band_id") % 9).cast("int"))
    return C.identity_summary(bands(spark, d).select(status.alias("status")), "status")


@query("c11_c12_provider_coverage", f"with i as ({IDS}), m as (select provider_id from i where provider_id is not null group by 1 having count(*) > 1) select status, count(*) as n, count(i.provider_id) as identified, count(m.provider_id) as duplicated from i left join m using (provider_id) group by status")
def coverage(spark, d):
    return C.provider_coverage(identities(spark, d), "status", "provider_id")


@query("c13_duplicate_assignments", f"with i as ({IDS}) select provider_id, count(*) as n, string_agg(cast(band_id as varchar), ',' order by band_id) as rows from i where provider_id is not null group by provider_id having count(*) > 1")
def duplicates(spark, d):
    return C.duplicate_ids(identities(spark, d), "band_id", "provider_id")


@query("l6_l7_my_concerts", f"select ord, band_id, d, d >= {T} as is_upcoming from concerts where attending")
def my_concerts(spark, d):
    return attended(spark, d).select("ord", "band_id", "d", C.upcoming(F.col("d"), TODAY).alias("is_upcoming"))


EUROPE = ", ".join(f"'{c}'" for c in C.EUROPE)
NEAR = "(lower(trim(country)) = 'sweden' and distance_km <= 150) or (lower(trim(country)) = 'denmark' and distance_km <= 80)"


@query(
    "l8_f26_concert_list",
    f"""select ord, coalesce(lower(trim(country)) in ({EUROPE}), false) as europe, coalesce({NEAR}, false) as near from
    (select *, row_number() over (partition by band_id order by attending desc, d nulls last, ord) as rn from concerts where d >= {T}) where rn = 1 and band_id in (select band_id from bands where not muted)
    and (coalesce(lower(trim(country)) in ({EUROPE}), false) or coalesce({NEAR}, false))""",
)
def concert_list(spark, d):
    near = C.nearest_per_band(concerts(spark, d), TODAY).join(bands(spark, d).where("not muted").select("band_id"), "band_id", "left_semi")
    return near.select("ord", C.in_europe(F.col("country")).alias("europe"), C.nearby(F.col("country"), F.col("distance_km")).alias("near")).where("europe or near")


@query("l9_venues_with_match", f"select venue, city, count(*) as n from concerts group by venue, city having bool_or(d >= {T} and coalesce(lower(trim(country)) in ({EUROPE}), false))")
def venues_with(spark, d):
    match = C.upcoming(F.col("d"), TODAY) & C.in_europe(F.col("country"))
    return concerts(spark, d).groupBy("venue", "city").agg(F.count("*").alias("n"), F.bool_or(match).alias("m")).where("m").drop("m")


@query("l10_my_bands", "select band_id, name from bands where not muted and len(list_filter(list_transform(regexp_split_to_array(genre_raw, '[,/]'), lambda t: lower(trim(t))), lambda t: regexp_matches(t, 'rock|new wave|britpop|post[\\s-]?punk|psych|grunge|power pop'))) > 0")
def my_bands(spark, d):
    return bands(spark, d).where("not muted").where(F.array_contains(genres.all_groups(F.col("genre_raw")), "rock")).select("band_id", "name")
