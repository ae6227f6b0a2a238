"""Queries on linking, releases, planning and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from setlight.functions.text import EXCLUDED, GENERIC_VENUE_WORDS, NOT_ALLOWED, UNKNOWN_VENUES
from setlight.operators import concerts as C
from setlight.operators import linking as K
from setlight.operators import planning as P
from setlight.operators import variants as V
from setlight.sources.standins import NOW_MS, bands, concerts, listens, read, releases, songs

from .registry import query

ALIASED = "select band_id, name, [concat('alias', band_id % 400), name] as aliases from bands"


def aliased(spark, d):
    return bands(spark, d).select("band_id", "name", F.array(F.concat(F.lit("alias"), (F.col("band_id") % 400).cast("string")), "name").alias("aliases"))


UNIQUE = f"uniq as (select name, min(band_id) as band_id from (select distinct band_id, unnest(list_append(aliases, name)) as name from ({ALIASED})) group by name having count(distinct band_id) = 1)"


@query("l2_unique_names", f"with {UNIQUE} select * from uniq")
def unique_names(spark, d):
    return K.unique_names(aliased(spark, d))


EVENTS = "select ord, case when ord % 3 = 0 then band_id end as explicit_id, concat('alias', ord % 900) as artist from listens"


@query("l3_s8_mapped_band", f"with {UNIQUE}, e as ({EVENTS}) select ord, explicit_id, artist, case when explicit_id is not null then b.band_id else uniq.band_id end as band_id from e left join bands b on b.band_id = e.explicit_id left join uniq on uniq.name = e.artist")
def mapped(spark, d):
    events = listens(spark, d).select("ord", F.when(F.col("ord") % 3 == 0, F.col("band_id")).alias("explicit_id"), F.concat(F.lit("alias"), (F.col("ord") % 900).cast("string")).alias("artist"))
    return K.mapped_band(events, bands(spark, d), K.unique_names(aliased(spark, d)))


@query("l4_sanitized", "select ord, case when duration_ms > 0 then duration_ms end as duration_ms from listens where trim(recording_title) <> '' and (source <> 'spotify_import' or (track_id is not null and duration_ms >= 30000))")
def sanitized(spark, d):
    rows = listens(spark, d).withColumns({"id": F.col("ord"), "title": F.col("recording_title"), "artist": F.col("band_id").cast("string")})
    return K.sanitized(rows).select("ord", "duration_ms")


@query("s6_first_by_id", "select id, ord from (select ord % 700 as id, ord, row_number() over (partition by ord % 700 order by ord) as rn from listens) where rn = 1")
def first_by_id(spark, d):
    return K.first_valid(listens(spark, d).selectExpr("ord % 700 as id", "ord"), "id", F.asc("ord"))


@query("s7_last_by_id", "select id, ord from (select ord % 700 as id, ord, row_number() over (partition by ord % 700 order by ord desc) as rn from listens) where rn = 1")
def last_by_id(spark, d):
    return K.first_valid(listens(spark, d).selectExpr("ord % 700 as id", "ord"), "id", F.desc("ord"))


META = "select track_id, max(recording_id) as recording_id from listens where track_id is not null and recording_id is not null group by track_id"


@query("l13_metadata_overwrites", f"with m as ({META}) select l.ord, coalesce(m.recording_id, l.recording_id) as recording_id from listens l left join m using (track_id)")
def overwrites(spark, d):
    rows = listens(spark, d)
    meta = rows.where("track_id is not null and recording_id is not null").groupBy("track_id").agg(F.max("recording_id").alias("recording_id"))
    return K.overwrite_from(rows.select("ord", "track_id", "recording_id"), meta, "track_id", ["recording_id"]).select("ord", "recording_id")


@query("l14_l16_fill_missing", f"with m as ({META}) select l.ord, coalesce(l.recording_id, m.recording_id) as recording_id from listens l left join m using (track_id)")
def fills(spark, d):
    rows = listens(spark, d)
    meta = rows.where("track_id is not null and recording_id is not null").groupBy("track_id").agg(F.max("recording_id").alias("recording_id"))
    return K.fill_from(rows.select("ord", "track_id", "recording_id"), meta, "track_id", ["recording_id"]).select("ord", "recording_id")


@query("l15_sibling_identity", "with a as (select track_id, min(recording_id) as r from listens where track_id is not null and recording_id is not null group by 1 having count(distinct recording_id) = 1) select l.ord, coalesce(l.recording_id, a.r) as recording_id from listens l left join a using (track_id)")
def siblings(spark, d):
    return K.fill_from_siblings(listens(spark, d).select("ord", "track_id", "recording_id"), "track_id", "recording_id").select("ord", "recording_id")


CANDS = "cands as (select ord as candidate, case when ord % 5 = 0 then ord end as provider_id, band_id, d, case when ord % 3 = 0 then venue else 99 end as venue, city from concerts where ord % 2 = 0)"


@query(
    "l18_l20_show_matches",
    f"""with {CANDS}, f as (select candidate, 1 as how, s.ord as s from cands join concerts s on s.ord = cands.provider_id
      union all select candidate, 2, s.ord from cands c join concerts s on s.band_id = c.band_id and s.d = c.d and s.venue = c.venue union all select candidate, 3, s.ord from cands c join concerts s on s.band_id = c.band_id and s.d = c.d and s.city = c.city),
    g as (select candidate, how, count(distinct s) as n, min(s) as s from f group by 1, 2), m as (select candidate, min((how, n, s)) as m from g group by 1)
    select candidate, cast(m[1] as bigint) as how, case when m[2] = 1 then m[3] end as show, coalesce(m[2], 0) > 1 as ambiguous from cands left join m using (candidate)""",
)
def shows(spark, d):
    rows = concerts(spark, d)
    cands = rows.where("ord % 2 = 0").selectExpr("ord as candidate", "case when ord % 5 = 0 then ord end as provider_id", "band_id", "d", "case when ord % 3 = 0 then venue else 99 end as venue", "city")
    return K.match_shows(cands, rows.selectExpr("ord as show", "ord as provider_id", "band_id", "d", "venue", "city"))


PLACED = """select ord, band_id % 40 as band_id, year(d) as d, ord % 16 < 6 as is_show, concat('City ', k % 2) as city, case when k % 3 > 0 then country end as country,
  case k % 7 when 0 then 'Royal Arena' when 1 then 'royal  arena, Copenhagen' when 2 then 'Forum' when 3 then 'Arena' when 4 then 'TBA' when 5 then 'Forum Hall' else 'Parken' end as venue,
  case when k % 4 = 0 then concat('Street ', k % 3) end as address, case when k % 6 = 1 then concat('https://t/', k % 5) end as url, case when k % 5 < 2 then concat('tm', k % 30) end as event_id, k % 5 < 3 as ticketmaster
  from (select *, cast(floor(ord * 37 / 11) as bigint) as k from concerts)"""


def plain_sql(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"


def same_venue_sql(a: str, b: str) -> str:
    """F29 of two normalised names; the one with fewer words, or the first of equals, has to be inside the other."""
    generic = "['" + "', '".join(GENERIC_VENUE_WORDS) + "']"
    words = lambda x: f"len(string_split({x}, ' '))"
    inside = lambda x, y: f"(len(list_filter(string_split({x}, ' '), lambda w: not list_contains({generic}, w))) > 0 and contains(' ' || {y} || ' ', ' ' || {x} || ' '))"
    return f"({a} <> '' and {b} <> '' and ({a} = {b} or case when {words(a)} <= {words(b)} then {inside(a, b)} else {inside(b, a)} end))"


PLACE = "r.n_city <> '' and r.n_city = c.n_city and not (r.n_country <> '' and c.n_country <> '' and r.n_country <> c.n_country)"
UNKNOWN = "('', '" + "', '".join(UNKNOWN_VENUES) + "')"


@query(
    "l19_reconcile",
    f"""with recursive pl as ({PLACED}), cs as (select ord, band_id, d, is_show, {{'id': case when is_show then 's' else 'c' end || ord, 'n_city': {plain_sql("city")}, 'n_country': {plain_sql("country")}, 'n_venue': {plain_sql("venue")}, 'n_address': {plain_sql("address")}, 'url': coalesce(url, ''), 'event': coalesce(event_id, ''), 'tm': ticketmaster}} as c from pl),
    todo as (select *, row_number() over (partition by band_id, d order by ord) as rn from cs where not is_show),
    st as (
      select band_id, d, 0 as k, list(c order by ord) filter (is_show) as recs, null::varchar as candidate, null::varchar as action, null::varchar as "show", null::varchar as how, false as ambiguous from cs group by band_id, d
      union all
      select band_id, d, k, case action when 'add' then list_append(recs, c) when 'upgrade' then list_transform(recs, lambda r: case when r.id <> found[1].id then r
          when how = 'trusted_venue_evidence' then struct_update(r, n_venue := c.n_venue)
          else {{'id': r.id, 'n_city': case when c.n_city <> '' then c.n_city else r.n_city end, 'n_country': case when c.n_country <> '' then c.n_country else r.n_country end, 'n_venue': case when c.n_venue = '' or (c.n_venue in {UNKNOWN} and r.n_venue not in {UNKNOWN}) then r.n_venue else c.n_venue end,
            'n_address': case when c.n_address <> '' then c.n_address else r.n_address end, 'url': case when c.url <> '' then c.url else r.url end, 'event': case when c.event <> '' then c.event else r.event end, 'tm': true}} end) else recs end,
        c.id, action, case when action in ('upgrade', 'skip_ticketmaster_duplicate') then found[1].id end, case when action in ('upgrade', 'skip_ticketmaster_duplicate') then how end, c.tm and len(found) > 1
      from (select *, case when len(found) = 1 then case when c.tm then 'upgrade' else 'skip_ticketmaster_duplicate' end when c.tm and len(found) > 1 then 'add'
          when len(list_filter(recs, lambda r: {PLACE} and r.n_venue <> '' and r.n_venue = c.n_venue and not (r.event <> '' and c.event <> '' and r.event <> c.event))) > 0 then 'skip_duplicate' else 'add' end as action
        from (select *, case when len(exact) > 0 then exact when len(recovered) > 0 then recovered else located end as found, case when len(exact) > 0 then 'provider_event_id' when len(recovered) > 0 then 'trusted_venue_evidence' else 'same_show' end as how
          from (select st.band_id, st.d, st.k + 1 as k, coalesce(recs, []) as recs, todo.c,
              list_filter(coalesce(recs, []), lambda r: c.event <> '' and r.event = c.event) as exact,
              list_filter(coalesce(recs, []), lambda r: c.tm and {PLACE} and r.n_venue in {UNKNOWN} and c.n_venue not in {UNKNOWN} and not (r.event <> '' and c.event <> '' and r.event <> c.event) and ((c.n_address <> '' and c.n_address = r.n_address) or (c.url <> '' and c.url = r.url))) as recovered,
              list_filter(coalesce(recs, []), lambda r: (c.tm or r.tm) and not (c.event <> '' and r.event <> '') and {PLACE} and {same_venue_sql("r.n_venue", "c.n_venue")}) as located
            from st join todo on todo.band_id = st.band_id and todo.d = st.d and todo.rn = st.k + 1))))
    select candidate, action, "show", how, ambiguous from st where candidate is not null""",
)
def reconcile(spark, d):
    concerts(spark, d).createOrReplaceTempView("concerts")
    rows = spark.sql(PLACED).withColumn("id", F.concat(F.when(F.col("is_show"), "s").otherwise("c"), F.col("ord").cast("string")))
    return K.reconcile(rows.where("not is_show"), rows.where("is_show"), decompose=False)


@query("l21_l24_agreed_values", "select ord % 4000 as k, min(recording_id) as recording_id from listens where recording_id is not null group by 1 having count(distinct recording_id) = 1")
def agreed(spark, d):
    return K.agreed(listens(spark, d).selectExpr("ord % 4000 as k", "recording_id"), "k", "recording_id")


DAY = 86_400_000


@query(
    "a24_identity_audit",
    f"""with i as (select band_id, count(*) as listens, count(*) filter (ms >= {NOW_MS - 14 * DAY}) as two_weeks, count(*) filter (ms >= {NOW_MS - 91 * DAY}) as three_months, count(*) filter (ms >= {NOW_MS - 365 * DAY}) as one_year, count(distinct track_id) as tracks, min(ms) as first_ms, max(ms) as last_ms from listens group by band_id)
    select b.band_id, coalesce(listens, 0) as listens, coalesce(two_weeks, 0) as two_weeks, coalesce(three_months, 0) as three_months, coalesce(one_year, 0) as one_year, coalesce(tracks, 0) as tracks, first_ms, last_ms from bands b left join i using (band_id)""".replace("i as (select", "i as (select"),
)
def identity_audit(spark, d):
    return K.identity_audit(bands(spark, d), listens(spark, d), NOW_MS)


ALBUM_LISTENS = "select ord, ms, band_id, concat('Album ', ord % 4) as release_title, case when ord % 499 = 0 then 'sAny' when ord % 97 = 0 then concat('s', band_id) when ord % 5 < 4 then concat('s', band_id, '-', ord % 4, '-', ord % 3) end as track_id from listens"
KNOWN = "select track_id, case when b % 4 = 0 then concat('al', b % 50) when b % 4 = 1 then concat('al', b, '-', n % 2) end as album_id, case when b % 3 > 0 then concat('http://', b) end as artwork, case when b % 6 = 2 then concat('n', n % 2) end as neutral_artwork from (select track_id, min(band_id) as b, count(*) as n from lt where track_id is not null group by track_id) t"
GROUPS = f"""lt as ({ALBUM_LISTENS}), kn as ({KNOWN}), tk as (select band_id, lower(trim(release_title)) as release, track_id, count(*) as n, max(ms) as ms from lt where track_id is not null and release_title is not null group by 1, 2, 3), x as (select track_id, count(*) > 1 as crosses from tk group by 1),
  gr as (select band_id, release, count(*) as tracks, cast(sum(n) as bigint) as listens, max(ms) as latest_ms, bool_or(crosses) as c, count(distinct album_id) > 1 as i, count(distinct neutral_artwork) > 1 as a, min(album_id) as al, min(artwork) filter (album_id is not null) as art, coalesce(min(track_id) filter (album_id is not null), min(track_id)) as rep from tk join x using (track_id) left join kn using (track_id) group by 1, 2),
  grp as (select band_id, release, tracks, listens, latest_ms, case when c then 'spotify_track_crosses_album_groups' when i then 'conflicting_known_spotify_album_ids' when a then 'conflicting_neutral_artwork' end as ambiguous, case when not c and not i and not a then al end as album_id, case when not c and not i and not a then art end as artwork, case when not c and not i and not a then rep end as representative from gr)"""


def album_rows(spark, d):
    rows = listens(spark, d)
    rows.createOrReplaceTempView("listens")
    spark.sql(ALBUM_LISTENS).createOrReplaceTempView("lt")
    return spark.table("lt"), spark.sql(KNOWN)


@query("a26_x7_album_groups", f"with {GROUPS} select * from grp")
def album_groups(spark, d):
    return K.album_groups(*album_rows(spark, d))


@query("a27_artwork_plan", f"with {GROUPS} select band_id, release, representative, case when album_id is not null and artwork is not null then 'reusable' when band_id % 4 = 3 and release like 'album%' then 'suppressed' else 'provider' end as way from grp where ambiguous is null")
def artwork(spark, d):
    groups = K.album_groups(*album_rows(spark, d))
    return K.artwork_plan(groups, groups.where("band_id % 4 = 3 and release like 'album%'"))


@query("x8_one_track_per_group", f"with {GROUPS} select distinct representative from grp where ambiguous is null and album_id is null")
def one_track(spark, d):
    """One track for each safe group without an album id."""
    return K.album_groups(*album_rows(spark, d)).where("ambiguous is null and album_id is null").select("representative").distinct()


@query("x1_artwork_coverage", "with p as (select bool_or(recording_id is not null) as c from listens group by band_id, release_title) select count(*) as albums, count(*) filter (c) as matched, cast(floor(count(*) filter (c) / count(*) * 100 + 0.5) as bigint) as percent from p")
def art_coverage(spark, d):
    return K.artwork_coverage(listens(spark, d))


@query("x12_x17_unresolved", "select distinct track_id from listens where track_id is not null and track_id not in (select track_id from listens where track_id is not null and ord % 100 = 0)")
def unresolved(spark, d):
    rows = listens(spark, d)
    return K.unresolved(rows, rows.where("track_id is not null and ord % 100 = 0").select("track_id").distinct())


# --- releases -----------------------------------------------------------------------------------

TODAY = "2024-02-01"
BAD = EXCLUDED
STAGED = """select release_id, band_id, title, type, release_date, provider_id, case when release_id % 6 <> 0 then concat('http://', release_id) end as url, case when release_id % 2 = 0 then concat('mb', release_id) end as mbid, concat(band_id, '|', title) as dedup, release_id % 10 <> 9 as eligible,
  case when release_id % 4 = 0 then date '2024-01-25' when release_id % 4 = 1 then date '2023-12-01' end as prior_album_announced, case when release_id % 7 = 0 then date '2024-01-01' end as prior_new_single, case when release_id % 13 = 0 then date '2024-01-01' end as prior_upcoming_release, case when release_id % 29 = 0 then date '2024-01-01' end as prior_out_today from releases"""
ST = f"""sd as ({STAGED}), st as (select *, unnest(list_filter([case when good and long and prior_album_announced is null then 'album_announced' end, case when good and type = 'Single' and provider_id is not null and url is not null and prior_new_single is null then 'new_single' end,
  case when good and long and release_date - date '{TODAY}' = 7 and prior_upcoming_release is null and not coalesce(date '{TODAY}' - prior_album_announced < 14, false) then 'upcoming_release' end, case when good and long and release_date = date '{TODAY}' and prior_out_today is null then 'out_today' end], lambda x: x is not null)) as stage
  from (select *, type in ('Album', 'EP') as long, type in ('Album', 'EP', 'Single') and not regexp_matches(lower(title), '{BAD}') as good from sd))"""


def staged(spark, d):
    releases(spark, d).createOrReplaceTempView("releases")
    return spark.sql(STAGED).withColumnRenamed("dedup", "key")


@query("r2_release_stages", f"with {ST} select release_id, band_id, stage from st")
def release_stages(spark, d):
    return staged(spark, d).select("release_id", "band_id", F.explode(P.stages(TODAY)).alias("stage"))


SLUGS = "concat('release-', band_id, '-', replace(stage, '_', '-'), '-', trim(regexp_replace(lower(case when mbid is not null then concat('mbid:', mbid, ':', type) when provider_id is not null then concat('spotify:', provider_id, ':', type) else concat(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), ':', coalesce(cast(release_date as varchar), ''), ':', type) end), '[^a-z0-9]+', '-', 'g'), '-'))"
ALERTS = "select release_id as ord, band_id, case when release_id % 5 = 0 then concat('release-', band_id, '-new-single-spotify-', coalesce(provider_id, ''), '-single') else concat('old-', release_id) end as alert_id, case when release_id % 3 = 1 then mbid end as mbid, case when release_id % 8 = 3 then provider_id end as provider_id, case when release_id % 8 = 5 then dedup end as key from sd where release_id % 3 <> 2"


@query(
    "r3_lifecycle_alerts",
    f"""with {ST}, al as ({ALERTS}), du as (select *, {SLUGS} as new_id from st where eligible), f as (select release_id, stage, ord, alert_id from du join al on al.band_id = du.band_id and (al.alert_id = new_id or (stage = 'album_announced' and (al.mbid = du.mbid or al.provider_id = du.provider_id or al.key = du.dedup)))),
    o as (select release_id, stage, arg_min(alert_id, ord) as old_id from f group by 1, 2)
    select du.release_id, band_id, du.stage, case when old_id is not null then 'enrich' else 'create' end as action, coalesce(old_id, new_id) as alert_id from du left join o on o.release_id = du.release_id and o.stage = du.stage union all select release_id, band_id, null, 'skip', null from sd where not eligible""",
)
def lifecycle(spark, d):
    rows = staged(spark, d)
    rows.withColumnRenamed("key", "dedup").createOrReplaceTempView("sd")
    return P.lifecycle_alerts(rows, spark.sql(ALERTS), TODAY)


@query("r1_feed_cleanup", "select type, count(*) filter (ok) as kept, count(*) filter (not ok) as removed from (select type, release_date is not null and type <> 'Broadcast' as ok from releases) group by type")
def cleanup(spark, d):
    return P.feed_cleanup(releases(spark, d), F.expr("release_date is not null and type <> 'Broadcast'"))


@query(
    "r4_availability_alerts",
    f"select release_id, case when provider_id is null then 'unavailable' when release_id % 4 = 0 then 'known' when release_date is null then 'undated' when date '{TODAY}' - release_date < 0 then 'future' when date '{TODAY}' - release_date <= 14 then 'alert' else 'catch_up' end as decision from releases",
)
def availability(spark, d):
    rows = releases(spark, d)
    return P.availability_alerts(rows, rows.where("release_id % 4 = 0"), TODAY, 14)


OBS = """select release_id as ord, release_id % 40 as band_id, case when release_id % 5 < 2 then 'MusicBrainz' else 'Spotify' end as source,
  concat(case k % 3 when 0 then 'Blue' when 1 then 'blue!' else 'Red' end, case k % 7 when 0 then ' (Deluxe Edition)' when 1 then ' [2010 Edition]' else '' end) as title, case k % 2 when 0 then 'Album' else 'Single' end as type,
  case k % 4 when 0 then '2024-01-05' when 1 then '2024-01' when 2 then '2024-01-05' end as release_date, case k % 4 when 0 then 'day' when 1 then 'month' when 2 then 'day' end as precision,
  case when release_id % 5 < 2 then concat('g', k % 9) end as mbid, case when release_id % 5 >= 2 then concat('sp', release_id) end as provider_id, case when release_id % 10 >= 4 and release_id % 5 >= 2 then concat('http://', release_id) end as url,
  case when k % 11 = 0 then 'b,a' else 'a' end as artists, cast(release_id % 100 as bigint) as first_seen from (select *, cast(floor(release_id * 13 / 7) as bigint) as k from releases)"""
FOLD = "trim(regexp_replace(lower(regexp_replace(title, '\\s*[\\[(](?:deluxe|expanded|anniversary|remaster(?:ed)?|reissue|clean|explicit|\\d{{4}}\\s+edition)[^\\])]*[\\])]\\s*$', '', 'i')), '[^a-z0-9]+', ' ', 'g'))".replace("{{4}}", "{4}")
SAME = "r.canonical = o.canonical and r.type = o.type and r.release_date is not distinct from o.release_date and r.precision is not distinct from o.precision"


@query(
    "r5_merged_releases",
    f"""with recursive ob as ({OBS}), fo as (select *, {FOLD} as canonical, array_to_string(list_sort(string_split(artists, ',')), ',') as credited from ob),
    todo as (select band_id, row_number() over (partition by band_id order by ord) as rn, source, {{'key': coalesce('mbid:' || mbid, 'spotify:' || band_id || '|' || canonical || '|' || lower(type) || '|' || coalesce(release_date, '') || '|' || coalesce(precision, '') || '|' || credited), 'canonical': canonical, 'title': title, 'type': type, 'release_date': release_date, 'precision': precision,
      'provider_id': provider_id, 'url': url, 'mbid': mbid, 'first_seen': first_seen, 'sources': [source]}} as o from fo),
    st as (
      select distinct band_id, 0 as k, [] :: struct(key varchar, canonical varchar, title varchar, type varchar, release_date varchar, precision varchar, provider_id varchar, url varchar, mbid varchar, first_seen bigint, sources varchar[])[] as rels from todo
      union all
      select band_id, k, case when hit is null then list_append(rels, o) else list_transform(rels, lambda r: case when r.key <> hit then r else {{'key': r.key, 'canonical': o.canonical, 'title': o.title, 'type': o.type, 'release_date': o.release_date, 'precision': o.precision,
        'provider_id': case when source = 'Spotify' then o.provider_id else r.provider_id end, 'url': case when source = 'Spotify' then o.url else r.url end, 'mbid': coalesce(r.mbid, o.mbid), 'first_seen': case when r.first_seen <> 0 then r.first_seen else o.first_seen end,
        'sources': case when list_contains(r.sources, source) then r.sources else list_append(r.sources, source) end}} end) end
      from (select *, coalesce(list_filter(rels, lambda r: {SAME})[1].key, list_filter(rels, lambda r: r.key = o.key)[1].key) as hit from (select st.band_id, st.k + 1 as k, rels, o, source from st join todo on todo.band_id = st.band_id and todo.rn = st.k + 1))),
    fin as (select band_id, arg_max(rels, k) as rels from st group by band_id), fl as (select band_id, unnest(rels) as r, generate_subscripts(rels, 1) - 1 as place from fin)
    select band_id, cast(place as bigint) as place, r.title, r.type, r.release_date, r.precision, r.provider_id, r.url, r.mbid, r.first_seen, array_to_string(r.sources, ',') as sources from fl""",
)
def merged(spark, d):
    releases(spark, d).createOrReplaceTempView("releases")
    rows = spark.sql(OBS).withColumn("artists", F.split("artists", ","))
    return P.merged_releases(rows, decompose=False).withColumn("sources", F.array_join("sources", ","))


@query("r6_m4_upsert", "select coalesce(a.release_id, b.release_id) as release_id, coalesce(b.provider_id, a.provider_id) as provider_id, coalesce(b.title, a.title) as title from (select * from releases where release_id % 3 <> 1) a full join (select release_id, provider_id, upper(title) as title from releases where release_id % 2 = 0) b on a.release_id = b.release_id")
def upsert(spark, d):
    rows = releases(spark, d)
    return P.upsert(rows.where("release_id % 3 <> 1"), rows.where("release_id % 2 = 0").withColumn("title", F.upper("title")), "release_id", ["provider_id", "title"])


@query("r7_r8_unseen", "select release_id from releases where release_id % 2 = 1 and title not in (select title from releases where release_id % 10 = 0)")
def unseen(spark, d):
    rows = releases(spark, d)
    base = rows.where("release_id % 2 = 0").select("release_id", F.when(F.col("release_id") % 10 == 0, F.col("title")).alias("title"))
    return P.unseen(rows, base, ["release_id", "title"]).select("release_id")


@query("r9_release_list", f"select release_id, release_date from releases where release_date is not null and type <> 'Broadcast' and band_id in (select band_id from bands where not muted)")
def release_list(spark, d):
    """Valid releases of unmuted bands."""
    return releases(spark, d).where("release_date is not null and type <> 'Broadcast'").join(bands(spark, d).where("not muted").select("band_id"), "band_id", "left_semi").select("release_id", "release_date")


NEWS = "select release_id, band_id, title, type, case when release_date is not null then case when release_id % 19 = 0 then substr(cast(release_date as varchar), 1, 7) else cast(release_date as varchar) end end as release_day, release_date as d from releases"


def news_rows(spark, d):
    releases(spark, d).createOrReplaceTempView("releases")
    return spark.sql(NEWS.replace("varchar", "string"))


@query("r10_structured_news", f"select release_id, band_id, 'New ' || lower(type) || ': ' || title as headline, try_cast(release_day as date) as d from ({NEWS}) where type in ('Album', 'EP', 'Single') and not regexp_matches(title, '{NOT_ALLOWED[4:]}', 'i') and (release_day is null or (length(release_day) = 10 and date '{TODAY}' - d <= 14))")
def news(spark, d):
    return P.structured_news(news_rows(spark, d), TODAY)


@query("x28_fresh_news", f"select release_id, title from releases where release_date is null or date '{TODAY}' - release_date <= 14")
def fresh(spark, d):
    return P.fresh_news(news_rows(spark, d), TODAY).select("release_id", "title")


@query("x29_first_of_key", "with n as (select release_id as ord, concat_ws('|', cast(band_id % 20 as varchar), type, lower(split_part(title, ' ', 1))) as key from releases) select key, min(ord) as ord from n where ord >= 100 and key not in (select key from n where ord < 100) group by key")
def first_news(spark, d):
    rows = releases(spark, d).selectExpr("release_id as ord", "band_id % 20 as band_id", "type as category", "split_part(title, ' ', 1) as headline")
    return P.first_of_key(rows.where("ord >= 100"), rows.where("ord < 100"))


@query("l11_news_list", "select release_id, band_id % 50 as band_id, row_number() over (order by release_date desc nulls last, release_id) as place from releases")
def news_list(spark, d):
    rows = releases(spark, d).selectExpr("release_id as ord", "band_id % 50 as band_id", "release_date as found")
    return P.news_list(rows).select(F.col("ord").alias("release_id"), "band_id", "place")


@query(
    "l11_alert_list",
    """with n as (select band_id, d as found, count(*) as n, case when count(*) = 1 then 'concert' else 'summary' end as kind from concerts where d >= date '2001-07-01' - 90 and band_id in (select band_id from bands where not muted) group by 1, 2)
    select *, row_number() over (order by found desc, band_id) as place from n""",
)
def alert_list(spark, d):
    return C.alert_list(concerts(spark, d).withColumn("found", F.col("d")), bands(spark, d), "2001-07-01").select("band_id", "found", "n", "kind", "place")


# --- planning -----------------------------------------------------------------------------------

TASKS = "select band_id, kind, cast((band_id + k) % 3 as bigint) as priority, date '2024-01-01' + cast((band_id * 7 + k) % 30 as integer) as due, cast(band_id % 13 as bigint) as activity from bands, (values (0, 'metadata'), (1, 'release')) v(k, kind) where (band_id + k) % 4 <> 0"


@query(
    "w1_w2_fair_plan",
    f"with r as (select *, row_number() over (partition by band_id order by priority, due, activity, kind) - 1 as round from ({TASKS})), t as (select * from r order by priority, round, due, activity, band_id, kind limit 200) select *, row_number() over (order by priority, round, due, activity, band_id, kind) as place from t",
)
def fair(spark, d):
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("metadata").alias("kind")), F.struct(F.lit(1).alias("k"), F.lit("release").alias("kind"))))
    rows = bands(spark, d).select("band_id", kinds.alias("v")).selectExpr("band_id", "v.kind", "v.k").where("(band_id + k) % 4 <> 0")
    tasks = rows.selectExpr("band_id", "kind", "(band_id + k) % 3 as priority", "date_add(date '2024-01-01', cast((band_id * 7 + k) % 30 as int)) as due", "band_id % 13 as activity")
    return P.fair_pick(tasks, 200)


DAYS = "cast(86400000 as bigint)"
CHECKED = f"select band_id, band_id % 5 as empty, case when band_id % 6 <> 0 then {NOW_MS} - (band_id % 90) * {DAYS} end as checked_ms, case when band_id % 4 <> 0 then {NOW_MS} + (band_id % 60 - 40) * {DAYS} end as next_ms, case when band_id % 3 = 0 then {NOW_MS} - 100 * {DAYS} end as found_ms from bands"
SHOWN = f"select band_id, {NOW_MS} - (ord % 400) * {DAYS} as at_ms from concerts where ord % 3 = 0"
STATES = f"""ck as ({CHECKED}), sh as (select band_id, max(at_ms) as t from ({SHOWN}) group by 1), sx as (select band_id, checked_ms, coalesce(found_ms, t) as found_ms, t is not null and (checked_ms is null or t > checked_ms) as reset, empty as e, next_ms as n, t from ck left join sh using (band_id)),
  sy as (select *, case when reset then 0 else e end as empty, case when reset then t + 28 * {DAYS} else n end as next_ms from sx)"""


def checked(spark, d):
    bands(spark, d).createOrReplaceTempView("bands")
    concerts(spark, d).createOrReplaceTempView("concerts")
    return spark.sql(CHECKED), spark.sql(SHOWN)


@query(
    "w3_w4_due_bands",
    f"with {STATES} select band_id, case when checked_ms is null then 'first_concert_web_check' when reset then 'ticketmaster_activity_reset' when empty = 0 then 'supplemental_concert_check' else 'inactive_backoff_due' end as reason, case when checked_ms is null then 0 when reset then 1 when empty = 0 then 2 else 3 end as priority, empty from sy where checked_ms is null or next_ms is null or next_ms <= {NOW_MS}",
)
def due(spark, d):
    return P.due_bands(*checked(spark, d), NOW_MS)


@query(
    "w4_next_state",
    f"""with {STATES}, nx as (select *, band_id % 7 = 0 as hit, least(3, empty + 1) as k from sy)
    select band_id, case when hit then 0 else k end as empty, {NOW_MS} + case when hit then 28 else 30 * k end * {DAYS} as next_ms, case when hit then {NOW_MS} else found_ms end as found_ms, case when hit then 'concerts_found' else 'no_concerts_found' end as result from nx""",
)
def after_look(spark, d):
    return P.next_state(*checked(spark, d), F.col("band_id") % 7 == 0, NOW_MS)


LOOKED = f"""select band_id, case when band_id % 5 = 0 then ' ' when band_id % 5 <> 1 then concat('Band ', band_id) end as artist_name, case when band_id % 4 <> 0 then {NOW_MS} - (band_id % 100) * {DAYS} end as success_ms, case when band_id % 3 = 0 then {NOW_MS} - (band_id % 50) * {DAYS} end as attempt_ms,
  case when band_id % 7 < 3 then {NOW_MS} + (band_id % 21 - 10) * {DAYS} end as next_ms, band_id % 11 < 4 as failed, case when band_id % 6 = 0 then 'complete' when band_id % 6 = 1 then 'running' when band_id % 6 = 2 then 'not_started' when band_id % 6 < 5 then 'complete' end as status, band_id % 13 = 0 as continues from bands"""


@query(
    "w2_tasks",
    f"""with lk as ({LOOKED}), m as (select *, coalesce(trim(artist_name), '') <> '' as named from lk),
    n as (select *, case when not named then coalesce(next_ms, attempt_ms, 0) when next_ms is not null then next_ms when success_ms is null then 0 else success_ms + 30 * {DAYS} end as due_ms from m),
    u as (select *, coalesce(status, 'not_started') <> 'complete' or continues as open, case when success_ms is null then 0 else success_ms + 14 * {DAYS} end as kept from lk), v as (select *, case when open then coalesce(next_ms, attempt_ms, success_ms, 0) when next_ms is null then kept else greatest(kept, next_ms) end as due_ms from u)
    select band_id, 'metadata' as kind, case when not named then 0 when next_ms is not null then case when failed then 0 else 1 end when success_ms is null then 0 else 1 end as priority, due_ms,
      case when not named then case when failed then 'metadata_retry_due' else 'metadata_bootstrap' end when next_ms is not null then case when failed then 'metadata_retry_due' else 'metadata_retained_due' end when success_ms is null then 'metadata_bootstrap' else 'metadata_retained_due' end as reason
    from n where case when not named then next_ms is null or next_ms <= {NOW_MS} else due_ms <= {NOW_MS} end
    union all select band_id, 'release', case when open then 0 else 1 end, due_ms, case when not open then 'release_retained_due' when coalesce(status, 'not_started') = 'not_started' then 'release_bootstrap' else 'release_continuation_or_retry' end from v where due_ms <= {NOW_MS}""",
)
def tasks(spark, d):
    bands(spark, d).createOrReplaceTempView("bands")
    rows = spark.sql(LOOKED)
    return P.metadata_tasks(rows, NOW_MS, 30).unionByName(P.release_tasks(rows, NOW_MS, 14))


IMAGES = f"""select b.band_id, b.band_id % 9 = 0 as has_image, b.band_id % 31 = 0 as duplicate, case when b.band_id % 3 <> 0 then concat('a', b.band_id) end as spotify_id, b.band_id % 2 = 0 as eligible, case when b.band_id % 5 = 0 then concat('a', b.band_id) when b.band_id % 5 = 1 then 'other' end as identity_id,
  case when b.band_id % 10 = 0 then {NOW_MS} + 1 when b.band_id % 10 = 5 then {NOW_MS} - 1 end as next_ms, case when n is null then 'noHistory' when b.band_id % 4 = 0 then 'threeMonths' when b.band_id % 4 = 1 then 'oneYear' when b.band_id % 4 = 2 then 'allTime' when b.band_id % 8 = 3 then 'fourteenDays' end as bucket,
  coalesce(n, 0) as listens, case when n is not null then b.band_id % 17 end as rank, {NOW_MS} as now_ms from bands b left join (select band_id, count(*) as n from listens group by band_id) l on l.band_id = b.band_id"""


@query(
    "w5_image_maintenance",
    f"""with im as ({IMAGES}), k as (select * from im where not has_image and not duplicate and case when spotify_id is null then eligible else identity_id is null or identity_id <> spotify_id or next_ms is null or next_ms <= now_ms end),
    r as (select band_id, spotify_id, row_number() over (order by coalesce(list_position(['fourteenDays', 'threeMonths', 'oneYear', 'allTime', 'noHistory'], bucket), 5), spotify_id is null, listens desc, rank nulls last, cast(band_id as varchar)) as place from k) select * from r where place <= 10""",
)
def images(spark, d):
    bands(spark, d).createOrReplaceTempView("bands")
    listens(spark, d).createOrReplaceTempView("listens")
    return P.image_maintenance(spark.sql(IMAGES), 10)


@query("w7_m7_page", "select band_id from (select band_id, 0 as w from bands where band_id > 1400 union all select band_id, 1 from bands where band_id <= 1400) order by w, band_id limit 150")
def page(spark, d):
    return P.page_after(bands(spark, d).select("band_id"), "band_id", 1400, 150)


@query("w10_rotation", "select band_id, (band_id - 37 + 5000) % 5000 as place from bands")
def rotation(spark, d):
    return P.rotated(bands(spark, d).select("band_id"), "band_id", 37, 5000)


@query("w11_x30_trailing_sum", "select ord, cast(sum(coalesce(duration_ms, 0)) over (partition by band_id order by ms range between 86400000 preceding and current row) as bigint) as used from listens")
def trailing(spark, d):
    rows = listens(spark, d).select("ord", "ms", "band_id", F.coalesce("duration_ms", F.lit(0)).alias("tokens"))
    return P.trailing_sum(rows, "ms", "tokens", DAY, "band_id").select("ord", "used")


@query("x30_remaining_budget", f"select band_id, cast(sum(n) as bigint) as reserved, greatest(0, 40 - sum(n))::bigint as remaining from (select band_id, ms, ord % 25 as n from listens) where ms > {NOW_MS} - {DAYS} and ms <= {NOW_MS} group by band_id")
def budget(spark, d):
    rows = listens(spark, d).where(F.col("ms") <= NOW_MS).selectExpr("band_id", "ms as at_ms", "ord % 25 as n")  # as in the SQL; the operator refuses later ones
    return P.remaining_budget(rows, "band_id", NOW_MS, 40)


@query("x15_backfill_plan", "select distinct track_id as id from listens where track_id is not null and track_id not in (select track_id from listens where track_id is not null and ord % 100 = 0) and track_id not in (select track_id from listens where track_id is not null and ord % 100 = 4) order by 1 limit 20")
def backfill(spark, d):
    rows = listens(spark, d).where("track_id is not null").selectExpr("ord", "track_id as id")
    return P.backfill_plan(rows, rows.where("ord % 100 = 0"), rows.where("ord % 100 = 4"), 20)


REPORTS = """select cast(floor(ord / 3) as bigint) as run, ord, case ord % 9 when 0 then 'Partial' when 1 then 'FAILED' when 2 then null when 3 then 'odd' else ' healthy ' end as status, case when ord % 4 <> 0 then (ord % 50 - 2) / 2.0 end as work, case when ord % 5 = 0 then ord % 7 end as changes, case when ord % 6 = 0 then concat(' line', chr(10), 'two ', ord) end as reason from listens"""


@query(
    "w12_merged_activity",
    f"""with rp as ({REPORTS}), s as (select *, lower(trim(coalesce(status, ''))) as l from rp)
    select run, case when bool_or(l in ('error', 'failed', 'failure')) then 'error' when bool_or(l in ('attention', 'partial', 'deferred', 'warning', 'needs_attention')) then 'attention' else 'ok' end as status, cast(floor(arg_max(work, ord) filter (work >= 0)) as bigint) as work,
      cast(arg_max(changes, ord) filter (changes >= 0) as bigint) as changes, trim(regexp_replace(arg_max(reason, ord) filter (reason is not null), '[\r\n\t]+', ' ', 'g')) as reason from s group by run""",
)
def activity(spark, d):
    listens(spark, d).createOrReplaceTempView("listens")
    return P.merged_activity(spark.sql(REPORTS), "run")


@query("w13_top_candidates", "select venue, band_id from (select venue, band_id, row_number() over (partition by venue order by max(price_cents) desc nulls last, count(*) desc, band_id) as rn from concerts group by venue, band_id) where rn <= 5")
def top_candidates(spark, d):
    """The best five for each search."""
    from pyspark.sql import Window as W

    sums = concerts(spark, d).groupBy("venue", "band_id").agg(F.max("price_cents").alias("p"), F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("venue").orderBy(F.desc_nulls_last("p"), F.desc("n"), "band_id"))
    return sums.withColumn("rn", rank).where("rn <= 5").select("venue", "band_id")


# --- merging ------------------------------------------------------------------------------------


def versions(spark, d):
    base = releases(spark, d).selectExpr("release_id as id", "title as a", "brand as b")
    mine = base.where("id % 7 <> 0").selectExpr("id", "case when id % 3 = 0 then concat(a, '!') else a end as a", "case when id % 5 = 0 then null else b end as b")
    theirs = base.where("id % 11 <> 0").selectExpr("id", "case when id % 2 = 0 then upper(a) else a end as a", "b")
    return base, mine, theirs


VERSIONS = "base as (select release_id as id, title as a, brand as b from releases), mine as (select id, case when id % 3 = 0 then concat(a, '!') else a end as a, case when id % 5 = 0 then null else b end as b from base where id % 7 <> 0), theirs as (select id, case when id % 2 = 0 then upper(a) else a end as a, b from base where id % 11 <> 0)"


@query(
    "m1_m2_s3_three_way_merge",
    f"""with {VERSIONS}, f as (select coalesce(base.id, mine.id, theirs.id) as id, base.id is not null as o, base.a as ba, base.b as bb, mine.id is not null as m, mine.a as ma, mine.b as mb, theirs.id is not null as t, theirs.a as ta, theirs.b as tb from base full join mine using (id) full join theirs using (id))
    select id, case when not m then ta when not t then ma when ma is not distinct from ba then ta else ma end as a, case when not m then tb when not t then mb when mb is not distinct from bb then tb else mb end as b
    from f where m or (t and (ta is distinct from ba or tb is distinct from bb))""",
)
def three_way(spark, d):
    return P.three_way(*versions(spark, d), "id", ["a", "b"])


#: Three versions of documents as columns; what is null a document does not have.
DOCS = """select release_id as id, title as ba, cast(release_id % 5 as bigint) as bn, cast(release_id % 2 as bigint) as bs, release_id % 7 <> 0 as m, case when release_id % 3 = 0 then concat(title, '!') else title end as ma, cast(case when release_id % 4 = 0 then release_id % 5 + 1 else release_id % 5 end as bigint) as mn,
  cast(case when release_id % 5 <> 0 then release_id % 2 end as bigint) as ms, case when release_id % 6 = 0 then 'mine' end as mx, release_id % 13 <> 0 as t, case when release_id % 2 = 0 then upper(title) else title end as ta, cast(case when release_id % 8 = 0 then 7 else release_id % 5 end as bigint) as tn,
  cast(case when release_id % 10 = 0 then 9 else release_id % 2 end as bigint) as ts, case when release_id % 3 = 0 then 'y' else 'x' end as tw, case when release_id % 4 = 1 then release_id end as tx from releases"""


def text_sql(a: str, n: str, s: str, w: str, x: str, y: str) -> str:
    """A document's JSON with sorted keys."""
    inner = f"'\"keep\":{{\"n\":' || {n} || ',\"who\":\"' || {w} || '\"}}' || coalesce(',\"seen\":' || {s}, '')"
    return f"'{{\"a\":' || to_json({a}) || ',\"future\":{{' || {inner} || '}}' || coalesce(',\"mine\":\"' || {x} || '\"', '') || coalesce(',\"theirs\":[' || {y} || ',null]', '') || '}}'"


@query(
    "m1_unknown_fields",
    f"""with v as (select *, {text_sql("ba", "bn", "bs", "'x'", "null", "null")} as b, {text_sql("ma", "mn", "ms", "'x'", "mx", "null")} as mine, {text_sql("ta", "tn", "ts", "tw", "null", "tx")} as theirs,
      {text_sql("case when ma = ba then ta else ma end", "case when mn = bn then tn else mn end", "case when ms is null and ts = bs then null else ts end", "tw", "mx", "tx")} as merged from ({DOCS}))
    select id, case when not m then theirs when not t then mine else merged end as doc, case when not m then ta when not t then ma when ma = ba then ta else ma end as a from v where m or (t and theirs <> b)""",
)
def unknown_fields(spark, d):
    """M1, S3: an object that no schema knows is merged field by field in a VARIANT column."""
    releases(spark, d).createOrReplaceTempView("releases")
    rows = spark.sql(DOCS)

    def version(a, n, s, w, x, y):
        future = F.struct(F.struct(F.col(n).alias("n"), w.alias("who")).alias("keep"), F.col(s).alias("seen"))
        theirs = F.when(y.isNotNull(), F.array(y, F.lit(None).cast("long")))
        return F.to_json(F.struct(F.col(a).alias("a"), future.alias("future"), x.alias("mine"), theirs.alias("theirs"))).alias("doc")

    none = F.lit(None)
    base = rows.select("id", version("ba", "bn", "bs", F.lit("x"), none.cast("string"), none.cast("long")))
    mine = rows.where("m").select("id", version("ma", "mn", "ms", F.lit("x"), F.col("mx"), none.cast("long")))
    theirs = rows.where("t").select("id", version("ta", "tn", "ts", F.col("tw"), none.cast("string"), F.col("tx")))
    merged = V.known_fields(V.three_way_documents(base, mine, theirs, "id", "doc"), "doc", {"a": "string"})
    return merged.select("id", F.to_json("doc").alias("doc"), "a")


@query("m3_x20_x32_keep_reviewed", f"with {VERSIONS} select base.id, case when base.id % 4 = 0 then base.a else coalesce(theirs.a, base.a) end as a, base.id % 4 = 0 as reviewed from base left join theirs using (id)")
def reviewed(spark, d):
    base, _, theirs = versions(spark, d)
    return P.keep_reviewed(base.select("id", "a", (F.col("id") % 4 == 0).alias("reviewed")), theirs, "id", ["a"])


@query("m5_history_rows", "select id, version from (select release_id as id, release_id % 3 as version from releases) where version <> 2 and id % 2 = 0")
def history(spark, d):
    cur = releases(spark, d).selectExpr("release_id as id", "release_id % 3 as version")
    return P.history_rows(cur, cur.where("id % 2 = 0").selectExpr("id", "2L as version"), "id")


@query(
    "m6_roll_back",
    """with c as (select release_id as id, 1 + release_id % 4 as version, title as value, release_id % 9 = 0 as reviewed from releases), h as (select release_id as id, v as version, concat(title, v) as value from releases, (values (1), (2), (3)) t(v) where (release_id + v) % 3 = 0),
    o as (select id, max(version) as v, arg_max(value, version) as value from h where version < 3 group by id)
    select c.id, case when reviewed or version < 3 then version else o.v end as version, case when reviewed or version < 3 then c.value else o.value end as value from c left join o using (id) where reviewed or version < 3 or o.v is not null""",
)
def roll_back(spark, d):
    rows = releases(spark, d)
    cur = rows.selectExpr("release_id as id", "1 + release_id % 4 as version", "title as value", "release_id % 9 = 0 as reviewed")
    hist = rows.select("release_id", "title", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("v")).where("(release_id + v) % 3 = 0").selectExpr("release_id as id", "cast(v as bigint) as version", "concat(title, v) as value")
    return P.roll_back(cur, hist, "id", 3)


@query("m8_newest_record", "select k, fetched, title from (select release_id % 300 as k, release_id as fetched, title, row_number() over (partition by release_id % 300 order by release_id desc) as rn from releases) where rn = 1")
def newest(spark, d):
    return P.newest(releases(spark, d).selectExpr("release_id % 300 as k", "release_id as fetched", "title"), "k", "fetched", ["title"])


RECS = "select p_partkey % 400 as recording, case when p_partkey % 97 = 0 then 'Other' else concat('Title ', p_partkey % 400) end as title, case when p_partkey % 89 = 0 then 'x' else 'y' end as artist, p_brand as release, case when p_partkey % 83 = 0 then 'Odd' else p_brand end as release_title, case when p_partkey % 3 = 0 then p_brand when p_partkey % 79 = 0 then 'z' end as release_group from part"


@query(
    "x18_united_recordings",
    f"""with r as ({RECS}), p as (select recording, release, count(distinct release_title) > 1 or count(distinct release_group) > 1 as bad from r group by 1, 2), q as (select recording, count(*) as releases, bool_or(bad) as bad from p group by 1),
    t as (select recording, count(distinct title) > 1 as ti, count(distinct artist) > 1 as ar, min(lower(title)) as title from r group by 1)
    select recording, releases, case when ti then 'recording' when ar then 'artist' when bad then 'release' end as problem, case when not ti and not ar and not bad then title end as title from q join t using (recording)""",
)
def recordings(spark, d):
    read(spark, d, "part").createOrReplaceTempView("part")
    return P.united_recordings(spark.sql(RECS))


PAGES = "select artist, pos + case when artist % 11 = 0 and pos > 0 then 1 else 0 end as pos, case when artist % 7 = 0 and pos = 2 then 3 else 2 end as n, case when artist % 5 = 0 and pos = 4 then 7 else 6 end as total from (select distinct p_partkey % 60 as artist, (p_partkey div 60 % 3) * 2 as pos from part) t"
LISTED = "select artist, pos + case when artist % 11 = 0 and pos > 0 then 1 else 0 end as pos, concat('r', artist, '-', case when artist % 13 = 0 and pos = 4 and i = 1 then 0 else pos + i end) as release from (select distinct p_partkey % 60 as artist, (p_partkey div 60 % 3) * 2 as pos, p_partkey div 180 % 2 as i from part) t"


@query(
    "m9_page_problems",
    f"""with pg as ({PAGES.replace(" div ", " // ")}), ls as ({LISTED.replace(" div ", " // ")}), e as (select *, min(pos) over (partition by artist, release) as first from ls), c as (select artist, pos, count(*) as listed, bool_or(first < pos) as again from e group by 1, 2),
    x as (select *, coalesce(lag(pos + n) over (partition by artist order by pos), 0) as expected, first_value(total) over (partition by artist order by pos) as t from pg)
    select x.artist, x.pos as "offset", case when coalesce(listed, 0) <> n then 'releases_do_not_match' when x.pos <> expected then 'not_sequential' when total <> t then 'total_changed' when again then 'release_repeated' end as problem from x left join c on c.artist = x.artist and c.pos = x.pos""",
)
def page_problems(spark, d):
    read(spark, d, "part").createOrReplaceTempView("part")
    named = lambda sql: spark.sql(sql).withColumnRenamed("pos", "offset")
    return P.page_problems(named(PAGES), named(LISTED))


@query("m9_union_pages", "select p_partkey % 200 as recording, count(distinct p_brand) as releases from part group by 1")
def pages(spark, d):
    return P.united_recordings(read(spark, d, "part").selectExpr("p_partkey % 200 as recording", "'t' as title", "'a' as artist", "p_brand as release", "p_brand as release_title", "p_brand as release_group")).select("recording", "releases")


SCOPES = "select artist, scope, (artist + k) % 5 <> 0 as complete from (select distinct p_partkey % 300 as artist, k, scope from part, (select 0 as k, 'release_artist' as scope union all select 1, 'release_track_artist') v) t where (artist + k) % 7 <> 0"
ARTS = f"select distinct p_partkey % 300 as artist, case when p_partkey % 300 % 4 <> 0 then {NOW_MS} + (p_partkey % 300 % 9 - 4) * {DAYS} end as fresh_until_ms from part"


@query("x13_assembled", f"with sc as ({SCOPES}), a as (select artist, coalesce(string_agg(scope, ',' order by scope) filter (complete), '') as scopes, count(*) filter (complete) = 2 as complete from sc group by 1) select *, case when complete then {NOW_MS} + 30 * {DAYS} end as fresh_until_ms from a")
def assembled(spark, d):
    read(spark, d, "part").createOrReplaceTempView("part")
    return P.assembled(spark.sql(SCOPES), NOW_MS)


@query("x14_artist_due", f"with sc as ({SCOPES}), ar as ({ARTS}), a as (select artist, count(*) filter (complete) = 2 as w from sc group by 1) select ar.artist, not coalesce(w, false) or fresh_until_ms is null or fresh_until_ms <= {NOW_MS} as due from ar left join a using (artist)")
def artist_due(spark, d):
    read(spark, d, "part").createOrReplaceTempView("part")
    return P.artist_due(spark.sql(SCOPES), spark.sql(ARTS), NOW_MS)


@query(
    "m11_merged_shows",
    """with l as (select ord as id, case when ord % 3 <> 0 then d end as checked, case when ord % 5 = 0 then 'old' end as setlist from concerts where ord % 10 <> 7), c as (select ord as id, case when ord % 4 <> 0 then d + 3 end as checked, case when ord % 2 = 0 then 'found' end as setlist from concerts where ord % 6 < 2), n as (select ord as id, d as checked, null as setlist from concerts where ord % 5 = 2)
    select l.id, case when l.checked is null then c.checked when c.checked is null then l.checked else greatest(l.checked, c.checked) end as checked, coalesce(l.setlist, c.setlist) as setlist from l left join c using (id) union all select * from n where id not in (select id from l)""",
)
def merged_shows(spark, d):
    rows = concerts(spark, d)
    latest = rows.where("ord % 10 <> 7").selectExpr("ord as id", "case when ord % 3 <> 0 then d end as checked", "case when ord % 5 = 0 then 'old' end as setlist")
    current = rows.where("ord % 6 < 2").selectExpr("ord as id", "case when ord % 4 <> 0 then date_add(d, 3) end as checked", "case when ord % 2 = 0 then 'found' end as setlist")
    return P.merged_shows(latest, current, rows.where("ord % 5 = 2").selectExpr("ord as id", "d as checked", "cast(null as string) as setlist"))


OWNERS = "select band_id, case when band_id % 10 = 0 then 'nSame' else concat('n', band_id) end as name, case when band_id % 3 > 0 then concat('p', band_id % 500) end as provider_id, band_id % 5 < 2 as confirmed from bands"
APPROVED = "select distinct concat('n', band_id) as name, concat('p', band_id % 500 + case when band_id % 16 = 1 then 1 else 0 end) as provider_id from bands where band_id % 4 = 1 union select 'nSame', 'p1'"


@query(
    "x20_approved_identities",
    f"""with ow as ({OWNERS}), ap as ({APPROVED}), t as (select ap.name, ap.provider_id as new, count(band_id) as n, min(band_id) as band_id, min(ow.provider_id) as own, bool_or(confirmed) as sure from ap left join ow using (name) group by 1, 2),
    x as (select t.*, exists (select 1 from ow where confirmed and ow.provider_id = t.new and ow.band_id not in (select band_id from t where band_id is not null)) as taken from t),
    p as (select *, case when n <> 1 then 'not_one_band' when coalesce(sure, false) and own is distinct from new then 'other_confirmed_identity' when taken then 'confirmed_on_another_band' end as problem from x)
    select name, case when n = 1 then band_id end as band_id, new as provider_id, problem, problem is null and not (coalesce(sure, false) and own is not distinct from new) as changed from p""",
)
def approved(spark, d):
    bands(spark, d).createOrReplaceTempView("bands")
    return P.approved_identities(spark.sql(OWNERS), spark.sql(APPROVED))


@query("m10_two_projections", "select ord, band_id, 'identity' as kind from listens where band_id in (select band_id from bands) union all select ord, band_id, 'canonical' from listens where band_id in (select band_id from bands)")
def projections(spark, d):
    """Two derived rows from one linked listen."""
    linked = listens(spark, d).join(bands(spark, d).select("band_id"), "band_id", "left_semi")
    return linked.select("ord", "band_id", F.explode(F.array(F.lit("identity"), F.lit("canonical"))).alias("kind"))


@query("x5_latest_runs", "select band_id, arg_max(ord, (ms, ord)) as run, max(ms) as finished from listens group by band_id")
def latest(spark, d):
    return P.latest_runs(listens(spark, d).selectExpr("band_id", "ord as run", "ms as finished"), "band_id")


@query("x33_operation_counts", "select source, release_title as outcome, count(*) as n from listens group by 1, 2")
def operations(spark, d):
    return P.counts_by(listens(spark, d).selectExpr("source", "release_title as outcome"), "source", "outcome")


STATE = f"""select ord, attending, d, case ord % 5 when 0 then 'ready' when 1 then 'ready' when 2 then 'ready' when 3 then 'unavailable' end as status, case when ord % 7 <> 0 then {NOW_MS} - (ord % 14) * {DAYS} end as generated_ms, ord % 4 as songs, case when ord % 11 <> 0 then 2 else 1 end as version, case when ord % 6 < 4 then 'a' else 'b' end as artist,
  case when ord % 9 < 6 then 'a' end as identity, case ord % 8 when 0 then null when 1 then 'error' when 2 then 'quota_blocked' else 'ok' end as match_status, case when ord % 3 > 0 then {NOW_MS} + (ord % 3 * 2 - 3) end as next_ms, ord % 10 < 4 as has_setlist, case when ord % 3 = 0 then date '1999-06-20' + cast(ord % 10 as int) end as checked, case when ord % 5 > 0 then {NOW_MS} - (ord % 30) * 3600000 end as last_ms from concerts"""


@query(
    "x24_x27_x31_due_checks",
    f"""with s as ({STATE}) select ord, status is null or status <> 'ready' or generated_ms is null or generated_ms + 7 * {DAYS} <= {NOW_MS} as prediction_due, coalesce(status = 'ready', false) and songs > 0 and case when version <> 2 then true when identity is not null and artist <> identity then true when match_status is null then true when match_status in ('error', 'quota_blocked') then next_ms is null or next_ms <= {NOW_MS} else false end as links_due,
      attending and d < date '1999-07-01' and not has_setlist and not coalesce(date '1999-07-01' - checked < 7, false) as setlist_due, last_ms is null or last_ms + 12 * 3600000 <= {NOW_MS} as run_due from s""",
)
def due_checks(spark, d):
    concerts(spark, d).createOrReplaceTempView("concerts")
    c = F.col
    return spark.sql(STATE).select(
        "ord",
        P.prediction_due(c("status"), c("generated_ms"), NOW_MS).alias("prediction_due"),
        P.links_due(c("status"), c("songs"), c("version"), c("artist"), c("identity"), c("match_status"), c("next_ms"), NOW_MS).alias("links_due"),
        P.setlist_check_due(c("attending"), c("d"), c("has_setlist"), c("checked"), "1999-07-01").alias("setlist_due"),
        P.run_due(c("last_ms"), NOW_MS, 12).alias("run_due"),
    )


@query("x27_songs_unchecked", "select distinct setlist from songs where not is_cover and idx % 3 = 1")
def unchecked(spark, d):
    return P.songs_unchecked(songs(spark, d).withColumn("checked", F.col("idx") % 3 != 1))


@query(
    "x19_track_evidence",
    """with e as (select ord, band_id, concat('Band ', band_id % 90) as artist, case when ord % 50 = 0 then '!' else recording_title end as title, track_id, case when track_id is not null and ord % 8 <> 0 then 'https://open.spotify.com/track/' || track_id end as url from listens),
    b as (select band_id, case when band_id % 2 = 0 then concat('Band ', band_id % 500) else name end as name, concat('a', band_id) as artist_id from bands), n as (select band_id, artist_id, name, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) as k from b), o as (select k from n group by k having count(*) = 1),
    r as (select e.*, n.artist_id, coalesce(name, artist) as who, coalesce(k, trim(regexp_replace(lower(artist), '[^a-z0-9]+', ' ', 'g'))) as k from e left join n using (band_id) where url is not null and title <> '!')
    select band_id, artist_id, who as artist, title, track_id, url from r union all select null, null, who, title, track_id, url from r where k in (select k from o)""",
)
def track_evidence(spark, d):
    events = listens(spark, d).selectExpr("band_id", "concat('Band ', band_id % 90) as artist", "case when ord % 50 = 0 then '!' else recording_title end as title", "track_id", "case when track_id is not null and ord % 8 <> 0 then 'https://open.spotify.com/track/' || track_id end as url")
    owners = bands(spark, d).selectExpr("band_id", "case when band_id % 2 = 0 then concat('Band ', band_id % 500) else name end as name", "concat('a', band_id) as artist_id")
    return K.track_evidence(events, owners, decompose=False)


@query("c14_ticket_labels", "select ord, typ || ' ' || row_number() over (partition by band_id, typ order by ord) as label from concerts")
def tickets(spark, d):
    """C14: numbered labels for each kind of ticket."""
    from pyspark.sql import Window as W

    nth = F.row_number().over(W.partitionBy("band_id", "typ").orderBy("ord"))
    return concerts(spark, d).select("ord", F.concat_ws(" ", "typ", nth.cast("string")).alias("label"))
