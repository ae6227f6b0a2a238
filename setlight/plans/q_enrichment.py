"""Queries on tracks that lack an identity, over stand-ins that hold every kind of conflict and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from setlight.operators import enrichment as E
from setlight.sources.standins import NOW_MS, bands, listens

from .registry import query

#: Stand-ins in words that both dialects know.
EVENTS = """select ord, band_id, case when ord % 997 = 0 then 'sAny' when ord % 5 < 3 then concat('s', band_id, '-', ord % 2) end as spotify_id,
  case when ord % 401 = 0 then ' ' else recording_title end as title, case when ord % 17 = 0 then null when ord % 1201 = 0 then 'Other' else concat('Band ', band_id) end as artist,
  case when band_id % 4 = 0 and ord % 3 = 0 then case when ord % 89 = 0 then 'rX' else concat('r', band_id, '-', ord % 2) end end as recording_id,
  case when ord % 6 = 0 then case when band_id % 23 = 0 then 'mOther' else concat('m', band_id) end end as artist_mbid,
  case when ord % 2 = 0 then concat('Rel ', band_id % 7) when ord % 211 = 0 then 'Odd' end as release_title,
  case when ord % 9 = 0 then concat('q', band_id % 7, case when ord % 300 = 0 then 'x' else '' end) end as release_id from listens"""
TRUSTED = "select band_id, case when band_id % 3 <> 0 then concat('m', band_id) end as mb_artist, case when band_id % 2 = 0 then concat('a', band_id) end as spotify_artist from bands"
METADATA = """select spotify_id, b % 37 <> 0 as sound, case when b % 5 in (1, 2) then 'SEABC0000001' when b % 25 = 3 then 'bad!' end as isrc, case when b % 19 = 0 then 'aOther' when b % 2 = 0 then concat('a', b) end as artist
  from (select spotify_id, min(band_id) as b from ev where spotify_id is not null group by spotify_id) t where b % 5 <> 0"""
STORED = """select track_key, b % 41 <> 0 as sound, case when b % 43 = 0 then -1 when b % 2 = 0 then b end as band_id, spotify_id, case when b % 7 = 0 and b % 4 = 1 then concat('z', b) when b % 7 = 0 and b % 4 = 0 then concat('r', b, '-0') end as recording_id,
  case when b % 47 = 0 then 'mOther' end as mb_artist, case when b % 53 = 0 then 'aOther' end as spotify_artist,
  case when b % 7 = 0 and b % 4 = 1 then 'resolved' when b % 7 = 1 and b % 5 < 2 then 'retry' when b % 7 = 1 and b % 5 = 2 then 'needs_review' when b % 7 = 1 and b % 5 = 3 then 'no_match' end as status,
  case when b % 13 = 0 then 'SEABC0000009' when b % 59 = 0 then 'bad!' end as isrc, case when b % 7 = 1 then case when b % 3 = 0 then 9999999999999 else 1 end end as next_ms,
  case when b % 7 = 1 and b % 5 = 0 then 'retry' when b % 7 = 2 and b % 2 = 0 then 'metadata' when b % 7 = 2 and b % 3 = 0 then 'no_match' end as spotify_state,
  case when b % 7 = 1 and b % 5 = 1 then 'retry' when b % 7 = 2 and b % 3 = 1 then 'no_match' when b % 61 = 0 then 'odd' end as musicbrainz_state, case when b % 11 = 0 then 'no_match' end as listenbrainz_state
  from (select track_key, min(spotify_id) as spotify_id, min(band_id) as b from keyed where track_key is not null group by track_key) t where b % 7 < 3"""
KEY = "case when spotify_id is not null then concat('spotify:', spotify_id) when trim(title) <> '' then concat('text:', band_id, chr(10), lower(trim(title))) end"
KEYED = f"select e.*, t.mb_artist, t.spotify_artist, {KEY} as track_key, case when trim(artist) <> '' and trim(title) <> '' then concat(lower(trim(artist)), chr(10), lower(trim(title))) end as names, nullif(lower(trim(release_title)), '') as rel from ev e join tb t on e.band_id = t.band_id".replace("concat('text:', band_id", "concat('text:', e.band_id")

TABLES = f"ev as ({EVENTS}), tb as ({TRUSTED}), keyed as ({KEYED}), md as ({METADATA}), st as ({STORED})"


def inputs(spark, d):
    """events, bands, metadata and identities as Spark tables."""
    views = {"listens": listens(spark, d), "bands": bands(spark, d)}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    out = {}
    for name, sql in (("ev", EVENTS), ("tb", TRUSTED), ("keyed", KEYED), ("md", METADATA), ("st", STORED)):
        out[name] = spark.sql(sql.replace("9999999999999", "9999999999999L").replace("then 1 ", "then 1L ").replace("else 1 end", "else 1L end"))
        out[name].createOrReplaceTempView(name)
    one = lambda c: F.array_compact(F.array(c))
    md = out["md"].select("spotify_id", "sound", "isrc", one("artist").alias("artists"))
    st = out["st"].withColumns({"mb_artists": one("mb_artist"), "spotify_artists": one("spotify_artist")}).drop("mb_artist", "spotify_artist")
    return out["ev"], out["tb"], md, st


ITEMS = f"""{TABLES}, it as (select track_key, count(*) as events, min(band_id) <> max(band_id) as bc, arg_min(band_id, ord) as band_id, min(spotify_id) as spotify_id, arg_min(struct_pack(m := mb_artist), ord).m as mb, arg_min(struct_pack(a := spotify_artist), ord).a as sp,
  count(distinct names) > 1 as tc, arg_min(trim(artist), ord) filter (names is not null) as an, arg_min(trim(title), ord) filter (names is not null) as rn, arg_min(lower(trim(title)), ord) as tn, count(distinct recording_id) > 1 as rc, min(recording_id) as src,
  coalesce(bool_and(artist_mbid <> mb_artist), false) as ac, count(distinct rel) as n_rel, min(rel) as rel, count(distinct release_id) as n_rid, min(release_id) as rid from keyed group by track_key having track_key is not null),
  w as (select i.* exclude (band_id, mb, sp, tc, an, rn), case when not bc then i.band_id end as band_id, case when not bc then mb end as mb, case when not bc then sp end as sp, tc or bc as tc, case when not tc and not bc then an end as an, case when not tc and not bc then rn end as rn,
    st.sound as s_sound, st.recording_id as s_rec, st.status as s_status, st.isrc as s_isrc, next_ms, spotify_state as ss, musicbrainz_state as ms, listenbrainz_state as ls, md.sound as m_sound, md.isrc as m_isrc, md.artist as m_artist,
    st.sound is not null and (not st.sound or coalesce(st.band_id <> case when not bc then i.band_id end, false) or (i.spotify_id is not null and st.spotify_id is distinct from i.spotify_id) or coalesce(st.mb_artist <> case when not bc then mb end, false) or coalesce(st.spotify_artist <> case when not bc then sp end, false)
      or coalesce(not regexp_matches(st.isrc, '^[A-Z]{{2}}[A-Z0-9]{{3}}[0-9]{{7}}$'), false) or (coalesce(st.status = 'resolved', false) and st.recording_id is null)) as sc
    from it i left join st using (track_key) left join md on md.spotify_id = i.spotify_id),
  inv as (select *, case when bc then 'band_conflict' when sc then 'stored_track_identity_conflict' when rc then 'source_recording_conflict' when mb is not null and ac then 'source_musicbrainz_artist_conflict' when s_rec <> src then 'stored_source_recording_conflict' when s_rec is not null then 'existing_track_identity'
    when src is not null then 'source_recording_mbid' when spotify_id is not null and m_sound is not null and (not m_sound or coalesce(m_artist <> sp, false) or coalesce(not regexp_matches(m_isrc, '^[A-Z]{{2}}[A-Z0-9]{{3}}[0-9]{{7}}$'), false)) then 'spotify_metadata_identity_conflict'
    when spotify_id is not null and m_isrc is not null then 'spotify_metadata_with_isrc' when spotify_id is not null and m_sound is not null then 'spotify_metadata_without_isrc' when spotify_id is not null then 'missing_spotify_metadata'
    when mb is not null and not tc and an is not null and rn is not null then 'exact_id_routes_exhausted' when tc then 'conflicting_lookup_text' when mb is null then 'missing_trusted_musicbrainz_artist' else 'missing_lookup_text' end as reason from w),
  items as (select *, case when reason in ('existing_track_identity', 'source_recording_mbid') then 'complete' when reason = 'spotify_metadata_with_isrc' then 'needs_musicbrainz' when reason = 'spotify_metadata_without_isrc' then 'spotify_metadata_present' when reason = 'missing_spotify_metadata' then 'needs_spotify'
    when reason = 'exact_id_routes_exhausted' then 'needs_listenbrainz_fallback' else 'blocked' end as status from inv)"""


def items(spark, d):
    return E.inventory(*inputs(spark, d), decompose=False)


@query("a25_w6_inventory", f"with {ITEMS} select track_key, events, band_id, mb as mb_artist, an as artist_name, rn as recording_name, status, reason, case when reason = 'spotify_metadata_with_isrc' then m_isrc end as metadata_isrc from items")
def inventory(spark, d):
    return items(spark, d).select("track_key", "events", "band_id", "mb_artist", "artist_name", "recording_name", "status", "reason", "metadata_isrc")


@query(
    "a25_inventory_counts",
    f"""with {ITEMS}, k as (select tb.band_id is not null as known, {KEY.replace("band_id", "ev.band_id")} as k from ev left join tb on ev.band_id = tb.band_id),
    e as (select count(*) as source_events, count(*) filter (known and k is not null) as mapped_events, count(*) filter (not known) as unmapped_events, count(*) filter (known and k is null) as unusable_events from k)
    select e.*, (select count(*) from items) as unique_tracks, (select count(spotify_id) from items) as spotify_tracks, (select count(*) from items where reason in ('spotify_metadata_with_isrc', 'spotify_metadata_without_isrc')) as metadata_tracks, (select count(*) from items where status = 'needs_spotify') as needs_spotify_tracks,
      (select count(*) from items where status = 'needs_musicbrainz') as needs_musicbrainz_tracks, (select count(*) from items where status = 'needs_listenbrainz_fallback') as needs_fallback_tracks, (select count(*) from items where status = 'blocked') as blocked_tracks, (select count(*) from items where status = 'complete') as complete_tracks from e""",
)
def counts(spark, d):
    ev, tb, md, st = inputs(spark, d)
    return E.inventory_counts(E.inventory(ev, tb, md, st, decompose=False), ev, tb, decompose=False)


TIERS = f"""{ITEMS}, hd as (select *, case when s_status in ('needs_review', 'retry', 'error', 'no_match') then 'durable_identity_' || s_status when ss in ('needs_review', 'retry', 'error', 'no_match') then 'durable_provider_spotify_' || ss when ss not in ('resolved', 'metadata') then 'durable_provider_spotify_unknown_status'
    when ms in ('needs_review', 'retry', 'error', 'no_match') then 'durable_provider_musicbrainz_' || ms when ms not in ('resolved', 'metadata') then 'durable_provider_musicbrainz_unknown_status' when ls in ('needs_review', 'retry', 'error', 'no_match') then 'durable_provider_listenbrainz_' || ls end as hold,
    n_rid > 1 or (n_rid > 0 and n_rel > 1) as doubt from items),
  tr as (select *, case when hold is not null then 'E' when status = 'complete' then 'A' when status = 'blocked' or doubt or mb is null or coalesce(rn, tn) = '' or tc then 'E' when n_rid > 0 or n_rel = 1 then 'B' else 'C' end as tier from hd)"""


@query("a28_evidence_tiers", f"with {TIERS} select track_key, tier, hold, case when n_rel = 1 then rel end as release_norm, case when n_rid = 1 then rid end as source_release from tr")
def tiers(spark, d):
    return E.evidence(items(spark, d)).select("track_key", "tier", "hold", "release_norm", "source_release")


ARTISTS = "select mb_artist, min(band_id) % 5 <> 4 as complete from tb where mb_artist is not null and band_id % 6 <> 1 group by mb_artist"
RECORDINGS = "select distinct mb_artist, concat('c', band_id, '-', title, case when band_id % 10 = 2 then cast(ord % 3 as varchar) else '' end) as recording_id, upper(title) as title, concat('q', band_id % 7) as release_id, case when band_id % 9 = 0 then 'Elsewhere' else concat('Rel ', band_id % 7) end as release_title from keyed where mb_artist is not null and ord % 4 <> 3"


def catalogue(spark):
    return spark.sql(ARTISTS), spark.sql(RECORDINGS.replace("varchar", "string"))


LOCAL = f"""{TIERS}, ca as ({ARTISTS}), cr as ({RECORDINGS}), fd as (select track_key, count(*) as n, min(recording_id) filter (tier = 'C' or case when n_rid = 1 then release_id = rid else lower(trim(release_title)) = rel and n_rel = 1 end) as low, max(recording_id) filter (tier = 'C' or case when n_rid = 1 then release_id = rid else lower(trim(release_title)) = rel and n_rel = 1 end) as high
    from tr join cr on cr.mb_artist = tr.mb and lower(trim(title)) = lower(trim(coalesce(rn, tn))) where tier in ('B', 'C') and hold is null group by track_key),
  lo as (select track_key, tier, case when hold is not null then hold when tier = 'A' then 'already_complete' when tier not in ('B', 'C') then 'not_catalogue_eligible' when complete is null then 'catalogue_missing' when not complete then 'catalogue_incomplete' when n is null then 'catalogue_no_match' when low is null then 'catalogue_release_mismatch'
    when low <> high then 'multiple_compatible_recordings' when tier = 'C' then 'catalogue_unique_recording_title' when n_rid = 1 then 'catalogue_exact_recording_release_identity' else 'catalogue_exact_recording_release' end as reason, low from tr left join ca on ca.mb_artist = tr.mb left join fd using (track_key)),
  lc as (select track_key, tier, case when reason = 'already_complete' then 'complete' when reason like 'durable%' or reason = 'not_catalogue_eligible' then 'exception' when reason = 'multiple_compatible_recordings' then 'ambiguous' when reason in ('catalogue_missing', 'catalogue_incomplete', 'catalogue_no_match', 'catalogue_release_mismatch') then 'unresolved' else 'resolved' end as status, reason, low from lo)"""


@query("l17_catalogue_match", f"with {LOCAL} select track_key, tier, status, reason, case when status = 'resolved' then low end as recording_id from lc")
def local(spark, d):
    found = E.evidence(items(spark, d))
    return E.from_catalogue(found, *catalogue(spark), decompose=False)


@query(
    "w8_w9_next_steps",
    f"""with {ITEMS}, r as (select *, coalesce(ss = 'retry', false)::int + coalesce(ms = 'retry', false)::int + coalesce(ls = 'retry', false)::int as n, case when reason = 'spotify_metadata_with_isrc' then m_isrc end as mi, coalesce(next_ms <= {NOW_MS}, false) as ripe from items),
    q as (select *, coalesce(s_isrc, mi) as isrc, n = 0 or coalesce(ms = 'retry', false) as t_m, n = 0 or coalesce(ss = 'retry', false) as t_s, n = 0 or coalesce(ls = 'retry', false) as t_l, ms is null or (ms = 'retry' and ripe) as a_m, ss is null or (ss = 'retry' and ripe) as a_s, ls is null or (ls = 'retry' and ripe) as a_l from r),
    s as (select track_key, case when sc then 'skipped blocked' when s_rec is not null or status = 'complete' then 'skipped complete' when status = 'blocked' or coalesce(s_status = 'resolved', false) then 'skipped blocked' when s_status in ('needs_review', 'error', 'no_match') then 'skipped no_route'
      when (coalesce(s_status = 'retry', false) and n <> 1) or (not coalesce(s_status = 'retry', false) and n > 0) then 'skipped no_route' when s_isrc <> mi then 'skipped blocked' when next_ms > {NOW_MS} then 'skipped retry_wait' when t_m and isrc is not null and mb is not null and a_m then 'musicbrainz isrc_lookup'
      when t_s and spotify_id is not null and status = 'needs_spotify' and (isrc is null or mb is null) and a_s then 'spotify exact_track'
      when t_l and (spotify_id is null or isrc is not null or status = 'spotify_metadata_present' or coalesce(ss in ('no_match', 'metadata'), false)) and (isrc is null or mb is null or coalesce(ms = 'no_match', false)) and a_l and mb is not null and an is not null and rn is not null then 'listenbrainz metadata_lookup' else 'skipped no_route' end as x from q)
    select track_key, split_part(x, ' ', 1) as provider, split_part(x, ' ', 2) as operation from s""",
)
def steps(spark, d):
    return E.next_steps(items(spark, d), NOW_MS)


@query(
    "w9_batch_bridge",
    f"""with {LOCAL}, o as (select tr.track_key, case when tr.tier = 'A' then 'complete' when lc.status = 'resolved' then 'resolved_locally' when lc.status = 'ambiguous' then 'ambiguous' when lc.status <> 'unresolved' or lc.reason not in ('catalogue_no_match', 'catalogue_release_mismatch') then 'not_unresolved_locally'
      when tr.tier not in ('B', 'C') or hold is not null or mb is null or an is null or rn is null then 'ineligible' else 'overflow' end as x from tr join lc using (track_key)),
    p as (select track_key from o where x = 'overflow' order by track_key limit 25)
    select track_key, case when track_key in (select track_key from p) then 'planned' else x end as outcome from o""",
)
def bridge(spark, d):
    found = E.evidence(items(spark, d))
    return E.batch_bridge(found, E.from_catalogue(found, *catalogue(spark), decompose=False))


@query("w6_lookup_plan", f"with {TABLES} select concat(lower(trim(artist)), chr(10), lower(trim(title)), chr(10), coalesce(lower(trim(release_title)), '')) as signature, min(ord) as first_ord, count(*) as events from ev where recording_id is null and trim(artist) <> '' and trim(title) <> '' group by 1")
def lookups(spark, d):
    """Events without a recording by artist, title and release."""
    ev = inputs(spark, d)[0]
    known = (F.trim("artist") != "") & (F.trim("title") != "")
    signature = F.when(known, F.concat_ws("\n", F.lower(F.trim("artist")), F.lower(F.trim("title")), F.coalesce(F.lower(F.trim("release_title")), F.lit(""))))
    return E.lookup_plan(ev, F.col("recording_id").isNotNull(), signature)
