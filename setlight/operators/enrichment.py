"""Tracks that lack an identity: inventory, evidence, catalogue match, next steps.

events (ord, band_id or null, spotify_id, title, artist, recording_id, artist_mbid, release_title, release_id)
bands (band_id, mb_artist, spotify_artist): the artist ids that are trusted
metadata (spotify_id, sound, isrc, artists): ``sound`` is false for malformed records
identities (track_key, sound, band_id, spotify_id, recording_id, mb_artists, spotify_artists, status, isrc, next_ms,
spotify_state, musicbrainz_state, listenbrainz_state): what was stored about a track; ``sound`` is false for
malformed ones and for records of another track. A provider's state is null where it was never asked.

A group's first values come by ``ord``. Whether a group has several values of a kind is told by its least and
largest, so no group gathers its values and rows are never expanded for distinct counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setlight.functions.text import norm_text

PROVIDERS = ("spotify", "musicbrainz", "listenbrainz")
#: States that wait for somebody, an international recording code, and what is left after a local match.
HELD = ("needs_review", "retry", "error", "no_match")
ISRC = "^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$"
BRIDGE_REASONS = ("catalogue_no_match", "catalogue_release_mismatch")
BRIDGE_MOST = 100


def yes(condition: Column) -> Column:
    """A condition that is false where it is unknown."""
    return F.coalesce(condition, F.lit(False))


def decide(*rules: tuple[Column, str, str], last: tuple[str, str] | None = None) -> list[Column]:
    """Two columns from (condition, first, second): the first rule that holds."""
    out = []
    for k in (1, 2):
        column = F.when(F.lit(False), "")
        for rule in rules:
            column = column.when(yes(rule[0]), rule[k])
        out.append(column.otherwise(last[k - 1]) if last else column)
    return out


def filled(text: str) -> Column:
    """The trimmed text, null where nothing is left."""
    return F.when(F.trim(text) != "", F.trim(text))


def track_key(decompose: bool = True) -> Column:
    """One key for each provider id, else for each band and title; null for neither."""
    title = norm_text(F.col("title"), decompose)
    return F.when(F.col("spotify_id").isNotNull(), F.concat(F.lit("spotify:"), "spotify_id")).when(title != "", F.concat(F.lit("text:"), F.col("band_id").cast("string"), F.lit("\n"), title))


def work_items(events: DataFrame, bands: DataFrame, decompose: bool = True) -> DataFrame:
    """One row for each track of mapped events, with what its events say."""
    names = F.when(filled("artist").isNotNull() & filled("title").isNotNull(), F.concat(norm_text(F.col("artist"), decompose), F.lit("\n"), norm_text(F.col("title"), decompose)))
    release = filled("release_title")
    rows = events.join(bands, "band_id").withColumns({"track_key": track_key(decompose), "names": names, "release": F.when(release.isNotNull(), norm_text(release, decompose))}).where("track_key is not null")
    first = lambda c, given: F.min_by(c, F.when(F.col(given).isNotNull(), F.col("ord")))
    several = lambda c: yes(F.min(c) != F.max(c))
    items = rows.groupBy("track_key").agg(
        F.count("*").alias("events"),
        several("band_id").alias("band_conflict"),
        F.min_by("band_id", "ord").alias("band_id"),
        F.min("spotify_id").alias("spotify_id"),
        F.min_by("mb_artist", "ord").alias("mb_artist"),
        F.min_by("spotify_artist", "ord").alias("spotify_artist"),
        several("names").alias("text_conflict"),
        first(F.trim("artist"), "names").alias("artist_name"),
        first(F.trim("title"), "names").alias("recording_name"),
        F.min_by(norm_text(F.col("title"), decompose), "ord").alias("title_norm"),
        several("recording_id").alias("recording_conflict"),
        F.min("recording_id").alias("source_recording"),
        yes(F.bool_and(F.col("artist_mbid") != F.col("mb_artist"))).alias("artist_conflict"),
        several("release").alias("release_conflict"),
        F.min("release").alias("release_norm"),
        first(release, "release").alias("release_name"),
        several("release_id").alias("release_id_conflict"),
        F.min("release_id").alias("source_release"),
    )
    cleared = {c: F.when(~F.col("band_conflict"), F.col(c)) for c in ("mb_artist", "spotify_artist", "band_id")}
    texts = {c: F.when(~(F.col("band_conflict") | F.col("text_conflict")), F.col(c)) for c in ("artist_name", "recording_name")}
    return items.withColumns(cleared | texts | {"text_conflict": F.col("text_conflict") | F.col("band_conflict")})


def foreign(trusted: str, stored: str) -> Column:
    """Stored artists without the trusted one."""
    return yes(F.col(trusted).isNotNull() & (F.size(stored) > 0) & ~F.array_contains(stored, F.col(trusted)))


def with_identity(items: DataFrame, identities: DataFrame) -> DataFrame:
    """The stored identity's columns as ``i_...``, and whether it contradicts the item."""
    stored = identities.select("track_key", *[F.col(c).alias(f"i_{c}") for c in identities.columns if c != "track_key"])
    both = items.join(stored, "track_key", "left")
    other_band = F.col("i_band_id").isNotNull() & F.col("band_id").isNotNull() & (F.col("i_band_id") != F.col("band_id"))
    other_track = F.col("track_key").startswith("spotify:") & ~F.col("i_spotify_id").eqNullSafe(F.col("spotify_id"))
    wrong = ~F.col("i_sound") | other_band | other_track | foreign("mb_artist", "i_mb_artists") | foreign("spotify_artist", "i_spotify_artists")
    wrong = wrong | (F.col("i_isrc").isNotNull() & ~F.col("i_isrc").rlike(ISRC)) | (yes(F.col("i_status") == "resolved") & F.col("i_recording_id").isNull())
    return both.withColumn("i_conflict", F.col("i_sound").isNotNull() & yes(wrong))


def inventory(events: DataFrame, bands: DataFrame, metadata: DataFrame, identities: DataFrame, decompose: bool = True) -> DataFrame:
    """A work item for each track with status and reason, the first rule that holds."""
    known = metadata.select("spotify_id", *[F.col(c).alias(f"m_{c}") for c in metadata.columns if c != "spotify_id"])
    rows = with_identity(work_items(events, bands, decompose), identities).join(known, "spotify_id", "left")
    has_metadata = F.col("m_sound").isNotNull()
    bad_metadata = has_metadata & (~F.col("m_sound") | foreign("spotify_artist", "m_artists") | yes(~F.col("m_isrc").rlike(ISRC)))
    stored, source, by_id = F.col("i_recording_id"), F.col("source_recording"), F.col("spotify_id").isNotNull()
    complete_names = F.col("artist_name").isNotNull() & F.col("recording_name").isNotNull()
    status, reason = decide(
        (F.col("band_conflict"), "blocked", "band_conflict"),
        (F.col("i_conflict"), "blocked", "stored_track_identity_conflict"),
        (F.col("recording_conflict"), "blocked", "source_recording_conflict"),
        (F.col("artist_conflict"), "blocked", "source_musicbrainz_artist_conflict"),
        (stored != source, "blocked", "stored_source_recording_conflict"),
        (stored.isNotNull(), "complete", "existing_track_identity"),
        (source.isNotNull(), "complete", "source_recording_mbid"),
        (by_id & bad_metadata, "blocked", "spotify_metadata_identity_conflict"),
        (by_id & F.col("m_isrc").isNotNull(), "needs_musicbrainz", "spotify_metadata_with_isrc"),
        (by_id & has_metadata, "spotify_metadata_present", "spotify_metadata_without_isrc"),
        (by_id, "needs_spotify", "missing_spotify_metadata"),
        (F.col("mb_artist").isNotNull() & ~F.col("text_conflict") & complete_names, "needs_listenbrainz_fallback", "exact_id_routes_exhausted"),
        (F.col("text_conflict"), "blocked", "conflicting_lookup_text"),
        (F.col("mb_artist").isNull(), "blocked", "missing_trusted_musicbrainz_artist"),
        last=("blocked", "missing_lookup_text"),
    )
    decided = rows.withColumns({"status": status, "reason": reason})
    return decided.withColumn("metadata_isrc", F.when(F.col("reason") == "spotify_metadata_with_isrc", F.col("m_isrc"))).drop("m_sound", "m_isrc", "m_artists")


def inventory_counts(items: DataFrame, events: DataFrame, bands: DataFrame, decompose: bool = True) -> DataFrame:
    """One row of sums over events and work items."""
    mapped = events.join(bands.select(F.col("band_id").alias("known")), F.col("band_id") == F.col("known"), "left").withColumn("k", track_key(decompose))
    of_events = mapped.agg(
        F.count("*").alias("source_events"),
        F.count_if(F.col("known").isNotNull() & F.col("k").isNotNull()).alias("mapped_events"),
        F.count_if(F.col("known").isNull()).alias("unmapped_events"),
        F.count_if(F.col("known").isNotNull() & F.col("k").isNull()).alias("unusable_events"),
    )
    states = {"needs_spotify_tracks": "needs_spotify", "needs_musicbrainz_tracks": "needs_musicbrainz", "needs_fallback_tracks": "needs_listenbrainz_fallback", "blocked_tracks": "blocked", "complete_tracks": "complete"}
    of_items = items.agg(F.count("*").alias("unique_tracks"), F.count("spotify_id").alias("spotify_tracks"), F.count_if(F.col("reason").startswith("spotify_metadata_with")).alias("metadata_tracks"), *[F.count_if(F.col("status") == s).alias(c) for c, s in states.items()])
    return of_events.crossJoin(of_items)  # one row each


def routing_hold() -> Column:
    """Why a stored identity keeps its track from being looked up, the first reason."""
    held = F.when(F.col("i_status").isin(*HELD), F.concat(F.lit("durable_identity_"), "i_status"))
    for p in PROVIDERS:
        state = F.col(f"i_{p}_state")
        held = held.when(state.isin(*HELD), F.concat(F.lit(f"durable_provider_{p}_"), state)).when(yes(~state.isin("resolved", "metadata")), f"durable_provider_{p}_unknown_status")
    return held


def evidence(items: DataFrame) -> DataFrame:
    """The items with their evidence tier: A complete, B one release, C title only, E neither."""
    doubtful = F.col("release_id_conflict") | (F.col("source_release").isNotNull() & F.col("release_conflict"))
    one_release = ~doubtful & (F.col("source_release").isNotNull() | (F.col("release_norm").isNotNull() & ~F.col("release_conflict")))
    hopeless = (F.col("status") == "blocked") | doubtful | F.col("mb_artist").isNull() | (F.coalesce("recording_name", "title_norm") == "") | F.col("text_conflict")
    held = items.withColumn("hold", routing_hold())
    tier = F.when(F.col("hold").isNotNull(), "E").when(F.col("status") == "complete", "A").when(hopeless, "E").when(one_release, "B").otherwise("C")
    single = {"release_norm": F.when(~F.col("release_conflict"), F.col("release_norm")), "release_name": F.when(~F.col("release_conflict"), F.col("release_name")), "source_release": F.when(~F.col("release_id_conflict"), F.col("source_release"))}
    return held.withColumns({"tier": tier} | single)


def from_catalogue(items: DataFrame, artists: DataFrame, recordings: DataFrame, decompose: bool = True) -> DataFrame:
    """(track_key, tier, status, reason, recording_id) by the artists' catalogues.

    artists (mb_artist, complete); recordings (mb_artist, recording_id, title, release_id, release_title), a row for each release.
    """
    wanted = items.withColumn("wanted", norm_text(F.coalesce("recording_name", "title_norm"), decompose))
    asked = wanted.where(F.col("tier").isin("B", "C") & F.col("hold").isNull()).select("track_key", "tier", "mb_artist", "wanted", "source_release", "release_norm")
    known = recordings.select("mb_artist", norm_text(F.col("title"), decompose).alias("wanted"), "recording_id", "release_id", norm_text(F.col("release_title"), decompose).alias("r_norm"))
    fits = (F.col("tier") == "C") | yes(F.when(F.col("source_release").isNotNull(), F.col("release_id") == F.col("source_release")).otherwise(F.col("r_norm") == F.col("release_norm")))
    fitting = F.when(fits, F.col("recording_id"))
    found = asked.join(known, ["mb_artist", "wanted"]).groupBy("track_key").agg(F.count("*").alias("n"), F.min(fitting).alias("low"), F.max(fitting).alias("high"))
    rows = wanted.join(artists.select("mb_artist", "complete"), "mb_artist", "left").join(found, "track_key", "left")
    status, reason = decide(
        (F.col("hold").isNotNull(), "exception", "held"),
        (F.col("tier") == "A", "complete", "already_complete"),
        (~F.col("tier").isin("B", "C"), "exception", "not_catalogue_eligible"),
        (F.col("complete").isNull(), "unresolved", "catalogue_missing"),
        (~F.col("complete"), "unresolved", "catalogue_incomplete"),
        (F.col("n").isNull(), "unresolved", "catalogue_no_match"),
        (F.col("low").isNull(), "unresolved", "catalogue_release_mismatch"),
        (F.col("low") != F.col("high"), "ambiguous", "multiple_compatible_recordings"),
        (F.col("tier") == "C", "resolved", "catalogue_unique_recording_title"),
        (F.col("source_release").isNotNull(), "resolved", "catalogue_exact_recording_release_identity"),
        last=("resolved", "catalogue_exact_recording_release"),
    )
    decided = rows.withColumns({"new_status": status, "new_reason": F.coalesce("hold", reason)})
    return decided.select("track_key", "tier", F.col("new_status").alias("status"), F.col("new_reason").alias("reason"), F.when(F.col("new_status") == "resolved", F.col("low")).alias("recording_id"))


def next_steps(items: DataFrame, now_ms: int) -> DataFrame:
    """(track_key, provider, operation) for each item: the next lookup, or ``skipped`` and why; the first rule that holds."""
    state = {p: F.col(f"i_{p}_state") for p in PROVIDERS}
    retries = sum((yes(s == "retry").cast("int") for s in state.values()), F.lit(0))
    retrying = yes(F.col("i_status") == "retry")
    turn = lambda p: (retries == 0) | yes(state[p] == "retry")
    ripe = yes(F.col("i_next_ms") <= now_ms)
    allowed = lambda p: state[p].isNull() | ((state[p] == "retry") & ripe)
    isrc = F.coalesce("i_isrc", "metadata_isrc")
    artist = F.col("mb_artist").isNotNull()
    usable = isrc.isNotNull() & artist
    spotify_done = F.col("spotify_id").isNull() | isrc.isNotNull() | (F.col("status") == "spotify_metadata_present") | yes(state["spotify"].isin("no_match", "metadata"))
    musicbrainz_done = ~usable | yes(state["musicbrainz"] == "no_match")
    named = F.col("artist_name").isNotNull() & F.col("recording_name").isNotNull()
    provider, operation = decide(
        (F.col("i_conflict"), "skipped", "blocked"),
        (F.col("i_recording_id").isNotNull() | (F.col("status") == "complete"), "skipped", "complete"),
        ((F.col("status") == "blocked") | yes(F.col("i_status") == "resolved"), "skipped", "blocked"),
        (F.col("i_status").isin("needs_review", "error", "no_match"), "skipped", "no_route"),
        ((retrying & (retries != 1)) | (~retrying & (retries > 0)), "skipped", "no_route"),
        (F.col("i_isrc") != F.col("metadata_isrc"), "skipped", "blocked"),
        (F.col("i_next_ms") > now_ms, "skipped", "retry_wait"),
        (turn("musicbrainz") & usable & allowed("musicbrainz"), "musicbrainz", "isrc_lookup"),
        (turn("spotify") & F.col("spotify_id").isNotNull() & (F.col("status") == "needs_spotify") & (isrc.isNull() | ~artist) & allowed("spotify"), "spotify", "exact_track"),
        (turn("listenbrainz") & spotify_done & musicbrainz_done & allowed("listenbrainz") & artist & named, "listenbrainz", "metadata_lookup"),
        last=("skipped", "no_route"),
    )
    return items.select("track_key", provider.alias("provider"), operation.alias("operation"))


def batch_bridge(items: DataFrame, local: DataFrame, most: int = 25) -> DataFrame:
    """(track_key, outcome): the first ``most`` tracks by key that the catalogue could not name are planned, others say why not."""
    results = local.select("track_key", F.col("tier").alias("l_tier"), F.col("status").alias("l_status"), F.col("reason").alias("l_reason"))
    rows = items.join(results, "track_key", "left")
    fit = F.col("tier").isin("B", "C") & F.col("hold").isNull() & F.col("mb_artist").isNotNull() & F.col("artist_name").isNotNull() & F.col("recording_name").isNotNull()
    open_ones = (F.col("l_status") == "unresolved") & F.col("l_reason").isin(*BRIDGE_REASONS)
    outcome = F.when(F.col("tier") == "A", "complete").when(~F.col("l_tier").eqNullSafe(F.col("tier")), "not_unresolved_locally").when(F.col("l_status") == "resolved", "resolved_locally").when(F.col("l_status") == "ambiguous", "ambiguous")
    outcome = outcome.when(~yes(open_ones), "not_unresolved_locally").when(~fit, "ineligible").otherwise("overflow")
    decided = rows.select("track_key", outcome.alias("outcome"))
    chosen = decided.where("outcome = 'overflow'").orderBy("track_key").limit(min(BRIDGE_MOST, most)).select(F.col("track_key").alias("chosen"))
    return decided.join(F.broadcast(chosen), F.col("track_key") == F.col("chosen"), "left").select("track_key", F.when(F.col("chosen").isNotNull(), "planned").otherwise(F.col("outcome")).alias("outcome"))


def lookup_plan(events: DataFrame, complete: Column, signature: Column) -> DataFrame:
    """(signature, first_ord, events): events to look up by signature, named by their first; rows without a signature are left out."""
    rows = events.where(~yes(complete)).withColumn("signature", signature).where("signature is not null")
    return rows.groupBy("signature").agg(F.min("ord").alias("first_ord"), F.count("*").alias("events"))
