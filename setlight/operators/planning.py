"""Release feeds, alerts, work planning and three-way merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setlight.functions.numbers import full_date
from setlight.functions.text import EXCLUDED, allowed_release, canonical_title, norm_artist, slug
from setlight.operators.folds import Row, global_rank, ordered_fold

# --- releases ---------------------------------------------------------------------------------

STAGES = ["album_announced", "new_single", "upcoming_release", "out_today"]
QUIET_DAYS = 14


def stages(now: str, prior: str = "prior_") -> Column:
    """R2: the stages that a release (title, type, release_date, provider_id, url) enters now.

    The columns prior_album_announced, prior_new_single, prior_upcoming_release and prior_out_today say when
    a stage was reported before; a reported stage does not come again, and a release announced less than
    two weeks ago is not yet called upcoming.
    """
    at = F.lit(now).cast("timestamp")
    long = F.col("type").isin("Album", "EP")
    good = F.col("type").isin("Album", "EP", "Single") & ~F.lower(F.coalesce("title", F.lit(""))).rlike(EXCLUDED)
    new = {s: F.col(f"{prior}{s}").isNull() for s in STAGES}
    days = F.floor((F.unix_millis(F.col("release_date").cast("timestamp")) - F.unix_millis(at)) / 86_400_000 + 0.5)
    quiet = F.coalesce(F.unix_millis(at) - F.unix_millis(F.col(f"{prior}album_announced").cast("timestamp")) < QUIET_DAYS * 86_400_000, F.lit(False))
    found = F.array(
        F.when(good & long & new[STAGES[0]], STAGES[0]),
        F.when(good & (F.col("type") == "Single") & F.col("provider_id").isNotNull() & F.col("url").isNotNull() & new[STAGES[1]], STAGES[1]),
        F.when(good & long & (days == 7) & new[STAGES[2]] & ~quiet, STAGES[2]),
        F.when(good & long & (F.col("release_date") == F.to_date(at)) & new[STAGES[3]], STAGES[3]),
    )
    return F.array_compact(found)


def alert_id() -> Column:
    """The id of a release's alert: band, stage and the release's best known identity as slugs."""
    kind = slug(F.col("type"), decompose=False)
    own = F.when(F.col("mbid").isNotNull(), F.concat(F.lit("mbid:"), "mbid", F.lit(":"), kind)).when(F.col("provider_id").isNotNull(), F.concat(F.lit("spotify:"), "provider_id", F.lit(":"), kind))
    named = F.concat(slug(F.col("title"), decompose=False), F.lit(":"), F.coalesce(F.col("release_date").cast("string"), F.lit("")), F.lit(":"), kind)
    return F.concat_ws("-", F.lit("release"), slug(F.col("band_id").cast("string"), decompose=False), slug(F.col("stage"), decompose=False), slug(F.coalesce(own, named), decompose=False))


def lifecycle_alerts(releases: DataFrame, alerts: DataFrame, now: str) -> DataFrame:
    """(release_id, band_id, stage, action, alert_id): each stage creates an alert or enriches the first that exists.

    An alert exists under the same id or, for announcements, for the same mbid, provider id or key of
    another alert of the band. Releases that are not ``eligible`` are skipped whole.
    """
    skipped = releases.where("not eligible").select("release_id", "band_id", F.lit(None).cast("string").alias("stage"), F.lit("skip").alias("action"), F.lit(None).cast("string").alias("alert_id"))
    due = releases.where("eligible").withColumn("stage", F.explode(stages(now))).withColumn("new_id", alert_id())
    ids = alerts.select("band_id", "ord", F.col("alert_id").alias("old_id"), "mbid", "provider_id", "key")
    found = due.select("release_id", "stage", "band_id", F.col("new_id").alias("old_id")).join(ids.select("band_id", "old_id", "ord"), ["band_id", "old_id"]).select("release_id", "stage", "ord", "old_id")
    for k in ("mbid", "provider_id", "key"):
        same = due.where((F.col("stage") == STAGES[0]) & F.col(k).isNotNull()).select("release_id", "stage", "band_id", k).join(ids.select("band_id", k, "ord", "old_id"), ["band_id", k])
        found = found.unionByName(same.select("release_id", "stage", "ord", "old_id"))
    first = found.groupBy("release_id", "stage").agg(F.min_by("old_id", "ord").alias("old_id"), F.lit(True).alias("found"))
    planned = due.join(first, ["release_id", "stage"], "left").select("release_id", "band_id", "stage", F.when(F.col("found"), "enrich").otherwise("create").alias("action"), F.coalesce("old_id", "new_id").alias("alert_id"))
    return planned.unionByName(skipped)


def feed_cleanup(items: DataFrame, valid: Column) -> DataFrame:
    """What stays and goes, by type."""
    return items.groupBy("type").agg(F.count_if(valid).alias("kept"), F.count_if(~valid).alias("removed"))


def availability_alerts(releases: DataFrame, seen: DataFrame, today: str, recent_days: int = 30) -> DataFrame:
    """Alerts for releases that became available; old ones count as catch-up and stay silent."""
    age = F.datediff(F.lit(today).cast("date"), "release_date")
    decision = F.when(F.col("provider_id").isNull(), "unavailable").when(F.col("s").isNotNull(), "known").when(F.col("release_date").isNull(), "undated").when(age < 0, "future").when(age <= recent_days, "alert").otherwise("catch_up")
    return releases.join(seen.select(F.col("release_id").alias("s")), releases.release_id == F.col("s"), "left").select("release_id", decision.alias("decision"))


class _Releases:
    """The merged releases of one band, by key and by what their fields say now."""

    def __init__(self) -> None:
        self.by_key: dict[str, Row] = {}  # in the order of first observations
        self.by_fields: dict[tuple, dict[int, str]] = {}  # place of first observation -> key

    @staticmethod
    def fields(release: Row) -> tuple:
        return (release["canonical"], release["type"], release["release_date"], release["precision"])

    def take(self, seen: Row) -> None:
        same = self.by_fields.get(self.fields(seen))
        key = same[min(same)] if same else seen["key"]
        prior = self.by_key.get(key)
        if prior is None:
            merged = seen | {"place": len(self.by_key), "sources": [seen["source"]]}
        else:
            self.by_fields[self.fields(prior)].pop(prior["place"])
            later = {c: seen[c] for c in ("canonical", "title", "type", "release_date", "precision")}
            spotify = {c: seen[c] for c in ("provider_id", "url")} if seen["source"] == "Spotify" else {}
            merged = prior | later | spotify | {"mbid": prior["mbid"] or seen["mbid"], "first_seen": prior["first_seen"] or seen["first_seen"]}
            merged["sources"] = prior["sources"] + [seen["source"]] * (seen["source"] not in prior["sources"])
        self.by_key[key] = merged
        self.by_fields.setdefault(self.fields(merged), {})[merged["place"]] = key


def merged_releases(rows: DataFrame, decompose: bool = True) -> DataFrame:
    """Observations (band_id, ord, source, title, type, release_date, precision, mbid, provider_id, url, artists, first_seen) as one row for each release.

    Each observation, in the order of ``ord``, joins the first release whose fields as merged so far say
    the same title, type, day and precision, else the one of its own key, else it starts one. Later
    titles, types and days win, even unknown ones; a Spotify observation sets id and url; the first mbid and
    first_seen stay; sources are collected in order.
    """
    lower = lambda c: norm_artist(F.col(c), decompose)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    canonical = canonical_title(F.col("title"), decompose)
    credited = F.array_join(F.array_sort(F.coalesce("artists", F.array().cast("array<string>"))), ",")
    own = F.concat(F.lit("spotify:"), F.concat_ws("|", text("band_id"), canonical, lower("type"), text("release_date"), text("precision"), credited))
    key = F.when(F.coalesce(F.col("mbid"), F.lit("")) != "", F.concat(F.lit("mbid:"), "mbid")).otherwise(own)
    seen = rows.withColumns({"canonical": canonical, "key": key})
    out = ["title", "type", "release_date", "precision", "provider_id", "url", "mbid", "first_seen", "sources"]
    schema = "band_id long, place long, title string, type string, release_date string, precision string, provider_id string, url string, mbid string, first_seen long, sources array<string>"

    def step(releases: _Releases, row: Row) -> list[Row]:
        releases.take(row)
        return []

    def finish(releases: _Releases) -> list[Row]:
        return [{c: r[c] for c in ("band_id", "place", *out)} for r in releases.by_key.values()]

    return ordered_fold(seen.withColumn("release_date", F.col("release_date").cast("string")), ["band_id"], ["ord"], _Releases, step, schema, finish)


def structured_news(releases: DataFrame, today: str, recent_days: int = 14) -> DataFrame:
    """News items of allowed releases: undated, or with a full day (text ``release_day``) at most ``recent_days`` old."""
    day = full_date(F.col("release_day"))
    fresh = F.col("release_day").isNull() | (day.isNotNull() & (F.datediff(F.lit(today).cast("date"), day) <= recent_days))
    headline = F.concat(F.lit("New "), F.lower("type"), F.lit(": "), "title")
    return releases.where(allowed_release(F.col("type"), F.col("title")) & fresh).select("release_id", "band_id", headline.alias("headline"), day.alias("d"))


def fresh_news(items: DataFrame, today: str, recent_days: int = 14) -> DataFrame:
    """Undated items and those at most ``recent_days`` old."""
    return items.where(F.col("d").isNull() | (F.datediff(F.lit(today).cast("date"), "d") <= recent_days))


def first_of_key(items: DataFrame, existing: DataFrame) -> DataFrame:
    """The first item of each band, category and lower-case headline that no existing item has."""
    key = lambda: F.concat_ws("|", F.col("band_id").cast("string"), "category", F.lower("headline"))
    known = existing.select(key().alias("key")).distinct()
    return items.withColumn("key", key()).join(known, "key", "left_anti").groupBy("key").agg(F.min("ord").alias("ord"))


def news_list(items: DataFrame) -> DataFrame:
    """All items with their place in one list, newest first; undated ones come last, equal ones as given."""
    return global_rank(items, [F.desc_nulls_last("found"), F.asc("ord")])


def upsert(existing: DataFrame, observed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Observed values win where known; rows of either side stay."""
    a = existing.select(key, *[F.col(c).alias(f"old_{c}") for c in columns])
    b = observed.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    return a.join(b, key, "full_outer").select(key, *[F.coalesce(f"new_{c}", f"old_{c}").alias(c) for c in columns])


def unseen(rows: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that match no baseline row on any of the keys; one anti join for each key."""
    return reduce(lambda df, k: df.join(baseline.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti"), keys, rows)


# --- work -------------------------------------------------------------------------------------


def fair_pick(tasks: DataFrame, cap: int) -> DataFrame:
    """Tasks by priority, then by how many tasks of the band come before, then due day, activity, band and kind."""
    order = ["priority", "due", "activity", "kind"]
    nth = F.row_number().over(W.partitionBy("band_id").orderBy(*order)) - 1
    rank = ["priority", "round", "due", "activity", "band_id", "kind"]
    top = tasks.withColumn("round", nth.cast("long")).orderBy(*rank).limit(cap)
    return top.withColumn("place", F.row_number().over(W.orderBy(*rank)).cast("long"))


DAY_MS = 86_400_000
#: Days until the next look after one, two and three or more empty ones, and after a find.
EMPTY_DAYS, ACTIVE_DAYS = (30, 60, 90), 28


def check_state(bands: DataFrame, trusted: DataFrame) -> DataFrame:
    """Bands (band_id, empty, checked_ms, next_ms, found_ms) after what their shows (band_id, at_ms) say: a show found since the last look resets the empty ones."""
    latest = trusted.groupBy("band_id").agg(F.max("at_ms").alias("trusted_ms"))
    both = bands.join(latest, "band_id", "left")
    reset = F.coalesce(F.col("trusted_ms") > F.col("checked_ms"), F.col("trusted_ms").isNotNull())
    return both.select(
        "band_id",
        "checked_ms",
        F.when(reset, 0).otherwise(F.greatest(F.lit(0), F.coalesce("empty", F.lit(0)))).cast("long").alias("empty"),
        F.when(reset, F.col("trusted_ms") + ACTIVE_DAYS * DAY_MS).otherwise(F.col("next_ms")).alias("next_ms"),
        F.coalesce("found_ms", "trusted_ms").alias("found_ms"),
        reset.alias("reset"),
    )


def due_bands(bands: DataFrame, trusted: DataFrame, now_ms: int) -> DataFrame:
    """(band_id, reason, priority, empty) of the bands to look at now: never looked at, reset, never empty, empty before."""
    rows = check_state(bands, trusted)
    waits = F.col("checked_ms").isNotNull() & F.coalesce(F.col("next_ms") > now_ms, F.lit(False))
    kind = F.when(F.col("checked_ms").isNull(), F.struct(F.lit("first_concert_web_check").alias("reason"), F.lit(0).alias("priority")))
    kind = kind.when(F.col("reset"), F.struct(F.lit("ticketmaster_activity_reset").alias("reason"), F.lit(1).alias("priority")))
    kind = kind.when(F.col("empty") == 0, F.struct(F.lit("supplemental_concert_check").alias("reason"), F.lit(2).alias("priority")))
    kind = kind.otherwise(F.struct(F.lit("inactive_backoff_due").alias("reason"), F.lit(3).alias("priority")))
    return rows.where(~waits).select("band_id", kind.alias("k"), "empty").select("band_id", "k.reason", F.col("k.priority").cast("long").alias("priority"), "empty")


def next_state(bands: DataFrame, trusted: DataFrame, found: Column, now_ms: int) -> DataFrame:
    """The state after a look: a find counts from now, an empty look is counted up to three and waits longer each time."""
    rows = check_state(bands, trusted).withColumn("hit", F.coalesce(found, F.lit(False)))
    empty = F.when(F.col("hit"), 0).otherwise(F.least(F.lit(len(EMPTY_DAYS)), F.col("empty") + 1))
    days = F.when(F.col("hit"), ACTIVE_DAYS).otherwise(F.get(F.array(*[F.lit(d) for d in EMPTY_DAYS]), (empty - 1).cast("int")))
    return rows.select("band_id", empty.cast("long").alias("empty"), (F.lit(now_ms) + days.cast("long") * DAY_MS).alias("next_ms"), F.when(F.col("hit"), F.lit(now_ms)).otherwise(F.col("found_ms")).alias("found_ms"), F.when(F.col("hit"), "concerts_found").otherwise("no_concerts_found").alias("result"))


def metadata_tasks(bands: DataFrame, now_ms: int, refresh_days: int) -> DataFrame:
    """(band_id, kind, priority, due_ms, reason) of the bands whose metadata is due.

    bands (band_id, artist_name, success_ms, attempt_ms, next_ms, failed). Without a name the first look or
    its retry is due; then a set time counts, else the last success and ``refresh_days``.
    """
    named = F.coalesce(F.trim("artist_name") != "", F.lit(False))
    set_time, failed, never = F.col("next_ms").isNotNull(), F.coalesce("failed", F.lit(False)), F.col("success_ms").isNull()
    due = F.when(~named, F.coalesce("next_ms", "attempt_ms", F.lit(0))).when(set_time, F.col("next_ms")).otherwise(F.coalesce(F.col("success_ms") + refresh_days * DAY_MS, F.lit(0)))
    late = F.when(~named, ~F.coalesce(F.col("next_ms") > now_ms, F.lit(False))).otherwise(due <= now_ms)
    first = ~named | (set_time & failed) | (~set_time & never)
    retry = (~named | set_time) & failed
    reason = F.when(retry, "metadata_retry_due").when(~named | (~set_time & never), "metadata_bootstrap").otherwise("metadata_retained_due")
    return bands.where(late).select("band_id", F.lit("metadata").alias("kind"), F.when(first, 0).otherwise(1).cast("long").alias("priority"), due.alias("due_ms"), reason.alias("reason"))


def release_tasks(bands: DataFrame, now_ms: int, refresh_days: int) -> DataFrame:
    """The same for release lists: bands (band_id, status, continues, success_ms, attempt_ms, next_ms)."""
    status = F.coalesce("status", F.lit("not_started"))
    unfinished = (status != "complete") | F.coalesce("continues", F.lit(False))
    kept = F.coalesce(F.col("success_ms") + refresh_days * DAY_MS, F.lit(0))
    due = F.when(unfinished, F.coalesce("next_ms", "attempt_ms", "success_ms", F.lit(0))).otherwise(F.greatest(kept, F.coalesce("next_ms", kept)))
    reason = F.when(~unfinished, "release_retained_due").when(status == "not_started", "release_bootstrap").otherwise("release_continuation_or_retry")
    return bands.where(due <= now_ms).select("band_id", F.lit("release").alias("kind"), F.when(unfinished, 0).otherwise(1).cast("long").alias("priority"), due.alias("due_ms"), reason.alias("reason"))


#: How lately a band was heard, most recent first.
ACTIVITY = ["fourteenDays", "threeMonths", "oneYear", "allTime", "noHistory"]


def image_maintenance(bands: DataFrame, cap: int = 10) -> DataFrame:
    """The ``cap`` bands to look up images for, with their place.

    bands (band_id, has_image, duplicate, spotify_id, eligible, identity_id, next_ms, bucket, listens, rank, now_ms):
    bands with an image, with an id of another band, not eligible for a first identity, or not due again
    are left out. Most recent activity first, then those with an identity, most listens, best rank, id.
    """
    known = F.col("spotify_id").isNotNull()
    due = F.col("identity_id").isNull() | (F.col("identity_id") != F.col("spotify_id")) | F.col("next_ms").isNull() | (F.col("next_ms") <= F.col("now_ms"))
    some = bands.where("not has_image and not duplicate").where(F.when(known, due).otherwise(F.col("eligible")))
    bucket = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(b) for b in ACTIVITY]), F.col("bucket")), F.lit(0)), F.lit(len(ACTIVITY)))
    order = [bucket, F.col("spotify_id").isNull(), F.desc("listens"), F.asc_nulls_last("rank"), F.col("band_id").cast("string")]
    top = some.orderBy(*order).limit(cap)
    return top.select("band_id", "spotify_id", F.row_number().over(W.orderBy(*order)).cast("long").alias("place"))


# --- due checks: each is a condition on state columns --------------------------------------------


def prediction_due(status: Column, generated_ms: Column, now_ms: int, refresh_days: int = 7) -> Column:
    """No ready prediction, or one of ``refresh_days`` ago."""
    return F.coalesce((status != "ready") | (generated_ms + refresh_days * DAY_MS <= now_ms), F.lit(True))


def links_due(status: Column, songs: Column, version: Column, artist: Column, identity: Column, match_status: Column, next_ms: Column, now_ms: int, current: int = 2) -> Column:
    """A ready prediction with songs whose links are of another version or artist, missing, or failed and ripe for another try."""
    ready = F.coalesce((status == "ready") & (songs > 0), F.lit(False))
    again = F.coalesce(next_ms <= now_ms, F.lit(True))
    wanted = F.when(~version.eqNullSafe(F.lit(current)), True).when(identity.isNotNull() & ~artist.eqNullSafe(identity), True).when(match_status.isNull(), True).when(match_status.isin("error", "quota_blocked"), again).otherwise(False)
    return ready & wanted


def setlist_check_due(attending: Column, day: Column, has_setlist: Column, checked: Column, today: str, recheck_days: int = 7) -> Column:
    """Attended past shows without a setlist, not looked up in the last ``recheck_days``."""
    now = F.lit(today).cast("date")
    recently = F.coalesce(F.datediff(now, checked) < recheck_days, F.lit(False))
    return attending & F.coalesce(day < now, F.lit(False)) & ~has_setlist & ~recently


def songs_unchecked(songs: DataFrame) -> DataFrame:
    """Setlists with a song that is no cover and was not looked up."""
    return songs.where("not is_cover and not checked").select("setlist").distinct()


def artist_due(scopes: DataFrame, artists: DataFrame, now_ms: int, wanted: tuple[str, ...] = ("release_artist", "release_track_artist")) -> DataFrame:
    """(artist, due): artists without a catalogue, with an unfinished scope, or no longer fresh."""
    done = scopes.where(F.col("complete") & F.col("scope").isin(*wanted)).groupBy("artist").agg((F.bool_or(F.col("scope") == wanted[0]) & F.bool_or(F.col("scope") == wanted[1])).alias("whole"))
    rows = artists.join(done, "artist", "left")
    return rows.select("artist", (~F.coalesce("whole", F.lit(False)) | F.coalesce(F.col("fresh_until_ms") <= now_ms, F.lit(True))).alias("due"))


def assembled(scopes: DataFrame, now_ms: int, fresh_days: int = 30, wanted: tuple[str, ...] = ("release_artist", "release_track_artist")) -> DataFrame:
    """(artist, scopes, complete, fresh_until_ms): an artist is complete and fresh once all wanted scopes are."""
    rows = scopes.groupBy("artist").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("complete"), F.col("scope")))), ",").alias("scopes"))
    complete = F.col("scopes") == ",".join(sorted(wanted))
    return rows.withColumns({"complete": complete, "fresh_until_ms": F.when(complete, F.lit(now_ms + fresh_days * DAY_MS))})


def run_due(last_ms: Column, now_ms: int, hours: int) -> Column:
    """Never run, or ``hours`` ago."""
    return F.coalesce(last_ms + hours * 3_600_000 <= now_ms, F.lit(True))


def remaining_budget(reservations: DataFrame, key: str, now_ms: int, cap: int) -> DataFrame:
    """(key, reserved, remaining) of the last 24 hours. A reservation in the future fails the query: it is no quota to forget."""
    at = F.when(F.col("at_ms") > now_ms, F.raise_error(F.concat(F.lit("reservation in the future: "), F.col("at_ms").cast("string"))).cast("long")).otherwise(F.col("at_ms"))
    active = at > now_ms - DAY_MS
    sums = reservations.groupBy(key).agg(F.sum(F.when(active, F.col("n"))).alias("reserved")).where("reserved is not null")
    return sums.withColumn("remaining", F.greatest(F.lit(0), cap - F.col("reserved")))


def backfill_plan(source: DataFrame, existing: DataFrame, not_found: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` ids by name that neither have a record nor were looked for in vain."""
    left = source.select("id").distinct().join(existing.select("id"), "id", "left_anti").join(not_found.select("id"), "id", "left_anti")
    return left.orderBy("id").limit(cap)


def page_after(rows: DataFrame, key: str, cursor, cap: int) -> DataFrame:
    """The next page by key; behind the end it begins again."""
    after = rows.where(F.col(key) > F.lit(cursor)).orderBy(key).limit(cap)
    wrapped = rows.where(F.col(key) <= F.lit(cursor)).orderBy(key).limit(cap)
    return after.withColumn("wrap", F.lit(0)).unionByName(wrapped.withColumn("wrap", F.lit(1))).orderBy("wrap", key).limit(cap).drop("wrap")


def rotated(rows: DataFrame, index: str, offset: int, n: int) -> DataFrame:
    """Places when the list starts at ``offset``."""
    return rows.withColumn("place", F.pmod(F.col(index) - offset, F.lit(n)))


def trailing_sum(rows: DataFrame, at: str, value: str, span_ms: int, *keys: str) -> DataFrame:
    """The sum over the last ``span_ms`` before and at each row, per key."""
    return rows.withColumn("used", F.sum(value).over(W.partitionBy(*keys).orderBy(at).rangeBetween(-span_ms, 0)))


#: Words for the three states of a run, from good to bad.
STATES = {"ok": ["ok", "success", "successful", "complete", "completed", "healthy"], "attention": ["attention", "partial", "deferred", "warning", "needs_attention"], "error": ["error", "failed", "failure"]}


def run_state(status: Column) -> Column:
    """Ok, attention or error; unknown words are ok."""
    low = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return F.when(low.isin(STATES["error"]), "error").when(low.isin(STATES["attention"]), "attention").otherwise("ok")


def merged_activity(reports: DataFrame, key: str) -> DataFrame:
    """Reports (key, ord, status, work, changes, reason) merged in order: the worst state, the last known counts and reason."""
    state = run_state(F.col("status"))
    last = lambda c, ok: F.max_by(c, F.when(ok, F.col("ord")))
    count = lambda c: last(F.floor(c).cast("long"), F.col(c) >= 0)
    worst = F.when(F.bool_or(state == "error"), "error").when(F.bool_or(state == "attention"), "attention").otherwise("ok")
    reason = F.substring(F.trim(F.regexp_replace(last("reason", F.col("reason").isNotNull()), r"[\r\n\t]+", " ")), 1, 140)
    return reports.groupBy(key).agg(worst.alias("status"), count("work").alias("work"), count("changes").alias("changes"), reason.alias("reason"))


def latest_runs(runs: DataFrame, key: str) -> DataFrame:
    """X5."""
    return runs.groupBy(key).agg(F.max_by("run", F.struct("finished", "run")).alias("run"), F.max("finished").alias("finished"))


# --- merging ----------------------------------------------------------------------------------


def merged_field(kind: T.DataType, base: Column, mine: Column, theirs: Column) -> Column:
    """M1: my value if only I changed it, theirs if only they did; structs are merged field by field, other conflicts are mine."""
    both = mine
    if isinstance(kind, T.StructType):
        fields = [merged_field(f.dataType, base[f.name], mine[f.name], theirs[f.name]).alias(f.name) for f in kind]
        both = F.when(mine.isNotNull() & theirs.isNotNull(), F.struct(*fields)).otherwise(mine)
    return F.when(mine.eqNullSafe(base), theirs).when(theirs.eqNullSafe(base), mine).otherwise(both)


def three_way(base: DataFrame, mine: DataFrame, theirs: DataFrame, key: str, columns: list[str], order: str | None = None) -> DataFrame:
    """M1, M2, S3: rows of three versions by key.

    My rows stay, with each field merged. A row that I deleted stays only if they changed it; one that they
    deleted and I still have stays as mine. With ``order`` (a column of all three) rows come in their order
    and my new ones behind: ``place`` sorts so.
    """
    kinds = {f.name: f.dataType for f in mine.schema}
    wanted = [*columns, *([order] if order else [])]
    side = lambda df, p: df.select(key, F.lit(True).alias(f"{p}_in"), *[F.col(c).alias(f"{p}_{c}") for c in wanted])
    full = side(base, "b").join(side(mine, "m"), key, "full_outer").join(side(theirs, "t"), key, "full_outer")
    has = {p: F.coalesce(f"{p}_in", F.lit(False)) for p in "bmt"}
    unchanged = reduce(lambda x, y: x & y, [F.col(f"t_{c}").eqNullSafe(F.col(f"b_{c}")) for c in columns])
    keep = has["m"] | (has["t"] & (~has["b"] | ~unchanged))
    pick = lambda c: F.when(~has["m"], F.col(f"t_{c}")).when(~has["t"] | ~has["b"], F.col(f"m_{c}")).otherwise(merged_field(kinds[c], F.col(f"b_{c}"), F.col(f"m_{c}"), F.col(f"t_{c}")))
    place = [F.struct(F.when(has["t"], 0).otherwise(1).alias("late"), F.coalesce(f"t_{order}", f"m_{order}").alias("at")).alias("place")] if order else []
    return full.where(keep).select(key, *[pick(c).alias(c) for c in columns], *place)


def approved_identities(bands: DataFrame, mappings: DataFrame) -> DataFrame:
    """Mappings (name, provider_id) that a person approved, put on bands (band_id, name, provider_id, confirmed).

    Every mapping must name exactly one band, must not contradict that band's confirmed id, and its id must
    not be confirmed on a band outside the mappings; ``problem`` says what is wrong. Without problems
    ``changed`` says whether the band takes the id or has it already.
    """
    named = mappings.join(bands.select("name", "band_id", F.col("provider_id").alias("own"), "confirmed"), "name", "left")
    targets = named.groupBy("name", F.col("provider_id").alias("new")).agg(F.count("band_id").alias("n"), F.min("band_id").alias("band_id"), F.min("own").alias("own"), F.bool_or("confirmed").alias("confirmed"))
    outside = bands.where("confirmed and provider_id is not null").join(targets.select("band_id"), "band_id", "left_anti").select(F.col("provider_id").alias("new"), F.lit(True).alias("taken")).distinct()
    sure = F.coalesce("confirmed", F.lit(False))
    problem = F.when(F.col("n") != 1, "not_one_band").when(sure & ~F.col("own").eqNullSafe(F.col("new")), "other_confirmed_identity").when(F.col("taken"), "confirmed_on_another_band")
    return targets.join(outside, "new", "left").select("name", F.when(F.col("n") == 1, F.col("band_id")).alias("band_id"), F.col("new").alias("provider_id"), problem.alias("problem"), (problem.isNull() & ~(sure & F.col("own").eqNullSafe(F.col("new")))).alias("changed"))


def merged_shows(latest: DataFrame, current: DataFrame, new: DataFrame) -> DataFrame:
    """The latest shows (id, checked, setlist) with what a run found: the later look, its setlist where none was, and new shows behind.

    ``current`` holds the shows that the run changed. New shows with a known id are left out.
    """
    run = current.select("id", F.col("checked").alias("r_checked"), F.col("setlist").alias("r_setlist"))
    merged = latest.join(run, "id", "left").select("id", F.greatest("checked", "r_checked").alias("checked"), F.coalesce("setlist", "r_setlist").alias("setlist"))
    return merged.unionByName(new.join(latest.select("id"), "id", "left_anti").select("id", "checked", "setlist"))


def keep_reviewed(current: DataFrame, intended: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Reviewed rows stay as they are, the others take the intended values."""
    new = intended.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    return current.join(new, current[key] == F.col("_k"), "left").withColumns({c: F.when(F.col("reviewed"), F.col(c)).otherwise(F.coalesce(f"_{c}", c)) for c in columns}).drop("_k", *[f"_{c}" for c in columns])


def history_rows(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """M5: current rows that go to history because a newer version comes."""
    new = incoming.select(F.col(key).alias("_k"), F.col("version").alias("_v"))
    return current.join(new, current[key] == F.col("_k")).where("_v <> version").drop("_k", "_v")


def roll_back(current: DataFrame, history: DataFrame, key: str, target: int) -> DataFrame:
    """M6: rows at or above ``target`` get their newest older version; without one they go; reviewed rows stay."""
    old = history.where(F.col("version") < target).groupBy(key).agg(F.max("version").alias("_v"), F.max_by("value", "version").alias("_value"))
    both = current.join(old, key, "left")
    stays = F.col("reviewed") | (F.col("version") < target)
    return both.where(stays | F.col("_v").isNotNull()).select(key, F.when(stays, F.col("version")).otherwise(F.col("_v")).alias("version"), F.when(stays, F.col("value")).otherwise(F.col("_value")).alias("value"))


def newest(rows: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """M8: the newest record of each key."""
    best = F.max_by(F.struct(*columns), F.struct(at, *columns))
    return rows.groupBy(key).agg(best.alias("x"), F.max(at).alias(at)).select(key, at, *[F.col(f"x.{c}").alias(c) for c in columns])


def united_recordings(rows: DataFrame) -> DataFrame:
    """Rows (recording, title, artist, release, release_title, release_group) as one for each recording, with its number of releases.

    ``problem`` names recordings whose rows disagree on title or artist, or give one release two titles or groups.
    """
    several = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))
    per_release = rows.groupBy("recording", "release").agg(F.min(F.lower(F.trim("title"))).alias("low"), F.max(F.lower(F.trim("title"))).alias("high"), F.min("artist").alias("a_low"), F.max("artist").alias("a_high"), (several(F.lower(F.trim("release_title"))) | several("release_group")).alias("bad"))
    united = per_release.groupBy("recording").agg(F.count("*").alias("releases"), (F.min("low") != F.max("high")).alias("titles"), (F.min("a_low") != F.max("a_high")).alias("artists"), F.bool_or("bad").alias("bad"), F.min("low").alias("title"))
    problem = F.when(F.col("titles"), "recording").when(F.col("artists"), "artist").when(F.col("bad"), "release")
    return united.select("recording", "releases", problem.alias("problem"), F.when(problem.isNull(), F.col("title")).alias("title"))


def page_problems(pages: DataFrame, releases: DataFrame) -> DataFrame:
    """M9: each catalogue page (artist, offset, n, total) with what keeps it from being merged, by its artist's pages in order.

    Pages follow each other without gaps, do not change the total, bring ``n`` releases (artist, offset,
    release) and repeat none of an earlier page.
    """
    order = W.partitionBy("artist").orderBy("offset")
    listed = releases.select("artist", "offset", "release").distinct()
    earliest = listed.withColumn("first", F.min("offset").over(W.partitionBy("artist", "release")))
    per_page = earliest.groupBy("artist", "offset").agg(F.count("*").alias("listed"), F.bool_or(F.col("first") < F.col("offset")).alias("again"))
    expected = F.coalesce(F.lag(F.col("offset") + F.col("n")).over(order), F.lit(0))
    rows = pages.withColumns({"expected": expected, "first_total": F.first("total").over(order)}).join(per_page, ["artist", "offset"], "left")
    problem = F.when(F.coalesce("listed", F.lit(0)) != F.col("n"), "releases_do_not_match").when(F.col("offset") != F.col("expected"), "not_sequential").when(F.col("total") != F.col("first_total"), "total_changed").when(F.col("again"), "release_repeated")
    return rows.select("artist", "offset", problem.alias("problem"))


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    """X33."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))
