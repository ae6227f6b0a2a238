"""Linking listens, bands, tracks and catalogue rows; identity work lists and audits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from setlight.functions.text import GENERIC_VENUE_WORDS, UNKNOWN_VENUES, norm_title
from setlight.operators.folds import Row, ordered_fold


def unique_names(bands: DataFrame) -> DataFrame:
    """L2: name or alias -> band, without names that point to more than one band."""
    names = bands.select("band_id", F.explode(F.array_distinct(F.concat(F.array("name"), "aliases"))).alias("name")).where("name <> ''")
    return names.groupBy("name").agg(F.countDistinct("band_id").alias("n"), F.min("band_id").alias("band_id")).where("n = 1").select("name", "band_id")


def mapped_band(events: DataFrame, bands: DataFrame, names: DataFrame) -> DataFrame:
    """An explicit id counts if it exists and never falls back to the name; otherwise the unique name."""
    known = bands.select(F.col("band_id").alias("known"))
    by_name = names.select(F.col("name").alias("artist"), F.col("band_id").alias("named"))
    both = events.join(known, events.explicit_id == F.col("known"), "left").join(by_name, "artist", "left")
    return both.withColumn("band_id", F.when(F.col("explicit_id").isNotNull(), F.col("known")).otherwise(F.col("named"))).drop("known", "named")


def sanitized(events: DataFrame, least_ms: int = 30_000) -> DataFrame:
    """L4: required fields; imported rows need a track id and ``least_ms``; bad optional values become null."""
    required = F.col("id").isNotNull() & F.col("ms").isNotNull() & (F.trim("title") != "") & F.col("artist").isNotNull()
    imported = (F.col("source") != "spotify_import") | (F.col("track_id").isNotNull() & (F.col("duration_ms") >= least_ms))
    return events.where(required & imported).withColumn("duration_ms", F.when(F.col("duration_ms") > 0, F.col("duration_ms")))


def first_valid(events: DataFrame, key: str, order: Column) -> DataFrame:
    """One row for each id, the first in ``order``."""
    return events.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_rn = 1").drop("_rn")


def overwrite_from(events: DataFrame, metadata: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Metadata by key replaces columns where it has a value."""
    side = metadata.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    return events.join(side, events[key] == F.col("_k"), "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop("_k", *[f"_{c}" for c in columns])


def fill_from(events: DataFrame, identities: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Only missing ids are filled."""
    side = identities.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    return events.join(side, events[key] == F.col("_k"), "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop("_k", *[f"_{c}" for c in columns])


def agreed(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Key -> value where all known values of the key agree; conflicts remove the key."""
    return rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.countDistinct(value).alias("n"), F.min(value).alias(value)).where("n = 1").drop("n")


def fill_from_siblings(events: DataFrame, group: str, value: str) -> DataFrame:
    """A missing value comes from the group if its known values agree."""
    return fill_from(events, agreed(events, group, value), group, [value])


def match_shows(candidates: DataFrame, shows: DataFrame) -> DataFrame:
    """A show by provider id, else by band, day and venue, else by band, day and city; several matches are ambiguous."""
    by_id = candidates.join(shows.select("provider_id", F.col("show").alias("s")), "provider_id").select("candidate", F.lit(1).alias("how"), "s")
    near = candidates.select("candidate", "band_id", "d", F.col("venue").alias("c_venue"), F.col("city").alias("c_city")).join(shows.select("band_id", "d", "venue", "city", F.col("show").alias("s")), ["band_id", "d"])
    by_venue = near.where("c_venue = venue").select("candidate", F.lit(2).alias("how"), "s")
    by_city = near.where("c_city = city").select("candidate", F.lit(3).alias("how"), "s")
    all_found = by_id.unionByName(by_venue).unionByName(by_city)
    best = all_found.groupBy("candidate", "how").agg(F.countDistinct("s").alias("n"), F.min("s").alias("s")).groupBy("candidate").agg(F.min(F.struct("how", "n", "s")).alias("m"))
    return candidates.select("candidate").join(best, "candidate", "left").select("candidate", F.col("m.how").cast("long").alias("how"), F.when(F.col("m.n") == 1, F.col("m.s")).alias("show"), (F.coalesce("m.n", F.lit(0)) > 1).alias("ambiguous"))


def _same_place(a: Row, b: Row) -> bool:
    return a["n_city"] != "" and a["n_city"] == b["n_city"] and not (a["n_country"] and b["n_country"] and a["n_country"] != b["n_country"])


@lru_cache(100_000)
def _same_venue(a: str, b: str) -> bool:
    """F29, for two values."""
    inner, outer = sorted((a.split(" "), b.split(" ")), key=len)
    own = any(w not in GENERIC_VENUE_WORDS for w in inner)
    return a != "" and b != "" and (a == b or (own and f" {' '.join(inner)} " in f" {' '.join(outer)} "))


def _unknown(venue: str) -> bool:
    return venue == "" or venue in UNKNOWN_VENUES


class _Records:
    """The shows known so far of one band and day, found by event id and by city, venue and traits.

    Shows of one venue that say the same of what rules ask share a place, so a candidate meets places, which
    stay few, and not every show. Of matches, two are enough to know that there are several.
    """

    def __init__(self) -> None:
        self.by_event: dict[str, dict[str, Row]] = {}
        self.by_place: dict[str, dict[str, dict[tuple, dict[str, Row]]]] = {}

    @staticmethod
    def _traits(record: Row) -> tuple:
        evidence = (record["n_address"], record["url"]) if _unknown(record["n_venue"]) else ("", "")
        return record["event_id"] != "", record["ticketmaster"], record["n_country"], *evidence

    def add(self, record: Row) -> None:
        if record["event_id"]:
            self.by_event.setdefault(record["event_id"], {})[record["id"]] = record
        if record["n_city"]:
            self.by_place.setdefault(record["n_city"], {}).setdefault(record["n_venue"], {}).setdefault(self._traits(record), {})[record["id"]] = record

    def patch(self, record: Row, values: Row) -> None:
        if record["event_id"]:
            del self.by_event[record["event_id"]][record["id"]]
        if record["n_city"]:
            places, traits = self.by_place[record["n_city"]][record["n_venue"]], self._traits(record)
            del places[traits][record["id"]]
            if not places[traits]:
                del places[traits]
        record.update(values)
        self.add(record)

    def match(self, candidate: Row, ticketmaster_only: bool) -> tuple[list[Row], str]:
        """Up to two of the matching records by the first way that finds any."""
        event, country = candidate["event_id"], candidate["n_country"]
        if event and (found := self.by_event.get(event)):
            return list(islice(found.values(), 2)), "provider_event_id"
        venues = self.by_place.get(candidate["n_city"], {})

        def near(venue: str) -> Iterator[tuple[tuple, dict[str, Row]]]:
            for traits, records in venues[venue].items():
                if not (ticketmaster_only and not traits[1]) and not (country and traits[2] and country != traits[2]) and not (event and traits[0]):
                    yield traits, records

        if candidate["ticketmaster"] and not _unknown(candidate["n_venue"]):
            evidence = lambda traits: any(x and x == candidate[c] for x, c in zip(traits[3:], ("n_address", "url")))
            recovered = list(islice((r for v in venues if _unknown(v) for traits, records in near(v) if evidence(traits) for r in records.values()), 2))
            if recovered:
                return recovered, "trusted_venue_evidence"
        return list(islice((r for v in venues if _same_venue(v, candidate["n_venue"]) for _, records in near(v) for r in records.values()), 2)), "same_show"

    def twin(self, candidate: Row) -> bool:
        event, country, venue = candidate["event_id"], candidate["n_country"], candidate["n_venue"]
        if venue == "":
            return False
        places = self.by_place.get(candidate["n_city"], {}).get(venue, {})
        if any(not (event and traits[0]) and not (country and traits[2] and country != traits[2]) for traits in places):
            return True
        return bool(event) and any(r["n_venue"] == venue and _same_place(r, candidate) for r in self.by_event.get(event, {}).values())


def _reconciled(records: _Records, row: Row) -> list[Row]:
    if row["candidate"] is None:
        records.add(row)
        return []
    decided = lambda action, show=None, how=None, ambiguous=False: [{"candidate": row["candidate"], "action": action, "show": show, "how": how, "ambiguous": ambiguous}]
    ours = row["ticketmaster"]
    found, how = records.match(row, not ours)
    if len(found) == 1:
        if not ours:
            return decided("skip_ticketmaster_duplicate", found[0]["id"], how)
        keep = {"n_venue"} if _unknown(row["n_venue"]) and not _unknown(found[0]["n_venue"]) else set()
        only = {"n_venue"} if how == "trusted_venue_evidence" else {"n_venue", "n_city", "n_country", "n_address", "url", "event_id"}
        values = {c: row[c] for c in only - keep if row[c]}
        records.patch(found[0], values if how == "trusted_venue_evidence" else values | {"ticketmaster": True})
        return decided("upgrade", found[0]["id"], how)
    if not (ours and len(found) > 1) and records.twin(row):
        return decided("skip_duplicate")
    records.add(row)
    return decided("add", ambiguous=ours and len(found) > 1)


def reconcile(candidates: DataFrame, shows: DataFrame, decompose: bool = True) -> DataFrame:
    """(candidate, action, show, how, ambiguous): what becomes of each candidate, taken in the order of ``ord``.

    Both sides: (id, ord, band_id, d, city, country, venue, address, url, event_id, ticketmaster). An
    accepted candidate is a record for those after it, and a Ticketmaster candidate that upgrades a
    record changes what later ones find; so each band's day is passed over in order, with the records of
    that day as the state. Several matches make a Ticketmaster candidate an ambiguous addition. Rows without
    band or day match nothing; ids are unique over both sides.
    """
    plain = lambda c: F.coalesce(norm_title(F.col(c), decompose), F.lit(""))
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))

    def side(rows: DataFrame, candidate: Column, rank: int) -> DataFrame:
        return rows.select("band_id", "d", F.lit(rank).alias("side"), "ord", "id", candidate.alias("candidate"), *[plain(c).alias(f"n_{c}") for c in ("city", "country", "venue", "address")], text("url").alias("url"), text("event_id").alias("event_id"), F.coalesce("ticketmaster", F.lit(False)).alias("ticketmaster"))

    known = F.col("band_id").isNotNull() & F.col("d").isNotNull()
    rows = side(shows.where(known), F.lit(None).cast("string"), 0).unionByName(side(candidates.where(known), F.col("id"), 1))
    folded = ordered_fold(rows, ["band_id", "d"], ["side", "ord"], _Records, _reconciled, "candidate string, action string, show string, how string, ambiguous boolean")
    none = F.lit(None).cast("string")
    return folded.unionByName(candidates.where(~known).select(F.col("id").alias("candidate"), F.lit("add").alias("action"), none.alias("show"), none.alias("how"), F.lit(False).alias("ambiguous")))


def track_evidence(events: DataFrame, bands: DataFrame, decompose: bool = True) -> DataFrame:
    """What events say about a song's link: (band_id, artist_id, artist, title, track_id, url), for L22.

    Events without a title or link say nothing. A second row without band and artist id stands for the
    artist's name, where only one band has it.
    """
    name = norm_title(F.col("name"), decompose)
    named = bands.select("band_id", F.col("name").alias("b_name"), F.col("artist_id").alias("b_artist"), name.alias("b_norm"))
    alone = bands.select(name.alias("norm")).groupBy("norm").count().where("count = 1 and norm <> ''").select("norm")
    artist = F.coalesce("b_name", "artist")
    rows = events.join(named, "band_id", "left").where((norm_title(F.col("title"), decompose) != "") & F.col("url").isNotNull()).withColumns({"who": artist, "norm": F.coalesce("b_norm", norm_title(F.col("artist"), decompose))})
    own = rows.select("band_id", F.col("b_artist").alias("artist_id"), F.col("who").alias("artist"), "title", "track_id", "url")
    null = lambda c: F.lit(None).cast(own.schema[c].dataType).alias(c)
    by_name = rows.join(alone, "norm", "left_semi").select(null("band_id"), null("artist_id"), F.col("who").alias("artist"), "title", "track_id", "url")
    return own.unionByName(by_name)


def identity_audit(bands: DataFrame, listens: DataFrame, now_ms: int) -> DataFrame:
    """What each band's listens amount to in overlapping windows, with distinct tracks, first and last."""
    day = 86_400_000
    windows = {"two_weeks": 14, "three_months": 91, "one_year": 365}
    sums = [F.count_if(F.col("ms") >= now_ms - n * day).alias(k) for k, n in windows.items()]
    impact = listens.groupBy("band_id").agg(F.count("*").alias("listens"), *sums, F.countDistinct("track_id").alias("tracks"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))
    return bands.select("band_id").join(impact, "band_id", "left").na.fill(0, ["listens", *windows, "tracks"])


def album_groups(listens: DataFrame, known: DataFrame) -> DataFrame:
    """Groups of a band's release title; ambiguous if a track is in several groups, or album ids or neutral artwork disagree.

    listens (ord, ms, band_id, release_title, track_id); known (track_id, album_id, artwork, neutral_artwork).
    """
    rows = listens.where("release_title is not null and track_id is not null and band_id is not null").withColumn("release", F.lower(F.trim("release_title")))
    tracks = rows.groupBy("band_id", "release", "track_id").agg(F.count("*").alias("n"), F.max("ms").alias("ms"))
    crossing = tracks.groupBy("track_id").agg((F.count("*") > 1).alias("crosses"))
    several = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))
    full = tracks.join(crossing, "track_id").join(known, "track_id", "left")
    groups = full.groupBy("band_id", "release").agg(
        F.count("*").alias("tracks"),
        F.sum("n").alias("listens"),
        F.max("ms").alias("latest_ms"),
        F.bool_or("crosses").alias("crosses"),
        several("album_id").alias("ids_disagree"),
        several("neutral_artwork").alias("artwork_disagrees"),
        F.min("album_id").alias("album_id"),
        F.min(F.when(F.col("album_id").isNotNull(), F.col("artwork"))).alias("artwork"),
        F.coalesce(F.min(F.when(F.col("album_id").isNotNull(), F.col("track_id"))), F.min("track_id")).alias("representative"),
    )
    reason = F.when(F.col("crosses"), "spotify_track_crosses_album_groups").when(F.col("ids_disagree"), "conflicting_known_spotify_album_ids").when(F.col("artwork_disagrees"), "conflicting_neutral_artwork")
    return groups.select("band_id", "release", "tracks", "listens", "latest_ms", reason.alias("ambiguous"), *[F.when(reason.isNull(), F.col(c)).alias(c) for c in ("album_id", "artwork", "representative")])


def artwork_plan(groups: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Each safe group's way to artwork: reuse what its album has, leave it alone where a try ended for good, else ask."""
    rows = groups.where("ambiguous is null").join(suppressed.select("band_id", "release", F.lit(True).alias("ended")), ["band_id", "release"], "left")
    way = F.when(F.col("album_id").isNotNull() & F.col("artwork").isNotNull(), "reusable").when(F.col("ended"), "suppressed").otherwise("provider")
    return rows.select("band_id", "release", "representative", way.alias("way"))


def artwork_coverage(listens: DataFrame) -> DataFrame:
    """Albums with any covered listen."""
    per = listens.where("release_title is not null").groupBy("band_id", "release_title").agg(F.bool_or(F.col("recording_id").isNotNull()).alias("covered"))
    return per.agg(F.count("*").alias("albums"), F.count_if("covered").alias("matched"), F.floor(F.count_if("covered") / F.count("*") * 100 + 0.5).alias("percent"))


def unresolved(listens: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct track ids without a record."""
    return listens.where("track_id is not null").select("track_id").distinct().join(known.select("track_id"), "track_id", "left_anti")
