"""Listening statistics over listens (ord, ms, band_id, titles, duration_ms, ids) and bands.

A missing duration is unknown but valid and counts as 0 ms; a duration that is present and not
positive makes the listen invalid. ``now_ms`` is always an argument. Rankings end with a unique key,
and grouped attributes come from the group's first row by ``ord``.
"""

from __future__ import annotations

from datetime import UTC, datetime
from typing import NamedTuple

from dateutil.relativedelta import relativedelta
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from setlight.functions.text import in_locale, norm_text

DAY = 86_400_000
BUCKETS = {"twoWeeks": "day", "threeMonths": "week", "oneYear": "month", "allTime": "year"}


class Span(NamedTuple):
    """Half-open windows in milliseconds; ``previous`` is None where there is none."""

    start: int | None
    end: int
    previous: int | None
    bucket: str


def resolve_window(timeframe: str, now_ms: int) -> Span:
    """A1: the current and the previous window; month and year shifts clamp the day. An all-time start is the earliest listen."""
    if timeframe == "allTime":
        return Span(None, now_ms + 1, None, "year")
    if timeframe == "twoWeeks":
        start = now_ms - 14 * DAY
        return Span(start, now_ms + 1, start - 14 * DAY, "day")
    step = relativedelta(months=3) if timeframe == "threeMonths" else relativedelta(years=1)
    now = datetime.fromtimestamp(now_ms / 1000, UTC)
    millis = lambda t: round(t.timestamp() * 1000)
    return Span(millis(now - step), now_ms + 1, millis(now - step - step), BUCKETS[timeframe])


def valid() -> Column:
    return F.col("ms").isNotNull() & (F.col("duration_ms").isNull() | (F.col("duration_ms") > 0))


def known_duration() -> Column:
    return F.when(F.col("duration_ms") > 0, F.col("duration_ms")).otherwise(0)


def linked(listens: DataFrame, bands: DataFrame) -> DataFrame:
    """L1: valid listens of bands that exist."""
    return listens.where(valid()).join(bands.select("band_id"), "band_id", "left_semi")


def in_window(listens: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Valid listens in [start, end)."""
    out = listens.where(valid())
    if start is not None:
        out = out.where(F.col("ms") >= start)
    return out if end is None else out.where(F.col("ms") < end)


def measures() -> list[Column]:
    return [F.sum(known_duration()).alias("duration_ms"), F.count("*").alias("listen_count"), F.max("ms").alias("last_ms")]


def ranked(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first ``limit`` rows with their rank: a bounded global sort, then a rank over those rows only."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))


def top_bands(listens: DataFrame, bands: DataFrame, limit: int = 100) -> DataFrame:
    """A2: bands by duration, count, recency, id."""
    sums = linked(listens, bands).groupBy("band_id").agg(*measures())
    return ranked(sums, limit, F.desc("duration_ms"), F.desc("listen_count"), F.desc("last_ms"), F.asc("band_id"))


def top_bands_by_name(listens: DataFrame, bands: DataFrame, limit: int = 100, decompose: bool = True) -> DataFrame:
    """A2 as the first statistics had it: bands by duration and count, equal ones by their names in the reader's order."""
    sums = linked(listens, bands).groupBy("band_id").agg(*measures()).join(bands.select("band_id", "name"), "band_id")
    name = in_locale(norm_text(F.col("name"), decompose))
    return ranked(sums, limit, F.desc("duration_ms"), F.desc("listen_count"), name.asc(), F.asc("band_id"))


def movement(current: DataFrame, previous: DataFrame | None, key: str, trusted: str | None = None) -> DataFrame:
    """Up, down or new against the previous ranking; untrusted rows have none."""
    if previous is None:
        return current.withColumns({"movement": F.lit(None).cast("string"), "delta": F.lit(None).cast("long")})
    old = previous.where(trusted) if trusted else previous
    both = current.join(old.select(F.col(key).alias("_key"), F.col("rank").alias("_rank")), F.col(key) == F.col("_key"), "left")
    moved = F.when(F.col("_rank").isNull(), "new").when(F.col("_rank") > F.col("rank"), "up").when(F.col("_rank") < F.col("rank"), "down")
    gap = F.when(F.col("_rank") != F.col("rank"), F.abs(F.col("_rank") - F.col("rank")))
    if trusted:
        moved, gap = F.when(F.expr(trusted), moved), F.when(F.expr(trusted), gap)
    return both.withColumns({"movement": moved, "delta": gap}).drop("_key", "_rank")


def top_bands_moving(listens: DataFrame, bands: DataFrame, timeframe: str, now_ms: int, limit: int = 100) -> DataFrame:
    span = resolve_window(timeframe, now_ms)
    current = top_bands(in_window(listens, span.start, span.end), bands, limit)
    previous = None if span.previous is None else top_bands(in_window(listens, span.previous, span.start), bands, limit)
    return movement(current, previous, "band_id")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s+", " ")


def top_items(listens: DataFrame, kind: str, limit: int = 10, normalize=F.lower) -> DataFrame:
    """A3: tracks or albums by count, duration, recency; stable ids first, else the text key."""
    title = F.trim("recording_title") if kind == "track" else squeeze(F.col("release_title"))
    artist = F.coalesce(F.col("band_id").cast("string"), F.lit(""))
    text = F.concat_ws("|", artist, normalize(title), *([F.coalesce(normalize(squeeze(F.col("release_title"))), F.lit(""))] if kind == "track" else []))
    key = F.coalesce(F.concat(F.lit("stable:"), "recording_id"), text) if kind == "track" else text
    rows = listens.where(valid()).withColumns({"title": title, "key": key}).where("title <> ''")
    sums = rows.groupBy("key").agg(*measures(), F.min_by(F.struct("title", "band_id"), "ord").alias("first"))
    flat = sums.select("key", "first.title", "first.band_id", "listen_count", "duration_ms", "last_ms")
    return ranked(flat, limit, F.desc("listen_count"), F.desc("duration_ms"), F.desc("last_ms"), F.asc("key"))


def rank_recordings(listens: DataFrame, limit: int = 100) -> DataFrame:
    """A4, A5: trusted ids make a group, other listens stand alone; ids of a group that disagree are dropped."""
    key = F.coalesce(F.concat(F.lit("recording:"), "recording_id"), F.concat(F.lit("spotify:"), "track_id"), F.concat(F.lit("event:"), "ord"))
    rows = listens.where(valid() & (F.trim("recording_title") != "")).withColumns({"key": key, "trusted": F.coalesce("recording_id", "track_id").isNotNull()})
    sums = rows.groupBy("key", "trusted").agg(*measures(), F.min_by("recording_title", "ord").alias("title"), F.countDistinct("track_id").alias("track_ids"), F.min("track_id").alias("one"))
    flat = sums.select("key", "trusted", "title", "listen_count", "duration_ms", "last_ms", F.when(F.col("track_ids") == 1, F.col("one")).alias("track_id"), (F.col("track_ids") > 1).alias("conflict"))
    return ranked(flat, limit, F.desc("listen_count"), F.desc("duration_ms"), F.desc("last_ms"), F.asc("key"))


def edition_albums(listens: DataFrame, edition: str, limit: int = 10) -> DataFrame:
    """Albums by text, split by edition id only where one text has more than one id."""
    rows = listens.where(valid() & (F.trim("release_title") != "")).withColumn("text_key", F.concat_ws("|", F.col("band_id").cast("string"), F.lower(squeeze(F.col("release_title")))))
    split = rows.groupBy("text_key").agg((F.countDistinct(edition) > 1).alias("split"))
    keyed = rows.join(split, "text_key").withColumn("key", F.when(F.col("split") & F.col(edition).isNotNull(), F.concat_ws("#", "text_key", edition)).otherwise(F.col("text_key")))
    sums = keyed.groupBy("key").agg(*measures())
    return ranked(sums, limit, F.desc("listen_count"), F.desc("duration_ms"), F.desc("last_ms"), F.asc("key"))


def bucket_start(ms: Column, kind: str) -> Column:
    """UTC start of the day, ISO week, month or year."""
    return F.date_trunc(kind, F.timestamp_millis(ms)).cast("date")


def time_buckets(listens: DataFrame, span: Span, kind: str | None = None) -> DataFrame:
    """Zero-filled sums from the first to the last bucket of the window."""
    kind = kind or span.bucket
    rows = in_window(listens, span.start, span.end)
    start = F.lit(span.start).cast("long") if span.start is not None else F.col("low")
    low = rows.agg(F.min("ms").alias("low"))
    spine = low.select(F.explode(F.sequence(bucket_start(start, kind), bucket_start(F.lit(span.end - 1), kind), F.expr(f"interval 1 {kind}"))).alias("start_at"))
    sums = rows.groupBy(bucket_start(F.col("ms"), kind).alias("at")).agg(F.sum(known_duration()).alias("duration_ms"), F.count("*").alias("listen_count"), F.count_if(known_duration() == 0).alias("unknown_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return spine.join(sums, F.col("start_at") == F.col("at"), "left").select("start_at", zero("duration_ms"), zero("listen_count"), zero("unknown_count"))


def most_active(buckets: DataFrame) -> DataFrame:
    """The bucket with most duration, then count, then the earliest."""
    return buckets.orderBy(F.desc("duration_ms"), F.desc("listen_count"), "start_at").limit(1)


GROUPS = ["Rock", "Pop", "Hip-hop/R&B", "Electronic", "Other"]


def genre_by_year(listens: DataFrame, bands: DataFrame, group: Column) -> DataFrame:
    """Per year and group durations, counts, unknown counts and shares in percent with one decimal."""
    dim = bands.select("band_id", group.alias("grp"))
    year = F.year(F.timestamp_millis("ms")).cast("long").alias("year")
    pivoted = (
        listens.where(valid()).join(dim, "band_id").groupBy(year).pivot("grp", GROUPS)
        .agg(F.coalesce(F.sum(known_duration()), F.lit(0)).alias("ms"), F.count(F.lit(1)).alias("n"), F.count_if(known_duration() == 0).alias("unknown"))
    )
    col = lambda g, k: F.coalesce(F.col(f"`{g}_{k}`"), F.lit(0))
    total = {k: sum((col(g, k) for g in GROUPS), F.lit(0)) for k in ("ms", "n", "unknown")}
    share = lambda x, of: F.when(of > 0, F.floor(x / of * 1000 + 0.5) / 10).otherwise(0.0)
    return pivoted.select(
        "year",
        total["ms"].alias("total_ms"),
        total["n"].alias("total_n"),
        total["unknown"].alias("total_unknown"),
        *[col(g, k).alias(f"g{i}_{k}") for i, g in enumerate(GROUPS) for k in ("ms", "n", "unknown")],
        *[share(col(g, "ms"), total["ms"]).alias(f"g{i}_pct") for i, g in enumerate(GROUPS)],
        *[share(col(g, "n"), total["n"]).alias(f"g{i}_listen_pct") for i, g in enumerate(GROUPS)],
    )


def genre_by_year_residual(listens: DataFrame, bands: DataFrame, group: Column) -> DataFrame:
    """Shares of known durations; the last group gets what is left of 100."""
    known = listens.where("duration_ms > 0")
    full = genre_by_year(known, bands, group)
    named = sum((F.col(f"g{i}_pct") for i in range(len(GROUPS) - 1)), F.lit(0.0))
    return full.select("year", "total_ms", *[f"g{i}_pct" for i in range(len(GROUPS) - 1)], (F.floor((100 - named) * 10 + 0.5) / 10).alias(f"g{len(GROUPS) - 1}_pct"))


def dominant_genre(by_year: DataFrame) -> DataFrame:
    """The group with the largest duration-weighted share; ties go to the earlier group."""
    weights = by_year.agg(*[F.sum(F.col("total_ms") * F.col(f"g{i}_pct") / 100).alias(f"w{i}") for i in range(len(GROUPS))])
    rows = weights.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(g).alias("grp"), F.col(f"w{i}").alias("w")) for i, g in enumerate(GROUPS)])).alias("x"), sum((F.col(f"w{i}") for i in range(len(GROUPS))), F.lit(0.0)).alias("total"))
    return rows.select("x.*", "total").where("total > 0").orderBy(F.desc("w"), "i").limit(1).select("grp", F.floor(F.col("w") / F.col("total") * 100 + 0.5).alias("pct"))


def yearly(listens: DataFrame, bands: DataFrame, now_year: int, genre: str | None, group: Column) -> DataFrame:
    """Zero-filled years from the first linked listen, found before the genre filter, to the current year."""
    rows = listens.where(valid()).join(bands.select("band_id", group.alias("grp")), "band_id").withColumn("year", F.year(F.timestamp_millis("ms")).cast("long"))
    spine = rows.agg(F.min("year").alias("low")).where("low is not null").select(F.explode(F.sequence("low", F.lit(now_year).cast("long"))).alias("y"))
    some = rows.where(F.col("grp") == genre) if genre else rows
    sums = some.groupBy("year").agg(F.sum(known_duration()).alias("duration_ms"), F.count("*").alias("listen_count"), F.count_if(known_duration() == 0).alias("unknown_count"))
    return spine.join(sums, F.col("y") == F.col("year"), "left").select(F.col("y").alias("year"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("duration_ms", "listen_count", "unknown_count")], (F.col("y") == now_year).alias("is_current"))


def totals(listens: DataFrame) -> DataFrame:
    """Total duration, counts, and the first and last listen (the first row wins ties)."""
    rows = listens.where(valid())
    return rows.agg(
        F.coalesce(F.sum(known_duration()), F.lit(0)).alias("duration_ms"),
        F.count("*").alias("listen_count"),
        F.count_if(known_duration() == 0).alias("unknown_count"),
        F.min_by("ord", F.struct("ms", "ord")).alias("first_listen"),
        F.max_by("ord", F.struct(F.col("ms"), -F.col("ord"))).alias("last_listen"),
    )


def selected_stats(listens: DataFrame, bands: DataFrame, timeframe: str, now_ms: int) -> DataFrame:
    """All that a window's page shows, as (section, place, key, duration_ms, listen_count, movement).

    Sections: total, unknown (listens without a duration), first and last (key is the listen), distinct_bands,
    band (with movement), track, album, bucket (key is its day) and most_active.
    """
    span = resolve_window(timeframe, now_ms)
    source = linked(listens, bands)
    selected = in_window(source, span.start, span.end)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")

    def rows(df: DataFrame, section: str, place: Column, key: Column, duration: Column, count: Column, moved: Column = none) -> DataFrame:
        return df.select(F.lit(section).alias("section"), place.cast("long").alias("place"), key.cast("string").alias("key"), duration.cast("long").alias("duration_ms"), count.cast("long").alias("listen_count"), moved.alias("movement"))

    sums = totals(selected)
    buckets = time_buckets(source, span)
    named = [F.col(c) for c in ("duration_ms", "listen_count")]
    parts = [
        rows(sums, "total", zero, none, *named),
        rows(sums, "unknown", zero, none, zero, F.col("unknown_count")),
        rows(sums, "first", zero, F.col("first_listen"), zero, zero),
        rows(sums, "last", zero, F.col("last_listen"), zero, zero),
        rows(selected.agg(F.countDistinct("band_id").alias("n")), "distinct_bands", zero, none, zero, F.col("n")),
        rows(top_bands_moving(listens, bands, timeframe, now_ms), "band", F.col("rank"), F.col("band_id"), *named, F.col("movement")),
        rows(top_items(selected, "track"), "track", F.col("rank"), F.col("key"), *named),
        rows(top_items(selected, "album"), "album", F.col("rank"), F.col("key"), *named),
        rows(buckets, "bucket", zero, F.col("start_at"), *named),
        rows(most_active(buckets), "most_active", zero, F.col("start_at"), *named),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def band_activity(listens: DataFrame, bands: DataFrame, now_ms: int) -> DataFrame:
    """Exclusive recency buckets per band with counts and recency ranks; future listens are left out."""
    now = datetime.fromtimestamp(now_ms / 1000, UTC)
    cuts = [now_ms - 14 * DAY, *(round((now - relativedelta(months=m)).timestamp() * 1000) for m in (3, 12))]
    names = ["fourteen_days", "three_months", "one_year", "all_time"]
    at = F.when(F.col("ms") >= cuts[0], names[0]).when(F.col("ms") >= cuts[1], names[1]).when(F.col("ms") >= cuts[2], names[2]).otherwise(names[3])
    sums = listens.where(F.col("ms") <= now_ms).join(bands.select("band_id"), "band_id", "left_semi").groupBy("band_id", at.alias("bucket")).agg(F.count("*").alias("n"), F.max("ms").alias("last_ms"))
    ranks = sums.withColumn("recency_rank", F.row_number().over(W.partitionBy("bucket").orderBy(F.desc("last_ms"), "band_id")).cast("long"))
    wide = ranks.groupBy("band_id").pivot("bucket", names).agg(F.first("n").alias("n"), F.first("recency_rank").alias("rank"))
    full = bands.select("band_id").join(wide, "band_id", "left")
    return full.select("band_id", *[c for x in names for c in (F.coalesce(F.col(f"{x}_n"), F.lit(0)).alias(f"{x}_n"), F.col(f"{x}_rank"))])


def concert_listening(concerts: DataFrame, listens: DataFrame, today: str, now_ms: int, months_before: int = 3, months_ahead: int = 6) -> DataFrame:
    """What was listened to around each concert.

    Past concerts look three months to either side, with the day after the window's last day as the end and
    never beyond now; upcoming ones six months back from now. Running sums per band and two as-of lookups
    answer each window, so a band with many concerts does not multiply its listens.
    """
    past = F.col("d") < F.lit(today).cast("date")
    start = F.when(past, F.unix_millis((F.add_months("d", -months_before)).cast("timestamp"))).otherwise(F.unix_millis(F.timestamp_millis(F.lit(now_ms)) - F.expr(f"interval '{months_ahead}' month")))
    end = F.when(past, F.least(F.unix_millis(F.date_add(F.add_months("d", months_before), 1).cast("timestamp")), F.lit(now_ms + 1))).otherwise(F.lit(now_ms + 1))
    windows = concerts.select(F.col("ord").alias("concert"), "band_id", start.alias("low"), end.alias("high"))
    zero = F.lit(0).cast("long")
    points = windows.select("band_id", F.explode(F.array(F.struct(F.col("low").alias("ms"), F.lit(-1).alias("sign")), F.struct(F.col("high").alias("ms"), F.lit(1).alias("sign")))).alias("p"), "concert")
    timeline = listens.where(valid()).select("band_id", "ms", F.lit(1).alias("order"), known_duration().cast("long").alias("dur"), F.lit(1).cast("long").alias("one"), F.lit(None).cast("long").alias("concert"), F.lit(None).cast("int").alias("sign")).unionByName(
        points.select("band_id", "p.ms", F.lit(0).alias("order"), zero.alias("dur"), zero.alias("one"), "concert", "p.sign")
    )
    # sums run inside blocks of a month and over each band's blocks, so a band's listens are not sorted in one task
    blocked = timeline.withColumn("block", F.floor(F.col("ms") / (30 * DAY)))
    sums = blocked.groupBy("band_id", "block").agg(F.sum("dur").alias("b_dur"), F.sum("one").alias("b_one"))
    earlier = W.partitionBy("band_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("band_id", "block", *[F.coalesce(F.sum(c).over(earlier), zero).alias(c) for c in ("b_dur", "b_one")])
    before = W.partitionBy("band_id", "block").orderBy("ms", "order").rowsBetween(W.unboundedPreceding, 0)
    inside = blocked.withColumns({"dur": F.sum("dur").over(before), "one": F.sum("one").over(before)}).where("concert is not null")
    running = inside.join(starts, ["band_id", "block"]).withColumns({"dur": F.col("dur") + F.col("b_dur"), "one": F.col("one") + F.col("b_one")})
    return running.groupBy("concert").agg(F.sum(F.col("sign") * F.col("dur")).alias("duration_ms"), F.sum(F.col("sign") * F.col("one")).alias("listen_count"))
