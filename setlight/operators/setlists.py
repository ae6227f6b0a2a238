"""Setlist analytics over sets (setlist, band_id, d, tour) and songs (setlist, name, idx, is_encore, is_cover)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from setlight.functions.text import norm_title
from setlight.operators.rounds import scratch

WINDOW_DAYS, MOST_SETS, LEAST_SETS = 730, 20, 3


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def rounded_median(values: Column) -> Column:
    """the middle value; of an even count the average of the middle two, rounded half up."""
    s, n = F.sort_array(values), F.size(values)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n % 2 == 1, low).otherwise(half_up((low + high) / 2).cast("long"))


def own_songs(sets: DataFrame, songs: DataFrame, *others: str) -> DataFrame:
    """Non-cover songs with their position among the set's own songs and the set's length."""
    order = W.partitionBy("setlist").orderBy("idx")
    real = songs.where("not is_cover and name is not null and name <> ''")
    placed = real.withColumns({"pos": (F.row_number().over(order) - 1).cast("long"), "length": F.count("*").over(W.partitionBy("setlist"))})
    return placed.join(sets, "setlist").select("setlist", "band_id", "d", "tour", F.lower("name").alias("song"), "pos", "length", "is_encore", *others)


def useful_sets(sets: DataFrame, songs: DataFrame, today: str) -> DataFrame:
    """Songs of each band's first 20 sets of the last 730 days that have own songs.

    Sets come in input order (``ord``); of several with one ``set_id`` (or, without one, of one day and
    venue) only the first counts, whether it has songs or not. ``sets`` without these columns are ordered
    by setlist and are all different.
    """
    day = F.lit(today).cast("date")
    order = F.col("ord") if "ord" in sets.columns else F.col("setlist")
    some = sets.where((F.col("d") <= day) & (F.col("d") >= F.date_sub(day, WINDOW_DAYS))).withColumn("at", order)
    if "set_id" in sets.columns:
        own_id = F.coalesce("set_id", F.concat_ws("|", F.col("d").cast("string"), F.col("venue").cast("string")))
        first = some.groupBy("band_id", own_id.alias("own_id")).agg(F.min("at").alias("at"))
        some = some.join(first.select("band_id", "at"), ["band_id", "at"], "left_semi")
    rows = own_songs(some.select("setlist", "band_id", "d", "tour", "at"), songs, "at")
    nth = F.dense_rank().over(W.partitionBy("band_id").orderBy("at"))
    return rows.withColumn("nth", nth.cast("long")).where(F.col("nth") <= MOST_SETS)


def predict(sets: DataFrame, songs: DataFrame, today: str) -> DataFrame:
    """The predicted songs of each band with at least three useful sets, in predicted order."""
    rows = useful_sets(sets, songs, today)
    per_set = rows.select("band_id", "setlist", "length").distinct()
    bands = per_set.groupBy("band_id").agg(F.count("*").alias("total"), rounded_median(F.collect_list("length")).alias("target")).where(F.col("total") >= LEAST_SETS)
    recent = F.ceil(F.col("total") / 2)
    joined = rows.join(bands, "band_id")
    position = half_up(F.when(F.col("length") > 1, F.col("pos") / (F.col("length") - 1)).otherwise(0.0) * 1000).cast("long")
    left_days = F.greatest(F.lit(0), F.lit(WINDOW_DAYS) - F.datediff(F.lit(today).cast("date"), "d"))
    per_song = joined.groupBy("band_id", "song", "total", "target").agg(
        F.count("*").alias("shows"),
        F.sum(left_days).alias("left_days"),
        rounded_median(F.collect_list(position)).alias("position"),
        F.count_if(F.col("pos") == 0).alias("opener"),
        F.count_if(F.col("pos") == F.col("length") - 1).alias("closer"),
        F.count_if("is_encore").alias("encore"),
        F.count_if(F.col("nth") <= recent).alias("recent"),
        F.count_if(F.col("nth") > recent).alias("older"),
    )
    rate = half_up(F.col("shows") / F.col("total") * 100)
    score = F.col("rate") / 100 * 0.8 + F.col("left_days") / WINDOW_DAYS / F.col("shows") * 0.2
    added = (F.col("recent") / recent >= 0.6) & ((F.col("older") == 0) | (F.col("older") / F.greatest(F.lit(1), F.col("total") - recent) <= 0.2))
    label = F.when(F.col("opener") / F.col("total") >= 0.5, "Likely opener").when(F.col("closer") / F.col("total") >= 0.5, "Common closer").when(F.col("encore") / F.col("total") >= 0.4, "Common encore").when(added, "Recently added")
    scored = per_song.withColumn("rate", rate).withColumns({"score": score, "label": label})
    best = F.row_number().over(W.partitionBy("band_id").orderBy(F.desc("score"), "song"))
    kept = scored.withColumn("rn", best).where(F.col("rn") <= F.greatest(F.lit(1), F.col("target")))
    place = F.row_number().over(W.partitionBy("band_id").orderBy("position", F.desc(F.col("opener") / F.col("total")), "song"))
    return kept.select("band_id", "song", place.cast("long").alias("place"), "rate", "label", "total")


def prediction_summary(sets: DataFrame, songs: DataFrame, today: str) -> DataFrame:
    """(band_id, status, sets, first_day, last_day, confidence, songs, fingerprint) for each band of ``sets``.

    Confidence is high for eight sets of nearly one length with well known songs, medium for five with
    known ones. The fingerprint changes with the sets used, their days and their songs; it is a digest of
    its own, not the text hash that a browser would make.
    """
    used = useful_sets(sets, songs, today)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "song", "is_encore"))), lambda x: F.concat(x["song"], F.when(x["is_encore"], "*").otherwise(""))), "\n")
    per_set = used.groupBy("band_id", "setlist", "nth", "d", "length").agg(F.sha2(line, 256).alias("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "setlist", "d", "text"))), lambda x: F.concat_ws("|", x["setlist"].cast("string"), x["d"].cast("string"), x["text"])), "\n")
    totals = per_set.groupBy("band_id").agg(F.count("*").alias("sets"), F.min_by("d", -F.col("nth")).alias("first_day"), F.min_by("d", "nth").alias("last_day"), (F.max("length") - F.min("length")).alias("spread"), F.sha2(whole, 256).alias("fingerprint"))
    predicted = predict(sets, songs, today).groupBy("band_id").agg(F.count("*").alias("songs"), F.avg("rate").alias("rate"))
    rows = sets.select("band_id").distinct().join(totals, "band_id", "left").join(predicted, "band_id", "left")
    n = F.coalesce("sets", F.lit(0))
    ready = n >= LEAST_SETS
    confidence = F.when((n >= 8) & (F.col("spread") <= 2) & (F.col("rate") >= 65), "high").when((n >= 5) & (F.col("rate") >= 45), "medium").otherwise("low")
    return rows.select(
        "band_id",
        F.when(n == 0, "unavailable").when(ready, "ready").otherwise("insufficient_data").alias("status"),
        n.alias("sets"),
        *[F.when(ready, F.col(c)).alias(c) for c in ("first_day", "last_day")],
        F.when(ready, confidence).alias("confidence"),
        F.coalesce("songs", F.lit(0)).alias("songs"),
        F.when(ready, F.col("fingerprint")).alias("fingerprint"),
    )


#: Words in a track's or album's name that make it unfit for a prediction.
UNFIT = r"\b(karaoke|tribute|cover)\b"
#: Pairs of songs and tracks that a task finds.
PAIRS_A_TASK = 2_000_000


def fitting_tracks(tracks: DataFrame, songs: DataFrame, decompose: bool = True) -> DataFrame:
    """Tracks (track_id, artist_id, title, album) for predicted songs (song_id, artist_id, name): same artist and normalised title, nothing unfit.

    There are as many tasks as the pairs need, and a title with very many pairs is split among tasks by its tracks.
    """
    known = tracks.where(~F.lower(F.concat_ws(" ", "title", "album")).rlike(UNFIT)).select("track_id", "artist_id", norm_title(F.col("title"), decompose).alias("wanted"))
    asked = songs.select("song_id", "artist_id", norm_title(F.col("name"), decompose).alias("wanted"))
    keys = ["artist_id", "wanted"]
    sizes = asked.groupBy(*keys).agg(F.count("*").alias("n")).join(known.groupBy(*keys).agg(F.count("*").alias("m")), keys)
    sizes = scratch(sizes.select(*keys, (F.col("n") * F.col("m")).alias("pairs"), F.ceil(F.col("n") * F.col("m") / PAIRS_A_TASK).alias("parts")), "title-sizes")
    n = -(-(sizes.agg(F.sum("pairs")).first()[0] or 0) // PAIRS_A_TASK)
    if n <= 1:
        return asked.join(known, keys).select("song_id", "track_id")
    parts = sizes.select(*keys, "parts")
    left = asked.join(parts, keys).select("song_id", *keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    right = known.join(parts, keys).select("track_id", *keys, F.pmod(F.xxhash64("track_id"), "parts").alias("part"))
    keys = [*keys, "part"]
    return left.repartition(n, *keys).join(right.repartition(n, *keys), keys).select("song_id", "track_id")


#: Sets and plays that a task of ``insights`` holds.
PLAYS_A_TASK = 250_000


def insights(sets: DataFrame, songs: DataFrame, compare: int = 50, least_prior: int = 20, rare: float = 0.05, least_tour: int = 3, gap_years: int = 2, most: int = 2) -> DataFrame:
    """For each set up to two remarkable songs against the band's earlier sets: long gap, tour debut, rare.

    Everything is counted by windows over each band's sets and each song's plays, so no set meets another.
    There are as many tasks as the sets and plays need, so a task's memory does not grow with the tables.
    """
    heard = scratch(songs.where("not is_cover and name is not null and name <> ''").select("setlist", F.lower("name").alias("song")), "plays")
    dated = sets.where("d is not null")
    n = max(sets.sparkSession.sparkContext.defaultParallelism, -(-(heard.count() + dated.count()) // PLAYS_A_TASK))
    dealt = lambda rows, *keys: rows.repartition(n, *keys)
    useful = dealt(dealt(dated, "setlist").join(dealt(heard.select("setlist"), "setlist"), "setlist", "left_semi"), "band_id").withColumn("day", F.unix_date("d"))
    before = lambda *keys: W.partitionBy(*keys).orderBy("day").rangeBetween(W.unboundedPreceding, -1)
    on_tour = lambda *keys: F.when(F.col("tour").isNotNull(), F.count("*").over(before(*keys, "tour"))).otherwise(0)
    order = F.row_number().over(W.partitionBy("band_id").orderBy("day", F.desc("setlist")))
    placed = useful.select("setlist", "band_id", "d", "day", "tour", order.alias("nth"), F.count("*").over(before("band_id")).alias("n_all"), on_tour("band_id").alias("n_tour"))
    plays = dealt(dealt(heard, "setlist").distinct().join(dealt(placed, "setlist"), "setlist"), "band_id", "song")
    counted = plays.withColumns({"in_all": F.count("*").over(before("band_id", "song")), "last_d": F.max("d").over(before("band_id", "song")), "in_tour": on_tour("band_id", "song")})
    # a set asks at the place behind its n_all earlier sets; plays of the last ``compare`` of them lie in reach
    mark = lambda place, one: F.struct(place.cast("long").alias("place"), F.lit(one).alias("one"))
    marks = counted.withColumn("m", F.explode(F.array(mark(2 * F.col("nth"), 1), mark(2 * F.col("n_all") + 1, 0)))).select("*", "m.place", "m.one").drop("m")
    lately = F.sum("one").over(W.partitionBy("band_id", "song").orderBy("place").rangeBetween(-2 * compare, 0))
    full = marks.withColumn("in_prior", lately).where("one = 0 and n_all > 0").withColumn("n_prior", F.least("n_all", F.lit(compare)))
    years = F.floor(F.datediff("d", "last_d") / 365.25)
    kinds = F.array(
        F.when((F.col("in_all") > 0) & (years >= gap_years), F.struct(F.lit(1).alias("priority"), (-years).cast("double").alias("score"), F.lit("long_gap").alias("kind"))),
        F.when((F.col("n_tour") >= least_tour) & (F.col("in_tour") == 0), F.struct(F.lit(2).alias("priority"), (-F.col("n_tour")).cast("double").alias("score"), F.lit("tour_debut").alias("kind"))),
        F.when((F.col("n_prior") >= least_prior) & (F.col("in_prior") / F.col("n_prior") <= rare), F.struct(F.lit(3).alias("priority"), (F.col("in_prior") / F.col("n_prior")).alias("score"), F.lit("rare").alias("kind"))),
    )
    best = dealt(full.select("setlist", "song", F.array_min(F.array_compact(kinds)).alias("x")).where("x is not null"), "setlist")
    rank = F.row_number().over(W.partitionBy("setlist").orderBy("x.priority", "x.score", "song"))
    return best.withColumn("rn", rank).where(F.col("rn") <= most).select("setlist", "song", F.col("x.kind").alias("kind"), F.col("rn").cast("long").alias("rank"))


def position_tags(songs: DataFrame) -> DataFrame:
    """P5: the opener, and the closer of the main set: the last song before the first encore."""
    first_encore = F.min(F.when(F.col("is_encore"), F.col("idx")))
    ends = songs.groupBy("setlist").agg(F.min("idx").alias("opener"), first_encore.alias("encore"))
    main = songs.join(ends, "setlist").where(F.col("encore").isNull() | (F.col("idx") < F.col("encore"))).groupBy("setlist").agg(F.max("idx").alias("closer"))
    return ends.join(main, "setlist", "left").select("setlist", "opener", "closer")


def flattened(sets: DataFrame) -> DataFrame:
    """Nested sets (setlist, parts[encore, songs[]]) to one row per song in playing order."""
    parts = sets.select("setlist", F.posexplode("parts").alias("part", "p"))
    rows = parts.select("setlist", "part", F.col("p.encore").alias("is_encore"), F.posexplode("p.songs").alias("at", "name"))
    return rows.select("setlist", (F.row_number().over(W.partitionBy("setlist").orderBy("part", "at")) - 1).cast("long").alias("idx"), "name", "is_encore")
