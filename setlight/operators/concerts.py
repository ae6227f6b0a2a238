"""Concert statistics over concerts (ord, band_id, d, venue, city, country, typ, attending, prices, ...).

``today`` is always an argument; concerts without a date count as upcoming and come last in orders.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from setlight.operators.folds import global_rank

#: Countries of the Europe filter and the radius of each nearby country.
EUROPE = [
    "sweden", "norway", "denmark", "finland", "iceland", "uk", "united kingdom", "ireland", "germany", "france", "belgium",
    "netherlands", "switzerland", "austria", "italy", "spain", "portugal", "poland", "czech republic", "czechia", "turkey",
    "greece", "hungary", "romania", "slovakia", "slovenia", "croatia", "serbia", "estonia", "latvia", "lithuania", "luxembourg",
]
NEARBY_KM = {"sweden": 150, "denmark": 80}


def place(text: Column) -> Column:
    return F.lower(F.trim(text))


def in_europe(country: Column) -> Column:
    """F26."""
    return F.coalesce(place(country).isin(EUROPE), F.lit(False))


def nearby(country: Column, km: Column) -> Column:
    """inside the country's own radius."""
    out = F.lit(False)
    for name, most in NEARBY_KM.items():
        out = out | ((place(country) == name) & (km <= most))
    return F.coalesce(out, F.lit(False))


def upcoming(d: Column, today: str) -> Column:
    """F27."""
    return d.isNull() | (d >= F.lit(today).cast("date"))


def nearest_per_band(concerts: DataFrame, today: str) -> DataFrame:
    """One upcoming concert per band, attended ones first, then the earliest."""
    first = F.row_number().over(W.partitionBy("band_id").orderBy(F.desc(F.coalesce("attending", F.lit(False))), F.asc_nulls_last("d"), "ord"))
    return concerts.where(upcoming(F.col("d"), today)).withColumn("rn", first).where("rn = 1").drop("rn")


def venue_groups(concerts: DataFrame) -> DataFrame:
    """A row per venue and city with its concert count and the first known country."""
    known = F.when(F.col("country").isNotNull() & (F.col("country") != ""), F.col("ord"))
    return concerts.where("venue is not null").groupBy("venue", "city").agg(F.count("*").alias("n"), F.min_by("country", known).alias("country"))


def last_show(bands: DataFrame, concerts: DataFrame) -> DataFrame:
    """The later of the stored date (a year counts as January 1st) and the latest concert."""
    latest = concerts.groupBy("band_id").agg(F.max("d").alias("latest"))
    stored = F.when(F.length("last_known") == 4, F.concat("last_known", F.lit("-01-01"))).otherwise(F.col("last_known")).try_cast("date")
    return bands.select("band_id", stored.alias("stored")).join(latest, "band_id", "left").select("band_id", F.greatest("stored", "latest").alias("last_date"))


def activity(last: DataFrame, years: int, today: str) -> DataFrame:
    """C4: unknown, active, or inactive after ``years`` years of 365.25 days."""
    days = F.datediff(F.lit(today).cast("date"), "last_date")
    status = F.when(F.col("last_date").isNull(), "unknown").when((days > 0) & (days / 365.25 >= years), "inactive").otherwise("active")
    return last.select("band_id", "last_date", F.year("last_date").cast("long").alias("last_year"), status.alias("status"))


def venue_visits(concerts: DataFrame) -> DataFrame:
    """Gaps and islands per venue. Same-day concerts share a visit, festival days in a row too; undated rows stand alone."""
    order = W.partitionBy("venue", "city").orderBy("d", "ord")
    gap = F.datediff("d", F.lag("d").over(order))
    both = (F.col("typ") == "festival") & (F.lag("typ").over(order) == "festival")
    begins = F.when((gap == 0) | ((gap == 1) & both), 0).otherwise(1)
    dated = concerts.where("venue is not null and d is not null").withColumn("begins", begins)
    numbered = dated.withColumn("island", F.sum("begins").over(order.rowsBetween(W.unboundedPreceding, 0)))
    flags = [F.count("*").alias("n"), F.max("d").alias("last_date"), F.min("ord").alias("visit"), F.bool_and(F.col("typ") == "festival").alias("festival"), F.min_by("distance_km", F.when(F.col("distance_km").isNotNull(), F.struct("d", "ord"))).alias("km")]
    islands = numbered.groupBy("venue", "city", "island").agg(*flags).drop("island")
    alone = concerts.where("venue is not null and d is null").select("venue", "city", F.lit(1).cast("long").alias("n"), F.col("d").alias("last_date"), F.col("ord").alias("visit"), (F.col("typ") == "festival").alias("festival"), F.col("distance_km").alias("km"))
    return islands.unionByName(alone)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def counts(past: DataFrame, visits: DataFrame) -> DataFrame:
    """Shows, countries, venues, cities, artists, distance travelled and festivals."""
    a = past.agg(
        F.count("*").alias("shows"),
        F.countDistinct(place(F.col("country"))).alias("countries"),
        F.countDistinct("venue", "city").alias("venues"),
        F.countDistinct("city").alias("cities"),
        F.countDistinct("band_id").alias("artists"),
        F.count("distance_km").alias("known_distances"),
        F.count("rating").alias("rated"),
        (half_up(F.avg("rating") * 10) / 10).alias("average_rating"),
    )
    b = visits.agg(F.coalesce(F.sum(2 * F.col("km")), F.lit(0)).alias("km_traveled"), F.count("*").alias("visits"), F.count_if("festival").alias("festivals"))
    return a.join(b)  # one row each


def spending(past: DataFrame, going: DataFrame) -> DataFrame:
    """Total, number of known prices, average price of a ticket, share of past shows with a price."""
    both = past.withColumn("past", F.lit(True)).unionByName(going.withColumn("past", F.lit(False)))
    qty = F.when(F.coalesce("quantity", F.lit(0)) == 0, 1).otherwise(F.col("quantity"))
    known = F.col("price_cents").isNotNull()
    total, tickets = F.sum(F.when(known, F.col("price_cents") * qty)), F.sum(F.when(known, qty))
    return both.agg(
        F.coalesce(total, F.lit(0)).alias("total_cents"),
        F.count_if(known).alias("known"),
        F.count_if(known & F.col("past")).alias("known_past"),
        half_up(total / tickets / 100).alias("average_price"),
        half_up(F.count_if(known & F.col("past")) / F.count_if("past") * 100).alias("priced_pct"),
    )


def spend_years(past: DataFrame, going: DataFrame) -> DataFrame:
    """The years with most and least spending; least only with two years or more, ties to the earlier year."""
    years = past.unionByName(going).where("price_cents is not null and d is not null").groupBy(F.year("d").cast("long").alias("year")).agg(F.sum(F.col("price_cents") * F.col("quantity")).alias("cents"), F.count("*").alias("n"))
    return years.agg(
        F.max_by("year", F.struct(F.col("cents"), -F.col("year"))).alias("highest_year"),
        F.max("cents").alias("highest_cents"),
        F.when(F.count("*") > 1, F.min_by("year", F.struct("cents", "year"))).alias("lowest_year"),
        F.when(F.count("*") > 1, F.min("cents")).alias("lowest_cents"),
    )


def busiest(visits: DataFrame) -> DataFrame:
    """Busiest year (ties to the later), month (ties to the earlier) and most visited city (ties to the latest visit)."""
    dated = visits.where("last_date is not null")
    year = dated.groupBy(F.year("last_date").cast("long").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).limit(1).select(F.lit("year").alias("what"), "k", "count")
    month = dated.groupBy(F.month("last_date").cast("long").alias("k")).count().orderBy(F.desc("count"), "k").limit(1).select(F.lit("month").alias("what"), "k", "count")
    city = visits.where("city is not null").groupBy(F.col("city").alias("k")).agg(F.count("*").alias("count"), F.max("last_date").alias("last")).orderBy(F.desc("count"), F.desc("last"), "k").limit(1).select(F.lit("city").alias("what"), "k", "count")
    return year.unionByName(month).unionByName(city)


def longest_gap(past: DataFrame, today: str) -> DataFrame:
    """The longest time between shows, over distinct days, with the first and the last show.

    Days are first made distinct, so the one ordered pass covers calendar days, not rows.
    """
    days = past.where("d is not null").select("d").distinct()
    gaps = days.withColumn("before", F.lag("d").over(W.orderBy("d"))).withColumn("gap", F.datediff("d", "before").cast("long"))
    return gaps.agg(F.max("gap").alias("days"), F.min_by("before", F.when(F.col("gap").isNotNull(), F.struct(-F.col("gap"), F.col("d")))).alias("from_date"), F.min("d").alias("first_show"), F.max("d").alias("last_show"), F.datediff(F.lit(today).cast("date"), F.max("d")).cast("long").alias("days_since"))


def top_artists(past: DataFrame, limit: int = 3) -> DataFrame:
    """Artists seen at least twice."""
    return past.groupBy("band_id").agg(F.count("*").alias("n"), F.max("d").alias("last_date")).where("n >= 2").orderBy(F.desc("n"), F.desc("last_date"), "band_id").limit(limit)


def top_venues(visits: DataFrame, limit: int = 5) -> DataFrame:
    return visits.groupBy("venue", "city").agg(F.count("*").alias("n"), F.max("last_date").alias("last_date")).orderBy(F.desc("n"), F.desc("last_date"), "venue", "city").limit(limit)


def extremes(past: DataFrame) -> DataFrame:
    """Farthest, closest, cheapest paid and priciest show; the first row wins ties."""
    pick = lambda by, value, where: F.min_by("ord", F.when(where, F.struct(by, "ord")))
    km, price = F.col("distance_km"), F.col("price_cents")
    return past.agg(
        pick(-km, km, km.isNotNull()).alias("farthest"),
        pick(km, km, km.isNotNull()).alias("closest"),
        pick(price, price, price > 0).alias("cheapest"),
        pick(-price, price, price.isNotNull()).alias("priciest"),
    )


def genre_breakdown(past: DataFrame, bands: DataFrame, group: Column) -> DataFrame:
    """Shows per primary genre with whole percents; shows of unknown bands count as other."""
    n = past.join(bands.select("band_id", group.alias("grp")), "band_id", "left").groupBy(F.coalesce("grp", F.lit("other")).alias("grp")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", half_up(F.col("n") / F.sum("n").over(W.partitionBy()) * 100))  # one row for each of eight genres


def alert_batches(concerts: DataFrame, bands: DataFrame, since: str) -> DataFrame:
    """New concerts of unmuted bands since a date; several of a band found on a day become one summary."""
    new = concerts.where(F.col("found") >= F.lit(since).cast("date")).join(bands.where("not muted").select("band_id"), "band_id", "left_semi")
    return new.groupBy("band_id", "found").agg(F.count("*").alias("n"), F.min("d").alias("first_date"), F.max("d").alias("last_date"), F.when(F.count("*") == 1, F.min("ord")).alias("concert"), F.count_if("attending").alias("attending")).withColumn("kind", F.when(F.col("n") == 1, "concert").otherwise("summary"))


def alert_list(concerts: DataFrame, bands: DataFrame, today: str, days: int = 90) -> DataFrame:
    """The alerts tab: the batches found in the last ``days``, with their place in one list, newest first."""
    since = str(date.fromisoformat(today) - timedelta(days=days))
    return global_rank(alert_batches(concerts, bands, since), [F.desc("found"), F.asc("band_id")])


def year_sections(concerts: DataFrame) -> DataFrame:
    """Rows with the size of their year's section."""
    sizes = concerts.groupBy(F.year("d").alias("year")).agg(F.count("*").alias("in_year"))
    return concerts.withColumn("_y", F.year("d")).join(sizes, F.col("_y") == F.col("year")).select("ord", F.col("year").cast("long").alias("year"), "in_year")


def duplicate_ids(rows: DataFrame, key: str, ident: str) -> DataFrame:
    """Ids given to more than one row, with the sorted rows (bounded by the assignments of one id)."""
    return rows.where(F.col(ident).isNotNull()).groupBy(ident).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(key)), ",").alias("rows")).where("n > 1")


#: States of an artist's identity and how a summary calls them; all others were not checked yet.
IDENTITY_STATES = {"auto_confirmed": "auto_confirmed", "manual_confirmed": "manual_confirmed", "needs_review": "awaiting_review", "no_match": "no_match", "error": "errors", "manual_rejected": "manually_rejected"}


def identity_summary(rows: DataFrame, status: str) -> DataFrame:
    """C11: one row with the number of bands in each state."""
    known = F.coalesce(F.col(status).isin(*IDENTITY_STATES), F.lit(False))
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == s).alias(name) for s, name in IDENTITY_STATES.items()], F.count_if(~known).alias("not_checked_yet"))


def provider_coverage(rows: DataFrame, status: str, ident: str) -> DataFrame:
    """Rows and identified rows per status, with rows whose id is not unique."""
    many = rows.where(F.col(ident).isNotNull()).groupBy(F.col(ident).alias("_i")).count().where("count > 1").select("_i")
    marked = rows.join(many, F.col(ident) == F.col("_i"), "left")
    return marked.groupBy(status).agg(F.count("*").alias("n"), F.count(ident).alias("identified"), F.count("_i").alias("duplicated"))
