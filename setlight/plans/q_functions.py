"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from setlight.functions import genres as G
from setlight.functions import numbers as N
from setlight.functions import text as T
from setlight.sources.standins import bands, concerts, listens, read, releases

from .q_concerts import TOKENS, has
from .q_listening import BAND_GROUP, FIVE_SQL
from .registry import query

TRIM = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
F1 = TRIM.format(x="lower(strip_accents(coalesce(text, '')))")


def docs(spark, d):
    return read(spark, d, "documents").select("doc_id", "text")


def pair(name, sql):
    return query(name, f"select doc_id, md5({sql}) as h from documents")


def hashed(rows, value):
    return rows.select("doc_id", F.md5(value).alias("h"))


@pair("f1_norm_text", F1)
def f1(spark, d):
    return hashed(docs(spark, d), T.norm_text(F.col("text")))


F2 = rf"regexp_replace({F1}, '\s+', ' ', 'g')"


@pair("f2_norm_spaces", F2)
def f2(spark, d):
    return hashed(docs(spark, d), T.norm_spaces(F.col("text")))


F3 = rf"trim(regexp_replace({F1}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@pair("f3_norm_title", F3)
def f3(spark, d):
    return hashed(docs(spark, d), T.norm_title(F.col("text")))


@pair("f4_norm_artist", rf"regexp_replace({F3}, '^the\s+', '')")
def f4(spark, d):
    return hashed(docs(spark, d), T.norm_artist(F.col("text")))


@pair("f5_norm_name", f"regexp_replace(replace({F1}, '&', 'and'), '[^a-z0-9]+', '', 'g')")
def f5(spark, d):
    return hashed(docs(spark, d), T.norm_name(F.col("text")))


@pair("f6_slug", f"regexp_replace(regexp_replace({F1}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')")
def f6(spark, d):
    return hashed(docs(spark, d), T.slug(F.col("text")))


@query(
    "f7_haversine",
    """select s_suppkey, cast(floor(6371 * 2 * atan2(sqrt(a), sqrt(1 - a)) + 0.5) as bigint) as km from (select s_suppkey,
      pow(sin(radians(55.34 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(55.34)) * pow(sin(radians(13.36 - lon) / 2), 2) as a from (select s_suppkey, s_suppkey % 140 - 70.0::double as lat, s_suppkey % 300 - 150.0::double as lon from supplier))""",
)
def f7(spark, d):
    at = read(spark, d, "supplier").selectExpr("s_suppkey", "s_suppkey % 140 - 70D as lat", "s_suppkey % 300 - 150D as lon")
    return at.select("s_suppkey", N.haversine_km(F.col("lat"), F.col("lon"), F.lit(55.34), F.lit(13.36)).alias("km"))


RAW = "lpad(cast(1 + o_orderkey % 31 as varchar), 2, '0') || '-' || lpad(cast(1 + o_orderkey % 13 as varchar), 2, '0') || '-' || cast(1990 + o_orderkey % 20 as varchar)"


@query("f8_f9_dates", f"select o_orderkey, try_cast(regexp_replace(raw, '(..)-(..)-(....)', '\\3-\\2-\\1') as date) as day from (select o_orderkey, {RAW} as raw from orders)")
def f9(spark, d):
    raw = read(spark, d, "orders").selectExpr("o_orderkey", RAW.replace("varchar", "string") + " as raw")
    return raw.select("o_orderkey", N.event_date(F.col("raw")).alias("day"))


@query("f10_f11_shift_and_buckets", "select ord, t - interval 3 month as three_back, t - interval 12 month as year_back, cast(date_trunc('week', t) as date) as week, cast(date_trunc('month', t) as date) as month from (select ord, make_timestamp(ms * 1000) as t from listens)")
def f10(spark, d):
    t = F.timestamp_millis("ms")
    shift = lambda n: N.month_shift(t, n).cast("timestamp_ntz")
    return listens(spark, d).select("ord", shift(-3).alias("three_back"), shift(-12).alias("year_back"), F.date_trunc("week", t).cast("date").alias("week"), F.date_trunc("month", t).cast("date").alias("month"))


@query("f12_stable_hash", "select p_partkey, lpad(printf('%x', list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(p_name, ''), lambda c: cast(ord(c) as bigint))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)), 8, '0') as h from part")
def f12(spark, d):
    return read(spark, d, "part").select("p_partkey", T.stable_hash(F.col("p_name")).alias("h"))


@query(
    "f13_f14_labels",
    """with m as (select ord, price_cents * 7 as ms, cast(floor(price_cents * 7 / 60000 + 0.5) as bigint) as mins, price_cents / 10 as n from concerts where price_cents is not null)
    select ord, case when mins >= 60 then format('{:,}', mins // 60) || ' h ' || lpad(cast(mins % 60 as varchar), 2, '0') || ' min' else mins || ' min' end as duration,
      case when n < 1000 then cast(cast(floor(n + 0.5) as bigint) as varchar) when n < 100000 then regexp_replace(cast(floor(n / 1000 * 10 + 0.5) / 10 as varchar), '\\.0$', '') || 'k' else cast(floor(n / 1000 + 0.5) as bigint) || 'k' end as compact from m""",
)
def f13(spark, d):
    rows = concerts(spark, d).where("price_cents is not null")
    return rows.select("ord", N.duration_text(F.col("price_cents") * 7).alias("duration"), N.compact_number(F.col("price_cents") / 10).alias("compact"))


@query(
    "f16_countdown",
    """with l as (select ord, greatest(0, epoch_ms(cast(d as timestamp)) - 930830400000) as ms from concerts)
    select ord, ms // 86400000 as days, ms % 86400000 // 3600000 as hours, ms % 3600000 // 60000 as minutes, ms % 60000 // 1000 as seconds, least(1.0::double, ms / 2592000000) as outer_ring,
      ((ms % 86400000 // 3600000) * 3600 + (ms % 3600000 // 60000) * 60 + ms % 60000 // 1000) / 86400 as inner_ring from l""",
)
def f16(spark, d):
    parts = N.countdown_parts(F.unix_millis(F.col("d").cast("timestamp")), F.lit(930830400000))
    return concerts(spark, d).select("ord", *[v.alias({"outer": "outer_ring", "inner": "inner_ring"}.get(k, k)) for k, v in parts.items()])


AGO = "case when n <= 0 then 'Today' when n = 1 then 'Yesterday' when n < 30 then n || ' days ago' when n < 365 then (n // 30) || ' month' || case when n // 30 = 1 then '' else 's' end || ' ago' else (n // 365) || ' year' || case when n // 365 = 1 then '' else 's' end || ' ago' end"


@query(
    "f15_f17_f18_day_labels",
    f"""with a as (select ord, date '2001-08-02' - d as n from concerts) select ord, {AGO} as ago, case when n = 0 then 'Today' when n = 1 then 'Tomorrow' else n || ' days' end as countdown,
      case when n < 365 then n || ' days' else regexp_replace(cast(floor(n / 365.25::double * 10 + 0.5) / 10 as varchar), '\\.0$', '') || ' years' end as gap from a""",
)
def f17(spark, d):
    n = F.datediff(F.lit("2001-08-02").cast("date"), "d")
    return concerts(spark, d).select("ord", N.ago_label(n).alias("ago"), N.day_label(n).alias("countdown"), N.gap_label(n).alias("gap"))


@query(
    "f19_bucket_labels",
    "select distinct d, strftime(d, '%-d %b') as day, strftime(d, '%-d %b') || ' - ' || strftime(d + 6, '%-d %b') as week, strftime(d, '%b %Y') as month, strftime(d, '%Y') as year from concerts",
)
def f19(spark, d):
    return concerts(spark, d).select("d").distinct().select("d", *[N.bucket_label(F.col("d"), k).alias(k) for k in ("day", "week", "month", "year")])


@query(
    "f20_nice_axis",
    """with s as (select ord, greatest(0, coalesce(price_cents, 0))::double as top from concerts), m as (select *, case when top > 0 then pow(10.0, floor(log10(top / 4))) end as mag from s), x as (select *, case when top = 0 then 0.25 else case when top / 4 / mag <= 1 then 1 when top / 4 / mag <= 2 then 2 when top / 4 / mag <= 2.5 then 2.5 when top / 4 / mag <= 5 then 5 else 10 end * mag end as step from m)
    select ord, case when top = 0 then 1.0 else ceil(top / step) * step end as max, step, cast(case when top = 0 then 4 else ceil(top / step) end as bigint) as intervals from x""",
)
def f20(spark, d):
    axis = N.nice_axis(F.col("price_cents"))
    return concerts(spark, d).select("ord", axis["max"].alias("max"), axis["step"].alias("step"), (F.size(axis["ticks"]) - 1).alias("intervals"))


WIDE_SQL = "case " + " ".join(f"when regexp_matches({{x}}, '{p}') then '{g}'" for g, p in G.WIDE) + " else 'Other' end"


@query(
    "f22_wide_genres",
    f"with g as (select band_id, list_filter(list_transform(regexp_split_to_array(genre_raw, '[,;/|]'), lambda y: {WIDE_SQL.format(x='lower(trim(y))')}), lambda y: y <> 'Other') as g from bands) select band_id, case when len(g) > 0 then g[1] else 'Other' end as wide from g",
)
def f22(spark, d):
    return bands(spark, d).select("band_id", G.band_group(F.col("genre_raw"), G.wide_groups).alias("wide"))


ALL = "case when len(list_filter(g, lambda x: x is not null)) = 0 then 'other' else array_to_string(list_sort(list_filter(g, lambda x: x is not null)), ',') end"


@query(
    "f21_f25_genres",
    f"select band_id, {FIVE_SQL.format(x='lower(trim(genre_raw))')} as five, {BAND_GROUP} as band_group, case {' '.join(f'when {has(g)} then {chr(39)}{g}{chr(39)}' for g in G.PRIORITY)} else 'other' end as primary_group, {ALL} as all_groups from (select *, [{', '.join(f'case when {has(g)} then {chr(39)}{g}{chr(39)} end' for g in G.PRIORITY)}] as g from bands)",
)
def f21(spark, d):
    raw = F.col("genre_raw")
    return bands(spark, d).select("band_id", G.five_groups(raw).alias("five"), G.band_group(raw).alias("band_group"), G.primary_group(raw).alias("primary_group"), F.array_join(G.all_groups(raw), ",").alias("all_groups"))


@query("f27_upcoming", "select ord, d is null or d >= date '1999-07-01' as upcoming from concerts")
def f27(spark, d):
    from setlight.operators.concerts import upcoming

    return concerts(spark, d).select("ord", upcoming(F.col("d"), "1999-07-01").alias("upcoming"))


NAMED = "select p_partkey, lower(p_name) as a, lower(p_brand || ' ' || p_name) as b, lower(split_part(p_name, ' ', 1)) as c, p_type as e from part"


@query(
    "f28_f30_name_matching",
    f"""select p_partkey, a <> '' and b <> '' and not regexp_matches(lower(e), '\\b(tribute|cover band|karaoke|experience|impersonator|salute to|performed by)\\b') and (a = b or contains(' ' || b || ' ', ' ' || a || ' ') or contains(' ' || a || ' ', ' ' || b || ' ')) as names,
      contains(a, c) or contains(c, a) as strict from ({NAMED})""",
)
def f28(spark, d):
    rows = read(spark, d, "part").selectExpr("p_partkey", "lower(p_name) as a", "lower(p_brand || ' ' || p_name) as b", "lower(split_part(p_name, ' ', 1)) as c", "p_type as e")
    return rows.select("p_partkey", T.names_match(F.col("a"), F.col("b"), F.col("e")).alias("names"), T.contained_either_way(F.col("a"), F.col("c"), False).alias("strict"))


VENUES = "select p_partkey, lower(p_name) as a, case p_partkey % 6 when 0 then lower(p_name) || ' arena' when 1 then 'royal ' || lower(p_name) || ' hall' when 2 then split_part(lower(p_name), ' ', 2) when 3 then 'arena' when 4 then '' else lower(p_brand) end as b from part"
GENERIC = "['" + "', '".join(T.GENERIC_VENUE_WORDS) + "']"


def inside_sql(x: str, y: str) -> str:
    return f"(len(list_filter(string_split({x}, ' '), lambda w: not list_contains({GENERIC}, w))) > 0 and contains(' ' || {y} || ' ', ' ' || {x} || ' '))"


@query("f29_venue_words", f"select p_partkey, a <> '' and b <> '' and (a = b or case when len(string_split(a, ' ')) <= len(string_split(b, ' ')) then {inside_sql('a', 'b')} else {inside_sql('b', 'a')} end) as m from (select p_partkey, a || case when p_partkey % 12 = 3 then ' arena' else '' end as a, b from ({VENUES}))")
def f29(spark, d):
    read(spark, d, "part").createOrReplaceTempView("part")
    rows = spark.sql(VENUES).withColumn("a", F.when(F.col("p_partkey") % 12 == 3, F.concat("a", F.lit(" arena"))).otherwise(F.col("a")))
    return rows.select("p_partkey", T.venues_match(F.col("a"), F.col("b")).alias("m"))


MADE = "select event_id, case when event_id % 3 = 0 then upper(h) else h end as h, case when event_id % 5 = 0 then 'http://' else 'https://' end || 'x.example/' || event_id as u, substr(md5(cast(event_id as varchar)) || 'Z', 1, case when event_id % 4 = 0 then 22 else 20 end) as s from (select event_id, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) as h from (select event_id, md5(cast(event_id as varchar)) as m from events))"


@query(
    "f31_f32_ids_and_urls",
    f"select event_id, case when regexp_matches(lower(h), '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[1-5][0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}$') then lower(h) end as uuid, case when starts_with(u, 'https://') then u end as url, case when length(s) = 22 then 'https://open.spotify.com/track/' || s end as link from ({MADE})",
)
def f31(spark, d):
    read(spark, d, "events").createOrReplaceTempView("events")
    rows = spark.sql(MADE.replace("varchar", "string"))
    return rows.select("event_id", T.safe_uuid(F.col("h")).alias("uuid"), T.safe_https(F.col("u")).alias("url"), T.provider_url("track", F.col("s")).alias("link"))


TITLES = "select p_partkey, p_name || case p_partkey % 8 when 0 then ' (Deluxe Edition)' when 1 then ' [2010 Remaster]' when 2 then ' live' when 3 then ' [2010 Edition] ' when 4 then ' (remastered)' when 5 then ' dj-mix' when 6 then ' (clean)' else '' end as title, case when p_partkey % 9 = 4 then 'Remix' else 'none' end as secondary, type from (select p_partkey, p_name, case p_size % 4 when 0 then 'Album' when 1 then 'EP' when 2 then 'Single' else 'Broadcast' end as type from part)"


@query(
    "f33_f34_release_titles",
    rf"select p_partkey, trim(regexp_replace(lower(regexp_replace(title, '{T.EDITIONS[4:]}', '', 'i')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) as canonical, type in ('Album', 'EP', 'Single') and not regexp_matches(title || ' ' || secondary, '{T.NOT_ALLOWED[4:]}', 'i') as allowed from ({TITLES})",
)
def f33(spark, d):
    read(spark, d, "part").createOrReplaceTempView("part")
    allowed = T.allowed_release(F.col("type"), F.col("title"), F.array("secondary"))
    return spark.sql(TITLES).select("p_partkey", T.canonical_title(F.col("title")).alias("canonical"), allowed.alias("allowed"))


@query("f40_truncated", r"select doc_id, case when length(t) <= 40 then t else regexp_replace(substr(t, 1, 40), '^\s+|\s+$', '', 'g') || '…' end as short from (select doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') as t from documents)")
def f40(spark, d):
    return read(spark, d, "documents").select("doc_id", T.truncate(F.col("text"), 40).alias("short"))


@query(
    "f35_match_score",
    """select c_custkey, case when c_custkey % 31 = 0 then 0 else least(100, greatest(0, case when c_custkey % 3 = 0 then 75 when c_custkey % 4 = 0 then 65 else 0 end + case when c_mktsegment in ('BUILDING', 'MACHINERY') then 10 else 0 end
      + case when c_acctbal > 5000 then 10 else 0 end + case when c_nationkey % 6 = 5 or c_custkey % 7 = 6 then 0 when c_nationkey % 6 = c_custkey % 7 then 5 else -30 end)) end as score from customer""",
)
def f35(spark, d):
    rows = read(spark, d, "customer")
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "Group").when(F.col("c_mktsegment") == "MACHINERY", "Orchestra").otherwise("Person")
    provider = F.when(F.col("c_acctbal") > 5000, 95).otherwise(94)
    origin, found = (F.expr(f"nullif({x}, {none})") for x, none in (("c_nationkey % 6", 5), ("c_custkey % 7", 6)))
    return rows.select("c_custkey", N.match_score(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 4 == 0, kind, provider, origin, found, F.col("c_custkey") % 31 == 0).alias("score"))


@query(
    "f36_country_from_text",
    """with w as (select doc_id, string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ') as w from documents), n as (select doc_id, unnest(range(1, len(w) + 1)) as i, w from w),
    g as (select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') as gram from n, (values (1), (2), (3), (4)) s(k) where i + k - 1 <= len(w)),
    a as (select lower(n_name) as alias, n_name as country from nation union all select 'the', 'Article' union all select 'of the', 'Phrase')
    select doc_id, arg_min(country, (-k, i, alias)) as country from g join a on gram = alias group by doc_id""",
)
def f36(spark, d):
    """the longest alias of up to four words; n-grams meet a small alias table by an equi join."""
    words = docs(spark, d).select("doc_id", F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " ").alias("w"))
    spots = words.select("doc_id", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
    grams = spots.select("doc_id", "i", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.when(F.col("i") + k - 1 <= F.size("w"), F.array_join(F.slice("w", F.col("i"), F.lit(k)), " ")).alias("gram")) for k in range(1, 5)])).alias("g")).select("doc_id", "i", "g.*")
    alias = read(spark, d, "nation").select(F.lower("n_name").alias("alias"), F.col("n_name").alias("country")).unionByName(spark.sql("select 'the' as alias, 'Article' as country union all select 'of the', 'Phrase'"))
    return grams.join(alias, F.col("gram") == F.col("alias")).groupBy("doc_id").agg(F.min_by("country", F.struct(-F.col("k"), F.col("i"), F.col("alias"))).alias("country"))


@query(
    "f37_f38_weather",
    """with w as (select ord, cast(ord % 100 as integer) as code, cast(ord % 24 as integer) as h from concerts), s as (select *, case when h < 6 or h >= 20 then 'Night' else 'Day' end as phase, case when ord % 29 = 0 then null else h end as start from w),
    t as (select *, case when code = 0 then 'clear' || phase when code in (1, 2) then 'partlyCloudy' || phase when code = 3 then 'cloudy' when code in (45, 48) then 'fog' when code between 51 and 57 and code not in (52, 54) then 'drizzle'
      when code in (61, 63, 66, 67, 80, 81) then 'rain' when code in (65, 82) then 'heavyRain' when code in (71, 73, 75, 77, 85, 86) then 'snow' when code in (95, 96, 99) then 'thunderstorm' else 'unknown' end as condition_key from s)
    select ord, condition_key, case when condition_key like 'clear%' then 'Clear' when code = 1 then 'Mostly clear' when code = 2 then 'Partly cloudy' when condition_key = 'cloudy' then 'Cloudy' when condition_key = 'fog' then 'Fog' when condition_key = 'drizzle' then 'Light rain'
      when condition_key = 'rain' then 'Rain' when condition_key = 'heavyRain' then 'Heavy rain' when condition_key = 'snow' then 'Snow' when condition_key = 'thunderstorm' then 'Thunderstorms' else 'Weather unavailable' end as condition_text,
      case when start is null then '17,19,21,23' else array_to_string(list_sort(list_distinct(list_filter([greatest(0, start - 2), start, least(23, start + 2), case when start <= 20 then least(23, start + 4) end], lambda x: x is not null))), ',') end as hours from t""",
)
def f37(spark, d):
    code, hour = (F.col("ord") % 100).cast("int"), (F.col("ord") % 24).cast("int")
    time = F.when(F.col("ord") % 29 == 0, "24:00").otherwise(F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":30")))
    said = N.weather(code, hour)
    return concerts(spark, d).select("ord", said["key"].alias("condition_key"), said["text"].alias("condition_text"), F.array_join(N.desired_hours(time), ",").alias("hours"))


FAILED = ["HTTP 429", "quota exceeded", "Request timed out", "403 Forbidden", "http 404", "Error 503", "fetch failed", "odd", "Malformed body", "ambiguous_show", "needs review", "Connect ECONNRESET", "room 4711"]


@query(
    "f39_failure_kind",
    f"""with e as (select ord, {FAILED!r}[ord % 13 + 1] as t, case when ord % 2 = 0 then 'Ticket<b>master' end as provider from concerts), l as (select ord, lower(t) as t, case when provider is null then 'Provider' else 'Ticketbmaster' end as label,
      try_cast(regexp_extract(lower(t), '(?:http\\s*)?(4\\d\\d|5\\d\\d)\\b', 1) as integer) as st from e),
    c as (select *, case when st = 429 or regexp_matches(t, 'rate[ _-]?limit|quota[_ -]?exceed|usage[_ -]?cap') then 1 when st >= 500 then 2 when regexp_matches(t, 'timeout|timed out|aborterror|aborted') then 3 when regexp_matches(t, 'invalid[_ -]?(json|response|provider)|unparseable|malformed') then 4
      when regexp_matches(t, 'show[_ -]?identity[_ -]?conflict|ambiguous[_ -]?show|match[_ -]?conflict') then 5 when regexp_matches(t, 'artist[_ -]?id[_ -]?mismatch|duplicate[_ -]?spotify[_ -]?identity|needs[_ -]?review') then 6 when regexp_matches(t, 'network|fetch failed|failed to fetch|econn|socket|dns') then 7 when st > 0 then 8 else 9 end as k from l)
    select ord, ['rate_limited', 'provider_unavailable', 'timeout', 'invalid_response', 'match_uncertain', 'match_uncertain', 'network_error', 'provider_error', 'update_failed'][k] as code,
      ['Rate limit reached; the item will be retried', label || ' temporarily unavailable (HTTP ' || st || ')', 'Request timed out', 'Provider returned an invalid response', 'Show could not be matched safely', 'Artist could not be matched safely', 'Network request failed', label || ' request failed (HTTP ' || st || ')', label || ' update could not be completed safely'][k] as reason from c""",
)
def f39(spark, d):
    text = F.get(F.array(*[F.lit(x) for x in FAILED]), (F.col("ord") % 13).cast("int"))
    said = N.failure_summary(text, F.when(F.col("ord") % 2 == 0, "Ticket<b>master"))
    return concerts(spark, d).select("ord", *[c.alias(k) for k, c in said.items()])


@query(
    "c15_usage_bars",
    """with u as (select ord, coalesce(price_cents, 0) / 100 as used, case when ord % 5 = 0 then 0 else ord % 2000 end as cap, case when ord % 3 = 0 then 0 else 3000 end as lim from concerts), l as (select *, case when lim <> 0 then lim when cap <> 0 then cap else 1 end as r from u),
    o as (select *, case when cap <> 0 then cap else r end as c from l)
    select ord, floor(least(100, greatest(0, c / r * 100)) * 100 + 0.5) / 100 as cap_pct, floor(least(100, greatest(0, used / r * 100)) * 100 + 0.5) / 100 as used_pct, c < r as tick from o""",
)
def c15(spark, d):
    rows = concerts(spark, d).selectExpr("ord", "coalesce(price_cents, 0) / 100 as used", "case when ord % 5 = 0 then 0 else ord % 2000 end as cap", "case when ord % 3 = 0 then 0 else 3000 end as lim")
    return rows.select("ord", *[c.alias(k) for k, c in N.usage_bar(F.col("used"), F.col("cap"), F.col("lim")).items()])


@query("f42_one_distinct", "select provider_id, case when count(distinct brand) = 1 then min(brand) end as brand from (select release_id % 300 as provider_id, case when release_id % 5 = 0 then null else brand end as brand from releases) group by 1")
def f42(spark, d):
    rows = releases(spark, d).selectExpr("release_id % 300 as provider_id", "case when release_id % 5 = 0 then null else brand end as brand")
    return rows.groupBy("provider_id").agg(T.one_distinct(F.collect_set("brand")).alias("brand"))


@query("f43_f44_keys", "select ord, concat_ws('|', cast(ms // 1000 as varchar), cast(band_id as varchar), lower(recording_title)) as fp, sha256(cast(band_id as varchar) || chr(10) || release_title) as k from listens")
def f43(spark, d):
    return listens(spark, d).select("ord", T.fingerprint(F.col("ms"), F.col("band_id").cast("string"), F.lower("recording_title")).alias("fp"), T.group_key(F.col("band_id").cast("string"), F.col("release_title")).alias("k"))


@query(
    "x2_x6_levels",
    "with p as (select ord, price_cents, cast(floor(coalesce(price_cents, 0) / 40000000 * 100 + 0.5) as bigint) as raw from concerts), q as (select ord, least(100, greatest(0, raw)) as pct from p) select ord, pct, case when pct >= 95 then 'excellent' when pct >= 90 then 'good' when pct >= 75 then 'fair' when pct >= 50 then 'low' else 'poor' end as level from q",
)
def x2(spark, d):
    return concerts(spark, d).select("ord", N.used_percent(F.coalesce("price_cents", F.lit(0)), F.lit(40000000)).alias("pct")).select("ord", "pct", N.coverage_level(F.col("pct")).alias("level"))


@query(
    "x3_x4_next_runs",
    """with t as (select ord, make_timestamp(ms * 1000) as t from listens), c as (select ord, t, unnest(range(0, 8)) as i from t),
    m as (select ord, min(date_trunc('day', t) + to_days(cast(i as integer)) + interval 1 hour) filter (date_trunc('day', t) + to_days(cast(i as integer)) + interval 1 hour > t and dayofweek(date_trunc('day', t) + to_days(cast(i as integer))) in (1, 3, 5)) as mwf from c group by ord)
    select ord, mwf, case when date_trunc('month', t) + interval 2 hour > t then date_trunc('month', t) + interval 2 hour when date_trunc('month', t) + interval 14 day + interval 2 hour > t then date_trunc('month', t) + interval 14 day + interval 2 hour else date_trunc('month', t) + interval 1 month + interval 2 hour end as focused from m join t using (ord)""",
)
def x3(spark, d):
    t = F.timestamp_millis("ms")
    return listens(spark, d).select("ord", N.next_mwf(t).cast("timestamp_ntz").alias("mwf"), N.next_first_or_fifteenth(t).cast("timestamp_ntz").alias("focused"))


@query("x21_status_kinds", "select band_id, array_to_string(list_filter([case when favorite then 'favorite' end, case when muted then 'muted' end], lambda x: x is not null), ',') as kinds from bands")
def x21(spark, d):
    return bands(spark, d).select("band_id", F.array_join(F.array_compact(F.array(F.when(F.col("favorite"), "favorite"), F.when(F.col("muted"), "muted"))), ",").alias("kinds"))


