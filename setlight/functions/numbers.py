"""Numbers, dates and labels (F7-F11, F13-F20, F35-F39, X2-X4, X6, C15). Rounding is half up, floor(x + 0.5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """whole kilometres on a sphere of radius 6371; null where a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return half_up(6371 * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)))


def full_date(text: Column) -> Column:
    """F8: a strict calendar day, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def event_date(text: Column) -> Column:
    """dd-MM-yyyy or ISO to a day, else null."""
    turned = F.regexp_replace(text, r"^(\d{2})-(\d{2})-(\d{4})$", "$3-$2-$1")
    return full_date(turned)


def month_shift(ts: Column, months: int) -> Column:
    """shift with day clamp, time of day kept."""
    return ts + F.make_ym_interval(F.lit(0), F.lit(months))


def duration_text(ms: Column) -> Column:
    """"1,234 h 05 min" or "12 min"."""
    minutes = half_up(F.greatest(F.lit(0), ms) / 60000)
    hours = F.floor(minutes / 60)
    return F.when(hours > 0, F.concat(F.format_number(hours, 0), F.lit(" h "), F.lpad((minutes % 60).cast("string"), 2, "0"), F.lit(" min"))).otherwise(F.concat(minutes.cast("string"), F.lit(" min")))


def _short(x: Column) -> Column:
    """One decimal without a trailing .0."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def compact_number(n: Column) -> Column:
    """F14."""
    small, thousands = half_up(n).cast("string"), n / 1000
    return F.when(F.abs(n) < 1000, small).when(F.abs(n) < 100000, F.concat(_short(half_up(thousands * 10) / 10), F.lit("k"))).otherwise(F.concat(half_up(thousands).cast("string"), F.lit("k")))


def countdown_parts(target_ms: Column, now_ms: Column) -> dict[str, Column]:
    """F16: days, hours, minutes, seconds and both ring fractions; the outer ring is full from 30 days on."""
    left = F.greatest(F.lit(0), target_ms - now_ms)
    part = lambda size, unit: F.floor(left % size / unit)
    hours, minutes, seconds = part(86400000, 3600000), part(3600000, 60000), part(60000, 1000)
    return {"days": F.floor(left / 86400000), "hours": hours, "minutes": minutes, "seconds": seconds, "outer": F.least(F.lit(1.0), left / (30 * 86400000)), "inner": (hours * 3600 + minutes * 60 + seconds) / 86400}


def day_label(days: Column) -> Column:
    """Today, Tomorrow or "N days"."""
    return F.when(days == 0, "Today").when(days == 1, "Tomorrow").otherwise(F.concat(days.cast("string"), F.lit(" days")))


def ago_label(days: Column) -> Column:
    """Today, Yesterday, then days, months and years ago."""
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    months, years = F.floor(days / 30), F.floor(days / 365)
    return F.when(days.isNull(), "Never").when(days <= 0, "Today").when(days == 1, "Yesterday").when(days < 30, say(days, "day")).when(days < 365, say(months, "month")).otherwise(say(years, "year"))


def gap_label(days: Column) -> Column:
    """days below a year, else years with one decimal."""
    return F.when(days < 365, F.concat(F.format_number(days, 0), F.lit(" days"))).otherwise(F.concat(_short(half_up(days / 365.25 * 10) / 10), F.lit(" years")))


def bucket_label(day: Column, kind: str) -> Column:
    """F19."""
    if kind == "week":
        return F.concat(F.date_format(day, "d MMM"), F.lit(" - "), F.date_format(F.date_add(day, 6), "d MMM"))
    return F.date_format(day, {"day": "d MMM", "month": "MMM yyyy", "year": "yyyy"}[kind])


def nice_axis(top: Column, intervals: int = 4) -> dict[str, Column]:
    """the axis' end, step (1, 2, 2.5, 5 or 10 times a power of ten) and ticks; 1 by quarters where nothing is to show."""
    top = F.greatest(F.lit(0.0), F.coalesce(top.cast("double"), F.lit(0.0)))
    raw = top / max(2, intervals)
    magnitude = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    x = raw / magnitude
    step = F.when(top == 0, 0.25).otherwise(F.when(x <= 1, 1.0).when(x <= 2, 2.0).when(x <= 2.5, 2.5).when(x <= 5, 5.0).otherwise(10.0) * magnitude)
    end = F.when(top == 0, 1.0).otherwise(F.ceil(top / step) * step)
    return {"max": end, "step": step, "ticks": F.transform(F.sequence(F.lit(0), half_up(end / step).cast("int")), lambda i: i * step)}


#: Weather codes, the key of the condition and what it says. Keys with a star differ by day and night.
WEATHER = [
    ([0], "clear*", "Clear"),
    ([1], "partlyCloudy*", "Mostly clear"),
    ([2], "partlyCloudy*", "Partly cloudy"),
    ([3], "cloudy", "Cloudy"),
    ([45, 48], "fog", "Fog"),
    ([51, 53, 55, 56, 57], "drizzle", "Light rain"),
    ([61, 63, 66, 67, 80, 81], "rain", "Rain"),
    ([65, 82], "heavyRain", "Heavy rain"),
    ([71, 73, 75, 77, 85, 86], "snow", "Snow"),
    ([95, 96, 99], "thunderstorm", "Thunderstorms"),
]
DAWN, DUSK = 6, 20


def weather(code: Column, hour: Column) -> dict[str, Column]:
    """key and text of a weather code; night is before 6 and from 20 on."""
    phase = F.when((hour < DAWN) | (hour >= DUSK), "Night").otherwise("Day")
    key, text = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for codes, name, said in WEATHER:
        key = key.when(code.isin(codes), F.concat(F.lit(name[:-1]), phase) if name.endswith("*") else F.lit(name))
        text = text.when(code.isin(codes), said)
    return {"key": key.otherwise("unknown"), "text": text.otherwise("Weather unavailable")}


def desired_hours(time: Column) -> Column:
    """of a start "HH:mm" the hours two before, at, two and four after, held inside the day; four evening hours without one."""
    start = F.substring(time, 1, 2).cast("int")
    around = F.array(F.greatest(F.lit(0), start - 2), start, F.least(F.lit(23), start + 2), F.when(start <= 20, F.least(F.lit(23), start + 4)))
    known = F.coalesce(time.rlike("^([01][0-9]|2[0-3]):[0-5][0-9]$"), F.lit(False))
    return F.when(known, F.array_distinct(F.array_compact(around))).otherwise(F.array(*[F.lit(h) for h in (17, 19, 21, 23)]))


#: What failures are called, by status or words, first match first; the reasons may name the provider and the status.
FAILURES = [
    ("rate_limited", "status = 429", "rate[ _-]?limit|quota[_ -]?exceed|usage[_ -]?cap", "Rate limit reached; the item will be retried"),
    ("provider_unavailable", "status >= 500", "", "{provider} temporarily unavailable (HTTP {status})"),
    ("timeout", "", "timeout|timed out|aborterror|aborted", "Request timed out"),
    ("invalid_response", "", "invalid[_ -]?(json|response|provider)|unparseable|malformed", "Provider returned an invalid response"),
    ("match_uncertain", "", "show[_ -]?identity[_ -]?conflict|ambiguous[_ -]?show|match[_ -]?conflict", "Show could not be matched safely"),
    ("match_uncertain", "", "artist[_ -]?id[_ -]?mismatch|duplicate[_ -]?spotify[_ -]?identity|needs[_ -]?review", "Artist could not be matched safely"),
    ("network_error", "", "network|fetch failed|failed to fetch|econn|socket|dns", "Network request failed"),
    ("provider_error", "status > 0", "", "{provider} request failed (HTTP {status})"),
    ("update_failed", "true", "", "{provider} update could not be completed safely"),
]
STATUS = r"(?i)(?:http\s*)?(4\d\d|5\d\d)\b"


def failure_summary(text: Column, provider: Column) -> dict[str, Column]:
    """code and reason of a failure message, with the first HTTP error status in it."""
    low = F.lower(F.coalesce(text, F.lit("")))
    status = F.regexp_extract(low, STATUS, 1).try_cast("int")
    label = F.substring(F.trim(F.regexp_replace(provider, r"[^A-Za-z0-9 ._-]", "")), 1, 40)
    label = F.when(F.coalesce(label, F.lit("")) == "", "Provider").otherwise(label)
    holds = {"": F.lit(False), "true": F.lit(True), "status = 429": status == 429, "status >= 500": status >= 500, "status > 0": status > 0}
    code, reason = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for name, by_status, words, said in FAILURES:
        hit = F.coalesce(holds[by_status], F.lit(False)) | (low.rlike(words) if words else F.lit(False))
        full = F.substring(F.replace(F.replace(F.lit(said), F.lit("{provider}"), label), F.lit("{status}"), F.coalesce(status.cast("string"), F.lit(""))), 1, 140)
        code, reason = code.when(hit, name), reason.when(hit, full)
    return {"code": code, "reason": reason}


def match_score(exact: Column, alias: Column, kind: Column, provider_score: Column, origin: Column, found: Column, impostor: Column) -> Column:
    """how well a candidate fits a band, 0 to 100: by name or alias, as a group, by the provider's own score, by country; impostors get 0."""
    points = F.when(exact, 75).when(alias, 65).otherwise(0) + F.when(kind.isin("Group", "Orchestra"), 10).otherwise(0)
    points = points + F.when(provider_score >= 95, 10).otherwise(0) + F.when(origin == found, 5).when(origin != found, -30).otherwise(0)
    return F.when(impostor, 0).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), points)))


def coverage_level(percent: Column) -> Column:
    """X2."""
    return F.when(percent >= 95, "excellent").when(percent >= 90, "good").when(percent >= 75, "fair").when(percent >= 50, "low").otherwise("poor")


def next_mwf(now: Column) -> Column:
    """The next Monday, Wednesday or Friday, 01:00 UTC."""
    days = F.sequence(F.lit(0), F.lit(7))
    at = F.transform(days, lambda i: F.date_trunc("day", now) + F.make_dt_interval(days=i, hours=F.lit(1)))
    return F.array_min(F.filter(at, lambda t: (t > now) & F.dayofweek(t).isin(2, 4, 6)))


def next_first_or_fifteenth(now: Column) -> Column:
    """The next 1st or 15th, 02:00 UTC."""
    month = F.date_trunc("month", now)
    two = F.make_dt_interval(hours=F.lit(2))
    options = F.array(month + two, month + F.make_dt_interval(days=F.lit(14)) + two, month + F.make_ym_interval(F.lit(0), F.lit(1)) + two)
    return F.array_min(F.filter(options, lambda t: t > now))


def used_percent(used: Column, cap: Column) -> Column:
    """Rounded percent, between 0 and 100."""
    return F.when(cap > 0, F.least(F.lit(100), F.greatest(F.lit(0), half_up(used / cap * 100)))).otherwise(0)


def usage_bar(used: Column, cap: Column, real: Column) -> dict[str, Column]:
    """The widths of our cap and of what is used, in percent of the real limit with two decimals, and whether the cap has a tick."""
    some = lambda *xs: F.coalesce(*[F.when(x != 0, x) for x in xs])
    limit = F.coalesce(some(real, cap), F.lit(1))
    ours = F.coalesce(some(cap), limit)
    share = lambda x: half_up(F.least(F.lit(100.0), F.greatest(F.lit(0.0), x / limit * 100)) * 100) / 100
    return {"cap_pct": share(ours), "used_pct": share(F.coalesce(used, F.lit(0))), "tick": ours < limit}
