"""Genre classifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns of each classifier, first match wins.
FIVE = [
    ("Rock", "rock|metal|punk|grunge"),
    ("Pop", "pop"),
    ("Hip-hop/R&B", "hip.?hop|rap|r&b|rhythm and blues"),
    ("Electronic", "electronic|dance|house|techno|ambient|synth"),
]
SEVEN = {
    "rock": "rock|new wave|britpop|post[\\s-]?punk|psych|grunge|power pop",
    "punk": "punk|noise rock",
    "metal": "metal|hardcore|thrash",
    "hiphop_rnb": "\\bhip[\\s-]?hop\\b|\\brap\\b|r ?& ?b|\\brnb\\b|g-?funk",
    "pop": "\\bpop\\b",
    "folk": "\\bfolk\\b|singer[\\s-]?songwriter|americana",
    "electronic": "electro|techno|\\bhouse\\b|\\bedm\\b|\\bdance\\b|synth",
}
WIDE = [
    ("Rock", "alternative rock|indie rock|hard rock|garage rock|post[- ]?punk|nu metal|alternative metal|heavy metal|rock|metal|punk|grunge|emo"),
    ("Pop", r"indie pop|synth[- ]?pop|power pop|pop rock|\bpop\b"),
    ("Hip-hop/R&B", r"hip[- ]?hop|\brap\b|trap|r&b|rnb|rhythm and blues|soul|funk"),
    ("Electronic", r"electronic|\bdance\b|edm|house|techno|electro|drum and bass|dnb|ambient|trip[- ]?hop"),
]
NOT_PUNK = "post[\\s-]?punk"
PRIORITY = ["metal", "punk", "folk", "hiphop_rnb", "electronic", "pop", "rock"]


def first_group(text: Column, patterns: list[tuple[str, str]]) -> Column:
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    out = F.when(F.lit(False), "")
    for name, pattern in patterns:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("Other")


def five_groups(text: Column) -> Column:
    """one of five groups, the first rule that matches."""
    return first_group(text, FIVE)


def wide_groups(text: Column) -> Column:
    """the same groups by wider patterns."""
    return first_group(text, WIDE)


def _is(token: Column, group: str) -> Column:
    hit = token.rlike(SEVEN[group])
    return hit & ~token.rlike(NOT_PUNK) if group == "punk" else hit


def tokens(text: Column, separators: str = "[,/]") -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), separators), lambda x: F.lower(F.trim(x)))
    return F.filter(parts, lambda x: x != "")


def all_groups(text: Column) -> Column:
    """every group that a comma or slash separated part matches, sorted, else other."""
    found = F.array_sort(F.array_compact(F.array(*[F.when(F.exists(tokens(text), _matcher(g)), g) for g in SEVEN])))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))


def _matcher(group: str):
    return lambda t: _is(t, group)


def primary_group(text: Column) -> Column:
    """one group by priority, else other."""
    out = F.when(F.lit(False), "")
    for group in PRIORITY:
        out = out.when(F.exists(tokens(text), _matcher(group)), group)
    return out.otherwise("other")


def band_group(text: Column, classify=five_groups) -> Column:
    """the first stored genre whose group is not Other."""
    groups = F.transform(F.split(F.coalesce(text, F.lit("")), "[,;/|]"), classify)
    return F.coalesce(F.get(F.filter(groups, lambda g: g != "Other"), 0), F.lit("Other"))
