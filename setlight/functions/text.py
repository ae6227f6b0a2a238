"""Text functions.

Compatibility decomposition has no built-in counterpart, so texts with characters beyond ASCII go
through one Arrow UDF; everything after that is column expressions.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.StringType())
def without_marks(text: pa.Array) -> pa.Array:
    """Compatibility decomposition without combining marks U+0300 to U+036F, in Arrow: no text becomes a Python object."""
    if pc.all(pc.string_is_ascii(text)).as_py() is not False:
        return text
    return pc.replace_substring_regex(pc.utf8_normalize(text, form="NFKD"), pattern=r"[\x{0300}-\x{036F}]+", replacement="")


def in_locale(text: Column) -> Column:
    """H6: ``text`` that compares and sorts as a reader expects: by letters, then accents, then case, punctuation first."""
    return F.collate(text, "UNICODE")


def norm_text(text: Column, decompose: bool = True) -> Column:
    """decomposed, trimmed, lower case; null counts as empty."""
    plain = F.coalesce(text, F.lit(""))
    return F.lower(F.regexp_replace(without_marks(plain) if decompose else plain, r"^\s+|\s+$", ""))


def norm_spaces(text: Column, decompose: bool = True) -> Column:
    """F1 with runs of white space as one space."""
    return F.regexp_replace(norm_text(text, decompose), r"\s+", " ")


def norm_title(text: Column, decompose: bool = True) -> Column:
    """marks removed, anything but letters and digits becomes one space."""
    plain = norm_text(text, decompose)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\p{M}", ""), r"[^\p{L}\p{N}]+", " "))


def norm_artist(text: Column, decompose: bool = True) -> Column:
    """F3 without a leading "the"; a name of symbols only keeps them in hex."""
    base = F.regexp_replace(norm_title(text, decompose), r"^the\s+", "")
    symbols = F.lower(F.hex(F.encode(F.trim(F.coalesce(text, F.lit(""))), "UTF-8")))
    return F.when(base != "", base).when(symbols != "", F.concat(F.lit("symbols-"), symbols)).otherwise("")


def norm_name(text: Column, decompose: bool = True) -> Column:
    """"&" reads "and", then only a-z and 0-9 stay."""
    return F.regexp_replace(F.regexp_replace(norm_text(text, decompose), "&", "and"), "[^a-z0-9]+", "")


def slug(text: Column, decompose: bool = True) -> Column:
    """F6."""
    return F.regexp_replace(F.regexp_replace(norm_text(text, decompose), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def stable_hash(text: Column) -> Column:
    """FNV-1a, 32 bits, over the UTF-16 code units of texts inside the basic plane, as eight hex digits."""
    units = F.filter(F.split(text, ""), lambda c: c != "")
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.lpad(F.lower(F.hex(F.aggregate(units, F.lit(2166136261).cast("long"), step))), 8, "0")


def whole_word_in(needle: Column, text: Column) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), needle, F.lit(" ")))


#: Fixed value: acts that play another artist's songs.
IMPERSONATORS = r"\b(tribute|cover band|karaoke|experience|impersonator|salute to|performed by)\b"


def names_match(band: Column, act: Column, event: Column) -> Column:
    """Equal, or one contained in the other as whole words, and no impersonator."""
    return (band != "") & (act != "") & ~F.lower(event).rlike(IMPERSONATORS) & ((band == act) | whole_word_in(band, act) | whole_word_in(act, band))


#: Words that many venues have in their names, and names that say no venue.
GENERIC_VENUE_WORDS = ["arena", "hall", "club", "stadium", "festival", "venue", "theatre", "theater", "centre", "center", "music", "live"]
UNKNOWN_VENUES = ["unknown venue", "unknown", "venue unknown", "tba", "tbd", "venue tba", "venue tbd", "to be announced", "to be determined"]


def venues_match(a: Column, b: Column) -> Column:
    """normalised names that are equal, or one whole inside the other as words, if not all of its words are generic."""
    words = lambda x: F.split(x, " ")
    a_first = F.size(words(a)) <= F.size(words(b))
    inner, outer = F.when(a_first, a).otherwise(b), F.when(a_first, b).otherwise(a)
    own = F.exists(words(inner), lambda w: ~w.isin(GENERIC_VENUE_WORDS))
    return (a != "") & (b != "") & ((a == b) | (own & whole_word_in(inner, outer)))


def contained_either_way(a: Column, b: Column, missing: bool) -> Column:
    """substring either way; missing evidence is ``missing``."""
    known = F.coalesce(a != "", F.lit(False)) & F.coalesce(b != "", F.lit(False))
    return F.when(known, a.contains(b) | b.contains(a)).otherwise(missing)


UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def safe_uuid(text: Column) -> Column:
    """F31."""
    low = F.lower(F.trim(text))
    return F.when(low.rlike(UUID), low)


def safe_https(text: Column) -> Column:
    """F31."""
    return F.when(text.rlike(r"^https://[^\s/?#@]+([/?#]\S*)?$"), text)


def provider_url(kind: str, ident: Column) -> Column:
    """F32: a link from a 22-character id."""
    return F.when(ident.rlike("^[A-Za-z0-9]{22}$"), F.concat(F.lit(f"https://open.spotify.com/{kind}/"), ident))


#: Fixed value: the note of an edition at the end of a title.
EDITIONS = r"(?i)\s*[\[(](?:deluxe|expanded|anniversary|remaster(?:ed)?|reissue|clean|explicit|\d{4}\s+edition)[^\])]*[\])]\s*$"


def canonical_title(text: Column, decompose: bool = True) -> Column:
    """F4 without an edition suffix."""
    return norm_artist(F.regexp_replace(F.coalesce(text, F.lit("")), EDITIONS, ""), decompose)


#: Release types that count; words of titles and secondary types that don't; words of titles that have no lifecycle.
RELEASE_TYPES = ["Album", "EP", "Single"]
NOT_ALLOWED = r"(?i)\b(compilation|live|remix|dj-mix|mixtape|audiobook|interview|spoken word|bootleg|promotion|promotional|reissue|remaster(?:ed)?|deluxe|expanded|anniversary|tribute|karaoke|appears on)\b"
EXCLUDED = r"\b(deluxe|expanded|anniversary|remaster(ed)?|reissue|compilation|greatest hits|remix|live|tribute|karaoke|bootleg)\b"


def allowed_release(kind: Column, title: Column, secondary: Column | None = None) -> Column:
    """a type that counts, and no excluded word in the title or the array of secondary types."""
    text = title if secondary is None else F.concat_ws(" ", title, F.array_join(secondary, " "))
    return F.coalesce(kind.isin(RELEASE_TYPES), F.lit(False)) & ~F.coalesce(text, F.lit("")).rlike(NOT_ALLOWED)


def truncate(text: Column, n: int = 350) -> Column:
    """the trimmed text, or its first ``n`` characters, trimmed again, and an ellipsis; null counts as empty."""
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    whole = trimmed(F.coalesce(text, F.lit("")))
    return F.when(F.length(whole) <= n, whole).otherwise(F.concat(trimmed(F.substring(whole, 1, n)), F.lit("…")))


def one_distinct(values: Column) -> Column:
    """The only distinct value that is not null, else null."""
    found = F.array_distinct(F.array_compact(values))
    return F.when(F.size(found) == 1, F.get(found, 0))


def fingerprint(ms: Column, artist: Column, title: Column) -> Column:
    """whole seconds, artist and title; null where any is missing."""
    return F.when(ms.isNotNull() & (artist != "") & (title != ""), F.concat_ws("|", F.floor(ms / 1000).cast("string"), artist, title))


def group_key(a: Column, b: Column) -> Column:
    """F44."""
    return F.sha2(F.concat(a, F.lit("\n"), b), 256)
