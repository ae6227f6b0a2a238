"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters, so words of the same letters share a key, and a
letter added, removed or exchanged changes it by that letter's power or by the difference of two. Words
whose keys differ so are joined. As one edit leaves the first or the last half of a word as it was, that
half is part of the join as well: without it, all orders of the same letters would meet. Of the pairs
found, those at an edit distance of 1 are near.

Rows: a null text has no words and a null id is an empty one; repeated rows count again; other columns are
ignored; an empty table gives an empty result. Of near words with the same count, the smaller in code-point
order gives the form.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: What is not a letter, once A-Z are a-z.
BETWEEN = r"[^a-zÀ-ÿ]+"
#: Keys are sums of fifth powers of code points, kept below this modulus whatever the length of a word.
POWER, MODULUS = 5, 1 << 60


def runs(text: Column) -> Column:
    """The maximal runs of letters in a text, with A-Z in lower case."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), BETWEEN)


def misspelt(doc_id: Column, run: Column, every: int) -> Column:
    """``run`` without one of its letters where ``every`` divides the hash of id and run, else ``run``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, least_letters: int = 7, least_n: int = 2, every: int = 31, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of at least ``least_letters`` letters with ``least_n`` occurrences in all texts."""
    found = docs.select(F.col(doc_id).alias("id"), F.explode(F.filter(runs(F.col(text)), lambda r: F.length(r) >= least_letters)).alias("run"))
    words = found.select(misspelt(F.col("id"), F.col("run"), every).alias("word"))
    return words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def power(letter: Column) -> Column:
    code, out = F.ascii(letter).cast("long"), F.lit(1).cast("long")
    for _ in range(POWER):
        out = out * code
    return out


def letters(part: Column) -> Column:
    return F.array_distinct(F.filter(F.split(part, ""), lambda c: c != ""))


def keyed(words: DataFrame) -> DataFrame:
    """``words`` with ``anagram``, the key of all letters."""
    add = lambda acc, c: F.pmod(acc + power(c), F.lit(MODULUS))
    return words.withColumn("anagram", F.aggregate(F.filter(F.split("word", ""), lambda c: c != ""), F.lit(0).cast("long"), add))


def join_keys(role: str, shape: Column, first: Column, last: Column, cut_first: Column | None = None, cut_last: Column | None = None) -> Column:
    """The join keys (last, k) of a word in a role: hashes of role, length, the half left alone and the key of the letters.

    ``first`` and ``last`` are the halves left alone, ``cut_first`` and ``cut_last`` what is beside them, of
    which one letter goes in turn; without these, all letters stay.
    """
    one = lambda side, half, key: F.struct(F.lit(side == "last").alias("last"), F.xxhash64(F.lit(role), F.lit(side), shape, half, key).alias("k"))
    if cut_first is None:
        return F.array(one("first", first, F.col("anagram")), one("last", last, F.col("anagram")))
    less = lambda side, half, rest: F.transform(letters(rest), lambda c: one(side, half, F.pmod(F.col("anagram") - power(c), F.lit(MODULUS))))
    return F.concat(less("first", first, cut_first), less("last", last, cut_last))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each unordered pair of words at an edit distance of 1, once, for ``words`` (word, n)."""
    size = F.length("word")
    left = lambda n: F.substring(F.col("word"), F.lit(1), n)
    rest = lambda n: F.substring(F.col("word"), n + 1, size)
    half, short_half = F.floor(size / 2).cast("int"), F.floor((size - 1) / 2).cast("int")
    known = keyed(words)

    def role(keys: Column, side: str) -> DataFrame:
        one = known.select(F.col("word").alias(side), F.col("n").alias(f"n_{side}"), F.explode(keys).alias("key"))
        return one.select(side, f"n_{side}", "key.k", F.col("key.last").alias(f"last_{side}"))

    # One letter exchanged: both words lose one letter of the half that differs.
    exchange = join_keys("exchange", size, left(half), rest(half), rest(half), left(half))
    pairs = role(exchange, "a").join(role(exchange, "b"), "k").where("a < b")
    # One letter removed from the longer word. One that stands beside its like can go from either half;
    # the pair then counts by the first.
    longer = join_keys("remove", size - 1, left(short_half), rest(short_half + 1), rest(short_half), left(short_half + 1))
    shorter = join_keys("remove", size, left(half), rest(half))
    first = lambda side: F.substring(F.col(side), F.lit(1), F.floor(F.length("b") / 2).cast("int"))
    moved = role(longer, "a").join(role(shorter, "b"), "k").where(~F.col("last_b") | (first("a") != first("b")))
    return pairs.unionByName(moved).where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")


def forms(words: DataFrame, times: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n): the most frequent near word, where it has ``times`` the word's occurrences."""
    pairs = near_pairs(words)
    to = lambda a, b: F.struct(F.col(a).alias("word"), (-F.col(f"n_{b}")).alias("less"), F.col(b).alias("near"))
    both = pairs.select(F.explode(F.array(to("a", "b"), to("b", "a"))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))
    out = words.join(best, "word", "left")
    taken = -F.col("best.less") >= times * F.col("n")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"))


def rooted(known: DataFrame) -> DataFrame:
    """``known`` (word, form, ...) with ``root``: the last form that following forms reaches, the word itself if it has none.

    Each form is at least ``times`` as frequent as its word, so chains are as short as a logarithm of the counts;
    pointers double their length in each round.
    """
    links = cut(known.where("form is not null").select("word", F.col("form").alias("root")), "spelling-forms")
    while True:
        via = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(links.join(via, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        links = step.select("word", "root")
        if step.where("moved").limit(1).count() == 0:
            break
    return known.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(docs: DataFrame, least_letters: int = 7, least_n: int = 2, every: int = 31, times: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of all texts."""
    words = cut(vocabulary(docs, least_letters, least_n, every, doc_id, text), "spelling-words")
    known = cut(forms(words, times), "spelling-near")
    return rooted(known).select("word", "form", "root", "n", "n_near", "form_n")


def oracle_sql() -> str:
    from .resampling import CRC32_SQL

    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
with recursive found as (
  select coalesce(doc_id::varchar, '') || ':' || run as w, run from (select doc_id, unnest(regexp_extract_all({lower}, '[a-z\x{{00C0}}-\x{{00FF}}]+')) as run from documents) where length(run) >= 7
), {CRC32_SQL.format(name="hashed", words="found")},
spelt as (
  select case when h % 31 = 0 then substr(run, 1, cast(h % length(run) as integer)) || substr(run, cast(h % length(run) + 2 as integer)) else run end as word from found join hashed using (w)
), words as (select word, count(*) as n from spelt where length(word) >= 7 group by word having count(*) >= 2),
holes as (
  select word, n, i, substr(word, 1, cast(i as integer)) as head, substr(word, cast(i + 2 as integer)) as tail from (select word, n, unnest(range(length(word))) as i from words)
), pairs as (
  select a.word, a.n, b.word as near, b.n as m from holes a join holes b on a.i = b.i and a.head = b.head and a.tail = b.tail and a.word <> b.word
  union
  select a.word, a.n, b.word, b.n from holes a join words b on a.head || a.tail = b.word
  union
  select b.word, b.n, a.word, a.n from holes a join words b on a.head || a.tail = b.word
), best as (
  select word, count(*) as n_near, arg_min(near, (-m, near)) as near, max(m) as m from pairs group by word
), forms as (
  select words.word, n, coalesce(n_near, 0) as n_near, case when m >= 10 * n then near end as form, case when m >= 10 * n then m end as form_n from words left join best using (word)
), chain as (
  select word, word as root, 0 as depth from forms union all select chain.word, form, depth + 1 from chain join forms on forms.word = chain.root where form is not null
)
select word, form, (select arg_max(root, depth) from chain where chain.word = forms.word) as root, n, n_near, form_n from forms
"""
