"""Importance resampling towards a target distribution, over a table of word positions.

Words are exploded with their positions; for orders above 1, ``lead`` over a document's positions
brings the following words beside each word, so that every run of 1 to ``order`` words is a feature.
Features are counted by hash bucket in the documents and in the target; the logarithm of their ratio is
a bucket's gain, and gains are joined back and summed by document. Noise drawn from the id turns the best
sums into a sample without replacement.

Rows: a null text has no words; a null id is hashed as an empty one and comes last among ties; rows that
repeat an id or a whole row each count and are each returned; other columns are ignored. An empty
table gives an empty result, and documents without features weigh 0.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Not part of a word: ASCII other than digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words whose followers one window task looks up at a time, and copies of a row that one array holds.
CHUNK, COPIES = 10_000, 10_000


def words(text: Column) -> Column:
    """The words of a text, in order; A-Z become a-z, other letters stay."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, BETWEEN), lambda w: w != "")


def features(rows: DataFrame, keys: list[str], text: str, order: int, buckets: int) -> DataFrame:
    """(keys, first, word, bucket): one row a feature, and at least one row for each input row.

    ``first`` marks one row of each input row, ``word`` the features of a single word; a text without
    words has one row without a bucket.
    """
    positions = rows.select(*keys, words(F.col(text)).alias("w"))
    if order == 1:
        out = positions.select(*keys, F.posexplode_outer("w").alias("pos", "word"))
        return out.select(*keys, (F.coalesce("pos", F.lit(0)) == 0).alias("first"), F.col("word").isNotNull().alias("single"), bucket(F.col("word"), buckets).alias("bucket"))
    # Chunks overlap by what follows their last word, so no window spans a whole long document.
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(CHUNK))
    chunks = positions.select(*keys, "w", F.explode(starts).alias("start")).select(*keys, "start", F.slice("w", F.col("start") + 1, CHUNK + order - 1).alias("w"))
    flat = chunks.select(*keys, "start", F.posexplode_outer("w").alias("pos", "word")).withColumn("pos", F.coalesce("pos", F.lit(0)))
    # Rows that repeat key and text hold the same words at the same places: they are followed together.
    place = [*keys, "start"]
    flat = flat.repartition(*place).groupBy(*place, "pos").agg(F.first("word").alias("word"), F.count("*").alias("copies"))
    following = W.partitionBy(*place).orderBy("pos")
    for k in range(1, order):
        flat = flat.withColumn(f"word{k}", F.lead("word", k).over(following))
    runs, ends = [], F.col("word").isNotNull()
    for k in range(order):
        ends = ends if k == 0 else ends & F.col(f"word{k}").isNotNull()
        run = F.concat_ws(" ", "word", *[f"word{j}" for j in range(1, k + 1)])
        runs.append(F.struct(F.lit(k == 0).alias("whole"), F.when(ends, run).alias("run")))
    kept = F.filter(F.array(*runs), lambda r: r["whole"] | r["run"].isNotNull())
    out = flat.where(F.col("pos") < CHUNK).select(*place, "pos", "copies", F.explode(kept).alias("f"))
    copies = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return out.select(*keys, ((F.col("start") == 0) & (F.col("pos") == 0) & F.col("f.whole")).alias("first"), (F.col("f.whole") & F.col("f.run").isNotNull()).alias("single"), bucket(F.col("f.run"), buckets).alias("bucket"), copies.alias("copy")).drop("copy")


def bucket(feature: Column, buckets: int) -> Column:
    return F.crc32(feature.cast("binary")) % buckets


def bucket_counts(rows: DataFrame, text: str, order: int, buckets: int) -> DataFrame:
    """(bucket, n), with at most ``buckets`` rows."""
    found = rows.select(F.lit(0).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    return features(found, ["k", "h"], "text", order, buckets).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = 10_000, text: str = "text", target_text: str = "text") -> DataFrame:
    """(bucket, gain) for each bucket: 1000 times the logarithm of its share in the target over its share in ``docs``."""
    s = cut(bucket_counts(docs, text, order, buckets), "source-buckets")
    t = cut(bucket_counts(target, target_text, order, buckets), "target-buckets")
    source, wanted = ((x.agg(F.sum("n")).first()[0] or 0) for x in (s, t))
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(s.withColumnRenamed("n", "s"), "bucket", "left").join(t.withColumnRenamed("n", "t"), "bucket", "left")
    more = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double") + 1.0
    share = (more("t") * F.lit(float(source + buckets))) / (more("s") * F.lit(float(wanted + buckets)))
    return both.select("bucket", F.floor(1000.0 * F.log(share)).alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """A Gumbel variate in thousandths, drawn by the hash of seed and id."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(head, 16, 10).cast("long")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighted(docs: DataFrame, gain: DataFrame, order: int, buckets: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight), one row for each row of ``docs``.

    Rows are told apart by id and text. Rows equal in both are summed together and divided again, so no
    row needs a number of its own; each task sums what it has exploded before anything is shuffled.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    each = features(rows, ["doc_id", "h"], "text", order, buckets).join(F.broadcast(gain), "bucket", "left")
    summed = each.groupBy("doc_id", "h").agg(
        F.count_if("first").alias("copies"),
        F.count_if("single").alias("words"),
        F.count("bucket").alias("features"),
        F.coalesce(F.sum("gain"), F.lit(0)).alias("gains"),
    )
    one = summed.select("doc_id", "copies", *[F.expr(f"{a} div copies").alias(b) for a, b in (("words", "n_words"), ("features", "n_features"), ("gains", "weight"))])
    blocks = one.withColumn("block", F.explode(F.sequence(F.lit(0), F.expr("(copies - 1) div " + str(COPIES)))))
    return blocks.withColumn("copy", F.explode(F.expr(f"sequence(1, least({COPIES}, copies - block * {COPIES}))"))).drop("copies", "block", "copy")


def ranked(scored: DataFrame, most: int) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... by score and then id, for the first ``most`` rows, else null.

    Rows are sorted by ranges, and a row's place is its place in its range plus the sizes of those before,
    of which there are as many as partitions.
    """
    in_order = scored.orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id())
    kept = cut(in_order, "resampling-order").withColumns({"part": F.shiftright("at", 33), "at": F.col("at") % (1 << 33)})
    before, sizes = 0, []
    for part, n in sorted(tuple(r) for r in kept.groupBy("part").count().collect()):
        sizes.append((part, before))
        before += n
    offsets = scored.sparkSession.createDataFrame(sizes, "part long, before long")
    rank = F.col("before") + F.col("at") + 1
    return kept.join(F.broadcast(offsets), "part").select(*scored.columns, F.when(rank <= most, rank).alias("rank"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    order: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of ``docs``.

    ``percent`` of the documents with at least ``least_words`` words are drawn, those of the highest scores;
    ``rank`` counts them and is null for the others.
    """
    gain = cut(gains(docs, target, order, buckets, text, target_text), "gains")
    rows = weighted(docs, gain, order, buckets, doc_id, text).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = cut(rows, "resampling-scores")
    out = ["doc_id", "n_features", "weight", "score"]
    long_enough = scored.where(F.col("n_words") >= least_words).select(*out)
    drawn = ranked(long_enough, long_enough.count() * percent // 100)
    short = scored.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(short)


#: crc32 of the words w of a relation, by the table of its polynomial: DuckDB has no such function.
CRC32_SQL = r"""crc_table as (
  select list(list_reduce(list_prepend(n, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by n) as crc from (select unnest(range(256)) as n)
), {name} as (
  select w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(w))),
    lambda i: cast('0x' || substr(hex(encode(w)), cast(2 * i + 1 as integer), 2) as bigint))), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) as h
  from (select distinct w from {words}), crc_table
)"""


def oracle_sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = rf"list_filter(regexp_split_to_array({lower}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return rf"""
with d as (select row_number() over () as i, doc_id, {split} as ws from documents),
target_words as (select unnest({split}) as w from benchmark),
source_words as (select i, unnest(ws) as w from d),
both_words as (select w from target_words union all select w from source_words),
{CRC32_SQL.format(name="hashed", words="both_words")},
s as (select h % 10000 as b, count(*) as n from source_words join hashed using (w) group by 1),
t as (select h % 10000 as b, count(*) as n from target_words join hashed using (w) group by 1),
gains as (
  select b.b, floor(1000 * ln(((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + 10000)::double)
    / ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from t) + 10000)::double))) as gain
  from (select unnest(range(10000)) as b) b left join s on s.b = b.b left join t on t.b = b.b
), weights as (
  select i, cast(sum(gain) as bigint) as weight from source_words join hashed using (w) join gains on gains.b = h % 10000 group by i
), scored as (
  select d.i, doc_id, cast(len(ws) as bigint) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
  from d left join weights using (i)
), placed as (
  select *, n_features >= 20 as fit, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last) as place,
    count(*) over (partition by n_features >= 20) as n from scored
)
select doc_id, n_features, weight, score, case when fit and place <= n * 10 // 100 then place end as rank from placed
"""
