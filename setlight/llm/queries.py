"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, extraction, jaccard, licenses, line_dedup, mixing, quality, quotes, resampling, spelling, topk, toxicity, warc
from .common import table


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score_quality(docs.select("doc_id", "text"), labels)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    return topk.top_k(vectors, F.col("id") % 100 == 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score_toxicity(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_packages(table(spark, sf_dir, "pages"))
    return warc.read_packages(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumns({c: F.round(c, 6) for c in ("bm25", "question_overlap", "answer_overlap")})


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op10_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotations(table(spark, sf_dir, "conversations"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def quoted_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over conversations whose messages quote earlier ones: those of the table do not."""
    return quotes.link_quotations(quotes.quoting_earlier_turns(table(spark, sf_dir, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mixing,
        op2_quality_classifier,
        op3_line_dedup,
        op4_exact_topk,
        op5_toxicity,
        op6_license_scan,
        op7_warc_packages,
        op8_decontamination,
        op9_jaccard_join,
        op10_quotation_linking,
        op11_importance_resampling,
        op12_spelling_variants,
        op13_main_text,
        quoted_threads,
    )
}

ORACLES = {
    "op4_exact_topk": r"""
with valid as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from valid q join valid c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
) where rank <= 10
""",
    "op6_license_scan": licenses.oracle_sql(),
    "op8_decontamination": decontam.oracle_sql(),
    "op10_quotation_linking": quotes.oracle_sql(),
    "op11_importance_resampling": resampling.oracle_sql(),
    "op12_spelling_variants": spelling.oracle_sql(),
    "quoted_threads": quotes.oracle_sql(quotes.QUOTING_SQL),
    "op7_warc_packages": r"""
with hashed as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hex from pages
), named as (
  select page_id, payload_bytes, hex,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
      (((strpos('0123456789abcdef', substr(hex, cast(5 * i // 4 + 1 as integer), 1)) - 1) * 16 + strpos('0123456789abcdef', substr(hex || '0', cast(5 * i // 4 + 2 as integer), 1)) - 1)
        >> cast(3 - (5 * i) % 4 as integer)) % 32, 1)), '') as payload_digest
  from hashed
), first as (select hex, min(page_id) as first_id from hashed group by hex)
select page_id, payload_bytes, payload_digest, case when page_id > first_id then 'revisit' else 'response' end as record_type,
  case when page_id > first_id then first_id end as refers_to
from named join first using (hex)
""",
    "op9_jaccard_join": r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+'), lambda x: x <> '') as w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
  from words
), items as (select doc_id, len(s) as n, unnest(s) as x from sets),
common as (
  select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c
  from items a join items b on a.x = b.x and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) group by 1, 2
), links as (select a, b from common where 100 * c >= 75 * (na + nb - c)),
reach as (select doc_id as a, doc_id as b from sets union select r.a, l.b from reach r join links l on r.b = l.a)
select doc_id, cast(len(s) as bigint) as n_shingles, (select min(b) from reach where reach.a = sets.doc_id) as component_id from sets
""",
    "op3_line_dedup": r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents
), keyed as (
  select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines
), hot as (
  select k, max(doc_id) as holder from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5
)
select doc_id, count(*) as n_lines, count(*) filter (hot.k is not null and holder <> doc_id) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (hot.k is null or holder = doc_id), '')) as kept_sha256
from keyed left join hot using (k) group by doc_id
""",
}
