"""Queries on duplicates and setlists."""

from __future__ import annotations

from pyspark.sql import functions as F

from setlight.operators import dedupe as D
from setlight.operators import setlists as P
from setlight.operators.preparation import Preparation
from setlight.sources.standins import concerts, listens, relistens, songs

from .q_sources import folder_of
from .registry import query

TOL = 300_000
PAIRS = f"""pairs as (select l.ord as l_ord, r.ord as r_ord, l.ms as l_ms, r.ms as r_ms, l.band_id as l_band, r.band_id as r_band, l.recording_title as l_t, r.recording_title as r_t, l.release_title as l_rel, r.release_title as r_rel,
  l.duration_ms as l_dur, r.duration_ms as r_dur, l.recording_id as l_rec, r.recording_id as r_rec, l.track_id as l_trk, r.track_id as r_trk
  from listens l join listens r on r.ms >= l.ms and r.ms - l.ms <= {TOL} and (l.ms < r.ms or l.ord < r.ord) and l.source <> r.source)"""
TIER = "case when l_rec = r_rec then 2 when l_trk = r_trk then 3 when l_rel = r_rel and l_dur > 0 and r_dur > 0 and abs(l_dur - r_dur) <= 2000 and l_band = r_band and lower(trim(l_t)) = lower(trim(r_t)) then 4 when l_band = r_band and lower(trim(l_t)) = lower(trim(r_t)) then 5 end"
CAND = f"{PAIRS}, cand as (select least(l_ord, r_ord) as a, greatest(l_ord, r_ord) as b, cast({TIER} as bigint) as tier, {TIER} <= 3 as automatic from pairs where {TIER} is not null)"


@query("d2_candidate_pairs", f"with {PAIRS} select l_ord, r_ord, r_ms - l_ms as apart from pairs")
def pairs(spark, d):
    return D.candidate_pairs(listens(spark, d).select("ord", "ms", "source"), TOL).select("l_ord", "r_ord", (F.col("r_ms") - F.col("l_ms")).alias("apart"))


@query("d3_d4_evidence", f"with {CAND} select * from cand")
def evidence(spark, d):
    return D.candidates(listens(spark, d), TOL)


SEEN = "select ord, ms, case when ord % 6 > 3 then 1 else band_id end as band_id, case when ord % 6 > 3 then ' Same' else recording_title end as recording_title, case when ord % 12 in (4, 5) then 'one' else release_title end as release_title, case when ord % 12 in (4, 5) then 5000 + ord % 2 else duration_ms end as duration_ms, source, case when ord % 6 < 2 then concat('r', floor(ord / 6)) end as recording_id, case when ord % 6 in (2, 3) then concat('t', floor(ord / 6)) end as track_id, case when ord % 5 < 3 then concat('i', ord % 700) end as source_id, ord % 31 = 0 as reviewed from listens"
BOTH = ["ord", "ms", "band_id", "recording_title", "release_title", "duration_ms", "source", "recording_id", "track_id", "source_id", "reviewed"]


@query(
    "d3_matching_evidence",
    f"""with s as ({SEEN}), p as (select {', '.join(f'l.{c} as l_{c}, r.{c} as r_{c}' for c in BOTH)} from s l join s r on r.ord in (l.ord + 1, l.ord + 700)),
    t as (select *, l_band_id = r_band_id and lower(trim(l_recording_title)) = lower(trim(r_recording_title)) as names from p),
    u as (select l_ord, r_ord, case when l_reviewed or r_reviewed then 0 when l_source = r_source and l_source_id = r_source_id then 1 when coalesce(abs(l_ms - r_ms) > 864000000, true) then 9 when l_recording_id = r_recording_id then 2 when l_track_id = r_track_id then 3
      when l_release_title = r_release_title and l_duration_ms > 0 and r_duration_ms > 0 and abs(l_duration_ms - r_duration_ms) <= 2000 and names then 4 when names then 5 else 9 end as k from t)
    select l_ord, r_ord, case when k between 1 and 5 then k end as tier, case k when 0 then 'user_reviewed' when 4 then 'probable_duplicate' when 5 then 'ambiguous' when 9 then 'unique' else 'exact_duplicate' end as outcome,
      case k when 0 then 'manual' when 1 then 'provider_id' when 2 then 'recording_id' when 3 then 'spotify_id' when 4 then 'trusted_release_duration_signature' when 5 then 'normalized_signature' end as method, k between 1 and 3 as automatic from u""",
)
def matching(spark, d):
    listens(spark, d).createOrReplaceTempView("listens")
    rows = spark.sql(SEEN)
    left = rows.select(*[F.col(c).alias(f"l_{c}") for c in BOTH], F.explode(F.array(F.col("ord") + 1, F.col("ord") + 700)).alias("at"))
    both = left.join(rows.select(*[F.col(c).alias(f"r_{c}") for c in BOTH]), F.col("at") == F.col("r_ord")).drop("at")
    return D.matching_evidence(both, 864_000_000)


#: Greedy matching as a recursion over ranked pairs that carries the taken listens; review pairs and groups from it.
MATCHED = f"""{CAND.replace("from listens l join listens r", "from relistens l join relistens r")}, rk as (select *, row_number() over (order by tier, a, b) as i from cand where automatic), go as (select cast(0 as bigint) as i, cast([] as bigint[]) as taken, cast([] as bigint[]) as won
  union all select rk.i, case when list_has_any(go.taken, [rk.a, rk.b]) then go.taken else list_concat(go.taken, [rk.a, rk.b]) end, case when list_has_any(go.taken, [rk.a, rk.b]) then go.won else list_append(go.won, rk.i) end from go join rk on rk.i = go.i + 1),
  fin as (select taken, won from go order by i desc limit 1), asg as (select a, b, tier, case when automatic then case when (select list_contains(won, (select i from rk where rk.a = cand.a and rk.b = cand.b)) from fin) then 'automatic' else 'rejected' end
    when (select list_has_any(taken, [a, b]) from fin) then 'rejected' else 'review' end as outcome from cand)"""


@query("d5_one_to_one", "with recursive" + f" {MATCHED} select * from asg")
def one_to_one(spark, d):
    return D.assign_listens(relistens(spark, d), TOL)


@query("d6_canonical_rows", f"with recursive {MATCHED} select a as ord, a as canonical, tier, cast(null as bigint) as duplicate_of from asg where outcome = 'automatic' union all select b, a, tier, a from asg where outcome = 'automatic'")
def canonical(spark, d):
    return D.canonical_rows(D.matched_listens(relistens(spark, d), TOL))


REVIEWED = "select distinct a, b, tier from (select least(ord, ord + 3 + ord % 5) as a, ord + 3 + ord % 5 as b, case when ord % 7 = 0 then 5 else 4 end as tier, ord from listens) t where ord % 11 in (0, 5)"
REACH = f"rv as ({REVIEWED}), ed as (select a as u, b as v from rv union select b, a from rv), rc as (select u as node, u as label from ed union select rc.node, ed.v from rc join ed on rc.label = ed.u), lb as (select node, min(label) as label from rc group by node)"


def review_pairs(spark, d):
    listens(spark, d).createOrReplaceTempView("listens")
    return spark.sql(REVIEWED)


@query("d7_d8_review_groups", f"with recursive {REACH} select label as group_id, count(*) as pairs, bool_and(tier = 4) as probable, max(b) as last_member from rv join lb on lb.node = rv.a group by label")
def groups(spark, d):
    """Pairs for review that overlap, so that groups of several listens arise."""
    return D.review_groups(review_pairs(spark, d).withColumn("outcome", F.lit("review")))


@query(
    "d8_merge_component",
    f"""with recursive {REACH}, gp as (select label as group_id, a, b, tier from rv join lb on lb.node = rv.a), fs as (select group_id, min((a, b)) as f from gp group by group_id), dc as (select group_id, f[1] as a, f[2] as b from fs),
    ea as (select gp.group_id, gp.a, gp.b from gp where (a + b) % 6 = 1), me as (select group_id, a as u, b as v from dc union select group_id, b, a from dc union select group_id, a, b from ea union select group_id, b, a from ea),
    mr as (select group_id, a as start, a as node from dc union select mr.group_id, start, me.v from mr join me on me.group_id = mr.group_id and me.u = mr.node), mb as (select group_id, node, min(node) over (partition by group_id) as target from mr),
    mp as (select gp.group_id, least(coalesce(x.target, gp.a), coalesce(y.target, gp.b)) as a, greatest(coalesce(x.target, gp.a), coalesce(y.target, gp.b)) as b, tier, (gp.a, gp.b) as was from gp left join dc on dc.group_id = gp.group_id and dc.a = gp.a and dc.b = gp.b
      left join mb x on x.group_id = gp.group_id and x.node = gp.a left join mb y on y.group_id = gp.group_id and y.node = gp.b where dc.a is null)
    select group_id, node as a, target as b, cast(null as integer) as tier, 'member' as kind from mb union all select group_id, a, b, arg_min(tier, was), 'pair' from mp where a <> b group by group_id, a, b""",
)
def merge_component(spark, d):
    """The first pair of each review group is merged, after some earlier ones."""
    from setlight.operators.rounds import components

    found = review_pairs(spark, d)
    labels = components(found).select(F.col("node").alias("a"), F.col("label").alias("group_id"))
    pairs = found.join(labels, "a").select("group_id", "a", "b", "tier")
    members = pairs.select("group_id", F.explode(F.array("a", "b")).alias("ord")).distinct()
    decided = pairs.groupBy("group_id").agg(F.min(F.struct("a", "b")).alias("f")).select("group_id", "f.a", "f.b")
    merged, left = D.merge_component(members, pairs, pairs.where("(a + b) % 6 = 1"), decided)
    return merged.select("group_id", F.col("ord").alias("a"), F.col("target").alias("b"), F.lit(None).cast("int").alias("tier"), F.lit("member").alias("kind")).unionByName(left.withColumn("kind", F.lit("pair")))


@query(
    "d9_d10_canonical_listens",
    f"""with recursive {MATCHED}, du as (select b as dup, a as rep from asg where outcome = 'automatic'), v as (select rep, arg_min(duration_ms, ord) filter (duration_ms is not null) as duration_ms, arg_min(recording_id, ord) filter (recording_id is not null) as recording_id, arg_min(track_id, ord) filter (track_id is not null) as track_id from relistens join du on ord = dup group by rep)
    select ord, ms, coalesce(l.duration_ms, v.duration_ms) as duration_ms, coalesce(l.recording_id, v.recording_id) as recording_id, coalesce(l.track_id, v.track_id) as track_id from relistens l left join v on v.rep = l.ord where ord not in (select dup from du)""",
)
def canonicalize(spark, d):
    rows = relistens(spark, d)
    return D.canonicalize(rows, D.canonical_rows(D.matched_listens(rows, TOL)))


@query("d11_audit", f"with recursive {MATCHED} select tier, outcome, count(*) as n from asg group by 1, 2")
def audit(spark, d):
    return D.audit(D.assign_listens(relistens(spark, d), TOL))


@query("d12_coverage_audit", "select count(*) as events, count(recording_id) as recordings, count(track_id) as tracks, count(*) filter (source = 'spotify_import') as imports, count(*) filter (source = 'listenbrainz') as pulls, strftime(make_timestamp(min(ms) * 1000), '%Y-%m') as first_month, strftime(make_timestamp(max(ms) * 1000), '%Y-%m') as last_month from listens")
def coverage(spark, d):
    return D.coverage_audit(listens(spark, d))


@query("d13_page_pairs", f"with {PAIRS} select l_ord, r_ord, r_ord // 500 as page from pairs")
def page(spark, d):
    """All pairs, each on the page of its later listen."""
    return D.candidate_pairs(listens(spark, d).select("ord", "ms", "source"), TOL).selectExpr("l_ord", "r_ord", "r_ord div 500 as page")


class Killed(Exception):
    """What ends a run in the query below."""


@query(
    "d13_d14_x16_resumed_preparation",
    f"""with recursive vl as (select * from relistens where trim(recording_title) <> '' and (source <> 'spotify_import' or (track_id is not null and duration_ms >= 30000))), {MATCHED.replace("from relistens l join relistens r", "from vl l join vl r")}
    select vl.ord, coalesce(a, vl.ord) as canonical, a as duplicate_of from vl left join asg on b = vl.ord and outcome = 'automatic'""",
)
def resumed(spark, d):
    """A preparation that is killed once in each phase, after a step's rows and before its cursor, and resumed."""
    folder, killed = folder_of(spark, "preparation"), set()

    def kill(phase: str, page: int) -> None:
        if phase not in killed:
            killed.add(phase)
            raise Killed(phase)

    while True:
        try:
            return Preparation(spark, folder, TOL, pages_a_step=16, watch=kill).run(relistens(spark, d))
        except Killed:
            continue


LINKS = "select ord, case when ord % 10 = 3 then ord - 3 when ord % 50 = 4 then ord - 1 end as duplicate_of from listens"


def linked_rows(spark, d):
    return listens(spark, d).selectExpr("ord", "case when ord % 10 = 3 then ord - 3 when ord % 50 = 4 then ord - 1 end as duplicate_of")


@query("d14_broken_rows", f"with c as ({LINKS}) select c.ord from c left join c r on r.ord = c.duplicate_of where c.duplicate_of is not null and (r.ord is null or r.duplicate_of is not null)")
def broken(spark, d):
    return D.broken_rows(linked_rows(spark, d))


@query("d15_stale_groups", "select ord as group_id, ord % 7 = 0 as reviewed from listens where ord % 7 <> 0 and ord not in (select ord from listens where ord % 2 = 0)")
def stale(spark, d):
    stored = listens(spark, d).selectExpr("ord as group_id", "ord % 7 = 0 as reviewed")
    return D.stale_groups(stored, stored.where("group_id % 2 = 0"))


def merge_sql(incoming: str) -> str:
    return f"""with recursive r as (select ord, ord % 4000 as id, concat_ws('|', cast(ms // 600000 as varchar), cast(band_id % 300 as varchar)) as fp, source, duration_ms, track_id from listens), e as (select * from r where ord < 1000), n as (select * from r where ord >= 1000 and id not in (select id from e) and fp not in (select fp from e) and {incoming}),
    ln as (select a.ord, b.ord as rival from n a join n b on b.ord < a.ord and (a.id = b.id or a.fp = b.fp)), sz as (select count(*) as n from n),
    st as (select 0 as step, (select list(ord) from n where ord not in (select ord from ln)) as ok, cast([] as bigint[]) as bad
      union all select step + 1, list_distinct(list_concat(ok, coalesce((select list(n.ord) from n where not list_contains(st.ok, n.ord) and not list_contains(st.bad, n.ord) and not exists (select 1 from ln where ln.ord = n.ord and not list_contains(st.bad, ln.rival))), cast([] as bigint[])))),
        list_distinct(list_concat(bad, coalesce((select list(distinct ln.ord) from ln where list_contains(st.ok, ln.rival)), cast([] as bigint[])))) from st where step < 40 and len(ok) + len(bad) < (select n from sz))
    select ord, id, fp from n where ord in (select unnest(ok) from (select ok from st order by step desc limit 1))"""


@query("d1b_new_listens", merge_sql("source = 'listenbrainz'"))
def new_listens(spark, d):
    rows = listens(spark, d).selectExpr("ord", "ord % 4000 as id", "concat_ws('|', ms div 600000, band_id % 300) as fp", "ms", "recording_title as title", "cast(band_id as string) as artist", "source", "track_id", "duration_ms")
    return D.new_listens(rows.where("ord >= 1000"), rows.where("ord < 1000")).select("ord", "id", "fp")


@query("d1_merge_new", merge_sql("true"))
def merge_new(spark, d):
    rows = listens(spark, d).selectExpr("ord", "ord % 4000 as id", "concat_ws('|', ms div 600000, band_id % 300) as fp")
    return D.merge_new(rows.where("ord >= 1000"), rows.where("ord < 1000"))


SETS = "sets as (select ord as setlist, band_id, d, cast(year(d) as varchar) as tour from concerts)"
OWN = f"""{SETS}, own as (select setlist, band_id, d, tour, lower(name) as song, row_number() over (partition by setlist order by idx) - 1 as pos, count(*) over (partition by setlist) as length, is_encore
  from songs join sets using (setlist) where not is_cover and name <> '')"""
DAY = "date '1999-07-01'"
USEFUL = f"{OWN}, useful as (select * from (select *, dense_rank() over (partition by band_id order by setlist) as nth from own where d <= {DAY} and d >= {DAY} - 730) where nth <= 20)"


def sets(spark, d):
    return concerts(spark, d).selectExpr("ord as setlist", "band_id", "d", "cast(year(d) as string) as tour")


@query(
    "p1_sets_in_input_order",
    f"""with {SETS}, c as (select ord as setlist, band_id % 50 as band_id, d, year(d) as tour, (ord * 7919) % 100003 * 10000000 + ord as pl, case when ord % 4 < 2 then concat('s', ord % 900) end as set_id, venue from concerts), w as (select * from c where d <= {DAY} and d >= {DAY} - 730),
    f as (select * from w qualify row_number() over (partition by band_id, coalesce(set_id, concat_ws('|', cast(d as varchar), cast(venue as varchar))) order by pl) = 1),
    o as (select setlist, lower(name) as song, row_number() over (partition by setlist order by idx) - 1 as pos from songs where not is_cover and name <> '')
    select setlist, song, pos, nth from (select f.setlist, song, pos, dense_rank() over (partition by band_id order by pl) as nth from f join o using (setlist)) where nth <= 20""",
)
def ordered_sets(spark, d):
    rows = concerts(spark, d).selectExpr("ord as setlist", "band_id % 50 as band_id", "d", "cast(year(d) as string) as tour", "(ord * 7919) % 100003 * 10000000 + ord as ord", "case when ord % 4 < 2 then concat('s', ord % 900) end as set_id", "venue")
    return P.useful_sets(rows, songs(spark, d), "1999-07-01").select("setlist", "song", "pos", "nth")


@query("p1_useful_sets", f"with {USEFUL} select setlist, song, pos, length, nth from useful")
def useful(spark, d):
    return P.useful_sets(sets(spark, d), songs(spark, d), "1999-07-01").select("setlist", "song", "pos", "length", "nth")


def med(x):
    s = f"list_sort(list({x}))"
    return f"case when count({x}) % 2 = 1 then {s}[cast((count({x}) + 1) / 2 as integer)] else cast(floor(({s}[cast(count({x}) / 2 as integer)] + {s}[cast(count({x}) / 2 as integer) + 1]) / 2 + 0.5) as bigint) end"


@query(
    "p2_predicted_setlist",
    f"""with {USEFUL}, b as (select band_id, count(*) as total, {med('length')} as target from (select distinct band_id, setlist, length from useful) group by band_id having count(*) >= 3),
    j as (select *, ceil(total / 2) as half, cast(floor(case when length > 1 then pos / (length - 1) else 0 end * 1000 + 0.5) as bigint) as p, greatest(0, 730 - ({DAY} - d)) as left_days from useful join b using (band_id)),
    s as (select band_id, song, total, target, half, count(*) as shows, sum(left_days) as left_days, {med('p')} as position, count(*) filter (pos = 0) as opener, count(*) filter (pos = length - 1) as closer,
      count(*) filter (is_encore) as encore, count(*) filter (nth <= half) as recent, count(*) filter (nth > half) as older from j group by all),
    t as (select *, cast(floor(shows / total * 100 + 0.5) as bigint) as rate from s),
    u as (select *, rate / 100 * 0.8::double + left_days / 730 / shows * 0.2::double as score, case when opener / total >= 0.5 then 'Likely opener' when closer / total >= 0.5 then 'Common closer' when encore / total >= 0.4 then 'Common encore'
      when recent / half >= 0.6 and (older = 0 or older / greatest(1, total - half) <= 0.2) then 'Recently added' end as label from t),
    k as (select *, row_number() over (partition by band_id order by score desc, song) as rn from u)
    select band_id, song, row_number() over (partition by band_id order by position, opener / total desc, song) as place, rate, label, total from k where rn <= greatest(1, target)""",
)
def predict(spark, d):
    return P.predict(sets(spark, d), songs(spark, d), "1999-07-01")


@query(
    "p2_prediction_summary",
    f"""with {USEFUL}, ps as (select band_id, setlist, nth, d, length, sha256(string_agg(song || case when is_encore then '*' else '' end, chr(10) order by pos, song, is_encore)) as t from useful group by all),
    to_ as (select band_id, count(*) as n, arg_max(d, nth) as first_day, arg_min(d, nth) as last_day, max(length) - min(length) as spread, sha256(string_agg(concat_ws('|', cast(setlist as varchar), cast(d as varchar), t), chr(10) order by nth)) as fp from ps group by band_id),
    ln as (select band_id, {med('length')} as target from ps group by band_id having count(*) >= 3),
    sg as (select band_id, song, count(*) as shows, sum(greatest(0, 730 - ({DAY} - d))) as left_days from useful group by 1, 2), rt as (select *, cast(floor(shows / n * 100 + 0.5) as bigint) as rate from sg join to_ using (band_id) join ln using (band_id)),
    pk as (select *, row_number() over (partition by band_id order by rate / 100 * 0.8::double + left_days / 730 / shows * 0.2::double desc, song) as rn from rt), pr as (select band_id, count(*) as songs, avg(rate) as rate from pk where rn <= greatest(1, target) group by band_id)
    select b.band_id, case when n is null then 'unavailable' when n >= 3 then 'ready' else 'insufficient_data' end as status, coalesce(n, 0) as sets, case when n >= 3 then first_day end as first_day, case when n >= 3 then last_day end as last_day,
      case when n >= 3 then case when n >= 8 and spread <= 2 and rate >= 65 then 'high' when n >= 5 and rate >= 45 then 'medium' else 'low' end end as confidence, coalesce(songs, 0) as songs, case when n >= 3 then fp end as fingerprint
    from (select distinct band_id from sets) b left join to_ using (band_id) left join pr using (band_id)""",
)
def summary(spark, d):
    return P.prediction_summary(sets(spark, d), songs(spark, d), "1999-07-01")


@query(
    "x23_fitting_tracks",
    """with t as (select p_partkey as track_id, p_partkey % 40 as artist_id, p_name || case p_partkey % 6 when 0 then ' (Karaoke)' when 1 then ' !' else '' end as title, case when p_partkey % 17 = 0 then 'A Tribute' else p_brand end as album from part), s as (select p_partkey as song_id, p_partkey % 40 as artist_id, upper(p_name) as name from part)
    select song_id, track_id from s join t on s.artist_id = t.artist_id and lower(name) = trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) where not regexp_matches(lower(title || ' ' || album), '\\b(karaoke|tribute|cover)\\b')""",
)
def fitting(spark, d):
    from setlight.sources.standins import read

    part = read(spark, d, "part")
    tracks = part.selectExpr("p_partkey as track_id", "p_partkey % 40 as artist_id", "p_name || case p_partkey % 6 when 0 then ' (Karaoke)' when 1 then ' !' else '' end as title", "case when p_partkey % 17 = 0 then 'A Tribute' else p_brand end as album")
    return P.fitting_tracks(tracks, part.selectExpr("p_partkey as song_id", "p_partkey % 40 as artist_id", "upper(p_name) as name"), decompose=False)


@query(
    "p3_p4_insights",
    f"""with {OWN}, u as (select * from sets where setlist in (select setlist from own)),
    r as (select s.setlist, s.d, s.tour, p.setlist as p_set, p.d as p_d, p.tour as p_tour, row_number() over (partition by s.setlist order by p.d desc, p.setlist) as nth from sets s join u p on p.band_id = s.band_id and p.d < s.d),
    c as (select setlist, count(*) filter (nth <= 5) as n_prior, count(*) filter (p_tour = tour) as n_tour from r group by setlist),
    t as (select distinct setlist, song, d from own),
    seen as (select r.setlist, t.song, count(*) filter (nth <= 5) as in_prior, count(*) as in_all, max(p_d) as last_d, count(*) filter (p_tour = r.tour) as in_tour from r join t on t.setlist = r.setlist join (select distinct setlist, song from own) q on q.setlist = r.p_set and q.song = t.song group by 1, 2),
    f as (select t.*, n_prior, n_tour, coalesce(in_prior, 0) as in_prior, coalesce(in_all, 0) as in_all, last_d, coalesce(in_tour, 0) as in_tour from t join c using (setlist) left join seen using (setlist, song)),
    k as (select setlist, song, case when in_all > 0 and floor((d - last_d) / 365.25) >= 1 then 1 when n_tour >= 2 and in_tour = 0 then 2 when n_prior >= 3 and in_prior / n_prior <= 0.25 then 3 end as priority,
      case when in_all > 0 and floor((d - last_d) / 365.25) >= 1 then -floor((d - last_d) / 365.25) when n_tour >= 2 and in_tour = 0 then -n_tour else in_prior / n_prior end as score from f)
    select setlist, song, ['long_gap', 'tour_debut', 'rare'][priority] as kind, rank from (select *, row_number() over (partition by setlist order by priority, score, song) as rank from k where priority is not null) where rank <= 2""",
)
def insights(spark, d):
    return P.insights(sets(spark, d), songs(spark, d), compare=5, least_prior=3, rare=0.25, least_tour=2, gap_years=1)


@query(
    "p5_position_tags",
    """with e as (select setlist, min(idx) as opener, min(idx) filter (is_encore) as encore from songs group by setlist)
    select e.setlist, opener, max(idx) filter (encore is null or idx < encore) as closer from e join songs using (setlist) group by 1, 2""",
)
def tags(spark, d):
    return P.position_tags(songs(spark, d))


@query("p6_flattened_sets", "select setlist, row_number() over (partition by setlist order by is_encore, idx) - 1 as idx, name, is_encore from songs")
def flattened(spark, d):
    part = songs(spark, d).groupBy("setlist", "is_encore").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "name"))), lambda x: x["name"]).alias("songs"))
    nested = part.groupBy("setlist").agg(F.array_sort(F.collect_list(F.struct(F.col("is_encore").alias("encore"), "songs"))).alias("parts"))
    return P.flattened(nested)


@query("p9_mix_songs", "select setlist, name from (select setlist, name, row_number() over (partition by setlist, name order by idx) as rn from songs where not is_cover) where rn = 1")
def mix_songs(spark, d):
    """Non-cover songs, the first of each name."""
    return songs(spark, d).where("not is_cover").groupBy("setlist", "name").agg(F.min("idx").alias("i")).drop("i")


@query("p7_p8_prediction_funnel", f"select count(*) as shows, count(*) filter (attending) as attending, count(*) filter (attending and d >= {DAY}) as coming, count(*) filter (attending and d >= {DAY} and band_id in (select band_id from bands)) as tracked from concerts")
def funnel(spark, d):
    """How many shows are left after each condition for a prediction."""
    from setlight.sources.standins import bands

    known = bands(spark, d).select("band_id", F.lit(True).alias("known"))
    rows = concerts(spark, d).join(known, "band_id", "left").withColumn("coming", F.col("attending") & (F.col("d") >= F.lit("1999-07-01").cast("date")))
    return rows.agg(F.count("*").alias("shows"), F.count_if("attending").alias("attending"), F.count_if("coming").alias("coming"), F.count_if(F.col("coming") & F.col("known")).alias("tracked"))
