"""Duplicate listens: candidate pairs, evidence, one-to-one assignment, review groups, canonical rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setlight.functions.text import in_locale

from .folds import global_rank
from .linking import sanitized
from .matching import match_listens, numbered
from .rounds import components, first_come, scratch

DURATION_TOLERANCE_MS = 2000
#: Pairs of listens that a task of ``candidate_pairs`` looks at.
PAIRS_A_TASK = 50_000_000
#: Spans of a time bucket, and listens of a cell: all pairs of two cells are made before the first is handed on.
SPANS = 8
CELL_ROWS = 64


def candidate_pairs(listens: DataFrame, tolerance_ms: int, same_source: bool = False) -> DataFrame:
    """Pairs of listens at most ``tolerance_ms`` apart, of different sources, with all columns of both (l_..., r_...).

    Listens of a source and a span of time lie in cells of some 64. Each cell goes to its own time bucket of some spans
    and, with the earlier listens of pairs, to the next, so an equi join of cells finds every pair once; cells
    that are near enough are unpacked in place, so a pair costs no step of a join. There are as many tasks as
    the pairs need, and a bucket with very many is a grid of tasks. Pairs of a later listen and a cell come together.
    """
    width = -(-(tolerance_ms + 1) // SPANS)
    names = [c for c in listens.columns if c != "source"]
    rows = listens.withColumn("span", F.floor(F.col("ms") / width)).where("span is not null")
    sizes = scratch(rows.groupBy("span", "source").agg(F.count("*").alias("n")), "span-sizes")
    own = sizes.groupBy(F.floor(F.col("span") / SPANS).alias("slot")).agg(F.sum("n").alias("n"))
    looks = own.join(own.selectExpr("slot + 1 as slot", "n as earlier"), "slot", "left").selectExpr("slot", "n * (n + coalesce(earlier, 0)) as pairs")
    total, most = looks.agg(F.sum("pairs"), F.max("pairs")).first()
    crowded = sizes.where(F.col("n") > CELL_ROWS).select(F.col("span").alias("at"), F.col("source").alias("of"), F.ceil(F.col("n") / CELL_ROWS).alias("cells"))
    rows = rows.join(crowded, (F.col("span") == F.col("at")) & F.col("source").eqNullSafe(F.col("of")), "left")
    cell = F.pmod(F.xxhash64("ord"), F.coalesce("cells", F.lit(1))).alias("cell")
    cells = rows.groupBy("span", "source", cell).agg(F.collect_list(F.struct(*names)).alias("rows")).withColumn("slot", F.floor(F.col("span") / SPANS))
    side = lambda c: [F.col(name).alias(f"{c}_{name}") for name in ("span", "source", "cell", "rows")]
    left, right, keys = cells.select(F.explode(F.array("slot", F.col("slot") + 1)).alias("slot"), *side("l")), cells.select("slot", *side("r")), ["slot"]
    n = -(-(total or 0) // PAIRS_A_TASK)
    if n > 1:
        n = max(n, listens.sparkSession.sparkContext.defaultParallelism)
        if most > PAIRS_A_TASK:
            keys, grids = ["slot", "x", "y"], looks.select("slot", F.ceil(F.sqrt(F.col("pairs") / PAIRS_A_TASK)).alias("g"))
            place = lambda c: F.pmod(F.xxhash64(f"{c}_span", f"{c}_source", f"{c}_cell"), "g")
            every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1))
            left = left.join(grids, "slot").withColumn("x", place("l")).withColumn("y", every)
            right = right.join(grids, "slot").withColumn("y", place("r")).withColumn("x", every)
        left, right = left.repartition(n, *keys), right.repartition(n, *keys)
    met = left.join(right, keys).where(F.col("r_span").between(F.col("l_span"), F.col("l_span") + (width - 1 + tolerance_ms) // width))
    if not same_source:
        met = met.where(F.col("l_source").isNull() | F.col("r_source").isNull() | (F.col("l_source") != F.col("r_source")))
    later = met.select("l_source", "r_source", "l_rows", F.inline("r_rows").alias(*[f"r_{c}" for c in names]))
    pairs = later.select("l_source", "r_source", *[f"r_{c}" for c in names], F.inline("l_rows").alias(*[f"l_{c}" for c in names]))
    earlier = (F.col("l_ms") < F.col("r_ms")) | ((F.col("l_ms") == F.col("r_ms")) & (F.col("l_ord") < F.col("r_ord")))
    return pairs.where(earlier & (F.col("r_ms") - F.col("l_ms") <= tolerance_ms))


def evidence() -> Column:
    """D3: tier of a pair of different sources; recording id, track id, release with both durations, names."""
    same = lambda c: F.col(f"l_{c}") == F.col(f"r_{c}")
    names = same("band_id") & (F.lower(F.trim("l_recording_title")) == F.lower(F.trim("r_recording_title")))
    close = (F.col("l_duration_ms") > 0) & (F.col("r_duration_ms") > 0) & (F.abs(F.col("l_duration_ms") - F.col("r_duration_ms")) <= DURATION_TOLERANCE_MS)
    tier = F.when(same("recording_id"), 2).when(same("track_id"), 3).when(same("release_title") & close & names, 4).when(names, 5)
    return tier.cast("long")


def matching_evidence(pairs: DataFrame, tolerance_ms: int) -> DataFrame:
    """D3: any pairs (l_..., r_..., with source, source_id and reviewed) as (l_ord, r_ord, tier, outcome, method, automatic), the first rule that holds.

    A reviewed listen is not judged again; one source's equal ids are the same listen whatever their times.
    """
    reviewed = F.coalesce("l_reviewed", F.lit(False)) | F.coalesce("r_reviewed", F.lit(False))
    by_id = (F.col("l_source") == F.col("r_source")) & (F.col("l_source_id") == F.col("r_source_id"))
    far = F.coalesce(F.abs(F.col("l_ms") - F.col("r_ms")) > tolerance_ms, F.lit(True))
    tier = F.when(reviewed, 0).when(by_id, 1).when(far, 9).otherwise(F.coalesce(evidence(), F.lit(9)))
    says = [
        (0, None, "user_reviewed", "manual", False),
        (1, 1, "exact_duplicate", "provider_id", True),
        (2, 2, "exact_duplicate", "recording_id", True),
        (3, 3, "exact_duplicate", "spotify_id", True),
        (4, 4, "probable_duplicate", "trusted_release_duration_signature", False),
        (5, 5, "ambiguous", "normalized_signature", False),
        (9, None, "unique", None, False),
    ]
    rules = pairs.sparkSession.createDataFrame(says, "rule long, tier long, outcome string, method string, automatic boolean")
    return pairs.withColumn("rule", tier.cast("long")).join(F.broadcast(rules), "rule").select("l_ord", "r_ord", "tier", "outcome", "method", "automatic")


def merge_component(groups: DataFrame, pairs: DataFrame, earlier: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions (group_id, a, b) to merge, applied to review groups: (merged members, remaining pairs).

    Listens joined by the decision or by earlier ones (group_id, a, b) become one; the smallest id stands for
    them. ``groups`` holds (group_id, ord), ``pairs`` (group_id, a, b, tier). Pairs inside the merged listens
    and the decided pair go, the others point to the smallest id and are kept once, the first by (a, b).
    """
    edges = earlier.select("group_id", "a", "b").unionByName(decided.select("group_id", "a", "b")).where("a <> b")
    labels = components(edges.select("a", "b")).select(F.col("node").alias("ord"), F.col("label").alias("target"))
    start = decided.join(labels, decided.a == labels.ord).select("group_id", F.col("target").alias("merged_into"))
    members = groups.join(labels, "ord").join(start, "group_id").where("target = merged_into").select("group_id", "ord", "target")
    end = lambda c: members.select("group_id", F.col("ord").alias(c), F.col("target").alias(f"to_{c}"))
    mapped = pairs.join(decided.select("group_id", "a", "b", F.lit(True).alias("done")), ["group_id", "a", "b"], "left").where("done is null").drop("done").join(end("a"), ["group_id", "a"], "left").join(end("b"), ["group_id", "b"], "left")
    x, y = F.coalesce("to_a", "a"), F.coalesce("to_b", "b")
    moved = mapped.select("group_id", F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "tier", F.struct("a", "b").alias("was")).where("a <> b")
    return members, moved.groupBy("group_id", "a", "b").agg(F.min_by("tier", "was").alias("tier"))


#: Time slots of this many tolerances: a listen goes to the next slot as well only if it is near its end.
SLOT = 4


def meetings(listens: DataFrame, tolerance_ms: int, from_ms: int | None = None, *others: str) -> DataFrame:
    """(a, b, tier) of the pairs with evidence, and ``others`` of both listens (l_..., r_...).

    Pairs with evidence share a recording id, a track id or band and title, so listens meet by these within
    their time slots, not all listens of a time. They carry what the mark itself does not say; a pair that meets
    more than once counts where its tier says.
    """
    width = SLOT * (tolerance_ms + 1)
    band = F.col("band_id").cast("string")
    title = F.concat(F.length(band), F.lit("|"), band, F.lit("|"), F.lower(F.trim("recording_title")))
    said = {2: [], 3: ["recording_id"], 5: ["recording_id", "track_id", "release_title", "duration_ms"]}
    carried = lambda rule: [(F.col(c) if c in said[rule] else F.lit(None).cast(listens.schema[c].dataType)).alias(c) for c in said[5]]
    marks = F.array(*[F.struct(F.lit(rule).alias("rule"), value.alias("mark"), *carried(rule)) for rule, value in ((2, F.col("recording_id")), (3, F.col("track_id")), (5, title))])
    marked = listens.select("ord", "ms", "source", *others, F.explode(F.filter(marks, lambda m: m["mark"].isNotNull())).alias("m"))
    slot = F.floor(F.col("ms") / width)
    side = lambda c, at: marked.select(*[F.col(x).alias(f"{c}_{x}") for x in ("ord", "ms", "source", *others)], *[F.col(f"m.{x}").alias(f"{c}_{x}") for x in said[5]], "m.rule", "m.mark", at.alias("slot"))
    right = side("r", slot)
    if from_ms is not None:
        right = right.where(F.col("r_ms") >= from_ms)
    left = side("l", F.explode(F.when(F.col("ms") >= (slot + 1) * width - tolerance_ms, F.array(slot, slot + 1)).otherwise(F.array(slot))))
    earlier = (F.col("l_ms") < F.col("r_ms")) | ((F.col("l_ms") == F.col("r_ms")) & (F.col("l_ord") < F.col("r_ord")))
    other = F.col("l_source").isNull() | F.col("r_source").isNull() | (F.col("l_source") != F.col("r_source"))
    same = lambda c: F.coalesce(F.col(f"l_{c}") == F.col(f"r_{c}"), F.lit(False))
    close = (F.col("l_duration_ms") > 0) & (F.col("r_duration_ms") > 0) & (F.abs(F.col("l_duration_ms") - F.col("r_duration_ms")) <= DURATION_TOLERANCE_MS)
    own = (F.col("rule") == 2) | ~same("recording_id") & ((F.col("rule") == 3) | ~same("track_id"))
    pairs = left.join(right, ["slot", "mark", "rule"]).where(earlier & (F.col("r_ms") - F.col("l_ms") <= tolerance_ms) & other & own)
    tier = F.when((F.col("rule") == 5) & same("release_title") & close, 4).otherwise(F.col("rule")).cast("long")
    return pairs.select(F.least("l_ord", "r_ord").alias("a"), F.greatest("l_ord", "r_ord").alias("b"), tier.alias("tier"), *[f"{c}_{x}" for c in "lr" for x in others])


def candidates(listens: DataFrame, tolerance_ms: int, from_ms: int | None = None) -> DataFrame:
    """(a, b, tier, automatic): pairs with evidence; of a page, those whose later listen is not before ``from_ms``."""
    return meetings(listens, tolerance_ms, from_ms).withColumn("automatic", F.col("tier") <= 3)


def pair_key(a: Column, b: Column) -> Column:
    """The key of a pair of ids, whichever comes first; keys compare in the reader's order."""
    return in_locale(F.concat(F.least(a, b), F.lit("|"), F.greatest(a, b)))


def assign_one_to_one(pairs: DataFrame, by_pair_key: bool = False) -> DataFrame:
    """Greedy matching by (tier, a, b) over automatic pairs; then review pairs that it leaves alone; the rest is rejected.

    With ``by_pair_key`` the ids are texts, and pairs of a tier come in the order of their keys. Pairs are
    sorted once and go by their places; of pairs that are equal one is taken.
    """
    pairs = scratch(pairs.select("a", "b", "tier", "automatic"), "pairs")
    order = ["tier", *([pair_key(F.col("a"), F.col("b"))] if by_pair_key else []), "a", "b"]
    ranked = scratch(global_rank(pairs.where("automatic"), [F.col(c) if isinstance(c, str) else c for c in order]), "ranked-pairs").withColumn("ends", F.array("a", "b"))
    won = first_come(ranked, "place", "place", "ends").withColumn("won", F.lit(True))
    marked = scratch(ranked.join(won, "place", "left").select("a", "b", "tier", F.when(F.col("won"), "automatic").otherwise("rejected").alias("outcome")), "assigned")
    used = marked.where("outcome = 'automatic'").select(F.explode(F.array("a", "b")).alias("n")).distinct()
    end = lambda c: used.select(F.col("n").alias(c), F.lit(True).alias(f"{c}_used"))
    touched = F.coalesce("a_used", "b_used").isNotNull()
    others = pairs.where("not automatic").join(end("a"), "a", "left").join(end("b"), "b", "left")
    return marked.unionByName(others.select("a", "b", "tier", F.when(touched, "rejected").otherwise("review").alias("outcome")))


def matched_listens(listens: DataFrame, tolerance_ms: int) -> DataFrame:
    """The automatic pairs of ``assign_listens``, (a, b, tier, outcome), for which no other pair is made."""
    rows = numbered(listens, "ord", "ms", "source", "recording_id", "track_id")
    return match_listens(rows, tolerance_ms).select("a", "b", "tier", F.lit("automatic").alias("outcome"))


def assign_listens(listens: DataFrame, tolerance_ms: int) -> DataFrame:
    """What ``assign_one_to_one`` says of the candidates of ``listens``: (a, b, tier, outcome).

    The matching comes first and goes with the listens, so a pair knows its outcome where it is found: pairs
    are neither written nor shuffled.
    """
    rows = numbered(listens, "ord", "ms", "source", "recording_id", "track_id", "band_id", "recording_title", "release_title", "duration_ms")
    matched = match_listens(rows, tolerance_ms)
    ends = matched.select("a", F.inline(F.array(*[F.struct(F.col(c).alias("t"), F.col(f"{c}_row").alias("at")) for c in "ab"])))
    ends = ends.groupBy("t").agg(F.collect_list("at").alias("at"), F.min("a").alias("match"))
    known = rows.join(ends, rows.ord == ends.t, "left").withColumns({"taken": F.col("t").isNotNull(), "won": F.when(F.array_contains("at", F.col("row")), F.col("match"))})
    pairs = meetings(known, tolerance_ms, None, "taken", "won")
    won = F.coalesce(F.col("l_won") == F.col("r_won"), F.lit(False))
    outcome = F.when(F.col("tier") <= 3, F.when(won, "automatic").otherwise("rejected")).otherwise(F.when(F.col("l_taken") | F.col("r_taken"), "rejected").otherwise("review"))
    return pairs.select("a", "b", "tier", outcome.alias("outcome"))


def canonical_rows(assigned: DataFrame) -> DataFrame:
    """Two rows for each automatic pair; the smaller id represents."""
    row = lambda c, duplicate_of: F.struct(F.col(c).alias("ord"), F.col("a").alias("canonical"), "tier", duplicate_of.alias("duplicate_of"))
    both = F.array(row("a", F.lit(None).cast(assigned.schema["a"].dataType)), row("b", F.col("a")))
    return assigned.where("outcome = 'automatic'").select(F.explode(both).alias("x")).select("x.*")


def review_groups(assigned: DataFrame) -> DataFrame:
    """Connected review pairs form a group, probable only if every pair is."""
    review = assigned.where("outcome = 'review'")
    labels = components(review.select("a", "b"))
    return review.join(labels, review.a == labels.node).groupBy(F.col("label").alias("group_id")).agg(F.count("*").alias("pairs"), F.bool_and(F.col("tier") == 4).alias("probable"), F.max("b").alias("last_member"))


def canonicalize(listens: DataFrame, canonical: DataFrame, *others: str) -> DataFrame:
    """Duplicates go, and their representative takes the fields it lacks from them; ``others`` are kept as they are.

    The first id with a value gives it; of several values of that id the smallest, so the same rows always give the same.
    """
    dup = canonical.where("duplicate_of is not null").select(F.col("ord").alias("dup"), F.col("duplicate_of").alias("rep"))
    values = listens.join(dup, listens.ord == dup.dup).groupBy("rep").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("ord", c))).alias(f"d_{c}") for c in ("duration_ms", "recording_id", "track_id")])
    kept = listens.join(dup, listens.ord == dup.dup, "left_anti")
    return kept.join(values, kept.ord == values.rep, "left").select("ord", "ms", *others, *[F.coalesce(c, f"d_{c}").alias(c) for c in ("duration_ms", "recording_id", "track_id")])


def merge_new(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose id and fingerprint are new; among the new ones the earlier row claims both."""
    fresh = incoming.join(existing.select("id").distinct(), "id", "left_anti").join(existing.where("fp is not null").select("fp").distinct(), "fp", "left_anti")
    keyed = fresh.withColumn("claims", F.array(F.concat(F.lit("i"), F.col("id").cast("string")), F.concat(F.lit("f"), F.col("fp"))))
    return keyed.join(first_come(keyed, "ord", "ord", "claims"), "ord").drop("claims")


def new_listens(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """The same for an incremental pull, of which only valid listens of the provider count."""
    return merge_new(sanitized(incoming).where("source = 'listenbrainz'"), existing)


def audit(assigned: DataFrame) -> DataFrame:
    """Pairs by tier and outcome."""
    return assigned.groupBy("tier", "outcome").agg(F.count("*").alias("n"))


def coverage_audit(listens: DataFrame) -> DataFrame:
    """How many listens carry which ids, sources, first and last month."""
    month = lambda f: F.date_format(F.timestamp_millis(f("ms")), "yyyy-MM")
    return listens.agg(F.count("*").alias("events"), F.count("recording_id").alias("recordings"), F.count("track_id").alias("tracks"), F.count_if(F.col("source") == "spotify_import").alias("imports"), F.count_if(F.col("source") == "listenbrainz").alias("pulls"), month(F.min).alias("first_month"), month(F.max).alias("last_month"))


def broken_rows(canonical: DataFrame) -> DataFrame:
    """Rows whose representative is missing or is itself a duplicate."""
    reps = canonical.select(F.col("ord").alias("r"), F.col("duplicate_of").alias("r_dup"))
    return canonical.where("duplicate_of is not null").join(reps, F.col("duplicate_of") == F.col("r"), "left").where("r is null or r_dup is not null").select("ord")


def stale_groups(stored: DataFrame, planned: DataFrame) -> DataFrame:
    """Stored groups that the plan no longer has and nobody reviewed."""
    return stored.where("not reviewed").join(planned.select("group_id"), "group_id", "left_anti")
