"""Chat formatting by quotation linking, with DataFrame functions only.

A message's lines carry quote marks; the number of ``>`` marks is a line's level, and neighbouring
lines of a level are one block. Level 0 is the message's own text, the others are quotations. Own
text (whole, by block and by line) and quoted text (by block and by line) are normalised and hashed.
Units of any length count, only empty ones are left out. A quoted hash points to the latest earlier
message of the conversation whose own text has it: an as-of lookup inside each (conversation, hash),
so repeated lines don't multiply. It looks within a block of turns, then to the last of all earlier
blocks, so that no task holds a line that every message of a huge conversation has. A message's
parent is the one its lowest quote level points to with most characters, ties to the later turn.
Chains of parents are followed by pointer doubling. Messages come back without quotations, ordered so
that each thread stands together behind its first message: by the thread's first turn, then by turn.

Defined cases: a message without a resolvable quotation begins a thread of its own; attribution
lines ("... wrote:") just before a quotation go with it; null texts are empty; rows with a null
conversation or turn link with nothing and have no place; repeated rows are kept, each with its own place; rows with
equal turns are ordered by role and text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

MARKS = r"^((?:[ \t]*>)+)[ \t]?"
ATTRIBUTION = r"wrote:[ \t\r]*$"
PLACES = 1024


def blocks_of(text: Column) -> Column:
    """Blocks (level, text, lines) of a message, in order."""
    lines = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("line")),
    )
    quoted_next = lambda a, i: F.coalesce(F.get(a, i + 1)["level"], F.lit(0)) > 0
    return F.filter(lines, lambda x, i: ~((x["level"] == 0) & x["line"].rlike(ATTRIBUTION) & quoted_next(lines, i)))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """Messages with ``lines`` (level, line), ``blocks`` (level, lines), their own text and a row number-free id."""
    one = messages.select("conv_id", "turn", "role", "text", F.xxhash64("conv_id", "turn", "role", "text").alias("row_id"))
    lines = one.select("*", F.explode(F.array(blocks_of(F.col("text")))).alias("lines"))
    begins = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (F.get("lines", i)["level"] != F.get("lines", i - 1)["level"]))
    begun = lines.select("*", F.explode(F.array(F.when(F.size("lines") > 0, begins).otherwise(F.array().cast("array<int>")))).alias("begins"))
    blocks = F.transform(
        "begins",
        lambda b, i: F.struct(
            F.get("lines", b)["level"].alias("level"),
            F.transform(F.slice("lines", b + 1, F.coalesce(F.get("begins", i + 1), F.size("lines")) - b), lambda x: x["line"]).alias("lines"),
        ),
    )
    with_blocks = begun.select("conv_id", "turn", "role", "text", "row_id", F.explode(F.array(blocks)).alias("blocks"))
    own = F.flatten(F.transform(F.filter("blocks", lambda b: b["level"] == 0), lambda b: b["lines"]))
    return with_blocks.withColumns({"own": F.trim(F.array_join(own, "\n")), "n_quotes": F.size(F.filter("blocks", lambda b: b["level"] > 0))})


def parents(rows: DataFrame, least: int) -> DataFrame:
    """(row_id, conv_id, turn, parent_turn) of the messages whose quotations point to an earlier one."""
    usable = rows.where("conv_id is not null and turn is not null")
    quoting = usable.where("n_quotes > 0").select("conv_id").distinct()
    there = usable.join(quoting, "conv_id", "left_semi")
    unit = lambda level, text: F.struct(level.alias("level"), normal(text).alias("text"))
    whole = F.array(unit(F.lit(0), F.col("own")))
    by_block = F.transform("blocks", lambda b: unit(b["level"], F.array_join(b["lines"], "\n")))
    by_line = F.flatten(F.transform("blocks", lambda b: F.transform(b["lines"], lambda x: unit(b["level"], x))))
    units = there.select("conv_id", "turn", "row_id", F.explode(F.array_distinct(F.concat(whole, by_block, by_line))).alias("u")).where(F.length("u.text") >= least)
    keyed = units.select("conv_id", "turn", "row_id", F.col("u.level").alias("level"), F.length("u.text").alias("size"), F.xxhash64("u.text").alias("h1"), F.crc32(F.col("u.text").cast("binary")).alias("h2"))
    asked = F.when(F.col("level") > 0, 0).otherwise(1)  # at the same turn, quotations come before originals
    said = F.when(F.col("level") == 0, F.col("turn"))
    unit_key = ["conv_id", "h1", "h2"]
    keyed = keyed.withColumn("block", F.floor(F.col("turn") / PLACES))
    in_block = W.partitionBy(*unit_key, "block").orderBy("turn", asked).rowsBetween(W.unboundedPreceding, 0)
    quoted = keyed.withColumn("near", F.last(said, ignorenulls=True).over(in_block)).where("level > 0")
    blocks = keyed.groupBy(*unit_key, "block").agg(F.max(said).alias("last"))
    before = F.max("last").over(W.partitionBy(*unit_key).orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    far = blocks.select(*unit_key, "block", before.alias("far")).where("far is not null")
    found = quoted.join(far, [*unit_key, "block"], "left").withColumn("origin", F.coalesce("near", "far")).where("origin < turn")
    votes = found.groupBy("row_id", "conv_id", "turn", "level", "origin").agg(F.sum("size").alias("size"))
    best = F.min(F.struct("level", (-F.col("size")).alias("size"), (-F.col("origin")).alias("origin")))
    return votes.groupBy("row_id", "conv_id", "turn").agg(best.alias("best")).select("row_id", "conv_id", "turn", (-F.col("best.origin")).alias("parent_turn"))


def roots(links: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) by pointer doubling; a turn that repeats takes its smallest parent."""
    at = cut(links.groupBy("conv_id", "turn").agg(F.min("parent_turn").alias("root_turn")).withColumn("depth", F.lit(1)), "threads")
    while True:
        up = at.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("root_turn").alias("further"), F.col("depth").alias("more"))
        joined = at.join(up, (at.conv_id == F.col("c")) & (at.root_turn == F.col("t")), "left")
        at = cut(joined.select("conv_id", "turn", F.coalesce("further", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("more").isNotNull().alias("moved")), "threads")
        if at.where("moved").limit(1).count() == 0:
            return at.drop("moved")
        at = at.drop("moved")


def quoting_earlier_turns(messages: DataFrame) -> DataFrame:
    """The messages, of which every one but the first of a conversation quotes an earlier turn before its own text, and that turn's earlier one.

    Turn t quotes turn conv_id mod t. A source of conversations with known threads.
    """
    said = messages.select("conv_id", "turn", "role", "text")
    picked = lambda t: F.when(t > 0, F.pmod("conv_id", t))
    other = lambda n: said.select(F.col("conv_id").alias(f"c{n}"), F.col("turn").alias(f"t{n}"), F.col("role").alias(f"r{n}"), F.col("text").alias(f"x{n}"))
    first = said.join(other(1), (F.col("conv_id") == F.col("c1")) & (picked(F.col("turn")) == F.col("t1")), "left")
    both = first.join(other(2), (F.col("conv_id") == F.col("c2")) & (picked(F.col("t1")) == F.col("t2")), "left")
    marked = lambda mark, text: F.concat(F.lit(mark), F.replace(text, F.lit("\n"), F.lit(f"\n{mark}")), F.lit("\n"))
    deeper = F.when(F.col("t2").isNotNull(), marked(">> ", F.col("x2"))).otherwise("")
    quoted = F.when(F.col("t1").isNotNull(), F.concat(F.lit("On Monday "), "r1", F.lit(" wrote:\n"), marked("> ", F.col("x1")), deeper)).otherwise("")
    return both.select("conv_id", "turn", "role", F.concat(quoted, "text").alias("text"))


def link_quotations(messages: DataFrame, least: int = 1) -> DataFrame:
    """(conv_id, turn, role, parent_turn, root_turn, depth, reply_order, n_quotes, text), a row for each message."""
    rows = cut(parsed(messages), "messages")
    links = cut(parents(rows, least), "quotations")
    threads = roots(links)
    full = (
        rows.select("conv_id", "turn", "role", "own", "n_quotes", "row_id")
        .join(links.select(F.col("row_id").alias("l_id"), "parent_turn"), F.col("row_id") == F.col("l_id"), "left")
        .join(threads.select(F.col("conv_id").alias("t_conv"), F.col("turn").alias("t_turn"), "root_turn", "depth"), (F.col("conv_id") == F.col("t_conv")) & (F.col("turn") == F.col("t_turn")), "left")
        .select("conv_id", "turn", "role", "own", "n_quotes", "row_id", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("int").alias("depth"))
    )
    # places: parts of a conversation by first turn, blocks of a part by thread and turn, so that no window holds a
    # whole hot conversation or one huge thread; rows without a conversation or turn have no place
    full = cut(full, "placed")
    placed = full.where("conv_id is not null and turn is not null").withColumns({"part": F.floor(F.col("root_turn") / PLACES), "block": F.floor(F.col("turn") / PLACES)})
    counts = placed.groupBy("conv_id", "part", "root_turn", "block").agg(F.count("*").alias("n"))
    of_parts = counts.groupBy("conv_id", "part").agg(F.sum("n").alias("n"))
    earlier = lambda keys, *order: F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = of_parts.select("conv_id", "part", earlier(["conv_id"], "part").alias("before_part"))
    starts = counts.withColumn("before", earlier(["conv_id", "part"], "root_turn", "block")).join(parts, ["conv_id", "part"]).select("conv_id", "part", "root_turn", "block", (F.col("before") + F.col("before_part")).alias("start"))
    within = F.row_number().over(W.partitionBy("conv_id", "part", "root_turn", "block").orderBy("turn", "role", "row_id"))
    columns = ["conv_id", "turn", "role", "parent_turn", "root_turn", "depth"]
    inside = placed.withColumn("within", within).join(starts, ["conv_id", "part", "root_turn", "block"]).select(*columns, (F.col("start") + F.col("within")).alias("reply_order"), "n_quotes", F.col("own").alias("text"))
    outside = full.where("conv_id is null or turn is null").select(*columns, F.lit(None).cast("long").alias("reply_order"), "n_quotes", F.col("own").alias("text"))
    return inside.unionByName(outside)


def oracle_sql(messages: str = "select conv_id, turn, role, text from conversations") -> str:
    """The same for DuckDB, over the texts themselves in place of hashes."""
    normal = "trim(regexp_replace(lower({x}), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
    return rf"""
with recursive messages as ({messages}), said as (select *, row_number() over (order by conv_id, turn, role, text) as rn from messages),
raw as (select rn, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from said),
marked as (select rn, pos, line, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)[ \t]?', 1), '[^>]', '', 'g')) as level, regexp_replace(line, '^((?:[ \t]*>)+)[ \t]?', '') as body from raw),
kept as (select * from (select *, lead(level) over (partition by rn order by pos) as next from marked) where not (level = 0 and regexp_matches(line, 'wrote:[ \t\r]*$') and coalesce(next, 0) > 0)),
changes as (select *, case when level is distinct from lag(level) over (partition by rn order by pos) then 1 else 0 end as begins from kept),
numbered as (select *, sum(begins) over (partition by rn order by pos) as block from changes),
blocks as (select rn, block, level, string_agg(body, chr(10) order by pos) as body from numbered group by rn, block, level),
own as (select rn, trim(coalesce(string_agg(body, chr(10) order by pos) filter (level = 0), '')) as own from kept group by rn),
full_rows as (select s.rn, conv_id, turn, role, coalesce(own, '') as own, (select count(*) from blocks b where b.rn = s.rn and level > 0) as n_quotes from said s left join own using (rn)),
units as (
  select distinct conv_id, turn, rn, level, u from (
    select rn, 0 as level, {normal.format(x="own")} as u from own union all select rn, level, {normal.format(x="body")} from blocks union all select rn, level, {normal.format(x="body")} from kept
  ) join full_rows using (rn) where u <> '' and conv_id is not null and turn is not null
),
found as (select q.rn, q.conv_id, q.turn, q.level, q.u, max(o.turn) as origin from units q join units o on o.conv_id = q.conv_id and o.u = q.u and o.level = 0 and o.turn < q.turn where q.level > 0 group by all),
votes as (select rn, conv_id, turn, level, origin, sum(length(u)) as size from found group by all),
links as (select rn, conv_id, turn, arg_min(origin, (level, -size, -origin)) as parent_turn from votes group by all),
steps as (select conv_id, turn, min(parent_turn) as up from links group by all),
climb as (select conv_id, turn, up as root, 1 as depth from steps union all select c.conv_id, c.turn, s.up, c.depth + 1 from climb c join steps s on s.conv_id = c.conv_id and s.turn = c.root),
threads as (select conv_id, turn, arg_max(root, depth) as root_turn, max(depth) as depth from climb group by all)
select f.conv_id, f.turn, role, parent_turn, coalesce(root_turn, f.turn) as root_turn, cast(coalesce(depth, 0) as integer) as depth,
  row_number() over (partition by f.conv_id order by coalesce(root_turn, f.turn), f.turn, role, own) as reply_order, cast(n_quotes as integer) as n_quotes, own as text
from full_rows f left join links l on l.rn = f.rn left join threads t on t.conv_id = f.conv_id and t.turn = f.turn
"""


#: ``quoting_earlier_turns`` in SQL.
QUOTING_SQL = r"""select a.conv_id, a.turn, a.role, case when b.turn is null then '' else 'On Monday ' || b.role || ' wrote:' || chr(10) || '> ' || replace(b.text, chr(10), chr(10) || '> ') || chr(10) || case when c.turn is null then '' else '>> ' || replace(c.text, chr(10), chr(10) || '>> ') || chr(10) end end || a.text as text
  from conversations a left join conversations b on b.conv_id = a.conv_id and a.turn > 0 and b.turn = a.conv_id % nullif(a.turn, 0) left join conversations c on c.conv_id = b.conv_id and b.turn > 0 and c.turn = b.conv_id % nullif(b.turn, 0)"""
