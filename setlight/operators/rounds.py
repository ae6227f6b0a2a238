"""Operators that take several distributed rounds: first-come selection and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table of so many rows is broadcast at most: some 16 MB.
BROADCAST_ROWS = 1_000_000
ROWS_A_FILE = 100_000
#: Rounds before what is left is split into components, and the claims of one that a task passes over in order;
#: it holds only the tokens that are taken. Where tokens have more claims than ``DENSE``, rounds accept few rows each.
FIRST_ROUNDS, ONE_TASK, DENSE = 4, 2_000_000, 3


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temp folder only in local mode.

    A cluster without that setting gets an error: a machine-local folder would be invisible to the
    other executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="setlight-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there.

    Survives lost executors, unlike cached blocks or a local checkpoint.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# --- first come -------------------------------------------------------------------------------


def first_come(rows: DataFrame, key: str, order: str, tokens: str) -> DataFrame:
    """The keys that a pass in ``order`` accepts, where an accepted row claims its tokens and rows with a claimed token are skipped.

    A row that comes first for all of its tokens is accepted in any order of evaluation, so each round
    takes all such rows at once and drops those that meet a claimed token. What a few rounds leave, such as
    long chains of claims, or all where tokens have many claims, is split into the components of rows that share tokens; each is passed over in
    one task. Only components of more than ``ONE_TASK`` claims go on in rounds. ``order`` is unique.
    """
    left = scratch(rows.select(F.col(key).alias("k"), F.col(order).alias("o"), F.explode(tokens).alias("t")).where("t is not null"), "claims")
    taken, n = [], 0
    size, distinct = left.agg(F.count("*"), F.approx_count_distinct("t")).first()
    split_at = 0 if size > DENSE * distinct else FIRST_ROUNDS
    while True:
        if n == split_at:
            passed, left = _small_components(left)
            taken.append(passed)
        first = left.withColumn("first", F.min("o").over(W.partitionBy("t")))
        wins = scratch(first.groupBy("k").agg(F.bool_and(F.col("o") == F.col("first")).alias("wins")).where("wins").select("k"), "accepted")
        if wins.limit(1).count() == 0:
            break
        taken.append(wins)
        claimed = left.join(wins, "k", "left_semi").select("t").distinct()
        gone = left.join(claimed, "t", "left_semi").select("k").distinct()
        left = scratch(left.join(gone, "k", "left_anti"), "claims")
        n += 1
    out = rows.where(F.size(F.array_compact(F.col(tokens))) == 0).select(F.col(key).alias("k"))
    for part in taken:
        out = out.unionByName(part)
    return out.withColumnRenamed("k", key)


def _small_components(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a pass accepts in each component of claims (k, o, t) that fits a task, and the claims of the others."""
    ends = left.groupBy("k").agg(F.min("t").alias("b"))
    labels = components(left.join(ends, "k").select(F.col("t").alias("a"), "b"), keep_loops=True)
    named = scratch(left.join(labels, left.t == labels.node).select("k", "o", "t", "label"), "component-claims")
    large = scratch(named.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > ONE_TASK).select("label"), "large-components")

    keys = left.select("k").schema
    plain = isinstance(keys["k"].dataType, T.LongType)
    out = pa.schema([("k", pa.int64() if plain else pa.string())])

    def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Claims sorted by component and order; a row's claims follow each other."""
        label, claimed, row, tokens, accepted = None, set(), None, set(), []

        def close() -> None:
            if tokens and not tokens & claimed:
                claimed.update(tokens)
                accepted.append(row[1])

        for batch in batches:
            for at, o, k, t in zip(*(batch.column(c).to_pylist() for c in ("label", "o", "k", "t"))):
                if row is None or (at, o) != (label, row[0]):
                    close()
                    if at != label:
                        label, claimed = at, set()
                    row, tokens = (o, k), set()
                tokens.add(t)
            yield pa.RecordBatch.from_pydict({"k": accepted}, schema=out)
            accepted = []
        close()
        yield pa.RecordBatch.from_pydict({"k": accepted}, schema=out)

    small = named.join(large, "label", "left_anti")
    place = F.col("o") if isinstance(named.schema["o"].dataType, T.IntegralType) else F.dense_rank().over(W.partitionBy("label").orderBy("o"))
    flat = small.select("label", F.col("k") if plain else F.to_json(F.struct("k")).alias("k"), "t", place.alias("o"))
    kept = flat.repartition("label").sortWithinPartitions("label", "o").mapInArrow(one_pass, "k long" if plain else "k string")
    accepted = scratch(kept if plain else kept.select(F.from_json("k", keys).alias("x")).select("x.k"), "accepted")
    return accepted, scratch(named.join(large, "label", "left_semi").select("k", "o", "t"), "claims")


# --- components -------------------------------------------------------------------------------


def few_or_shuffled(labels: DataFrame) -> DataFrame:
    """``labels``, broadcast while there are few of them."""
    return F.broadcast(labels) if labels.count() <= BROADCAST_ROWS else labels


def _hooks(pairs: DataFrame) -> DataFrame:
    """(node, label): each node of (u, v), u <= v, with its least neighbour, or itself if that is larger."""
    return pairs.select(F.col("v").alias("node"), F.col("u").alias("label")).unionByName(pairs.select(F.col("u").alias("node"), F.col("u").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))


def _flatten(labels: DataFrame) -> DataFrame:
    """(node, label) with each node's root, by pointer jumping."""
    while True:
        via = labels.select(F.col("node").alias("via"), F.col("label").alias("top"))
        n = labels.count()
        low = labels.select("node", F.col("label").alias("via")).join(F.broadcast(via) if n <= BROADCAST_ROWS else via, "via")
        low = scratch(low.select("node", F.col("via").alias("old"), F.col("top").alias("label")).coalesce(max(4, -(-n // ROWS_A_FILE))), "labels")
        labels = low.select("node", "label")
        if low.where("label <> old").limit(1).count() == 0:
            return labels


def components(edges: DataFrame, a: str = "a", b: str = "b", keep_loops: bool = False) -> DataFrame:
    """(node, label) for the nodes of (a, b): the smallest node that each can reach.

    Nodes hook on to their least neighbours and jump to their roots; then edges are drawn between
    roots, so those inside a component go, and the roots hook again. Edges of a node to itself are left
    out unless ``keep_loops``.
    """
    some = edges if keep_loops else edges.where(F.col(a) != F.col(b))
    pairs = scratch(some.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "edges")
    labels = _flatten(scratch(_hooks(pairs), "labels"))
    while True:
        root = few_or_shuffled(labels.select("node", F.col("label").alias("root")))
        ends = pairs.join(root, pairs.u == root.node).select(F.col("root").alias("x"), "v").join(root, F.col("v") == root.node).select("x", F.col("root").alias("y"))
        pairs = scratch(ends.where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
        if pairs.limit(1).count() == 0:
            return labels
        moved = scratch(_hooks(pairs).select(F.col("node").alias("label"), F.col("label").alias("to")), "hooks")
        labels = _flatten(scratch(labels.join(few_or_shuffled(moved), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels"))
