"""Line dedup over levelled sorted runs of line hashes.

``LineRuns`` is an append-only store in the shared folder. Each batch of documents becomes one run of
(h1, h2, n, holder): the 128-bit hash of a line key, the number of documents of the batch that hold
it and the largest id among them. A new batch is merge-anti-joined with the runs: keys that no run
has are first sightings and bring their holder, the others only add to the count. When a level holds
``fanout`` runs they are merged into one sorted run of the next level.

Batches go from large ids to small ones, so a first sighting already carries the holder that stays.

Defined cases: a null or empty text is one empty line; a null id counts as a document but never as
the holder; repeated rows are documents of their own, and all rows of the largest id keep their
lines; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_counted, per_batch, pieces, unused

#: Stripped at both ends of a line.
STRIP = " \t\n\x0b\x0c\r"
RUN = "h1 long, h2 long, n long, holder long"
#: Repeated keys that are broadcast: 32 MB of data at most.
MOST_KEYS = 1_000_000
PAIR = np.dtype([("h1", "<i8"), ("h2", "<i8")])


def line_hashes(text: str | None, least: int) -> list[bytes | None]:
    """For each line the 16-byte hash of its key, or None where the key is shorter than ``least``."""
    out: list[bytes | None] = []
    for line in (text or "").split("\n"):
        key = line.strip(STRIP)
        out.append(hashlib.blake2b(key.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest() if len(key) >= least else None)
    return out


def batch_keys(docs: DataFrame, least: int) -> DataFrame:
    """The run of one batch: a row for each key, added up before the shuffle and after it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list] = {}
            for doc_id, text in (x for piece in pieces([batch]) for x in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True)):
                for h in {h for h in line_hashes(text, least) if h}:
                    got = found.setdefault(h, [0, None])
                    got[0] += 1
                    if doc_id is not None and (got[1] is None or doc_id > got[1]):
                        got[1] = doc_id
            h = np.frombuffer(b"".join(found), PAIR)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h["h1"].copy()), pa.array(h["h2"].copy()), pa.array([x[0] for x in found.values()], pa.int64()), pa.array([x[1] for x in found.values()], pa.int64())],
                ["h1", "h2", "n", "holder"],
            )

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, RUN)
    return counted.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("holder").alias("holder"))


class LineRuns:
    """Levelled runs of line keys; ``fanout`` runs of a level are merged into one of the next."""

    def __init__(self, spark: SparkSession, least: int = 40, fanout: int = 3):
        self.spark, self.least, self.fanout = spark, least, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _union(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out

    def merged(self, runs: list[DataFrame] | None = None) -> DataFrame:
        runs = self.runs() if runs is None else runs
        if not runs:
            return self.spark.createDataFrame([], RUN)
        if len(runs) == 1:
            return runs[0]
        return self._union(runs).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("holder").alias("holder"))

    def add(self, docs: DataFrame) -> None:
        """Add a batch: its new keys with their holders, its known keys as counts."""
        keys = batch_keys(docs, self.least)
        if runs := self.runs():
            keys = cut(keys, "line-batch")
            seen = self._union(runs).where("holder is not null").select("h1", "h2")
            first = keys.join(seen, ["h1", "h2"], "left_anti")
            again = keys.join(seen, ["h1", "h2"], "left_semi").withColumn("holder", F.lit(None).cast("long"))
            keys = first.unionByName(again)
        self._place(keys, 0)

    def _place(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(cut(run.sortWithinPartitions("h1", "h2"), f"line-run-{level}"))
        if len(self.levels[level]) >= self.fanout:
            together, self.levels[level] = self.levels[level], []
            self._place(self.merged(together), level + 1)

    def repeated(self, at_least: int) -> DataFrame:
        """(h1, h2, n, holder) of the keys that ``at_least`` documents hold."""
        return self.merged().where(F.col("n") >= at_least).select("h1", "h2", "n", "holder")


def id_ranges(docs: DataFrame, batches: int) -> list:
    """Predicates on doc_id that split the table, large ids first; null ids come last."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return [F.lit(True)]
    step = max(1, -(-(high - low + 1) // batches))
    edges = [*range(low, high + 1, step), high + 1]
    inside = [(F.col("doc_id") >= a) & (F.col("doc_id") < b) for a, b in zip(edges, edges[1:], strict=False)][::-1]
    return [*inside[:-1], inside[-1] | F.col("doc_id").isNull()]


def dedup_lines(docs: DataFrame, least: int = 40, at_least: int = 5, batches: int = 3) -> DataFrame:
    """Every row of ``docs`` with its columns, ``kept`` (text without dropped lines), ``n_lines`` and ``n_dropped``,
    which replace columns of these names."""
    spark = docs.sparkSession
    store = LineRuns(spark, least)
    for where in id_ranges(docs, batches):
        store.add(docs.where(where))
    repeated = cut(store.repeated(at_least), "line-repeated")
    own_id, own_fp, own_drop = unused(docs, "dedup_id", "dedup_fp", "dedup_drop")

    def places(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts, lines, hashes = [], [], [], []
        for doc_id, text, fp in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for i, h in enumerate(line_hashes(text, least)):
                if h:
                    ids.append(doc_id), texts.append(fp), lines.append(i), hashes.append(h)
        h = np.frombuffer(b"".join(hashes), PAIR)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(texts, pa.int64()), pa.array(lines, pa.int32()), pa.array(h["h1"].copy()), pa.array(h["h2"].copy())],
            ["id", "fp", "line", "h1", "h2"],
        )

    marked = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_fp: F.xxhash64("text")})
    lines = marked.select(own_id, "text", own_fp).mapInArrow(per_batch(places, 1000), "id long, fp long, line int, h1 long, h2 long")
    # few keys can be frequent; the rows of the others are shuffled only where the keys do not fit a broadcast
    found = lines.join(F.broadcast(repeated), ["h1", "h2"]) if repeated.count() <= MOST_KEYS else join_counted(lines, repeated, ["h1", "h2"], "n")
    drops = (
        found.where("id is null or holder is null or id <> holder")
        .groupBy("id", "fp")
        .agg(F.collect_set("line").alias(own_drop))
    )
    joined = marked.alias("d").join(drops.alias("x"), F.col(f"d.{own_id}").eqNullSafe(F.col("x.id")) & (F.col(f"d.{own_fp}") == F.col("x.fp")), "left").select("d.*", f"x.{own_drop}")
    names = [c for c in docs.columns if c.lower() not in ("kept", "n_lines", "n_dropped")]

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, total, gone = [], [], []
        for text, drop in zip(batch.column("text").to_pylist(), batch.column(own_drop).to_pylist(), strict=True):
            lines, drop = (text or "").split("\n"), set(drop or ())
            total.append(len(lines)), gone.append(len(drop))
            kept.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text or "")
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*names, "kept", "n_lines", "n_dropped"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c in names)
    return joined.select(*[F.col(f"`{c}`") for c in names], own_drop).mapInArrow(per_batch(keep, 1000), f"{schema}, kept string, n_lines long, n_dropped long")
