"""Shared pieces of the training-data operators: tables, scratch space and label folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setlight.operators.rounds import scratch as cut
from setlight.operators.rounds import scratch_dir

__all__ = ["cut", "held_out", "join_counted", "one_label", "per_batch", "pieces", "scratch_dir", "table", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id's text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) with one row an id. Null ids and null labels go; of unequal labels 1 wins."""
    return (
        labels.select("doc_id", F.col(column).cast("int").alias("label"))
        .where("doc_id is not null and label is not null")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names with underscores before them until no column of ``df`` has them, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Fewer keys than this can each have more than so large a part of all rows.
HEAVY = 10_000


def join_counted(rows: DataFrame, keys: DataFrame, on: str | list[str] = "h", n: str = "df") -> DataFrame:
    """``rows`` joined with ``keys`` on ``on``, where the column ``n`` of ``keys`` counts the rows of a key, or more.

    Fewer than ``HEAVY`` keys can have more than that part of all rows: these are broadcast, and their
    rows stay where they are. No other key is large enough to matter in a shuffle.
    """
    names = [on] if isinstance(on, str) else on
    most = (keys.agg(F.sum(n)).first()[0] or 0) // HEAVY
    heavy = F.broadcast(keys.where(F.col(n) > most))
    return rows.join(heavy, names).unionByName(rows.join(heavy.select(*names), names, "left_anti").join(keys.where(F.col(n) <= most), names))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def per_batch(fn: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch | None], rows: int | None = None):
    """A mapInArrow function from one that maps a record batch, of at most ``rows`` rows if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, rows) if rows else batches:
            out = fn(batch)
            if out is None:
                continue
            if isinstance(out, pa.Table):
                yield from out.combine_chunks().to_batches()
            else:
                yield out

    return run
