"""Sums over listens that are kept up to date: A2, A9 and A20 without reading the archive again.

The archive is a table by month. A view holds, for each day and band, the number and duration of canonical
listens, as signed contributions in one folder for each batch. A batch adds new listens and takes back what
it changes: listens that are now declared duplicates go, and a representative that takes fields from
its duplicates (D10) is taken back as it was and added as it is. Only the months of changed rows are read;
which they are, the ids of the archive tell.
Batches are numbered and overwrite their own folders, so one that failed can be run again. Every few
batches the contributions become one base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setlight.operators.dedupe import canonicalize
from setlight.operators.rounds import scratch
from setlight.sources.documents import month, read_parquet

LISTEN = "ord long, ms long, band_id long, duration_ms long, recording_id string, track_id string"
DECLARED = "ord long, duplicate_of long, ms long"
SUMS = "month string, d date, band_id long, n long, duration_ms long"
KEYS = ["month", "d", "band_id"]


def sums(listens: DataFrame, sign: int = 1) -> DataFrame:
    """(month, d, band_id, n, duration_ms) of listens, times ``sign``."""
    known = F.when(F.col("duration_ms") > 0, F.col("duration_ms")).otherwise(0)
    at = F.timestamp_millis("ms")
    return listens.groupBy(month(F.col("ms")).alias("month"), F.to_date(at).alias("d"), "band_id").agg((F.count("*") * sign).alias("n"), (F.sum(known) * sign).alias("duration_ms"))


def added_up(parts: DataFrame) -> DataFrame:
    """Contributions as one row for each key; keys without listens go."""
    return parts.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("duration_ms").alias("duration_ms")).where("n <> 0")


def canonical_of(listens: DataFrame, declared: DataFrame) -> DataFrame:
    """The listens that are no duplicates, with the fields they take from theirs, and their bands."""
    return canonicalize(listens, declared, "band_id")


class MaintainedSums:
    """The archive, the declared duplicates and the view under one folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, compact_every: int = 8):
        self.spark, self.folder, self.compact_every = spark, folder.rstrip("/"), compact_every

    def _numbered(self, name: str, schema: str, below: int, months: list[str] | None = None) -> DataFrame:
        """The rows of a table from batches before ``below``, of some months only."""
        rows = read_parquet(self.spark, f"{self.folder}/{name}", f"{schema}, batch int" + (", month string" if name == "listens" else "")).where(F.col("batch") < below)
        return rows.drop("batch") if months is None else rows.where(F.col("month").isin(months)).drop("batch")

    def _write(self, name: str, rows: DataFrame, batch: int, *parts: str) -> None:
        rows.write.mode("overwrite").partitionBy(*parts).parquet(f"{self.folder}/{name}/batch={batch}")

    def apply(self, batch: int, listens: DataFrame, declared: DataFrame) -> None:
        """Take new listens and newly declared duplicates (ord, duplicate_of, ms), the ms being the duplicate's.

        A duplicate and its representative may lie in any months: which ones is looked up by their ids.
        """
        new, declared = scratch(listens.select(*_names(LISTEN)), "new-listens"), scratch(declared.select(*_names(DECLARED)), "declared")
        # The rows whose contribution may change: new ones, declared ones and their representatives.
        before = self._numbered("declared", DECLARED, batch)
        changed = scratch(declared.select(F.col("ord").alias("k")).unionByName(declared.select(F.col("duplicate_of").alias("k"))).distinct(), "changed")
        family = before.join(changed, before.duplicate_of == changed.k, "left_semi")
        wanted = scratch(changed.unionByName(family.select(F.col("ord").alias("k"))).distinct(), "wanted")
        touched = [r[0] for r in self._numbered("listens", LISTEN, batch).join(wanted, F.col("ord") == F.col("k"), "left_semi").select("month").distinct().collect()]  # months, of which there are few
        known = self._numbered("listens", LISTEN, batch, touched).select(*_names(LISTEN))
        old_rows = scratch(known.join(wanted, F.col("ord") == F.col("k"), "left_semi"), "changed-before")
        was = canonical_of(old_rows, before).join(changed, F.col("ord") == F.col("k"), "left_semi")
        now = canonical_of(old_rows.unionByName(new), family.unionByName(declared).select("ord", "duplicate_of"))
        already = old_rows.join(before.select(F.col("ord").alias("o")), F.col("ord") == F.col("o"), "left_semi").select("ord")
        now = now.join(already, "ord", "left_anti")
        self._write("view", sums(was, -1).unionByName(sums(now)).groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("duration_ms").alias("duration_ms")).where("n <> 0 or duration_ms <> 0"), batch)
        self._write("declared", declared, batch)
        self._write("listens", new.withColumn("month", month(F.col("ms"))), batch, "month")
        if (batch + 1) % self.compact_every == 0:
            self.compact(batch)

    def compact(self, upto: int) -> None:
        """One base of all batches up to ``upto``, written beside them."""
        added_up(self._parts(upto)).write.mode("overwrite").parquet(f"{self.folder}/base/upto={upto}")

    def _parts(self, upto: int) -> DataFrame:
        bases = read_parquet(self.spark, f"{self.folder}/base", f"{SUMS}, upto int").where(F.col("upto") <= upto)
        newest = bases.agg(F.max("upto")).first()[0]
        base = bases.where(F.col("upto") == (-1 if newest is None else newest)).drop("upto")
        since = read_parquet(self.spark, f"{self.folder}/view", f"{SUMS}, batch int").where((F.col("batch") > (-1 if newest is None else newest)) & (F.col("batch") <= upto))
        return base.unionByName(since.drop("batch"))

    def read(self, upto: int = 1 << 30) -> DataFrame:
        """(month, d, band_id, n, duration_ms): the view after the last batch, or after batch ``upto``."""
        return added_up(self._parts(upto))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def days(view: DataFrame) -> DataFrame:
    """Daily sums from the view."""
    return view.groupBy("d").agg(F.sum("n").alias("listen_count"), F.sum("duration_ms").alias("duration_ms"))


def top_bands(view: DataFrame, first: str, last: str) -> DataFrame:
    """A2: bands by duration over whole days."""
    return view.where(F.col("d").between(first, last)).groupBy("band_id").agg(F.sum("duration_ms").alias("duration_ms"), F.sum("n").alias("listens"))


def activity(view: DataFrame) -> DataFrame:
    """Days with listens and totals of each band and month."""
    return view.groupBy("band_id", "month").agg(F.count("*").alias("active_days"), F.sum("n").alias("listens"), F.sum("duration_ms").alias("duration_ms"))
