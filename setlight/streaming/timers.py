"""State with event-time timers: bands that become due without a new row (W4), and trailing sums.

Both take the rows of a key in the order of their times; rows of one batch are sorted, later batches must not bring
earlier rows. They need the RocksDB state store: ``stateful_session`` gives a session that has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from setlight.operators.planning import ACTIVE_DAYS, DAY_MS, EMPTY_DAYS

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The time of a band that was reported and has had no row since.
REPORTED = -1
DUE = "band_id long, due_ms long, reason string, empty long"


def stateful_session(spark: SparkSession) -> SparkSession:
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return session


def in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(list(by), kind="stable")


class DueBands(StatefulProcessor):
    """Looks at a band (found or empty) and sightings by a trusted provider set the time when it is due again.

    A timer stands at that time; it moves with each row, and when it goes off the band is reported. A row at or after
    the time reports it as well, so that the report does not depend on where batches end.
    """

    def __init__(self, day_ms: int = DAY_MS):
        self.day_ms = day_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "empty long, next_ms long, reset boolean")

    def _report(self, band: int, empty: int, next_ms: int, reset: bool) -> tuple:
        reason = "ticketmaster_activity_reset" if reset else "inactive_backoff_due" if empty else "supplemental_concert_check"
        return (band, next_ms, reason, empty)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, out = self.state.exists(), []
        empty, next_ms, reset = tuple(self.state.get()) if known else (0, REPORTED, False)
        if next_ms != REPORTED:
            self.handle.deleteTimer(next_ms)
        for row in in_order(rows, "ms", "ord").itertuples():
            if next_ms != REPORTED and row.ms >= next_ms:
                out.append(self._report(key[0], empty, next_ms, reset))
                next_ms = REPORTED
            if row.kind == "look":
                empty = 0 if row.found else min(len(EMPTY_DAYS), empty + 1)
                next_ms, reset, known = int(row.ms) + (ACTIVE_DAYS if row.found else EMPTY_DAYS[empty - 1]) * self.day_ms, False, True
            elif known:  # a sighting counts for bands that were looked at
                empty, next_ms, reset = 0, int(row.ms) + ACTIVE_DAYS * self.day_ms, True
        if known:
            self.state.update((empty, next_ms, reset))
        if next_ms != REPORTED:
            self.handle.registerTimer(next_ms)
        yield pd.DataFrame(out, columns=["band_id", "due_ms", "reason", "empty"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        empty, next_ms, reset = tuple(self.state.get())
        due = expiredTimerInfo.getExpiryTimeInMs()
        rows = [self._report(key[0], empty, next_ms, reset)] if due == next_ms else []
        self.state.update((empty, REPORTED, reset))
        yield pd.DataFrame(rows, columns=["band_id", "due_ms", "reason", "empty"])

    def close(self) -> None:
        pass


class TrailingSum(StatefulProcessor):
    """For each row the sum over ``span_ms`` before and at it; only rows that a later sum can need are kept."""

    def __init__(self, span_ms: int):
        self.span_ms = span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "ms long, tokens long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = in_order(rows, "ms")
        before = pd.DataFrame(list(self.recent.get()) if self.recent.exists() else [], columns=["ms", "tokens"])
        times = pd.concat([before["ms"], batch["ms"]]).astype("int64").to_numpy()
        sums = pd.concat([pd.Series([0]), pd.concat([before["tokens"], batch["tokens"]])]).astype("int64").cumsum().to_numpy()
        mine = batch["ms"].to_numpy()
        used = sums[times.searchsorted(mine, "right")] - sums[times.searchsorted(mine - self.span_ms, "left")]
        kept = times.searchsorted(mine[-1] - self.span_ms, "left")
        tokens = sums[1:] - sums[:-1]
        self.recent.put([(int(t), int(n)) for t, n in zip(times[kept:], tokens[kept:], strict=True)])
        yield pd.DataFrame({"ord": batch["ord"].to_numpy(), "used": used})

    def close(self) -> None:
        pass


def due_stream(stream: DataFrame, delay: str, day_ms: int = DAY_MS) -> DataFrame:
    """(band_id, due_ms, reason, empty) as bands become due, from rows (band_id, ord, ms, kind, found)."""
    timed = stream.withColumn("at", F.timestamp_millis("ms")).withWatermark("at", delay)
    return timed.groupBy("band_id").transformWithStateInPandas(DueBands(day_ms), DUE, "Append", "EventTime")


def trailing_stream(stream: DataFrame, key: str, span_ms: int) -> DataFrame:
    """(ord, used) for rows (key, ord, ms, tokens)."""
    return stream.groupBy(key).transformWithStateInPandas(TrailingSum(span_ms), "ord long, used long", "Append", "None")
