"""Paged pulls as a data source for batch and stream reads (format ``listen_pages``).

A folder holds files of JSON lines, one page of raw listens a line: {"account", "page", "listens": [...]}. Pages of
an account stand together, newest first, as a provider serves them. A batch read pulls each account until
a page is short or reaches the cutoff; an account that needs more pages than allowed fails the whole read,
so that nothing is saved in part. A stream read takes files in the order of their names; its offset is the
number of files that were read, kept in the query's checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from setlight.functions.text import norm_text

from .documents import flat_listens

SCHEMA = "account string, page long, pos long, listened_at long, raw string"
ARROW = pa.schema([("account", pa.string()), ("page", pa.int64()), ("pos", pa.int64()), ("listened_at", pa.int64()), ("raw", pa.string())])
#: Of a raw listen, what S10 reads.
RAW = "listened_at long, recording_msid string, track_metadata struct<artist_name: string, track_name: string, release_name: string, additional_info: struct<duration_ms: long, duration: long>>"
PAGE_SIZE, MAX_PAGES = 100, 50


class TooManyPages(Exception):
    """An account has more new listens than one pull may bring."""


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


class PageFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Pages:
    """What both readers share: the folder's files, and the pages in one."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.after = max(0, int(options.get("afterms", options.get("afterMs", "0"))) // 1000)
        self.page_size = int(options.get("pagesize", options.get("pageSize", str(PAGE_SIZE))))
        self.max_pages = int(options.get("maxpages", options.get("maxPages", str(MAX_PAGES))))

    def files(self) -> list[str]:
        system, folder = located(self.folder)
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))

    def pages(self, path: str) -> Iterator[dict]:
        system, _ = located(self.folder)
        with system.open_input_stream(path) as raw:
            rest = b""
            while chunk := raw.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                yield from map(json.loads, filter(None, lines))
            if rest:
                yield json.loads(rest)

    def rows(self, page: dict) -> pa.RecordBatch:
        """A page's listens after the cutoff's second; finer comparison is left to the reader's user."""
        found = [(i, x) for i, x in enumerate(page["listens"]) if isinstance(x.get("listened_at"), int) and x["listened_at"] >= self.after]
        n = len(found)
        return pa.RecordBatch.from_arrays(
            [pa.array([page["account"]] * n, pa.string()), pa.array([page["page"]] * n, pa.int64()), pa.array([i for i, _ in found], pa.int64()), pa.array([x["listened_at"] for _, x in found], pa.int64()), pa.array([json.dumps(x) for _, x in found], pa.string())],
            schema=ARROW,
        )


class PageReader(_Pages, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [PageFile(path) for path in self.files()]

    def read(self, partition: PageFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without files
            return
        account, pulled, done = None, 0, False
        for page in self.pages(partition.path):
            if page["account"] != account:
                account, pulled, done = page["account"], 0, False
            if done:
                continue
            if pulled == self.max_pages:
                raise TooManyPages(f"{account} has more than {self.max_pages} pages of {self.page_size} new listens; nothing was saved")
            pulled += 1
            times = [x["listened_at"] for x in page["listens"] if isinstance(x.get("listened_at"), int)]
            done = len(page["listens"]) < self.page_size or not times or min(times) <= self.after
            yield self.rows(page)


class PageStream(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(self.files())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [PageFile(path) for path in self.files()[start["files"] : end["files"]]]

    def read(self, partition: PageFile) -> Iterator[pa.RecordBatch]:
        for page in self.pages(partition.path):
            yield self.rows(page)


class ListenPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listen_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStream:
        return PageStream(self.options)


def parsed(pages: DataFrame, after_ms: int) -> DataFrame:
    """Raw rows as listens (account, page, pos, id, ms, artist, title, release, duration_ms, fp) strictly after the cutoff."""
    raw = pages.select("account", "page", "pos", F.from_json("raw", RAW).alias("x")).select("account", "page", "pos", "x.*")
    keyed = raw.withColumn("place", F.struct("account", "page", "pos"))
    listens = flat_listens(keyed, "place").select("place.*", "id", "ms", "artist", "title", "release", "duration_ms")
    fingerprint = F.concat_ws("|", F.floor(F.col("ms") / 1000), norm_text(F.col("artist")), norm_text(F.col("title")))
    return listens.where(F.col("ms") > after_ms).withColumn("fp", fingerprint)


def pull(spark: SparkSession, folder: str, after_ms: int = 0, page_size: int = PAGE_SIZE, max_pages: int = MAX_PAGES) -> DataFrame:
    """The new listens of all accounts, each once by account, id and fingerprint, the first served."""
    spark.dataSource.register(ListenPages)
    pages = spark.read.format("listen_pages").option("afterMs", after_ms).option("pageSize", page_size).option("maxPages", max_pages).load(folder)
    rows = parsed(pages, after_ms)
    fields = [c for c in rows.columns if c not in ("account", "id", "fp", "page", "pos")]
    first = F.min_by(F.struct(*fields), F.struct("page", "pos")).alias("x")
    return rows.groupBy("account", "id", "fp").agg(first).select("account", "id", "x.*")


def pull_stream(spark: SparkSession, folder: str, after_ms: int = 0) -> DataFrame:
    """S9 as a stream of listens with an event time ``at``; duplicates are left to ``fresh``."""
    spark.dataSource.register(ListenPages)
    return parsed(spark.readStream.format("listen_pages").option("afterMs", after_ms).load(folder), after_ms).withColumn("at", F.timestamp_millis("ms"))
