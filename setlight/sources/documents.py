"""Documents and exports: JSON import, monthly archives with checksums, versioned writes, CSV, nested payloads.

Paths are Spark paths. Versioned writes keep every version in a folder of its own and small pointer
files say which one counts; a writer that began from another version fails, or merges and tries again.
"""

from __future__ import annotations

import json
import re
import uuid
from html.parser import HTMLParser

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, lines: bool = True) -> DataFrame:
    """JSON (gzip too) with a given schema; a missing path is an empty table."""
    try:
        return spark.read.schema(schema).option("multiLine", not lines).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Parquet with a given schema, partition columns included; a missing path is an empty table."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


class StaleVersion(Exception):
    """The table has moved on since it was read."""


class VersionedTable:
    """Compare-and-swap versions of a small table under one folder.

    Version n counts once the file ``pointers/n`` names it. A pointer is moved into place by a rename that
    fails if the target exists, so of two writers of one number only one succeeds; the file system must
    offer that (HDFS and local disks do).
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _files(self, name: str):
        """The file system and path of something under the table's folder."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(conf), path

    def head(self) -> tuple[int, str | None]:
        """Number and name of the newest version: the pointer with the largest name."""
        files, path = self._files("pointers")
        names = sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []
        if not names:
            return 0, None
        row = self.spark.read.schema("number long, version string").json(f"{self.folder}/pointers/{names[-1]}").first()
        return row.number, row.version

    def read(self, version: str | None = None) -> DataFrame:
        version = version or self.head()[1]
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{version}") if version else self.spark.createDataFrame([], self.schema)

    def document(self) -> tuple[DataFrame, str | None]:
        """The rows of the newest version and its name, which a later write must give back."""
        version = self.head()[1]
        return self.read(version), version

    def _claim(self, number: int, pointer: dict) -> None:
        """Set the pointer of a number, or fail if it is set."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        files, draft = self._files(f"drafts/{pointer['version']}.json")
        _, target = self._files(f"pointers/{number:012d}.json")
        files.mkdirs(target.getParent())
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        no_options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(files.makeQualified(draft), files.makeQualified(target), no_options)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                raise StaleVersion(f"another writer was faster than {pointer['version']}") from e
            raise

    def write_if_current(self, df: DataFrame, parent: str | None) -> str:
        """Strict write: fails if ``parent`` is not the head, or is no longer when the pointer is set."""
        number, head = self.head()
        if head != parent:
            raise StaleVersion(f"{head} is newer than {parent}")
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.folder}/{name}")
        self._claim(number + 1, {"number": number + 1, "version": name, "parent": parent})
        return name

    def write_merging(self, df: DataFrame, parent: str | None, merge, tries: int = 2) -> str:
        """Write, and on conflict merge (base, mine, theirs) and try again."""
        base, mine = self.read(parent) if parent else self.spark.createDataFrame([], self.schema), df
        for _ in range(tries):
            try:
                return self.write_if_current(mine, parent)
            except StaleVersion:
                parent = self.head()[1]
                mine = merge(base, df, self.read(parent))
        return self.write_if_current(mine, parent)


def imported(events: DataFrame, key: str, order: str, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, the first of each id, and one row that counts what was rejected."""
    first = F.row_number().over(W.partitionBy(key).orderBy(order))
    kept = events.where(valid).withColumn("_rn", first).where("_rn = 1").drop("_rn")
    n = kept.agg(F.count("*").alias("kept"))
    return kept, events.agg(F.count("*").alias("total")).join(n).withColumn("rejected", F.col("total") - F.col("kept"))


def month(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM")


def row_digest(columns: list[str]) -> Column:
    """A digest of a row; digests of rows add up, so a set's checksum needs no order."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])


def manifest(events: DataFrame, columns: list[str]) -> DataFrame:
    """Count, first, last and checksum of each month."""
    checksum = F.sum(row_digest(columns).cast("decimal(38,0)")).cast("string")
    return events.groupBy(month(F.col("ms")).alias("month")).agg(F.count("*").alias("n"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), checksum.alias("checksum"))


def store_months(events: DataFrame, folder: str, columns: list[str]) -> DataFrame:
    """Append to month partitions; returns the manifest of what was written."""
    listed = manifest(events, columns)
    events.withColumn("month", month(F.col("ms"))).repartition("month", F.pmod(row_digest(columns), F.lit(8))).write.mode("append").partitionBy("month").parquet(folder)
    return listed


def restore_months(spark: SparkSession, folder: str, listed: DataFrame, columns: list[str]) -> DataFrame:
    """All months, checked against the manifest; a difference raises."""
    rows = spark.read.parquet(folder).drop("month")
    have = manifest(rows, columns).select("month", F.col("n").alias("h_n"), F.col("checksum").alias("h_sum"))
    bad = listed.join(have, "month", "full_outer").where("not (n <=> h_n and checksum <=> h_sum)").select("month").limit(5).collect()
    if bad:
        raise ValueError(f"months differ from the manifest: {[r[0] for r in bad]}")
    return rows


def csv_cell(value: Column, kind: T.DataType) -> Column:
    """Nested values as JSON; quotes around cells with comma, quote or line break."""
    text = F.to_json(value) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else value.cast("string")
    plain = F.coalesce(text, F.lit(""))
    return F.when(plain.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(plain)


def csv_lines(df: DataFrame) -> DataFrame:
    """One line of text for each row, cells in column order."""
    return df.select(F.concat_ws(",", *[csv_cell(F.col(f.name), f.dataType) for f in df.schema]).alias("line"))


def flat_listens(payloads: DataFrame, *keep: str) -> DataFrame:
    """Nested provider records (listened_at seconds, track_metadata) to listens; ids fall back to a hash."""
    m, info = F.col("track_metadata"), F.col("track_metadata.additional_info")
    key = F.concat_ws("|", F.col("listened_at").cast("string"), m["artist_name"], m["track_name"])
    return payloads.select(
        *keep,
        F.coalesce("recording_msid", F.concat(F.lit("lb-"), F.sha2(key, 256))).alias("id"),
        (F.col("listened_at") * 1000).alias("ms"),
        m["artist_name"].alias("artist"),
        F.trim(m["track_name"]).alias("title"),
        F.nullif(F.trim(m["release_name"]), F.lit("")).alias("release"),
        F.coalesce(info["duration_ms"], info["duration"] * 1000).alias("duration_ms"),
    )


def catalogue_recordings(pages: DataFrame) -> DataFrame:
    """Releases, media and tracks of catalogue pages to recordings with their releases."""
    media = pages.select(F.explode("releases").alias("r")).select("r.id", F.explode("r.media").alias("m"))
    tracks = media.select("id", F.explode("m.tracks").alias("t"))
    return tracks.groupBy(F.col("t.recording").alias("recording")).agg(F.min("t.title").alias("title"), F.countDistinct("id").alias("releases"))


def upcoming_events(rows: DataFrame, today: str) -> DataFrame:
    """Events inside JSON bodies to concert rows, without cancelled and past ones."""
    schema = "events array<struct<id: string, date: string, status: string, venue: struct<name: string, city: string>>>"
    events = rows.select("band_id", F.explode(F.from_json("body", schema)["events"]).alias("e"))
    day = F.col("e.date").try_cast("date")
    return events.where((F.col("e.status") != "cancelled") & (day >= F.lit(today).cast("date"))).select("band_id", F.col("e.id").alias("event"), day.alias("d"), F.col("e.venue.name").alias("venue"), F.col("e.venue.city").alias("city"))


class _Page(HTMLParser):
    """Title, description, image, first profile links and visible text of a page."""

    HIDDEN = {"script", "style", "noscript", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.description, self.image, self.instagram, self.spotify = "", "", "", "", ""
        self.text: list[str] = []
        self.hidden, self.in_title = 0, False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "meta" and (a.get("name") or "").lower() == "description":
            self.description = self.description or a.get("content", "")
        elif tag == "meta" and (a.get("property") or "").lower() == "og:image":
            self.image = self.image or a.get("content", "")
        elif tag == "a" and "instagram.com/" in a.get("href", ""):
            self.instagram = self.instagram or a["href"]
        elif tag == "a" and "open.spotify.com/" in a.get("href", ""):
            self.spotify = self.spotify or a["href"]

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.text.append(data)


PAGE = "title string, description string, image string, instagram string, spotify string, text string"


#: A reference without its semicolon, such as one that a cut left.
UNTERMINATED = re.compile(r"&(?=#?[A-Za-z0-9]+(?![A-Za-z0-9;]))")


def page_parts(html: str | None, most: int, terminated: bool = False) -> tuple[str, ...]:
    """The parts of a page; if ``terminated``, references without a semicolon stay as they are, where browsers read some."""
    page = _Page()
    page.feed(UNTERMINATED.sub("&amp;", html or "") if terminated else html or "")
    page.close()
    text = " ".join(" ".join(page.text).split())
    return page.title.strip(), page.description, page.image, page.instagram, page.spotify, text[:most]


def homepage_info(pages: DataFrame, most: int = 600, terminated: bool = False) -> DataFrame:
    """What a band's homepage says, with the first ``most`` characters of its text."""

    def parse(batches):
        for batch in batches:
            rows = [page_parts(x, most, terminated) for x in batch["html"]]
            yield pd.concat([batch[["page_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["title", "description", "image", "instagram", "spotify", "text"])], axis=1)

    return pages.select("page_id", "html").mapInPandas(parse, f"page_id long, {PAGE}")


def forecast_hours(rows: DataFrame) -> DataFrame:
    """Parallel hourly arrays to rows, for the wanted hours only."""
    zipped = F.explode(F.arrays_zip("hours", "codes", "temperatures"))
    return rows.select("place", "wanted", zipped.alias("h")).where(F.array_contains("wanted", F.col("h.hours"))).select("place", "h.hours", "h.codes", "h.temperatures")


def synthetic_listens(spark: SparkSession, n: int, bands: int, end_ms: int, step_ms: int = 90_000) -> DataFrame:
    """A deterministic stream of listens that ends at ``end_ms``."""
    i = F.col("id")
    return spark.range(n).select(
        i.alias("ord"),
        (F.lit(end_ms) - (n - 1 - i) * step_ms).alias("ms"),
        F.pmod(i * 7919, F.lit(bands)).alias("band_id"),
        F.when(i % 17 == 0, None).otherwise(120_000 + F.pmod(i * 104_729, F.lit(240_000))).alias("duration_ms"),
        F.concat(F.lit("Song "), F.pmod(i * 31, F.lit(500)).cast("string")).alias("recording_title"),
    )
