"""Stored pages of the archive's index as a data source that goes on where it stopped.

A page lies at ``<root>/<domain>/<year>/<name>.json``, where the name is ``first`` or the sha256 of the resume key that it was asked with; so a page's end names the next page, as the
archive's own answers do. Domains and years are independent: they are dealt to tasks, which follow the pages of each one after another and hold one page at a time.
"""
from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators import cursors as C
from .blob_store import _opened, put
from .files import captures
from .versions import VersionedTable

FORMAT = "adlens_archive_index"
PAGES = "domain string, year int, page int, asked string, content string, resume_key string"
CURSORS = StructType().add("source_key", "string").add("scope", "string").add("resume_key", "string").add("done", "boolean")
#: Most domains and years whose cursors a read takes along.
MOST_SCOPES = 100_000


def page_name(asked: Column) -> Column:
    """A page's file name by the resume key that it was asked with, null for the first."""
    return F.concat(F.coalesce(F.sha2(asked, 256), F.lit("first")), F.lit(".json"))


def _name(asked: str | None) -> str:
    return "first.json" if asked is None else hashlib.sha256(asked.encode()).hexdigest() + ".json"


def next_key(rows: list) -> str | None:
    """The resume key that a page ends with: after an empty row, alone in the last one."""
    return rows[-1][0] if len(rows) > 2 and rows[-2] == [] and len(rows[-1]) == 1 else None


@dataclass
class Scopes(InputPartition):
    """Domains and years, each with the resume key that it goes on from, which one task follows in turn."""

    scopes: list[tuple[str, int, str | None]]


class IndexReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.most = int(options.get("maxPages", 0))
        self.domain = options.get("domain")
        self.years = range(int(options.get("fromYear", 0)), int(options.get("toYear", 9999)) + 1)
        self.cursors = json.loads(options.get("cursors", "{}"))
        self.tasks = int(options.get("tasks", 200))

    def partitions(self) -> Sequence[Scopes]:
        """The domains and years that aren't done, dealt to ``tasks`` partitions at most."""
        system, root = _opened(self.root)
        folders = lambda path: sorted(i.base_name for i in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if i.type == fs.FileType.Directory)
        out = []
        for domain in [self.domain] if self.domain else folders(root):
            for year in folders(f"{root}/{domain}"):
                if not year.isdigit() or int(year) not in self.years:
                    continue
                key, done = self.cursors.get(f"{domain}/{year}", (None, False))
                if not done:
                    out.append((domain, int(year), key))
        n = min(len(out), self.tasks)
        return [Scopes(out[i::n]) for i in range(n)]

    def read(self, dealt: Scopes | None) -> Iterator[pa.RecordBatch]:
        for scope in dealt.scopes if dealt is not None else []:  # nothing to read is one empty partition
            yield from self.follow(*scope)

    def follow(self, domain: str, year: int, asked: str | None) -> Iterator[pa.RecordBatch]:
        system, root = _opened(self.root)
        page = 0
        while not self.most or page < self.most:
            path = f"{root}/{domain}/{year}/{_name(asked)}"
            if system.get_file_info(path).type != fs.FileType.File:
                return  # not stored yet: the cursor stays before it
            with system.open_input_stream(path) as stream:
                content = stream.read().decode()
            rows = json.loads(content) if content.strip() else []
            key = next_key(rows) if len(rows) > 1 else None
            if key is not None and len(rows) == 3:
                key = None  # a page without captures ends the listing
            page += 1
            yield pa.RecordBatch.from_pydict({"domain": [domain], "year": pa.array([year], pa.int32()), "page": pa.array([page], pa.int32()), "asked": pa.array([asked], pa.string()), "content": [content or "[]"], "resume_key": pa.array([key], pa.string())})
            if key is None:
                return
            asked = key


class ArchiveIndex(DataSource):
    """Options: path; domain, fromYear, toYear choose scopes; maxPages bounds the pages of each; tasks bounds the partitions; cursors is ``{"domain/year": [resume key, done]}``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return PAGES

    def reader(self, schema: StructType) -> IndexReader:
        return IndexReader(self.options)


def pages(spark: SparkSession, root: str, *, cursors: DataFrame | None = None, source_key: str | None = None, max_pages: int = 0, domain: str | None = None, years: tuple[int, int] | None = None) -> DataFrame:
    """The pages after ``cursors`` (source_key, scope, resume_key, done; scope is ``domain/year``), a row each: what was asked, the content, the resume key at its end."""
    spark.dataSource.register(ArchiveIndex)
    out = spark.read.format(FORMAT).option("maxPages", max_pages)
    if domain:
        out = out.option("domain", domain)
    if years:
        out = out.option("fromYear", years[0]).option("toYear", years[1])
    if cursors is not None:
        own = cursors.where(F.col("source_key") == source_key) if source_key is not None else cursors
        held = own.select("scope", "resume_key", "done").limit(MOST_SCOPES + 1).collect()  # a row a domain and year
        if len(held) > MOST_SCOPES:
            raise ValueError(f"more than {MOST_SCOPES} scopes: read them by domain")
        out = out.option("cursors", json.dumps({r.scope: (r.resume_key, bool(r.done)) for r in held}))
    return out.load(root)


def index_captures(read: DataFrame) -> DataFrame:
    """Captures of pages: domain, year, page, position, url_key, timestamp, original_url, digest."""
    file = F.to_json(F.struct("domain", "year", "page"))
    rows = captures(read.select(file.alias("file"), "content"))
    at = F.from_json("file", "domain string, year int, page int")
    return rows.withColumn("at", at).select("at.domain", "at.year", "at.page", *rows.columns[1:])


def reached(read: DataFrame, source_key: str) -> DataFrame:
    """Cursors behind the pages: the resume key of each scope's last, done without one."""
    last = read.groupBy("domain", "year").agg(F.max(F.struct("page", "resume_key")).alias("x"))
    return last.select(F.lit(source_key).alias("source_key"), F.concat_ws("/", "domain", F.col("year").cast("string")).alias("scope"), F.col("x.resume_key").alias("resume_key"), F.col("x.resume_key").isNull().alias("done"))


def discover(root: str, source_key: str, found: VersionedTable, cursors: VersionedTable, *, max_pages: int = 10, **scopes) -> int:
    """Read on by at most ``max_pages`` pages a scope: captures that ``found`` doesn't have go in, then the cursors move; how many scopes moved.

    ``found`` is keyed by url_key and timestamp (url_key, timestamp, original_url, digest), ``cursors`` by source_key and scope. Captures are stored before their cursors: a run that ends
    in between reads the same pages again, and rows that are there already stay as they are. So nothing is lost and nothing twice, wherever it stops.
    """
    spark = found.spark
    read = pages(spark, root, cursors=cursors.read(), source_key=source_key, max_pages=max_pages, **scopes)
    moved = reached(read.select("domain", "year", "page", "resume_key"), source_key).collect()  # a row a domain and year
    if not moved:
        return 0
    first = Window.partitionBy("url_key", "timestamp").orderBy("original_url", "digest")
    rows = index_captures(read).withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*found.schema.names)
    found.update(lambda _: rows, lambda old, new: old.unionAll(new.join(old.select(*found.keys), found.keys, "left_anti").select(*found.schema.names)))
    after = spark.createDataFrame(moved, CURSORS)
    cursors.update(lambda _: after, lambda old, new: C.save(old, new))
    return len(moved)


def store_pages(rows: DataFrame, root: str) -> None:
    """Write pages (domain, year, asked, content) where ``pages`` looks for them, each whole or not at all."""

    def write(found: Iterator) -> None:
        system, where = _opened(root.rstrip("/"))
        for r in found:
            put(system, where, f"{r.domain}/{r.year}/{r.name}", r.content.encode())

    rows.select("domain", "year", page_name(F.col("asked")).alias("name"), "content").foreachPartition(write)
