"""Raw bytes as objects under day-partitioned keys: written by tasks whole or not at all, read, looked up and deleted by key.

A task writes an object under a hidden name beside its own, compares the digest, and renames. A task that is killed leaves at most a hidden object, which readers pass over and
``sweep`` deletes; its next attempt writes the same objects again, so an object is there once however often it is tried. Paths may be any that ``pyarrow.fs`` opens.
"""
from __future__ import annotations

import hashlib
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .files import _KEY

FORMAT = "adlens_blobs"
#: What a key is, at the end of a path.
_AT_END = r"([a-z0-9_]+/\d{4}/\d{2}/\d{2}/[0-9a-f-]{36}\.[a-z0-9]+)$"
_HIDDEN = re.compile(r"^\..*\.tmp$")


def content_key(source_key: Column, content: Column, day: Column, extension: Column) -> Column:
    """Key of bytes by what they are: the first half of their sha256 stands as the name, so equal bytes of a source and day are one object."""
    h = F.sha2(content, 256)
    name = F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.concat(source_key, F.lit("/"), F.date_format(day, "yyyy/MM/dd"), F.lit("/"), name, F.lit("."), extension)


def references(rows: DataFrame, root: str, content_type: str | None = None) -> DataFrame:
    """Rows (key, content) as references: key, uri, size_bytes, sha256, content_type."""
    return rows.select("key", F.concat(F.lit(root.rstrip("/") + "/"), F.col("key")).alias("uri"), F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.lit(content_type).cast("string").alias("content_type"))


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def _checked(key: str | None) -> str:
    if key is None or not _KEY.match(key):
        raise ValueError(f"not a blob key: {key}")
    return key


@dataclass
class Written(WriterCommitMessage):
    blobs: int
    size: int


class BlobWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def write(self, rows: Iterator) -> Written:
        """Write a task's rows: key, content and maybe sha256, which the bytes must have. A null content is an error."""
        system, root = _opened(self.root)
        blobs = size = 0
        for row in rows:
            put(system, root, _checked(row["key"]), bytes(row["content"]), row["sha256"] if "sha256" in row else None)
            blobs, size = blobs + 1, size + len(row["content"])
        return Written(blobs, size)


def put(system: fs.FileSystem, root: str, key: str, content: bytes, sha256: str | None = None) -> None:
    """One object, whole or not at all; one of the same key is replaced."""
    if sha256 is not None and hashlib.sha256(content).hexdigest() != sha256:
        raise ValueError(f"{key}: the bytes don't have the digest {sha256}")
    folder, _, name = f"{root}/{key}".rpartition("/")
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
    system.create_dir(folder, recursive=True)
    try:
        with system.open_output_stream(hidden) as out:
            out.write(content)
        if system.get_file_info(hidden).size != len(content):
            raise OSError(f"{key}: written in part")
        system.move(hidden, f"{folder}/{name}")
    except Exception:
        if system.get_file_info(hidden).type != fs.FileType.NotFound:
            system.delete_file(hidden)
        raise


class BlobSink(DataSource):
    """``rows.write.format(FORMAT).mode("append").save(root)``; other modes are refused, as keys replace one by one."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> BlobWriter:
        if overwrite:
            raise ValueError("blobs are added; delete those that should go")
        if not {"key", "content"} <= set(schema.names):
            raise ValueError("rows need key and content")
        return BlobWriter(self.options["path"])


def store(rows: DataFrame, root: str) -> None:
    """Write rows (key, content, maybe sha256) as objects under ``root``, without a shuffle. Rows that repeat a key write it again, and any of them stays: by ``content_key`` they are equal."""
    rows.sparkSession.dataSource.register(BlobSink)
    rows.write.format(FORMAT).mode("append").save(root)


def key_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, _AT_END, 1), F.lit(""))


def fetch(keys: DataFrame, root: str) -> DataFrame:
    """``content`` beside each row's key, null where there is no such object: what is read follows the keys, not the store. Other columns stay."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, where = _opened(root.rstrip("/"))
        for batch in batches:
            for at in range(len(batch)):  # an object at a time, so that a batch's bytes aren't held together
                one = batch.iloc[at : at + 1].copy()
                key = one["key"].iloc[0]
                path = None if key is None else f"{where}/{_checked(key)}"
                found = path is not None and system.get_file_info(path).type == fs.FileType.File
                content = None
                if found:
                    with system.open_input_stream(path) as stream:
                        content = stream.read()
                one["content"] = pd.Series([content], index=one.index, dtype=object)
                yield one

    return keys.mapInPandas(read, StructType([*keys.schema.fields]).add("content", "binary"))


def exists(keys: DataFrame, root: str) -> DataFrame:
    """``stored`` beside each row's key."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, where = _opened(root.rstrip("/"))
        for batch in batches:
            infos = [system.get_file_info(f"{where}/{_checked(k)}").type == fs.FileType.File if k is not None else False for k in batch["key"]]
            yield batch.assign(stored=infos)

    return keys.mapInPandas(look, StructType([*keys.schema.fields]).add("stored", "boolean"))


def delete(keys: DataFrame, root: str) -> None:
    """Delete the rows' objects; one that isn't there is no error."""

    def drop(rows: Iterator) -> None:
        system, where = _opened(root.rstrip("/"))
        for row in rows:
            try:
                system.delete_file(f"{where}/{_checked(row['key'])}")
            except FileNotFoundError:
                pass

    keys.where("key is not null").select("key").distinct().foreachPartition(drop)


def sweep(spark: SparkSession, root: str, *, older_than: float = 86_400.0) -> int:
    """Delete what killed tasks left, once it is ``older_than`` seconds old; how many objects that were. A task takes a source's day."""
    system, where = _opened(root.rstrip("/"))
    level = [where]
    for _ in range(4):  # source, year, month, day: folders only
        level = [i.path for f in level for i in system.get_file_info(fs.FileSelector(f, allow_not_found=True)) if i.type == fs.FileType.Directory]
    if not level:
        return 0
    limit = time.time() - older_than

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inside, _ = _opened(root.rstrip("/"))
        for batch in batches:
            n = 0
            for folder in batch["folder"]:
                for info in inside.get_file_info(fs.FileSelector(folder)):
                    if _HIDDEN.match(info.base_name) and info.mtime.timestamp() <= limit:
                        inside.delete_file(info.path)
                        n += 1
            yield pd.DataFrame({"n": [n]})

    return spark.createDataFrame([(f,) for f in level], "folder string").mapInPandas(clean, "n long").agg(F.sum("n")).first()[0] or 0
