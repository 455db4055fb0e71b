"""Blobs: round trips, digests, keys, tasks that are killed."""
import hashlib
import os
import signal
import subprocess
import sys
from datetime import date

import pytest
from pyspark.sql import functions as F

from adlens.sources import blob_store as B
from adlens.sources.files import blobs


def rows(spark, contents, day=date(2012, 3, 4)):
    df = spark.createDataFrame([(bytearray(c),) for c in contents], "content binary")
    return df.select(B.content_key(F.lit("src"), F.col("content"), F.lit(day), F.lit("html")).alias("key"), "content", F.sha2("content", 256).alias("sha256"))


def test_round_trip_and_repeats(spark, tmp_path):
    root, contents = str(tmp_path / "b"), [b"", b"one", b"two" * 9999, bytes(range(256))]
    put = rows(spark, [*contents, b"one"])
    B.store(put, root)
    B.store(put, root)  # tried again: the same objects
    found = {bytes(r.content) for r in blobs(spark, root).collect()}
    assert found == set(contents) - {b""}  # scans pass empty files over
    assert {bytes(r.content) for r in B.fetch(put.select("key"), root).collect()} == set(contents)
    assert {r.sha256 for r in blobs(spark, root).collect()} == {hashlib.sha256(c).hexdigest() for c in contents if c}
    refs = {r.key: r for r in B.references(put, root).collect()}
    assert all(os.path.getsize(r.uri) == r.size_bytes for r in refs.values()) and len(refs) == 4
    assert {r.k for r in blobs(spark, root).select(B.key_of(F.col("path")).alias("k")).collect()} == {k for k, r in refs.items() if r.size_bytes}
    assert {str(r.day) for r in blobs(spark, root).collect()} == {"2012-03-04"}


def test_fetch_exists_delete(spark, tmp_path):
    root = f"file://{tmp_path}/b"
    put = rows(spark, [b"a", b"b"])
    B.store(put.drop("sha256"), root)
    keys = put.select("key", F.lit(7).alias("stored_by")).unionAll(rows(spark, [b"never"]).select("key", F.lit(8))).unionAll(spark.createDataFrame([(None, 9)], "key string, stored_by int"))
    got = {r.stored_by if r.content is None else bytes(r.content): r.key for r in B.fetch(keys, root).collect()}
    assert set(got) == {b"a", b"b", 8, 9}
    assert sorted((r.stored_by, r.stored) for r in B.exists(keys, root).collect()) == [(7, True), (7, True), (8, False), (9, False)]
    B.delete(keys, root)
    B.delete(keys, root)
    assert not any(r.stored for r in B.exists(keys, root).collect())


@pytest.mark.parametrize("bad", ["../up/2012/03/04/x.html", "src/2012/03/04/x.html", None])
def test_keys_and_digests_are_checked(spark, tmp_path, bad):
    writer = B.BlobWriter(str(tmp_path))
    with pytest.raises(ValueError):
        writer.write(iter([{"key": bad, "content": b"x"}]))
    good = rows(spark, [b"x"]).first().key
    with pytest.raises(ValueError):
        writer.write(iter([{"key": good, "content": b"y", "sha256": hashlib.sha256(b"x").hexdigest()}]))
    assert not list(tmp_path.rglob("*.html"))
    with pytest.raises(Exception, match="blobs are added"):
        spark.dataSource.register(B.BlobSink)
        rows(spark, [b"x"]).write.format(B.FORMAT).mode("overwrite").save(str(tmp_path))


KILLED = """
import os, signal, sys
sys.path.insert(0, sys.argv[1])
from adlens.sources import blob_store as B

class Half:
    def __init__(self, inner): self.inner = inner
    def __getattr__(self, name): return getattr(self.inner, name)
    def open_output_stream(self, path):
        out = self.inner.open_output_stream(path)
        out.write(b"x" * 100); out.flush()
        os.kill(os.getpid(), signal.SIGKILL)

B._opened = lambda root, held=B._opened: (lambda system, where: (Half(system), where))(*held(root))
B.BlobWriter(sys.argv[2]).write(iter([{"key": sys.argv[3], "content": b"x" * 100000}]))
"""


def test_a_killed_task_leaves_no_partial_blob(spark, tmp_path):
    root, content = str(tmp_path / "b"), b"x" * 100000
    put = rows(spark, [content])
    key = put.first().key
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", KILLED, repo, root, key], timeout=120)
    assert done.returncode == -signal.SIGKILL
    left = [p for p in (tmp_path / "b").rglob("*") if p.is_file()]
    assert len(left) == 1 and left[0].name.startswith(".") and left[0].stat().st_size < len(content)
    assert blobs(spark, root).count() == 0 and not B.exists(put.select("key"), root).first().stored
    B.store(put, root)
    assert bytes(B.fetch(put.select("key"), root).first().content) == content
    assert B.sweep(spark, root) == 0  # not while a task may still write it
    assert B.sweep(spark, root, older_than=-1) == 1 and B.sweep(spark, root, older_than=-1) == 0
    assert blobs(spark, root).count() == 1
