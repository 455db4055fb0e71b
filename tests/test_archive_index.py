"""The stored index: pages in order, stops and resumes, scopes."""
import hashlib
import json

import pytest
from pyspark.sql.types import StringType, StructField, StructType

from adlens.sources import archive_index as A
from adlens.sources.versions import VersionedTable

HEADER = ["urlkey", "timestamp", "original", "digest"]
FOUND = StructType([StructField(n, StringType()) for n in ("url_key", "timestamp", "original_url", "digest")])


def write(root, domain, year, pages):
    """Pages of rows, each ending with the key of the next."""
    folder = root / domain / str(year)
    folder.mkdir(parents=True, exist_ok=True)
    asked = None
    for i, rows in enumerate(pages):
        key = f"key {domain} {year} {i}" if i + 1 < len(pages) else None
        name = "first" if asked is None else hashlib.sha256(asked.encode()).hexdigest()
        (folder / f"{name}.json").write_text(json.dumps([HEADER, *rows, *([[], [key]] if key else [])]))
        asked = key


def rows(domain, year, page, n=3):
    return [[f"com,{domain})/{page}-{i}", f"{year}0101{page:02d}00{i:02d}", f"http://{domain}.com/{page}-{i}", f"d{i}"] for i in range(n)]


@pytest.fixture()
def root(tmp_path):
    root = tmp_path / "index"
    for domain, year, n in (("a", 2011, 5), ("a", 2012, 1), ("b", 2011, 3)):
        write(root, domain, year, [rows(domain, year, p) for p in range(n)])
    write(root, "c", 2011, [rows("c", 2011, 0), []])  # a last page without captures
    (root / "d" / "2011").mkdir(parents=True)
    (root / "d" / "2011" / "first.json").write_text("")
    return root


def tables(spark, tmp_path):
    return (VersionedTable(spark, str(tmp_path / "found"), FOUND, ["url_key", "timestamp"], buckets=4), VersionedTable(spark, str(tmp_path / "cursors"), A.CURSORS, ["source_key", "scope"], buckets=4))


def test_pages_follow_their_resume_keys(spark, root):
    read = A.pages(spark, str(root))
    assert read.rdd.getNumPartitions() == 5
    got = sorted((r.domain, r.year, r.page, r.asked, r.resume_key) for r in read.select("domain", "year", "page", "asked", "resume_key").collect() if r.domain == "b")
    assert got == [("b", 2011, 1, None, "key b 2011 0"), ("b", 2011, 2, "key b 2011 0", "key b 2011 1"), ("b", 2011, 3, "key b 2011 1", None)]
    found = A.index_captures(read)
    assert found.count() == (5 + 1 + 3 + 1) * 3
    assert A.index_captures(A.pages(spark, str(root), domain="a", years=(2012, 2020))).select("url_key").distinct().count() == 3
    assert A.pages(spark, str(root), domain="none").count() == 0
    assert {(r.scope, r.done) for r in A.reached(A.pages(spark, str(root), max_pages=2), "s").collect()} == {("a/2011", False), ("a/2012", True), ("b/2011", False), ("c/2011", True), ("d/2011", True)}


def test_stops_and_resumes_without_loss_or_repeats(spark, root, tmp_path):
    found, cursors = tables(spark, tmp_path)
    moved = []
    while n := A.discover(str(root), "s", found, cursors, max_pages=2):
        moved.append(n)
    assert moved == [5, 2, 1]
    every = sorted(tuple(r) for r in found.read().collect())
    want = sorted((r.url_key, r.timestamp, r.original_url, r.digest) for r in A.index_captures(A.pages(spark, str(root))).collect())
    assert every == want and len(every) == len(set(every)) == 30
    assert all(r.done for r in cursors.read().collect())


def test_a_stop_before_the_cursors_move(spark, root, tmp_path):
    found, cursors = tables(spark, tmp_path)
    A.discover(str(root), "s", found, cursors, max_pages=1)

    class Stopped(Exception):
        pass

    class Broken:
        def __getattr__(self, name):
            return getattr(cursors, name)

        def update(self, *_):
            raise Stopped

    with pytest.raises(Stopped):
        A.discover(str(root), "s", found, Broken(), max_pages=1)
    before = found.read().count()
    A.discover(str(root), "s", found, cursors, max_pages=1)  # the same pages once more
    assert found.read().count() == before
    while A.discover(str(root), "s", found, cursors, max_pages=3):
        pass
    assert found.read().count() == 30


def test_a_page_that_comes_later(spark, root, tmp_path):
    found, cursors = tables(spark, tmp_path)
    write(root, "e", 2011, [rows("e", 2011, 0), rows("e", 2011, 1)])
    late = root / "e" / "2011" / (hashlib.sha256(b"key e 2011 0").hexdigest() + ".json")
    kept = late.read_text()
    late.unlink()
    A.discover(str(root), "s", found, cursors, domain="e")
    assert found.read().count() == 3
    late.write_text(kept)
    A.discover(str(root), "s", found, cursors, domain="e")
    assert found.read().count() == 6 and cursors.read().first().done
