"""SimHash components against all pairs in plain Python."""
import random

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash

from adlens.llm import simhash
from adlens.llm._bytes import flat

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    ws = regex.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def plain_components(rows, radius):
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(b)] = find(a)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted(((i, f"{f:016x}", least.get(find(f))) for i, f in rows), key=str)


def check(spark, rows, schema="doc_id long, text string", radius=4):
    got = simhash.simhash_components(spark.createDataFrame(rows, schema), radius=radius).collect()
    want = plain_components([(r[0], plain_fingerprint(r[1])) for r in rows], radius)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want


def test_fingerprints_of_hostile_texts():
    texts = [None, "", " \t\n", "One", "a b c d", "A B c D e", "é" * 700, "x " * 5000, "\x00 \x1f \x85   b", "ÀB c", " ".join(f"w{i % 37}" for i in range(3000))]
    got = simhash.majority(*simhash.shingle_hashes(*flat(pa.array(texts, pa.string()))))
    assert [int(v) for v in got] == [plain_fingerprint(t) for t in texts]


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    check(spark, [tuple(r) for r in docs.collect()])


def test_edges(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(None, ""), (None, None), (5, None), (2**63 - 1, "  "), (-3, text), (-3, text), (9, text + " tail"), (4, text.upper()), (7, "only"), (8, "only")]
    check(spark, rows)
    check(spark, rows[:2])
    check(spark, [])
    docs = spark.createDataFrame([("b", text, 1, 2), ("a", text + " more", 1, 2)], "doc_id string, text string, fp int, label int")
    assert {tuple(r)[::2] for r in simhash.simhash_components(docs).collect()} == {("b", "a"), ("a", "a")}


@pytest.mark.parametrize("parts", [(1, 64), (4, 30)])
def test_links_of_chains_and_groups(spark, monkeypatch, parts):
    """Planted groups and chains of fingerprints over many small tiles hang together as by all pairs."""
    monkeypatch.setattr(simhash, "LEAST_TILE", 48)
    monkeypatch.setattr(simhash, "TILES", parts[1])
    rng = random.Random(parts[0])
    fps = {rng.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1}
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(rng.choice((3, 60))):
            fps.add(at)
            for b in rng.sample(range(64), rng.randint(1, 6)):
                at ^= 1 << b
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), radius=4, inner=16).collect()
    assert len(edges) < 40 * len(fps)
    want = plain_components(list(enumerate(fps)), 4)
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        assert (e.src ^ e.dst) & (2**64 - 1)
        root[find(e.src)] = find(e.dst)
    least = {}
    for i, f in enumerate(signed):
        least.setdefault(find(f), i)
    assert sorted(((i, f"{fps[i]:016x}", least[find(f)]) for i, f in enumerate(signed)), key=str) == want


def test_group_is_not_all_pairs():
    """A group within the radius costs links in proportion to its size, and small tiles that hang together aren't compared again."""
    base = np.uint64(0x0F0F0F0F0F0F0F0F)
    fps = np.array(sorted({int(base) ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i, 64)}), np.uint64)
    root = np.arange(len(fps), dtype=np.int32)
    simhash.compare(fps, None, 4, root)
    assert (root == 0).all()
