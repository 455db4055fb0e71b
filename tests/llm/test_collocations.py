"""Phrase collocations against plain Python, and the trie's bursts and spills."""
import random
from collections import Counter

import numpy as np
import pytest
import regex

from adlens.llm import collocations as C

SF = "/root/testdata/sf0.001"


def plain(rows, longest=5, least=100, percent=100, top=2000):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in regex.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = regex.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, longest + 1):
                for i in range(len(ws) - m + 1):
                    f[lang, tuple(ws[i : i + m])] += 1
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = {}
    for (lang, p), a in cands.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p):
                    inside[lang, p[i:j]] = max(a, inside.get((lang, p[i:j]), 0))
    out = {}
    for (lang, p), a in cands.items():
        if 100 * inside.get((lang, p), 0) >= percent * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, all_ in out.items() for i, x in enumerate(sorted(all_)[:top]))


def check(spark, rows, limits=C.Limits(), **how):
    got = C.collocations(spark.createDataFrame(rows, "text string, lang string"), limits=limits, **how).collect()
    want = plain([r[:2] for r in rows], **how)
    assert sorted(tuple(r) for r in got) == want
    return want


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").collect()]
    assert len(check(spark, rows, least=20)) > 50


def test_edges(spark):
    rng = random.Random(3)
    names = ["a", "B", "é", "x\x00y", "the", "\x85", "z" * 300]
    rows = [(" ".join(rng.choice(names) + rng.choice(["", "", "", ".", ",", "\n", " \t", "!?"]) for _ in range(rng.choice((0, 1, 2, 30, 200)))), rng.choice(["en", None, "und", ""])) for _ in range(60)]
    rows += [(None, "en"), ("", None), (" \t\n ", "en"), ("p q r s t u " * 40 + "v", "en")] + [("same words here again", "xx")] * 12
    assert check(spark, rows, least=5)
    check(spark, rows, least=3, longest=3, percent=90, top=7)
    check(spark, [], least=1)
    check(spark, [("a b", "en")], least=2)
    docs = spark.createDataFrame([("a b", "en", 1, 2, 3)] * 3, "text string, lang string, id int, n int, phrase int")
    assert [tuple(r) for r in C.collocations(docs, least=3).collect()] == [("en", 1, "a b", 3, 3, 3, 6, 2000)]


def test_small_tries_and_bitmaps(spark):
    """Bursts, spills and a bitmap that is mostly wrong change nothing."""
    rng = random.Random(5)
    rows = [(" ".join(f"w{min(int(rng.expovariate(0.4)), 12)}" for _ in range(120)), "en") for _ in range(20)]
    assert check(spark, rows, least=6, limits=C.Limits(burst=2, held=40, text_bytes=500, bits=7))


def test_collisions_try_another_salt(spark):
    """Ids of few bits collide: the salt is changed until they don't, or the run ends with an error."""
    rows = [("a b c d " * 9, "en")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert not C._vocabulary(docs, 0, C.Limits(id_bits=2)).where("low <> high").isEmpty()
    with pytest.raises(RuntimeError, match="share an id"):
        C.collocations(docs, least=4, limits=C.Limits(id_bits=1))
    check(spark, rows, least=4, limits=C.Limits(id_bits=4))


def test_trie():
    rng = np.random.default_rng(1)
    trie, want = C.HatTrie(4, burst=3), Counter()
    for _ in range(20):
        keys = rng.integers(0, 4, (50, 4)).astype(np.uint64)
        trie.add(keys, np.arange(50))
        for k, n in zip(map(tuple, keys.tolist()), range(50), strict=True):
            want[k] += n
    assert trie.held == len(want)
    assert any(type(c) is C._Node for c in trie.root.values())
    roots = len(trie.root)
    keys, counts = trie.spill(len(want) // 2)
    assert 0 < len(trie.root) < roots
    rest = trie.spill(0)
    assert trie.held == 0 and not trie.root
    got = Counter()
    for k, n in zip(np.concatenate([keys, rest[0]]).tolist(), np.concatenate([counts, rest[1]]).tolist(), strict=True):
        got[tuple(k)] += n
    assert got == want


def test_products_beyond_64_bits(spark):
    """The score's arithmetic in columns holds products of 37 digits."""
    a, n, lr = 10**16 + 3, 10**18 - 7, 10**16 + 9
    row = spark.createDataFrame([(a, n, lr)], "a long, n long, l long").selectExpr(
        "(cast(a as decimal(18,0)) * cast(n as decimal(18,0)) * cast(1000 as decimal(4,0))) div (cast(l as decimal(18,0)) * cast(l as decimal(18,0))) as score").first()
    assert row.score == 1000 * a * n // (lr * lr)
