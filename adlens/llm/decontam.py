"""Benchmark decontamination with suffix arrays of the training words.

Each Arrow batch of documents is a shard: its words become ranks, prefix doubling sorts its suffixes, and every test window, the
head of a test suffix, is looked up by binary search; windows that several items have are looked up once. That gives the places
of every test window. How far each of them goes on is found the other way round, in the suffix array of the test set: a place's
neighbours there have its longest verbatim match with any test suffix. Shards are bounded by bytes, whole documents each, and
shuffle nothing. The test set is broadcast in blocks of at most ``block_bytes``; more blocks mean more passes over a batch in the
same stage.

Words are compared by two independent 64-bit hashes: one orders them, the other confirms each window.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import ALNUM, flat, owner, parts, prefix, slices, word_hashes, words
from ._store import bounded_batches

SHARD_BYTES = 4 << 20


@dataclass(frozen=True)
class TestSet:
    """The words of test items one after the other, as two hashes; ``at`` has the items' n + 1 offsets.

    known: the sorted hashes of all words. ranks: each word's place there plus 1, with a 0 after each item; place: a word's place among
    these; order: the suffixes of ``ranks`` that begin with a word, sorted. heads: the first word of one window of each kind, and
    need: its words; kinds: item of each window, in slices of ``kind_at`` by kind.
    """

    names: tuple[str, ...]
    one: np.ndarray
    two: np.ndarray
    at: np.ndarray
    window: int
    known: np.ndarray
    ranks: np.ndarray
    place: np.ndarray
    order: np.ndarray
    heads: np.ndarray
    need: np.ndarray
    kinds: np.ndarray
    kind_at: np.ndarray


def test_set(items: list[tuple[str, str]], window: int) -> TestSet:
    data, offsets = flat(pa.array([t or "" for _, t in items], pa.large_string()))
    starts, ends, at = words(data, offsets, ALNUM)
    one, two = word_hashes(data, starts, ends, lower=True), word_hashes(data, starts, ends, lower=True, seed=2)
    known, size, item = np.unique(one), np.diff(at), owner(at)
    place = np.arange(len(one)) + item
    ranks = np.zeros(len(one) + len(size), np.int64)
    ranks[place] = np.searchsorted(known, one) + 1
    order = suffix_array(ranks, int(size.max()) if len(size) else 0)
    need = np.minimum(window, size[item])
    first = np.flatnonzero(at[item + 1] - np.arange(len(one)) >= need)  # windows begin here
    need = need[first]
    key = np.stack([slices(prefix(one), first, first + need), slices(prefix(two, 2), first, first + need, 2), need.astype(np.uint64)])
    _, head, kind = np.unique(key, axis=1, return_index=True, return_inverse=True) if len(first) else (None, first, first)
    by_kind = np.argsort(kind.reshape(-1), kind="stable")
    kind_at = np.concatenate([[0], np.cumsum(np.bincount(kind.reshape(-1), minlength=len(head)))])
    return TestSet(tuple(n for n, _ in items), one, two, at, window, known, ranks, place, order[ranks[order] > 0], first[head], need[head], item[first[by_kind]], kind_at)


def suffix_array(ranks: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the suffixes of ``ranks`` in the order of their first ``depth`` values, by prefix doubling."""
    n = len(ranks)
    rank = ranks.astype(np.uint64)
    length = 1
    order = np.argsort(rank, kind="stable")
    while length < depth:
        after = np.zeros(n, np.uint64)
        after[: max(0, n - length)] = rank[length:] + np.uint64(1)
        key = (rank << np.uint64(32)) | after
        order = np.argsort(key)
        new = np.ones(n, bool)
        key = key[order]
        new[1:] = key[1:] != key[:-1]
        rank = np.empty(n, np.uint64)
        rank[order] = (np.cumsum(new) - 1).astype(np.uint64)
        length *= 2
        if new.all():
            break
    return order


class Shard:
    """The suffix array of some documents' words."""

    def __init__(self, one: np.ndarray, at: np.ndarray, known: np.ndarray, least: int, depth: int):
        """``known``: the sorted hashes of the test set's words. No match reaches across a word that it lacks, so the
        text is what is left of the documents: their runs of at least ``least`` known words, each with a 0 after it."""
        found = np.searchsorted(known, one)
        found[found == len(known)] = 0
        ok = known[found] == one
        first, last = ok.copy(), ok.copy()
        first[1:] &= ~ok[:-1]
        last[:-1] &= ~ok[1:]
        edges = at[(at > 0) & (at < len(one))]
        first[edges], last[edges - 1] = ok[edges], ok[edges - 1]
        begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        long = ends - begins >= least
        begins, size = begins[long], (ends - begins)[long]
        total = int(size.sum())
        run = np.repeat(np.arange(len(size)), size)
        #: Of each word of the text: its number among all words, and its place in ``text``.
        self.word = np.arange(total) + np.repeat(begins - (np.cumsum(size) - size), size)
        self.place = np.arange(total) + run
        self.text = np.zeros(total + len(size) + 1, np.int64)
        self.text[self.place] = found[self.word] + 1
        order = suffix_array(self.text, depth)
        self.order = order[self.text[order] > 0]

    def _compare(self, queries: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sign of query less suffix over the query's length."""
        width = queries.shape[1]
        steps = np.arange(width)
        got = self.text[np.minimum(at[:, None] + steps, len(self.text) - 1)]
        differs = (got != queries) & (steps < lengths[:, None])
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), lengths)
        rows = np.arange(len(at))
        col = np.minimum(first, width - 1)
        return np.where(first >= lengths, 0, np.sign(queries[rows, col] - got[rows, col]))

    def bounds(self, queries: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query (a row of ranks): first and end of the suffixes that begin with it."""
        n, m = len(self.order), len(queries)
        ends = []
        for upper in (False, True):
            lo, hi = np.zeros(m, np.int64), np.full(m, n, np.int64)
            while (live := np.flatnonzero(lo < hi)).size:
                mid = (lo[live] + hi[live]) // 2
                sign = self._compare(queries[live], lengths[live], self.order[mid])
                right = (sign > 0) | ((sign == 0) if upper else np.zeros(len(live), bool))
                lo[live[right]] = mid[right] + 1
                hi[live[~right]] = mid[~right]
            ends.append(lo)
        return ends[0], ends[1]


def _shared(sums: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of two sequences from ``a`` and ``b`` on, at most ``most``, by halving on hashes of slices."""
    lo, hi = np.zeros(len(a), np.int64), most.copy()
    while (live := np.flatnonzero(lo < hi)).size:
        mid = (lo[live] + hi[live] + 1) // 2
        same = slices(sums[0], a[live], a[live] + mid) == slices(sums[1], b[live], b[live] + mid)
        lo[live[same]] = mid[same]
        hi[live[~same]] = mid[~same] - 1
    return lo


def longest_matches(tests: TestSet, text: np.ndarray, at: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Longest verbatim match of each of ``text``'s suffixes from ``at`` on, of ``room`` words, with any test suffix.

    ``text`` has ranks as the test set does. The suffix's place among the sorted test suffixes is found by binary search; the
    longest match is with a neighbour.
    """
    sums = prefix(text.astype(np.uint64)), prefix(tests.ranks.astype(np.uint64))
    n = len(tests.order)
    item = owner(tests.at)
    left = np.zeros(len(tests.ranks), np.int64)
    left[tests.place] = tests.at[item + 1] - np.arange(len(item))
    best = np.zeros(len(at), np.int64)
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), n, np.int64)
    while (live := np.flatnonzero(lo < hi)).size:
        mid = (lo[live] + hi[live]) // 2
        other = tests.order[mid]
        same = _shared(sums, at[live], other, np.minimum(room[live], left[other]))
        best[live] = np.maximum(best[live], same)
        mine = np.where(same < room[live], text[np.minimum(at[live] + same, len(text) - 1)], 0)
        right = mine > tests.ranks[np.minimum(other + same, len(tests.ranks) - 1)]
        lo[live[right]] = mid[right] + 1
        hi[live[~right]] = mid[~right]
    return best


def find(batch: pa.RecordBatch, tests: TestSet) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]], np.ndarray]:
    """Words of each text, the spans of words that test windows cover, the names of their items, the longest match."""
    data, offsets = flat(batch.column("text"))
    starts, ends, at = words(data, offsets, ALNUM)
    docs = len(at) - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in range(docs)]
    names: list[set[str]] = [set() for _ in range(docs)]
    longest_of = np.zeros(docs, np.int64)
    n_words = np.diff(at)
    if not len(starts) or not len(tests.heads):
        return n_words, spans, names, longest_of
    one = word_hashes(data, starts, ends, lower=True)
    shard = Shard(one, at, tests.known, int(tests.need.min()), int(tests.need.max()))
    head = tests.place[tests.heads]
    queries = tests.ranks[np.minimum(head[:, None] + np.arange(int(tests.need.max())), len(tests.ranks) - 1)]
    lo, hi = shard.bounds(queries, tests.need)
    count = hi - lo
    if not count.sum():
        return n_words, spans, names, longest_of
    kind = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(kind)) - np.repeat(np.cumsum(count) - count, count)
    text_at = shard.order[np.repeat(lo, count) + inside]
    word = shard.word[np.searchsorted(shard.place, text_at)]
    length, q = tests.need[kind], tests.heads[kind]
    two = word_hashes(data, starts, ends, lower=True, seed=2)
    same = slices(prefix(two, 2), word, word + length, 2) == slices(prefix(tests.two, 2), q, q + length, 2)
    kind, word, length, text_at = kind[same], word[same], length[same], text_at[same]
    doc = owner(at)[word]
    cover = np.zeros(len(one) + 1, np.int64)
    np.add.at(cover, word, 1)
    np.add.at(cover, word + length, -1)
    hit = np.cumsum(cover[:-1]) > 0
    for d, k in np.unique(np.stack([doc, kind]), axis=1).T.tolist():
        names[d].update(tests.names[i] for i in tests.kinds[tests.kind_at[k] : tests.kind_at[k + 1]].tolist())
    ends_at = np.flatnonzero(shard.text == 0)  # each run of known words ends here, at its document's end at the latest
    room = ends_at[np.searchsorted(ends_at, text_at)] - text_at
    np.maximum.at(longest_of, doc, longest_matches(tests, shard.text, text_at, room))
    for d in np.unique(doc).tolist():
        h = np.flatnonzero(np.diff(np.concatenate([[0], hit[at[d] : at[d + 1]].astype(np.int8), [0]])))
        spans[d] = list(zip(h[::2].tolist(), h[1::2].tolist(), strict=True))
    return n_words, spans, names, longest_of


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_bytes: int = 2 << 20) -> DataFrame:
    """One row per input row: id, n_words long, n_hit long, items array<string>, spans array<struct<start, end>>, longest int.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. ``items`` are the distinct ids, sorted as strings, of
    the items of which a window of ``window`` words (a shorter item: all of it) occurs; ``spans`` are the words inside such
    occurrences, ``longest`` the words of the longest match. Null or wordless texts have no words and items without words no
    window. A null item id is written as an empty string; items that repeat an id count as one. Rows that repeat an id or a text are
    judged each for itself; an empty table gives no rows, an empty test set no hits; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(docs.sparkSession)
    tests = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("name"), F.col(item_text_col).alias("words")).where("words is not null")
    total = tests.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(0).alias("longest"),
    )
    schema = f"id {kind}, text string, n_words long, items array<string>, spans array<struct<start:int,end:int>>, longest int"
    for k in range(blocks):
        mine = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("name", "words"), F.lit(blocks)) == k)
        block = test_set([(r[0], r[1]) for r in mine.distinct().orderBy("name", "words").collect()], window)
        held = spark.sparkContext.broadcast(block)  # about ``block_bytes`` of text

        def run(batches: Iterator[pa.RecordBatch], held=held, last=k == blocks - 1) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for batch in parts(big, "text", SHARD_BYTES):
                    n_words, spans, names, longest = find(batch, held.value)
                    if blocks > 1:
                        was = batch.column("spans").to_pylist()
                        spans = [_union(s + [(x["start"], x["end"]) for x in w]) for s, w in zip(spans, was, strict=True)]
                        names = [a | set(b) for a, b in zip(names, batch.column("items").to_pylist(), strict=True)]
                        longest = np.maximum(longest, batch.column("longest").to_numpy())
                    text = pa.nulls(batch.num_rows, pa.string()) if last else batch.column("text")
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("id"), text, pa.array(n_words, pa.int64()), pa.array([sorted(x) for x in names], pa.list_(pa.string())),
                            pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPAN), pa.array(longest.astype(np.int32)),
                        ],
                        ["id", "text", "n_words", "items", "spans", "longest"],
                    )

        out = out.mapInArrow(run, schema)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]).cast("long"))
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), "items", "spans", "longest")
