"""Phrase collocations, counted in HAT-tries: hash containers under a shallow trie of word ids.

Orders are counted one after the other, each in a pass over the texts. A phrase of m words is counted only where its first and last m - 1
words are frequent, which a bitmap of fixed size tells (a wrong yes costs work, not results).

1. A task cuts texts into pieces and words; a word is a 64-bit id of language and word. Ids are checked against a second hash: if two
   words share one, all is done again with another salt.
2. The task counts phrases in a trie: below the first word is a hash container of the other words' ids. A container that grows beyond
   ``burst`` phrases bursts into a node with a container for each next word.
3. A trie of more than ``held`` phrases spills its largest subtrees, whole, as runs sorted by key, one for each prefix partition
   (a hash of the first three words, so that neither a frequent word nor a frequent pair makes one large).
4. The owner of a partition merges its runs and keeps the frequent phrases.

Scores are columns: a phrase's cuts are looked up among the frequent phrases, with exact decimal arithmetic.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bytes import flat, mix, owner, parts, word_hashes, words
from ._repeats import pack, unpack
from ._store import bounded_batches, dropped, stored_at

_U = np.uint64
#: Fixed patterns: bytes that end a piece, and those that a word has (neither these nor space and tab).
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD = ~ENDS
WORD[[0x20, 0x09]] = False
#: Bytes of all texts for each prefix partition.
PARTITION_BYTES = 4 << 20
_STEP = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Limits:
    """Phrases that a container holds before it bursts, and a trie before it spills; bytes of texts that a task takes at once; bits of the
    bitmap of frequent phrases, and of word ids (fewer only in tests)."""

    burst: int = 1 << 12
    held: int = 400_000
    text_bytes: int = 4 << 20
    bits: int = 26
    id_bits: int = 64


class _Node(dict):
    """A trie node: the next word's id to a container (a plain dict of the remaining ids to a count) or to another node."""


class HatTrie:
    """Counts of phrases of ``order`` word ids; keys are big-endian, so that runs sort by words."""

    def __init__(self, order: int, burst: int):
        self.order, self.burst, self.root, self.held = order, burst, _Node(), 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add to the counts of phrases, a row of ids each."""
        order = np.argsort(keys[:, 0])
        keys, counts = keys[order], counts[order].tolist()
        rests = _bytes(keys[:, 1:])
        at = np.flatnonzero(np.append(True, keys[1:, 0] != keys[:-1, 0])) if len(keys) else order
        for step, a, b in zip(_bytes(keys[at, :1]), at.tolist(), [*at[1:].tolist(), len(keys)], strict=True):
            child = self.root.setdefault(step, {})
            if type(child) is dict:
                self.held -= len(child)
                for rest, n in zip(rests[a:b], counts[a:b]):
                    child[rest] = child.get(rest, 0) + n
                self.held += len(child)
                self._grown(self.root, step, child, self.order - 1)
            else:
                for rest, n in zip(rests[a:b], counts[a:b]):
                    self._below(child, rest, n)

    def _below(self, node: _Node, rest: bytes, n: int) -> None:
        """Add below a node."""
        step, rest = rest[:8], rest[8:]
        child = node.setdefault(step, {})
        while type(child) is _Node:
            node, step, rest = child, rest[:8], rest[8:]
            child = node.setdefault(step, {})
        self.held += rest not in child
        child[rest] = child.get(rest, 0) + n
        self._grown(node, step, child, len(rest) // 8)

    def _grown(self, parent: _Node, step: bytes, container: dict, words_left: int) -> None:
        """Burst a container that has grown too large and whose phrases have more than one word left, and what comes of it likewise."""
        if len(container) <= self.burst or words_left < 2:
            return
        node = parent[step] = _Node()
        for rest, n in container.items():
            node.setdefault(rest[:8], {})[rest[8:]] = n
        for below, child in list(node.items()):
            self._grown(node, below, child, words_left - 1)

    def _containers(self, before: bytes, child: dict) -> Iterator[tuple[bytes, dict]]:
        if type(child) is _Node:
            for step, below in child.items():
                yield from self._containers(before + step, below)
        else:
            yield before, child

    @classmethod
    def _size(cls, child: dict) -> int:
        return sum(map(cls._size, child.values())) if type(child) is _Node else len(child)

    def spill(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Take the largest subtrees out, whole, until at most ``most`` phrases are left; their phrases and counts."""
        sizes = sorted(((self._size(child), step) for step, child in self.root.items()), reverse=True)
        by_depth: dict[int, list[tuple[bytes, dict]]] = {}
        for size, step in sizes:
            if self.held <= most:
                break
            for path, container in self._containers(step, self.root.pop(step)):
                by_depth.setdefault(len(path) // 8, []).append((path, container))
            self.held -= size
        keys, counts = [np.zeros((0, self.order), _U)], [np.zeros(0, np.int64)]
        for depth, found in by_depth.items():
            sizes = [len(c) for _, c in found]
            paths = np.frombuffer(b"".join(path for path, _ in found), ">u8").reshape(-1, depth).astype(_U)
            rests = np.frombuffer(b"".join(rest for _, c in found for rest in c), ">u8").reshape(-1, self.order - depth).astype(_U)
            keys.append(np.hstack([np.repeat(paths, sizes, axis=0), rests]))
            counts.append(np.fromiter((n for _, c in found for n in c.values()), np.int64, sum(sizes)))
        return np.concatenate(keys), np.concatenate(counts)


def _bytes(ids: np.ndarray) -> list[bytes]:
    """Each row's ids as big-endian bytes."""
    return np.ascontiguousarray(ids.astype(">u8")).view(f"V{8 * ids.shape[1]}").ravel().tolist()


def combined(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows of ids as one, with the sum of their counts, sorted by ids."""
    if not len(keys):
        return keys, counts
    order = np.lexsort(keys.T[::-1])
    keys, counts = keys[order], counts[order]
    new = np.append(True, (keys[1:] != keys[:-1]).any(axis=1))
    at = np.flatnonzero(new)
    return keys[at], np.add.reduceat(counts, at)


def tallied(keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ids and how often they occur, by a sort of their hashes. Rows of one hash that differ stay apart, if need be in several rows."""
    order = np.argsort(hashes)
    keys = keys[order]
    at = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else order
    return keys[at], np.diff(np.append(at, len(keys)))


def phrase_hashes(ids: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` ids from each position on."""
    n = max(0, len(ids) - order + 1)
    h = np.full(n, order, _U)
    for j in range(order):
        h = mix(h * _U(_STEP) + ids[j : j + n])
    return h


def _cut(batch: pa.RecordBatch, salt: int, bits: int) -> tuple[np.ndarray, ...]:
    """Bytes, starts and ends of words, their ids, a second hash, text of each word, and whether the next word is in the same piece."""
    data, offsets = flat(batch.column("text"))
    starts, ends, at = words(data, offsets, WORD)
    who = owner(at)
    first, second = (word_hashes(data, starts, ends, lower=True, seed=s) for s in (1, 2))
    names, place = flat(batch.column("lang"))
    tongue = word_hashes(names, place[:-1], place[1:], lower=False)[who] if len(names) else np.zeros(len(who), _U)
    first = mix(first * _U(_STEP) + mix(tongue + _U(salt))) >> _U(64 - bits)
    second = mix(second * _U(_STEP) + tongue)
    piece = np.cumsum(ENDS[data], dtype=np.int64)[starts] if len(starts) else starts
    joined = np.zeros(len(starts), bool)
    joined[:-1] = (piece[1:] == piece[:-1]) & (who[1:] == who[:-1])
    return data, starts, ends, first, second, who, joined


def _batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for big in batches:
        yield from parts(big, "text", most)


def _vocabulary(docs: DataFrame, salt: int, limits: Limits) -> DataFrame:
    """Rows (lang, id, f, low, high): a language's number of words (id null), or a word's with the bounds of its second hash (lang null)."""

    def run(batches):
        for batch in _batches(batches, limits.text_bytes):
            _, _, _, ids, second, who, _ = _cut(batch, salt, limits.id_bits)
            both, counts = tallied(np.stack([ids, second], axis=1), ids)
            names, code = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
            n = np.bincount(code[who], minlength=len(names))
            yield pa.RecordBatch.from_arrays(
                [pa.array([None] * len(both) + names.tolist(), pa.string()), pa.array(np.append(both[:, 0], np.zeros(len(names), _U)).view(np.int64), mask=np.arange(len(both) + len(names)) >= len(both)),
                 pa.array(np.append(counts, n)), pa.array(np.append(both[:, 1], np.zeros(len(names), _U)).view(np.int64))],
                ["lang", "id", "n", "second"],
            )

    found = docs.mapInArrow(run, "lang string, id long, n long, second long")
    return found.groupBy("lang", "id").agg(F.sum("n").alias("f"), F.min("second").alias("low"), F.max("second").alias("high"))


def _bitmap(frequent: DataFrame, bits: int) -> np.ndarray:
    """A bit for each value of the first ``bits`` bits of a frequent phrase's hash ``h``: at most a word for 64 bits reaches the driver."""
    bit = F.shiftrightunsigned("h", 64 - bits)
    got = frequent.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")).alias("v")).toArrow()
    out = np.zeros(1 << (bits - 6), _U)
    out[got.column("w").to_numpy()] = got.column("v").to_numpy().view(_U)
    return out


def _has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h >> _U(64 - (64 * len(bitmap) - 1).bit_length())
    return (bitmap[(bit >> _U(6)).astype(np.int64)] >> (bit & _U(63))) & _U(1) == 1


def _runs(docs: DataFrame, order: int, partitions: int, held, salt: int, limits: Limits) -> DataFrame:
    """Sorted runs (place, blob) of the phrases of ``order`` words whose first and last words but one the bitmap ``held`` has."""

    def packed(keys, counts):
        place = (phrase_rows(keys[:, :3]) % _U(partitions)).astype(np.int64)
        rank = np.lexsort((*keys.T[::-1], place))
        keys, counts, place = keys[rank], counts[rank], place[rank]
        at = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        ends = np.append(at[1:], len(place))
        blobs = [pack(*keys[a:b].T, counts[a:b]) for a, b in zip(at, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(place[at].astype(np.int32)), pa.array(blobs, pa.binary())], ["place", "blob"])

    def run(batches):
        trie, bitmap = HatTrie(order, limits.burst), held.value
        for batch in _batches(batches, limits.text_bytes):
            _, _, _, ids, _, _, joined = _cut(batch, salt, limits.id_bits)
            good = _has(bitmap, phrase_hashes(ids, order - 1))
            n = len(ids) - order + 1
            if n <= 0:
                continue
            whole = reduce(np.logical_and, (joined[j : j + n] for j in range(order - 1)))
            at = np.flatnonzero(whole & good[:n] & good[1 : n + 1])
            if len(at):
                trie.add(*tallied(ids[at[:, None] + np.arange(order)], phrase_hashes(ids, order)[at]))
            if trie.held > limits.held:
                yield packed(*trie.spill(limits.held // 2))
        if trie.held:
            yield packed(*trie.spill(0))

    return docs.mapInArrow(run, "place int, blob binary")


def phrase_rows(keys: np.ndarray) -> np.ndarray:
    """``phrase_hashes`` of each row of ids."""
    h = np.full(len(keys), keys.shape[1], _U)
    for j in range(keys.shape[1]):
        h = mix(h * _U(_STEP) + keys[:, j])
    return h


def _merged(runs: DataFrame, order: int, least: int) -> DataFrame:
    """Frequent phrases of the runs: ids, f and hash."""

    def run(table: pa.Table) -> pa.Table:
        columns = [unpack(b.as_py()) for b in table.column("blob")]
        keys = np.stack([np.concatenate([c[j] for c in columns]) for j in range(order)], axis=1)
        keys, counts = combined(keys, np.concatenate([c[order] for c in columns]))
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
        ids = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, order, dtype=np.int32), pa.array(keys.reshape(-1).view(np.int64)))
        return pa.Table.from_arrays([ids, pa.array(counts), pa.array(phrase_rows(keys).view(np.int64))], ["ids", "f", "h"])

    return runs.groupBy("place").applyInArrow(run, "ids array<long>, f long, h long")


def _texts(docs: DataFrame, held, salt: int, limits: Limits) -> DataFrame:
    """Language and text of the words that the bitmap ``held`` has: id, lang, word. A task tells each once, unless it has very many."""

    def run(batches):
        told: set[int] = set()
        for batch in _batches(batches, limits.text_bytes):
            data, starts, ends, ids, _, who, _ = _cut(batch, salt, limits.id_bits)
            some, at = np.unique(ids, return_index=True)
            at = at[_has(held.value, phrase_hashes(some, 1))]
            at = [i for i in at.tolist() if ids[i] not in told]
            if len(told) > limits.held:
                told.clear()
            told.update(ids[at].tolist())
            raw = data.tobytes()
            names = batch.column("lang")
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at].view(np.int64)), pa.array([names[int(who[i])].as_py() for i in at], pa.string()), pa.array([raw[starts[i] : ends[i]].lower().decode() for i in at], pa.string())], ["id", "lang", "word"]
            )

    return docs.mapInArrow(run, "id long, lang string, word string").groupBy("id").agg(F.min("lang").alias("lang"), F.min("word").alias("word"))


def _hashed(ids: DataFrame) -> DataFrame:
    """Rows of a word's id, and more, with its hash ``h`` as a phrase of one word."""

    def run(batches):
        for batch in batches:
            h = phrase_hashes(batch.column("id").to_numpy(zero_copy_only=False).view(_U), 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h.view(np.int64))], [*batch.schema.names, "h"])

    return ids.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in [*ids.dtypes, ("h", "long")]))


def _phrases(spark: SparkSession, docs: DataFrame, longest: int, least: int, limits: Limits, kept) -> tuple[DataFrame, DataFrame, int]:
    """Frequent phrases of all orders (ids, f), languages (lang, n), and the salt of the ids; ``kept`` stores a table."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    partitions = int(max(64, size // PARTITION_BYTES))
    for salt in range(8):
        vocabulary = kept(_vocabulary(docs, salt, limits).where(F.col("lang").isNotNull() | (F.col("f") >= least) | (F.col("low") != F.col("high"))), "vocabulary")
        if vocabulary.where("lang is null and low <> high").isEmpty():
            break
    else:
        raise RuntimeError("words share an id with each of eight salts")
    languages = vocabulary.where("lang is not null").select("lang", F.col("f").alias("n"))

    single = _hashed(vocabulary.where("lang is null").select("id", "f")).select(F.array("id").alias("ids"), "f", "h")
    orders = [kept(single, "phrases-1")]
    for order in range(2, longest + 1):
        held = spark.sparkContext.broadcast(_bitmap(orders[-1], limits.bits))
        orders.append(kept(_merged(_runs(docs, order, partitions, held, salt, limits), order, least), f"phrases-{order}"))
        held.destroy()
    return reduce(DataFrame.unionAll, (o.select("ids", "f") for o in orders)), languages, salt


def collocations(docs: DataFrame, *, longest: int = 5, least: int = 100, percent: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score; numbers are long.

    Phrases have 2 to ``longest`` words of one piece and occur ``least`` times or more. A phrase is scored by its worst cut; one inside a longer phrase
    that has ``percent`` per cent of its occurrences is dropped. Whole texts are read. A null language is ``und``, a null text empty; repeated rows count
    each. An empty table, and one without frequent phrases, gives no rows. Equal scores rank by occurrences, then by the phrase's bytes. Columns
    besides the two are ignored, whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    named = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    paths = []

    def stored(df, name):
        out, path = stored_at(df, name)
        paths.append(path)
        return out

    frequent, languages, salt = _phrases(spark, named, longest, least, limits, stored)
    cands = frequent.where(F.size("ids") > 1).withColumnRenamed("f", "a")
    # Phrases inside longer ones: two of one word less cover the rest, as each of these lies in between.
    inside = cands.where(F.size("ids") > 2).select(F.explode(F.array(F.slice("ids", F.lit(1), F.size("ids") - 1), F.slice("ids", F.lit(2), F.size("ids") - 1))).alias("ids"), F.col("a").alias("longer"))
    inside = inside.groupBy("ids").agg(F.max("longer").alias("longer"))
    kept = stored(cands.join(inside, "ids", "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < percent * F.col("a"))).select("ids", "a"), "kept")
    cuts = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("right"))
    cuts = cuts.join(frequent.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left").join(frequent.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
    held = spark.sparkContext.broadcast(_bitmap(_hashed(kept.select(F.explode("ids").alias("id")).distinct()), limits.bits))
    texts = stored(_texts(named, held, salt, limits), "words")
    held.destroy()
    spelt = kept.select("ids", F.posexplode("ids").alias("at", "id")).join(texts, "id").groupBy("ids").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"), F.min("lang").alias("lang"))
    wide = lambda c: F.col(c).cast("decimal(18,0)")  # noqa: E731  their products have 38 digits at most, and more is an error
    scored = cuts.join(spelt, "ids").join(languages, "lang").withColumn("over", wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)")).withColumn("under", wide("l") * wide("r"))
    worst = scored.withColumn("score", F.expr("over div under")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("worst"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("worst.score"), F.desc("a"), "phrase"))
    out = worst.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "worst.l", "worst.r", "n", "worst.score")
    out, _ = stored_at(out, "collocations")
    for path in paths:
        dropped(spark, path)
    return out
