"""Repeated windows of symbols across documents: which windows of ``width`` symbols also start in an earlier document.

Every window is named by its anchor, the leftmost k-gram of least hash inside it. Equal windows have equal anchors at equal
offsets, so windows need to be compared only with those of the same anchor hash, and only one record an anchor is shuffled
(about one in eleven to sixteen symbols), not one a window.

1. ``anchors``: for each anchor its hash and the hash of its context, all windows that it names.
2. ``judge``: owners of hash ranges find, for each anchor, whether an earlier document has the same context (then all its
   windows repeat) or the same anchor in another context (then its context takes part in step 3).
3. ``contexts`` of the latter go to the same owners, where a resolver decides window by window.
4. Verdicts return to the documents' bins, where the covered symbols are marked.

Records travel as compressed blobs, one for each task and owner or bin. A document is known by its rank (all 64 bits of its id) and a
64-bit hash of id and text, once a blob; records point to it. Contexts are compared by 96 bits, and those of step 3 window by
window. Bins and owners grow in number with the input, so what one of them holds does not. Of equal contexts in a task only the
least documents' are judged by the owner: the others repeat already, and are dealt evenly over the owners (DONE) on their way to
their bins, so a passage that a large share of all documents has costs its owner one record a task.
"""
from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import flat, mix, parts, prefix, slices
from ._store import bounded_batches, stored

_U = np.uint64
LAST = np.iinfo(np.int64).max
#: Records carry 48 bits of either hash: a pair is taken as equal by 96.
KEPT_ANCHOR, KEPT_CONTEXT = _U(0xFFFFFFFFFFFF0000), _U(0x0000FFFFFFFFFFFF)
PACKED = "place int, what int, blob binary"
PART_BYTES, BIN_BYTES, OWNER_BYTES = 1 << 19, 2 << 20, 10 << 20
#: Records, and bytes of texts, that a task gathers before it packs them.
HELD_RECORDS, HELD_BYTES = 1 << 18, 8 << 20


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed blob; bytes of equal significance lie together."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
        out += [a.dtype.char.encode(), len(a).to_bytes(8, "little"), raw]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 0
    while at < len(raw):
        kind = np.dtype(raw[at : at + 1].decode())
        n = int.from_bytes(raw[at + 1 : at + 9], "little")
        at += 9
        size = n * kind.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, n) if n else np.zeros((kind.itemsize, 0), np.uint8)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += size
    return out


def anchors(symbols: np.ndarray, at: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums of the symbols; hash and position of each anchor, and the first and last start of the windows it names."""
    none = np.zeros(0, np.int64)
    sums = prefix(symbols)
    n = len(symbols) - k + 1
    if n <= 0 or not (np.diff(at) >= width).any():
        return sums, np.zeros(0, _U), none, none, none
    where = np.arange(n)
    best, arg = slices(sums, where, where + k), where.astype(np.int32)
    wide, span = width - k + 1, 1
    while span < wide:
        step = min(span, wide - span)
        m = len(best) - step
        if m <= 0:
            break
        left = best[:m] <= best[step : step + m]
        best, arg = np.where(left, best[:m], best[step : step + m]), np.where(left, arg[:m], arg[step : step + m])
        span += step
    inside = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(inside, at[:-1], 1)
    np.add.at(inside, np.maximum(at[1:] - width + 1, at[:-1]), -1)
    start = np.flatnonzero(np.cumsum(inside[: len(arg)]) > 0)
    chosen = arg[start].astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1)
    i = np.flatnonzero(new)
    place, first, last = chosen[i], start[i], start[np.append(i[1:], len(start)) - 1]
    return sums, slices(sums, place, place + k), place, first, last


def context_hash(sums: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    return mix(slices(sums, first, last + width) ^ (place - first).astype(_U))


Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def tagged(rank: Column, text: Column) -> Column:
    """The tag of a row. Tags place rows in bins and tell rows of one rank apart; rows of different ranks may share one."""
    return F.xxhash64(rank, text)


class Plan:
    """The exchange of one run: how texts become symbols, how wide windows are, and how many owners and bins there are."""

    def __init__(self, docs: DataFrame, symbols: Symbols, *, width: int, k: int, id_col: str, text_col: str):
        if not 0 < k <= width:
            raise ValueError("k must be from 1 to width")
        self.symbols, self.width, self.k = symbols, width, k
        bounded_batches(docs.sparkSession)
        # Measured: the optimizer's guess is far off behind a join, and boundless for rows that no file holds.
        self.size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
        self.bins, self.owners = int(max(64, self.size // BIN_BYTES)), int(max(64, self.size // OWNER_BYTES))
        text = F.coalesce(F.col(text_col), F.lit(""))
        # A null id comes after all others. Rows are known by rank and tag together, so repeated ids with different texts stay apart.
        rank = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
        self.base = docs.select(rank.alias("rank"), text.alias("text")).select("rank", tagged(F.col("rank"), F.col("text")).alias("tag"), "text")

    def between(self, low: int | None, high: int | None) -> Plan:
        """The same exchange for the rows of ranks from ``low`` to below ``high``."""
        part = copy.copy(self)
        part.base = self.base
        if low is not None:
            part.base = part.base.where(F.col("rank") >= low)
        if high is not None:
            part.base = part.base.where(F.col("rank") < high)
        return part

    def __getstate__(self):  # what the executors need
        return {k: v for k, v in self.__dict__.items() if k != "base"}

    def owner(self, a: np.ndarray) -> np.ndarray:
        return ((a >> _U(32)) * _U(self.owners) >> _U(32)).astype(np.int64)

    def bin(self, tag: np.ndarray) -> np.ndarray:
        return ((mix(tag.view(_U)) >> _U(32)) * _U(self.bins) >> _U(32)).astype(np.int64)


def _rows(place: list[int], what: int, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array([what] * len(place), pa.int32()), pa.array(blobs, pa.binary())], ["place", "what", "blob"])


def _rows_table(place: list[int], what: int, blobs: list[bytes]) -> pa.Table:
    return pa.Table.from_batches([_rows(place, what, blobs)])


def _split(where: np.ndarray, order_by: tuple[np.ndarray, ...] = (), order: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of each place, ordered by ``order_by`` within it; ``order`` where the rows' order by place is known."""
    if not len(where):
        return
    if order is None:
        order = np.lexsort((*order_by, where)) if order_by else np.argsort(where, kind="stable")
    sorted_ = where[order]
    edge = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    for a, b in zip(edge, np.append(edge[1:], len(order)), strict=True):
        yield int(sorted_[a]), order[a:b]


ANCHOR, DOCS, VERDICT, CONTEXT, RUN, DONE = range(6)


def narrow(which: np.ndarray, n: int) -> np.ndarray:
    """Numbers below ``n`` in as few bytes as hold them."""
    return which.astype(np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32)


def documents(rank: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For records of (rank, tag): a number of each record's document, and one record of each document."""
    order = np.lexsort((tag, rank))
    new = np.ones(len(order), bool)
    new[1:] = (rank[order][1:] != rank[order][:-1]) | (tag[order][1:] != tag[order][:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return which, order[new]


def listed(doc: np.ndarray, rank: np.ndarray, tag: np.ndarray) -> list[np.ndarray]:
    """Rank differences and tags of the documents that ``doc`` names by number, and the place of each record's among these."""
    used, which = np.unique(doc, return_inverse=True)
    return [np.diff(rank[used], prepend=np.int64(0)), tag[used], narrow(which, len(used))]


def unlisted(found: list[list[np.ndarray]], at: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of blobs with ``listed`` arrays from place ``at`` on: each record's document number, and the documents' ranks and tags."""
    rank = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(x[at]) for x in found)])
    tag = np.concatenate([np.zeros(0, np.int64), *(x[at + 1] for x in found)])
    base = np.cumsum([0, *(len(x[at]) for x in found)])
    doc = np.concatenate([np.zeros(0, np.int64), *(b + x[at + 2].astype(np.int64) for b, x in zip(base, found))])
    return doc, rank, tag


def packed_anchors(plan: Plan) -> DataFrame:
    """Rows (owner, ANCHOR, blob of anchor, context, documents, first window, offset of the anchor, windows).

    Rows DONE (any owner: documents, first window, windows) have the contexts that an earlier document of the same task has.
    """
    symbols, width, k = plan.symbols, plan.width, plan.k
    small = np.uint8 if width < 256 else np.uint32

    def flush(held: list[list[np.ndarray]], ids: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        a, c, d, f, o, w = (np.concatenate(x) for x in zip(*held, strict=True))
        rank, tag = (np.concatenate(x) for x in zip(*ids, strict=True))
        group, least = _first_of((a, c), rank[d])
        again = rank[d] > least[group]
        order = np.argsort(a)  # owners are ranges of hashes
        order, done = order[~again[order]], np.flatnonzero(again)
        if len(done):
            yield _rows([int(a[done[0]] % _U(plan.owners))], DONE, [pack(*listed(d[done], rank, tag), f[done].astype(np.uint32), w[done].astype(small))])
        place, blobs = [], []
        for p, i in _split(plan.owner(a), order=order):
            place.append(p)
            blobs.append(pack(np.diff(a[i], prepend=_U(0)), c[i], *listed(d[i], rank, tag), f[i].astype(np.uint32), o[i].astype(small), w[i].astype(small)))
        yield _rows(place, ANCHOR, blobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        ids: list[list[np.ndarray]] = []
        size = docs = 0
        for big in batches:
            for batch in parts(big, "text", PART_BYTES):
                data, offsets = flat(batch.column("text"))
                sym, at = symbols(data, offsets)
                sums, a, place, first, last = anchors(sym, at, width, k)
                # An anchor is the least of many hashes; mixed again, anchors are spread evenly over owners.
                a, c = mix(a) & KEPT_ANCHOR, context_hash(sums, place, first, last, width) & KEPT_CONTEXT
                doc = np.searchsorted(at, place, "right") - 1
                held.append([a, c, docs + doc, (first - at[doc]).astype(np.uint32), (place - first).astype(np.uint16), (last - first + 1).astype(np.uint16)])
                ids.append([batch.column("rank").to_numpy(), batch.column("tag").to_numpy()])
                size, docs = size + len(a), docs + batch.num_rows
                if size >= HELD_RECORDS:
                    yield from flush(held, ids)
                    held, ids, size, docs = [], [], 0, 0
        if size:
            yield from flush(held, ids)

    return plan.base.mapInArrow(run, PACKED)


def packed_docs(plan: Plan) -> DataFrame:
    """Rows (bin, DOCS, blob of ranks, tags, sizes and texts)."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        rank, tag = table.column("rank").to_numpy(), table.column("tag").to_numpy()
        data, offsets = flat(table.column("text"))
        place, blobs = [], []
        for p, i in _split(plan.bin(tag)):
            texts = np.concatenate([data[offsets[j] : offsets[j + 1]] for j in i.tolist()])
            place.append(p)
            blobs.append(pack(rank[i], tag[i], (offsets[i + 1] - offsets[i]), texts, level=3))
        yield _rows(place, DOCS, blobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for big in batches:
            for batch in parts(big, "text", PART_BYTES):
                held.append(batch)
                size += batch.nbytes
                if size >= HELD_BYTES:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return plan.base.mapInArrow(run, PACKED)


def _by_what(table: pa.Table, what: int) -> list[list[np.ndarray]]:
    kinds, blobs = table.column("what").to_numpy(), table.column("blob")
    return [unpack(blobs[i].as_py()) for i in np.flatnonzero(kinds == what).tolist()] if len(kinds) else []


def _first_of(keys: tuple[np.ndarray, ...], value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each row by ``keys``, and the least value of each group."""
    h = keys[0]
    for k in keys[1:]:
        h = mix(h * _U(0x9E3779B97F4A7C15) + k.astype(_U))
    order = np.argsort(h)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0) if len(order) else new[1:]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(value[order], np.flatnonzero(new)) if len(order) else value[:0]
    return group, least


def judge(plan: Plan, packed: DataFrame) -> DataFrame:
    """Rows (bin, VERDICT, blob of documents, first window, windows, kind, offset, anchor); kind 0: all repeat, 1: take part in step 3."""

    def run(table: pa.Table) -> pa.Table:
        found, done = _by_what(table, ANCHOR), _by_what(table, DONE)
        a = np.concatenate([np.zeros(0, _U), *(np.cumsum(x[0], dtype=_U) for x in found)])
        c = np.concatenate([np.zeros(0, _U), *(x[1] for x in found)])
        doc, ranks, tags = unlisted([x[2:5] for x in found] + [x[:3] for x in done])
        n, total = len(a), len(doc)
        rank = ranks[doc[:n]]
        by_context, first_context = _first_of((a, c), rank)
        by_anchor, first_anchor = _first_of((a,), rank)
        contexts = np.zeros(len(first_anchor), np.int64)
        one = np.unique(by_context, return_index=True)[1]
        np.add.at(contexts, by_anchor[one], 1)
        last_anchor = np.full(len(first_anchor), np.iinfo(np.int64).min)
        np.maximum.at(last_anchor, by_anchor, rank)
        repeats = first_context[by_context] < rank
        mixed = (contexts[by_anchor] > 1) & (last_anchor[by_anchor] > first_anchor[by_anchor])
        part = np.zeros(total, bool)
        part[:n] = mixed & ~repeats  # every row of the first document that has the context
        first = np.concatenate([np.zeros(0, np.uint32), *(x[5] for x in found), *(x[3] for x in done)])
        count = np.concatenate([np.zeros(0, np.uint32), *(x[7] for x in found), *(x[4] for x in done)]).astype(np.uint32)
        offset = np.concatenate([np.zeros(0, np.uint32), *(x[6] for x in found)]).astype(np.uint16)
        chosen = np.concatenate([np.flatnonzero(repeats | part[:n]), np.arange(n, total)])
        place, blobs = [], []
        for p, i in _split(plan.bin(tags[doc[chosen]]), (first[chosen], doc[chosen])):
            i = chosen[i]
            asked = part[i]
            place.append(p)
            blobs.append(pack(*listed(doc[i], ranks, tags), first[i], count[i], asked.astype(np.uint8), offset[i[asked]], a[i[asked]]))
        return _rows_table(place, VERDICT, blobs)

    return packed.groupBy("place").applyInArrow(run, PACKED)


def in_slices(symbols: Symbols, data: np.ndarray, offsets: np.ndarray, most: int = PART_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """``symbols`` of documents a few at a time: what it needs on the way is many times their size."""
    found, counts, at = [np.zeros(0, _U)], [np.zeros(1, np.int64)], 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        got, edge = symbols(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        found.append(got)
        counts.append(np.diff(edge))
        at = end
    return np.concatenate(found), np.cumsum(np.concatenate(counts))


class Bin:
    """The documents of one bin, as flat bytes, and what was found of them."""

    def __init__(self, table: pa.Table, plan: Plan):
        docs = _by_what(table, DOCS)
        cat = lambda i, kind: np.concatenate([np.zeros(0, kind), *(x[i] for x in docs)])
        self.rank, self.tag = cat(0, np.int64), cat(1, np.int64)
        self.data = cat(3, np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(cat(2, np.int64))])
        self.symbols, self.at = in_slices(plan.symbols, self.data, self.offsets)
        self.order = np.argsort(self.tag, kind="stable")
        self.tags = self.tag[self.order]

    def rows(self, rank: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For records with ``rank`` and ``tag``: pairs of record and document (repeated rows: each of them)."""
        lo, hi = np.searchsorted(self.tags, tag), np.searchsorted(self.tags, tag, "right")
        count = hi - lo
        record = np.repeat(np.arange(len(tag)), count)
        doc = self.order[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        same = self.rank[doc] == rank[record]
        return record[same], doc[same]


def verdicts(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Document numbers, their ranks and tags, first window, windows, whether it takes part; then offset and anchor of those that do."""
    found = _by_what(table, VERDICT)
    cat = lambda xs, kind: np.concatenate([np.zeros(0, kind), *xs])
    return (
        *unlisted(found), cat((x[3] for x in found), np.uint32).astype(np.int64), cat((x[4] for x in found), np.uint32).astype(np.int64),
        cat((x[5] for x in found), np.uint8).astype(bool), cat((x[6] for x in found), np.uint16).astype(np.int64), cat((x[7] for x in found), _U),
    )


def answers(plan: Plan, doc: np.ndarray, ranks: np.ndarray, tags: np.ndarray, start: np.ndarray) -> pa.Table:
    """Rows (bin, VERDICT, blob) that say that the windows at ``start`` of these documents (by number) repeat."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order].astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    begin = np.flatnonzero(new)
    doc, start, count = doc[begin], start[begin].astype(np.uint32), np.diff(np.append(begin, len(order))).astype(np.uint32)
    place, blobs = [], []
    for p, i in _split(plan.bin(tags[doc])):
        place.append(p)
        blobs.append(pack(*listed(doc[i], ranks, tags), start[i], count[i], np.zeros(len(i), np.uint8), np.zeros(0, np.uint16), np.zeros(0, _U)))
    return _rows_table(place, VERDICT, blobs)


def exchange(plan: Plan, contexts: Callable[[Bin, tuple[np.ndarray, ...]], list[np.ndarray]], resolve: Callable[[list[list[np.ndarray]]], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[DataFrame, DataFrame]:
    """Packed documents and all verdicts, both by bin.

    ``contexts`` makes the arrays that an owner gets of the anchors that take part (anchor first, then anything);
    ``resolve`` gives rank, tag and position of the windows that repeat.
    """
    first = stored(judge(plan, packed_anchors(plan)), "repeats")

    def ask(table: pa.Table) -> pa.Table:
        here = Bin(table, plan)
        doc, rank, tag, start, count, asked, offset, a = verdicts(table)
        asking = doc[asked]
        arrays = contexts(here, (rank[asking], tag[asking], start[asked], count[asked], offset, a))
        place, blobs = [], []
        for p, i in _split(plan.owner(arrays[0])):
            place.append(p)
            blobs.append(pack(*(x[i] for x in arrays)))
        return pa.table([pa.array(place, pa.int32()), pa.array([CONTEXT] * len(place), pa.int32()), pa.array(blobs, pa.binary())], names=["place", "what", "blob"])

    def answer(table: pa.Table) -> pa.Table:
        rank, tag, start = resolve(_by_what(table, CONTEXT))
        which, one = documents(rank, tag)
        return answers(plan, which, rank[one], tag[one], start)

    asked = stored(packed_docs(plan).unionAll(first).groupBy("place").applyInArrow(ask, PACKED), "contexts")
    return packed_docs(plan), first.unionAll(asked.groupBy("place").applyInArrow(answer, PACKED))


def covered(here: Bin, table: pa.Table, width: int) -> np.ndarray:
    """Which symbols of the bin a repeated window covers."""
    doc, rank, tag, start, count, asked, _, _ = verdicts(table)
    doc, start, count = doc[~asked], start[~asked], count[~asked]
    record, doc = here.rows(rank[doc], tag[doc])
    begin = here.at[doc] + start[record]
    cover = np.zeros(len(here.symbols) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + count[record] - 1 + width, -1)
    return np.cumsum(cover[:-1]) > 0
