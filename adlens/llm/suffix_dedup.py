"""Removal of long byte strings that an earlier document has, with a run-length Burrows-Wheeler index.

Candidate contexts come from ``_repeats``. Each owner of a hash range concatenates its contexts, sorts their suffixes and keeps the
Burrows-Wheeler transform as runs, with the text positions of the suffixes at both ends of each run. Contexts are then streamed
from their last byte to their first: the index gives their matching statistics, the longest match at each byte and where it is. A
byte that the row's run doesn't have moves the match to the nearest run that has it, whichever end shares more. Where a
match is ``width`` long, the block of rows that agree in as many bytes gives the least document that has those bytes.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _repeats as R
from ._bytes import _BYTE

_U = np.uint64


def byte_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _BYTE[1][data], offsets


PACKED = 7


def suffix_order(text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and which rows begin a block that agrees in ``width`` values; ``width`` is at least ``PACKED``.

    ``text`` has values from 0 to 256 and ends in a 0; zeros differ from each other and are ordered by position. The first seven
    values are packed into one number, then prefixes double, as far as the longest stretch between zeros reaches.
    """
    n = len(text)
    where = np.arange(n)
    key, live = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(PACKED):
        value = np.zeros(n, np.int64)
        value[: max(0, n - i)] = text[i:]
        value[~live] = 0
        live &= value > 0
        key = key * 257 + value
    order = np.lexsort((where, key)) if not live.all() else np.argsort(key)
    longest = int(np.diff(np.flatnonzero(text == 0), prepend=-1).max())
    length, ranks = PACKED, {}
    while True:
        new = np.ones(n, bool)
        sorted_ = key[order]
        new[1:] = sorted_[1:] != sorted_[:-1]
        if length == PACKED:
            new |= ~live[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        ranks[length] = rank
        if length >= max(width, longest):
            break
        after = np.zeros(n, np.int64)
        after[: max(0, n - length)] = rank[length:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key)
        length *= 2
    # Blocks of ``width``: two overlapping prefixes.
    half = max(p for p in ranks if p <= width)
    one, new = ranks[half][order], np.ones(n, bool)
    new[1:] = one[1:] != one[:-1]
    for shift in {*range(half, width - half, half), width - half} - {0}:
        second = np.full(n, -1, np.int64)
        second[: n - shift] = ranks[half][shift:]
        two = second[order]
        new[1:] |= two[1:] != two[:-1]
    return order, new


class RunLengthIndex:
    """Run-length BWT of contexts that each end in a 0; bytes are stored as 1 to 256.

    heads, starts, ends: symbol, first and last row of each run. before: for each run, earlier rows with its symbol; first: the
    rows before the smallest suffix of each symbol. first_at, last_at: text positions of the suffixes at the run's ends. keys,
    by_head: the runs by symbol and row. blocks, least: first row of each block that agrees in ``width`` bytes, and the least
    rank of a document in it.
    """

    def __init__(self, text: np.ndarray, rank_of: np.ndarray, width: int):
        order, new = suffix_order(text, width)
        bwt = text[order - 1]
        edge = np.ones(len(bwt), bool)
        edge[1:] = bwt[1:] != bwt[:-1]
        self.text, self.size, self.width = text.astype(np.int16), len(text), width
        self.starts = np.flatnonzero(edge)
        self.ends = np.append(self.starts[1:], self.size) - 1
        self.heads = bwt[self.starts]
        self.first_at, self.last_at = order[self.starts], order[self.ends]
        lengths = self.ends - self.starts + 1
        counts = np.bincount(self.heads, lengths, 258).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        self.by_head = np.argsort(self.heads, kind="stable")
        self.keys = self.heads[self.by_head] * (self.size + 1) + self.starts[self.by_head]
        base = np.zeros(len(self.by_head), np.int64)
        base[self.by_head] = np.cumsum(lengths[self.by_head]) - lengths[self.by_head]
        self.before = base - self.first[self.heads]
        self.blocks = np.flatnonzero(new)
        self.least = np.minimum.reduceat(rank_of[order], self.blocks)

    def shared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes the text has in common from ``a`` and from ``b`` on, up to ``most``."""
        out, live, steps = most.copy(), np.flatnonzero(most > 0), np.arange(16)
        at = 0
        while len(live):
            left = self.text[np.minimum(a[live, None] + at + steps, self.size - 1)]
            differs = left != self.text[np.minimum(b[live, None] + at + steps, self.size - 1)]
            some = differs.any(axis=1)
            out[live[some]] = np.minimum(most[live[some]], at + differs[some].argmax(axis=1))
            at += 16
            live = live[~some & (most[live] > at)]
        return out

    def extend(self, symbol: np.ndarray, row: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The longest match that begins with ``symbol`` and goes on as the match of ``length`` bytes at ``row``, text position ``at``.

        Gives its row, text position and length; 0 where the text lacks the symbol.
        """
        run = np.searchsorted(self.starts, row, "right") - 1
        other = np.flatnonzero(self.heads[run] != symbol)
        row, at, length = row.copy(), at.copy(), length.copy()
        if len(other):
            want, here = symbol[other], row[other]
            k = np.searchsorted(self.keys, want * (self.size + 1) + here)
            up, down = self.by_head[np.maximum(k - 1, 0)], self.by_head[np.minimum(k, len(self.keys) - 1)]
            has_up, has_down = (k > 0) & (self.heads[up] == want), (k < len(self.keys)) & (self.heads[down] == want)
            one = np.where(has_up, self.shared(at[other], self.last_at[up], np.where(has_up, length[other], 0)), -1)
            two = np.where(has_down, self.shared(at[other], self.first_at[down], np.where(has_down, length[other], 0)), -1)
            above = one >= two
            run[other] = np.where(above, up, down)
            row[other] = np.where(above, self.ends[up], self.starts[down])
            at[other] = np.where(above, self.last_at[up], self.first_at[down])
            length[other] = np.maximum(one, two)
        found = length >= 0
        row = np.where(found, self.first[symbol] + self.before[run] + row - self.starts[run], self.ends[0])
        return row, np.where(found, at - 1, self.last_at[0]), np.where(found, length + 1, 0)

    def least_rank(self, row: np.ndarray) -> np.ndarray:
        return self.least[np.searchsorted(self.blocks, row, "right") - 1]

    def earlier(self, byte: np.ndarray, begin: np.ndarray, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pattern and offset of the strings of ``width`` bytes that a document of less than the pattern's rank has."""
        live, done = np.arange(len(size)), 0
        row, at, length = (np.zeros(len(size), np.int64) for _ in range(3))
        at += self.last_at[0]
        row += self.ends[0]
        who, where = [live[:0]], [live[:0]]
        while len(live := live[size[live] > done]):
            done += 1
            place = size[live] - done
            row[live], at[live], length[live] = self.extend(byte[begin[live] + place].astype(np.int64) + 1, row[live], at[live], length[live])
            far = length[live] >= self.width
            hit = far.copy()
            hit[far] = self.least_rank(row[live[far]]) < rank[live[far]]
            who.append(live[hit])
            where.append(place[hit])
        return np.concatenate(who), np.concatenate(where)


#: Bytes of contexts in one index. Contexts of different anchors never meet, so an owner's are indexed in parts; those of one
#: anchor are one index up to the second bound, and beyond it several, in order of rank, through which later contexts are streamed.
INDEX_BYTES, MOST_BYTES = 1 << 19, 4 << 20


def _resolver(width: int, index_bytes: int = INDEX_BYTES, most_bytes: int = MOST_BYTES):
    def found_in(byte: np.ndarray, begin: np.ndarray, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context and offset of the strings of these contexts that an earlier document has."""
        order = np.argsort(rank, kind="stable")
        piece = (np.cumsum(size[order]) - size[order]) // most_bytes
        who, where = [], []
        for _, i in R._split(piece, order=np.arange(len(order))):
            mine, later = order[i], order[i[0]:]
            m, total = len(mine), int(size[mine].sum())
            step = np.repeat(begin[mine] - (np.cumsum(size[mine]) - size[mine]), size[mine])
            text = np.zeros(total + m, np.int64)
            text[np.arange(total) + np.repeat(np.arange(m), size[mine])] = byte[np.arange(total) + step].astype(np.int64) + 1
            index = RunLengthIndex(text, np.repeat(rank[mine], size[mine] + 1), width)
            w, o = index.earlier(byte, begin[later], size[later], rank[later])
            who.append(later[w])
            where.append(o)
        return np.concatenate(who), np.concatenate(where)

    def resolve(blobs: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Blobs of anchor (once a byte), byte, and per context: rank, tag, start, size."""
        if not blobs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        byte = np.concatenate([x[1] for x in blobs])
        # A context's first byte carries its numbers; size is 0 elsewhere.
        heads = [np.flatnonzero(x[5]) for x in blobs]
        anchor, rank, tag, start, size = (np.concatenate([x[i][h] for x, h in zip(blobs, heads, strict=True)]) for i in (0, 2, 3, 4, 5))
        blobs.clear()
        start, size = start.astype(np.int64), size.astype(np.int64)
        begin = np.cumsum(size) - size
        order = np.argsort(anchor, kind="stable")
        upto = np.cumsum(size[order])
        edge = np.flatnonzero(np.diff(anchor[order], prepend=anchor[order[:1]] ^ _U(1 << 63)))
        found, at = [(order[:0], order[:0])], 0
        while at < len(order):  # whole anchors, at least one
            want = np.searchsorted(upto, (upto[at - 1] if at else 0) + index_bytes, "right")
            later = edge[edge > at]
            fits = later[later <= want]
            end = int(fits[-1]) if len(fits) else int(later[0]) if len(later) else len(order)
            end = len(order) if want >= len(order) else end
            i = order[at:end]
            who, where = found_in(byte, begin[i], size[i], rank[i])
            found.append((i[who], where))
            at = end
        who, where = (np.concatenate(x) for x in zip(*found, strict=True))
        return rank[who], tag[who], (start[who] + where).astype(np.uint32)

    return resolve


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 50, k: int = 20) -> DataFrame:
    """One row per input row: id, n_bytes long, n_removed long, spans array<struct<start, end>>, kept binary.

    A byte goes if a ``width``-byte string covers it that also starts in a document with a smaller id; strings are judged on the
    input, as UTF-8, and never cross documents. ``spans`` are the maximal removed runs, ``kept`` the remaining bytes
    (a cut may fall inside a character). Null texts count as empty; null ids come last; rows that repeat an id don't
    remove each other's bytes.
    """
    plan = R.Plan(docs, byte_symbols, width=width, k=k, id_col=id_col, text_col=text_col)

    def contexts(here: R.Bin, asked: tuple[np.ndarray, ...]) -> list[np.ndarray]:
        rank, tag, start, count, _, a = asked
        record, doc = here.rows(rank, tag)
        size = count[record] - 1 + width
        total = int(size.sum())
        begin = np.cumsum(size) - size
        byte = here.data[np.arange(total) + np.repeat(here.at[doc] + start[record] - begin, size)]
        spread = lambda x, kind: _at(total, begin, x, kind)
        return [np.repeat(a[record], size), byte, spread(here.rank[doc], np.int64), spread(tag[record], np.int64), spread(start[record], np.uint32), spread(size, np.uint16)]

    packed, found = R.exchange(plan, contexts, _resolver(width))

    def finish(table: pa.Table) -> pa.Table:
        here = R.Bin(table, plan)
        gone = R.covered(here, table, width)
        keep = ~gone
        left = here.data[keep].tobytes()
        edge = np.concatenate([[0], np.cumsum(keep)])[here.offsets]
        kept = [left[edge[i] : edge[i + 1]] for i in range(len(here.rank))]
        size = np.diff(here.offsets)
        first, last = gone.copy(), gone.copy()
        first[1:] &= ~gone[:-1]
        last[:-1] &= ~gone[1:]
        cut = here.offsets[(here.offsets > 0) & (here.offsets < len(gone))]
        first[cut], last[cut - 1] = gone[cut], gone[cut - 1]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        at = np.searchsorted(a, here.offsets)
        doc = np.repeat(np.arange(len(size)), np.diff(at))
        spans = pa.StructArray.from_arrays([pa.array((a - here.offsets[doc]).astype(np.int32)), pa.array((b - here.offsets[doc]).astype(np.int32))], names=["start", "end"])
        ids = pa.array(here.rank, pa.int64(), mask=here.rank == R.LAST)
        return pa.table(
            [ids, pa.array(size, pa.int64()), pa.array(size - np.diff(edge), pa.int64()), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), spans), pa.array(kept, pa.binary())],
            names=["id", "n_bytes", "n_removed", "spans", "kept"],
        )

    kind = docs.schema[id_col].dataType
    out = packed.unionAll(found).groupBy("place").applyInArrow(finish, "id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")
    return out.select(F.col("id").cast(kind).alias(id_col), "n_bytes", "n_removed", "spans", "kept")


def _at(total: int, where: np.ndarray, values: np.ndarray, kind) -> np.ndarray:
    out = np.zeros(total, kind)
    out[where] = values
    return out
