"""Arrow string columns as flat numpy byte buffers, their words, and polynomial hashes of any slice of a sequence.

Everything works on UTF-8 bytes: the word patterns of this package only name ASCII characters, so a byte of 0x80 or above
has the class of the character that it is part of.
"""
from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute

_U = np.uint64


def _lean_heap() -> None:
    """Have glibc map arrays of 8 MB and more, so that freeing them gives the memory back at once, and trim its heap."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        trim_threshold, mmap_threshold = -1, -3
        libc.mallopt(mmap_threshold, 8 << 20)
        libc.mallopt(trim_threshold, 32 << 20)


_lean_heap()


def _fixed_random(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=_U)


_BYTE = {seed: _fixed_random(seed, 256) | _U(1) for seed in (1, 2)}
_BASE = {1: 0x9E3779B97F4A7C15, 2: 0xD6E8FEB86659FD93}


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values one after the other, and the n + 1 offsets of the values. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Fixed patterns: words between ASCII white space, and words of ASCII letters, digits and all that isn't ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of ``member`` bytes, and the n + 1 offsets of the documents' words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = member[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


_held: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the seed's base and of its inverse; the longest that were asked for are kept."""
    if seed not in _held or len(_held[seed][0]) < n:
        room = 1 << max(16, (n - 1).bit_length())
        both = []
        for b in (_BASE[seed], pow(_BASE[seed], -1, 2**64)):
            p = np.full(room, b, _U)
            p[0] = 1
            both.append(np.multiply.accumulate(p, out=p))
        _held[seed] = both[0], both[1]
    return _held[seed]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads a 64-bit value over all its bits; one to one."""
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def prefix(values: np.ndarray, seed: int = 1) -> np.ndarray:
    """Prefix sums from which ``slices`` hashes any slice; ``values`` are uint64."""
    n = len(values)
    up, _ = _powers(seed, n + 1)
    out = np.zeros(n + 1, _U)
    np.cumsum(values * up[:n], out=out[1:])
    return out


def slices(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """Polynomial hash mod 2 ** 64 of each slice, mixed; equal slices have equal hashes wherever they are."""
    _, down = _powers(seed, len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *, lower: bool, seed: int = 1) -> np.ndarray:
    table = _BYTE[seed][LOWER] if lower else _BYTE[seed]
    return slices(prefix(table[data], seed), starts, ends, seed)


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each text's values, added up in their order from 0: the same for equal texts, whatever texts are beside them."""
    return np.bincount(owner(offsets), values, len(offsets) - 1) if len(offsets) > 1 else np.zeros(0)


def owner(offsets: np.ndarray) -> np.ndarray:
    """Document of each element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def parts(batch: pa.RecordBatch, text: str, most: int = 8 << 20):
    """Slices of a batch of at most ``most`` bytes of text, or of one document."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    at = 0
    total = np.concatenate([[0], np.cumsum(sizes)])
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end
