"""SimHash near duplicates: tiles of fingerprints are compared whole, by exclusive-or and bit counts in numpy.

1. Each text's fingerprint is the majority of its shingles' hashes, bit by bit. Rows of one fingerprint are one node from there on.
2. Distinct fingerprints are sorted by their population count, then by those of ever smaller parts (halves, quarters, bytes), in
   ranges of Spark, and cut into tiles. A tile travels as one blob with the least and greatest count of each part.
3. Two tiles can hold a pair within the radius only if the gaps of their parts' counts don't add up to more than it: other pairs of
   tiles are skipped, first whole tiles, then the small ones of ``INNER`` fingerprints that a task cuts them into.
4. A task tells which fingerprints of its two tiles hang together and returns links that span them, not all pairs. Small tiles that
   hang together already aren't compared again, so a large group of near copies costs little more than its size.

Compared pairs grow with the square of the number of distinct fingerprints, less what is skipped: the more fingerprints there are, the fewer counts
a tile spans, and the larger a share is skipped.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import LOWER, NOT_SPACE, flat, parts, words
from ._graph import components
from ._store import bounded_batches, dropped, stored_at

_U = np.uint64
#: Fixed values of the fingerprint: words in a shingle and seed of XXH64.
SHINGLE, SEED = 4, 42
#: Fingerprints in a small tile; tiles are about ``TILES`` in number unless their size passes these bounds (12 bytes a fingerprint).
INNER, TILES, LEAST_TILE, MOST_TILE = 1024, 64, 1 << 12, 1 << 19
#: Bits of the parts whose counts order the tiles: the whole, then the first half of each part before.
_PARTS = [(0, 64), (0, 32), (0, 16), (32, 48), *((8 * i, 8 * i + 8) for i in (0, 2, 4, 6))]
#: Parts that don't overlap and together are the whole, as rows of counts, for the bound of two tiles.
_LEVELS = [[(0, 64)], [(0, 32), (32, 64)], [(16 * i, 16 * i + 16) for i in range(4)], [(8 * i, 8 * i + 8) for i in range(8)]]
#: One bit of a byte in each byte of a word: adds up to 255 hashes at once.
_SPREAD = np.array([sum(((v >> i) & 1) << (8 * i) for i in range(8)) for v in range(256)], _U)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each text's shingles, repeats included, and the n + 1 offsets of the texts' shingles."""
    starts, ends, at = words(data, offsets, NOT_SPACE)
    count = np.diff(at)
    shingles = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    # All words joined by one space: a shingle is a slice of them.
    size = ends - starts
    close = np.cumsum(size + 1) - 1
    joined = np.full(int(close[-1]) + 1 if len(close) else 0, 32, np.uint8)
    open_ = close - size
    inside = np.flatnonzero(NOT_SPACE[data])
    joined[np.repeat(open_ - starts, size) + inside] = LOWER[data[inside]]
    out = np.concatenate([[0], np.cumsum(shingles)])
    first = np.arange(out[-1]) - np.repeat(out[:-1] - at[:-1], shingles)
    last = first + np.repeat(np.minimum(count, n), shingles) - 1
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((digest(text[a:b], SEED) for a, b in zip(open_[first].tolist(), close[last].tolist())), _U, len(first)), out


def majority(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text the bits that are set in over half of its hashes; 0 for a text without any."""
    texts, n = len(at) - 1, np.diff(at)
    # Blocks of at most 255 hashes of one text: their sums fit in a byte.
    blocks = -(-n // 255)
    first = np.concatenate([[0], np.cumsum(blocks)])
    begin = np.repeat(at[:-1], blocks) + 255 * (np.arange(first[-1]) - np.repeat(first[:-1], blocks))
    out = np.zeros(texts, _U)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    for byte in range(8):
        sums = np.add.reduceat(_SPREAD[(hashes >> _U(8 * byte)).astype(np.uint8)], begin)
        lanes = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first[some], axis=0)
        bits = (2 * lanes > n[some][:, None]).astype(_U)
        out[some] |= (bits << np.arange(8, dtype=_U)).sum(axis=1, dtype=_U) << _U(8 * byte)
    return out


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and ``fp``, the fingerprint as a signed number. Whole texts are read; null counts as empty: 0."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for big in batches:
            for batch in parts(big, "text", 2 << 20):
                got = majority(*shingle_hashes(*flat(batch.column("text"))))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(got.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def _counts(fp: np.ndarray, parts_: list[tuple[int, int]]) -> np.ndarray:
    """Population counts of bit ranges, a column each."""
    return np.stack([np.bitwise_count((fp >> _U(a)) & _U((1 << (b - a)) - 1)) for a, b in parts_], axis=1).astype(np.int16)


def _count_column(fp: Column, a: int, b: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1)))


def _boxes(fp: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Least and greatest counts of each slice, for each level of parts."""
    out = []
    for level in _LEVELS:
        c = _counts(fp, level)
        out.append((np.minimum.reduceat(c, starts), np.maximum.reduceat(c, starts)))
    return out


def _gap(a: list, b: list) -> np.ndarray:
    """A lower bound of the distance between slices of ``a`` (rows) and of ``b`` (columns)."""
    best = np.zeros((len(a[0][0]), len(b[0][0])), np.int16)
    for (low_a, high_a), (low_b, high_b) in zip(a, b, strict=True):
        gap = np.zeros_like(best)
        for p in range(low_a.shape[1]):
            gap += np.maximum(0, np.maximum(low_b[None, :, p] - high_a[:, None, p], low_a[:, None, p] - high_b[None, :, p]))
        best = np.maximum(best, gap)
    return best


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of a[i] and b[i] in ``root``, where every node points to its set's least node."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def compare(left: np.ndarray, right: np.ndarray | None, radius: int, root: np.ndarray, inner: int = INNER) -> None:
    """Merge in ``root`` (left's nodes, then right's) what is within ``radius``; without ``right``, within left itself."""
    other = left if right is None else right
    shift = 0 if right is None else len(left)
    la, lb = np.arange(0, len(left), inner), np.arange(0, len(other), inner)
    near = _gap(_boxes(left, la), _boxes(other, lb)) <= radius
    if right is None:
        near = np.triu(near)
    for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
        x, y = slice(la[i], la[i] + inner), slice(lb[j], lb[j] + inner)
        rx, ry = root[: len(left)][x], root[shift:][y]
        if rx[0] == ry[0] and (rx == rx[0]).all() and (ry == ry[0]).all():
            continue  # all of them hang together already
        hit = np.bitwise_count(left[x][:, None] ^ other[y][None, :]) <= radius
        if right is None and i == j:
            np.fill_diagonal(hit, False)
        if hit.any():
            a, b = np.nonzero(hit)
            _join(root, a + la[i], b + lb[j] + shift)


def _tiles(nodes: DataFrame, ranges: int, most: int, radius: int, inner: int) -> DataFrame:
    """Sorted tiles: id, blob of fingerprints, blob of the first node each hangs together with inside the tile, and bounds of each part's counts."""
    order = [_count_column(F.col("fp"), a, b).alias(f"c{i}") for i, (a, b) in enumerate(_PARTS)]
    keys = [*(f"c{i}" for i in range(len(_PARTS))), "fp"]
    ranked = nodes.select("fp", *order).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)

    def run(batches):
        from pyspark import TaskContext

        part, k, held, n = TaskContext.get().partitionId(), 0, [], 0

        def packed(fp):
            root = np.arange(len(fp), dtype=np.int32)
            compare(fp, None, radius, root, inner)
            box = _boxes(fp, np.zeros(1, np.int64))
            row = [(part << 32) + k, fp.tobytes(), root.tobytes(), int(box[0][0][0, 0]), int(box[0][1][0, 0]), [int(v) for low, high in box for v in (*low[0], *high[0])]]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int32())), strict=True)], ["tile", "fps", "roots", "low", "high", "box"])

        for batch in batches:
            held.append(batch.column("fp").to_numpy(zero_copy_only=False).view(_U))
            n += len(held[-1])
            while n >= most:
                whole = np.concatenate(held)
                yield packed(whole[:most])
                k, held, n = k + 1, [whole[most:]], n - most
        if n:
            yield packed(np.concatenate(held))

    return ranked.select("fp").mapInArrow(run, "tile long, fps binary, roots binary, low int, high int, box array<int>")


def _box(values: list) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for level in _LEVELS:
        k = len(level)
        out.append((np.array([values[at : at + k]], np.int16), np.array([values[at + k : at + 2 * k]], np.int16)))
        at += 2 * k
    return out


def _tile_gap(a: Column, b: Column) -> Column:
    """The bound of two tiles in columns: of each level of parts the gaps' sum, and of these the greatest."""
    levels, at = [], 0
    for level in _LEVELS:
        k, gap = len(level), F.lit(0)
        for p in range(k):
            gap = gap + F.greatest(F.lit(0), b[at + p] - a[at + k + p], a[at + p] - b[at + k + p])
        levels.append(gap)
        at += 2 * k
    return F.greatest(*levels)


def links(nodes: DataFrame, *, radius: int, inner: int = INNER) -> DataFrame:
    """Links (src, dst) that span the sets of fingerprints ``fp`` (distinct) within ``radius`` bits of each other."""
    n = nodes.count()
    tile = min(MOST_TILE, max(LEAST_TILE, -(-n // TILES)))
    tiles, path = stored_at(_tiles(nodes, max(1, -(-n // tile)), 2 * tile, radius, inner), "tiles")
    # Tiles meet at each population count that the one has and the other has within the radius; a pair is kept at the least of these.
    seen = tiles.select("tile", "box", F.explode(F.sequence("low", "high")).alias("c"))
    wide = tiles.select(F.col("tile").alias("other"), F.col("box").alias("far"), F.explode(F.sequence(F.col("low") - radius, F.col("high") + radius)).alias("c"))
    met = seen.join(wide, "c").where((F.col("tile") < F.col("other")) & (_tile_gap(F.col("box"), F.col("far")) <= radius)).select("tile", "other").distinct()
    turned = F.xxhash64("tile", "other") % 2 == 0  # else the last tiles would meet the most
    met = met.select(F.when(turned, F.col("other")).otherwise(F.col("tile")).alias("tile"), F.when(turned, F.col("tile")).otherwise(F.col("other")).alias("other"))
    left = tiles.select("tile", "fps", "roots")
    right = tiles.select(F.col("tile").alias("other"), F.col("fps").alias("fps2"), F.col("roots").alias("roots2"))
    paired = met.join(left, "tile").join(right, "other").select("fps", "roots", "fps2", "roots2")

    def spans(fp, before, root):
        """Links from each node to its set's least one, for those that were in another set before."""
        i = np.flatnonzero(root != before)
        return pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[root[i]].view(np.int64))], ["src", "dst"])

    def across(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                a, ra, b, rb = (np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in enumerate((_U, np.int32, _U, np.int32)))
                before = np.concatenate([ra, rb + len(a)]).astype(np.int32)
                root = before.copy()
                compare(a, b, radius, root, inner)
                yield spans(np.concatenate([a, b]), before, root)

    def inside(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                fp, root = (np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in enumerate((_U, np.int32)))
                yield spans(fp, np.arange(len(fp), dtype=np.int32), root)

    kind = "src long, dst long"
    found, own = stored_at(paired.mapInArrow(across, kind).unionAll(tiles.select("fps", "roots").mapInArrow(inside, kind)), "links")
    dropped(nodes.sparkSession, path)
    return found


def simhash_components(docs: DataFrame, *, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits) and component_id, the least id reachable by links of at most ``radius`` bits.

    Null and empty texts, and those of white space, have fingerprint 0 and link like any other. Fewer words than a shingle has: all of
    them are one. Repeated rows and ids are a row each. A null id never is the least one; a component of null ids has a null id. An empty
    table gives no rows. Ids are of any type that has an order; columns besides the two are ignored, whatever their names.
    """
    spark = docs.sparkSession
    marked, path = stored_at(fingerprints(docs, id_col=id_col, text_col=text_col).withColumnRenamed(id_col, "id"), "fingerprinted")
    nodes, held = stored_at(marked.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    labels = components(links(nodes.select("fp"), radius=radius))
    classed = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    # Few fingerprints share a label but in groups of near copies; a label's minimum is combined before it travels.
    least = classed.groupBy("label").agg(F.min("least").alias("component_id"))
    named = classed.join(least, "label").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
