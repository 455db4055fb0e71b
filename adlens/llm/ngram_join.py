"""N-gram Jaccard join on a prefix tree, and the components of its links.

0. Two fifths of all n-grams, by hash, are counted. A document of which too few of these are in a second document has no partner.
1. The set of word n-grams of each one left is ordered by document frequency, rarest first, with ties by hash. Two sets can only be as
   similar as asked if they share an n-gram of their prefixes, so a document whose prefix holds n-grams of its own alone has
   no partner.
2. Documents that share a prefix n-gram, neighbours by size in its list, are joined into candidate groups: as many edges as list
   entries, never pairs.
3. Each group's sets go, once each, to one task, which stores them in a prefix tree (a compressed trie in the global order). A set is
   looked up by walking the tree: sets below a node share the overlap counted so far, and a subtree is left when its
   remaining length, or that of the looked-up set, can't reach the overlap that its sizes need.
4. A group over ``block`` sets is cut into blocks; each pair of blocks is a task. Tasks return a spanning forest of their links, so
   links that only repeat a connection are not sent.

Equal sets, by 128 bits of hash and their size, are one class from the start. N-grams are compared by 64-bit hashes, of which 48 find candidates.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _repeats as R
from ._bytes import NOT_SPACE, mix, owner, prefix, slices, word_hashes, words
from ._graph import components
from ._store import stored

_U = np.uint64
CLASS, POSTING, SET = 10, 11, 12
#: N-grams whose hash is below this, two fifths of all, decide which documents can have a partner.
SAMPLE = _U(2**64 * 2 // 5)
SECOND = 0x5851F42D4C957F2D


class Shingles:
    """Symbols of a text for ``_repeats``: the sorted distinct n-gram hashes of each document."""

    def __init__(self, n: int):
        self.n = n

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, at = words(data, offsets, NOT_SPACE)
        docs = len(at) - 1
        sums = prefix(word_hashes(data, starts, ends, lower=True))
        count = np.diff(at)
        whole = np.minimum(count, self.n)  # a text of fewer words is one n-gram
        n_grams = np.where(count > 0, count - whole + 1, 0)
        doc = np.repeat(np.arange(docs), n_grams)
        begin = np.arange(n_grams.sum()) - np.repeat(np.cumsum(n_grams) - n_grams, n_grams) + at[doc]
        h = slices(sums, begin, begin + whole[doc])
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        return h, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=docs))]).astype(np.int64)


def prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    """So many of the first n-grams of a set meet those of any set that is similar enough."""
    return size - -(-percent * size // 100) + 1


def need(a, b, percent: int):
    """Least overlap of sets of sizes ``a`` and ``b`` with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


class PrefixTree:
    """A compressed trie of sorted rank arrays."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        keys = [s.astype(">u4").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets = [sets[i] for i in self.order]
        self.size = np.array([len(s) for s in self.sets])
        lcp = [0]
        for a, b in zip(self.sets, self.sets[1:]):
            n = min(len(a), len(b))
            d = np.flatnonzero(a[:n] != b[:n])
            lcp.append(int(d[0]) if len(d) else n)
        self.lcp = np.array(lcp)
        #: By node: first and end of its sets, depth where its segment begins and ends, first of its children and their places.
        self.nodes: list[tuple[int, int, int, int, np.ndarray | None, int]] = []
        self._build()
        first: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            for t in s[: int(prefix_length(np.int64(len(s)), percent))].tolist() if len(s) else []:
                first.setdefault(t, []).append(i)
        self.lists = {t: np.array(v) for t, v in first.items() if len(v) > 1}

    def _build(self) -> None:
        work = [(0, len(self.sets), 0, -1)]
        at = 0
        self.nodes = [None]  # type: ignore[list-item]
        while at < len(work):
            lo, hi, begin, _ = work[at]
            end = int(self.lcp[lo + 1 : hi].min()) if hi - lo > 1 else int(self.size[lo])
            kids, first = None, 0
            if hi - lo > 1:
                cut = lo + 1 + np.flatnonzero(self.lcp[lo + 1 : hi] == end)
                kids = np.concatenate([[lo], cut])
                first = len(work)
                for a, b in zip(kids.tolist(), [*kids[1:].tolist(), hi], strict=True):
                    work.append((a, b, end, at))
                    self.nodes.append(None)  # type: ignore[arg-type]
            self.nodes[at] = (lo, hi, begin, end, kids, first)
            at += 1

    def similar(self, x: np.ndarray, mark: np.ndarray, open_: np.ndarray) -> list[int]:
        """Places in order of the sets among ``open_`` that are similar to ``x``; ``mark`` is true at x's ranks."""
        lists = [self.lists[t] for t in x[: int(prefix_length(np.int64(len(x)), self.percent))].tolist() if t in self.lists]
        if not lists:
            return []
        near = np.unique(np.concatenate(lists))
        n = len(x)
        sizes = self.size[near]
        near = near[open_[near] & (100 * sizes >= self.percent * n) & (100 * n >= self.percent * sizes)]
        out: list[int] = []
        stack = [(0, near, 0)] if len(near) else []
        while stack:
            node, near, overlap = stack.pop()
            lo, hi, begin, end, kids, first = self.nodes[node]
            if end > begin:
                segment = self.sets[lo][begin:end]
                overlap += int(np.count_nonzero(mark[segment]))
                left = n - int(np.searchsorted(x, segment[-1], "right"))
                sizes = self.size[near]
                if overlap + min(left, int(sizes.max()) - end) < need(n, int(sizes.min()), self.percent):
                    continue
            if kids is None:
                if overlap >= need(n, int(self.size[lo]), self.percent):
                    out.append(lo)
                continue
            child = np.searchsorted(kids, near, "right") - 1
            edge = np.flatnonzero(np.concatenate([[True], child[1:] != child[:-1]]))
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(near)], strict=True):
                stack.append((first + int(child[a]), near[a:b], overlap))
        return out


def spanning_links(sets: list[np.ndarray], ranks: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs: each set found is looked up once, among those not reached yet."""
    tree = PrefixTree(sets, percent)
    mark = np.zeros(ranks, bool)
    open_ = np.ones(len(sets), bool)
    links = []
    for root in range(len(sets)):
        if not open_[root]:
            continue
        open_[root] = False
        queue = [root]
        while queue:
            i = queue.pop()
            x = tree.sets[i]
            mark[x] = True
            found = tree.similar(x, mark, open_)
            mark[x] = False
            for j in found:
                open_[j] = False
                links.append((tree.order[i], tree.order[j]))
            queue += found
    return links


def _signature(h: np.ndarray, at: np.ndarray, salt: int = 0) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(h ^ _U(salt)), dtype=_U)])
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(_U)).view(np.int64)


def ngram_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, block: int = 2048) -> DataFrame:
    """One row per input row: id, n_shingles long, component_id.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a set has the distinct ``n``-word sequences, for fewer words the whole one.
    Two documents link when 100 * intersection >= ``percent`` * union; ``component_id`` is the least id that links reach. Null,
    empty and wordless texts have empty sets and link with nothing. Null ids come last and get the least other id of
    their component, or null. Rows that repeat an id with the same text are one document.
    """
    shingles = Shingles(n)
    plan = R.Plan(docs, shingles, width=1, k=1, id_col=id_col, text_col=text_col)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in R.parts(big, "text", R.PART_BYTES):
                h, at = shingles(*R.flat(batch.column("text")))
                tag = batch.column("tag")
                size = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rank"), tag, pa.array(_signature(h, at)), pa.array(_signature(h, at, SECOND)), pa.array(size)], ["rank", "tag", "sig", "sig2", "n"]
                )

    rows = stored(plan.base.mapInArrow(describe, "rank long, tag long, sig long, sig2 long, n long"), "shingled")
    # Of a class of equal sets only the least document looks for partners. The class's number is fixed by being written.
    classes = rows.where("n > 0").groupBy("sig", "sig2", "n").agg(F.min(F.struct("rank", "tag")).alias("least"))
    reps = stored(classes.select(F.monotonically_increasing_id().alias("node"), "least.rank", "least.tag", "sig", "sig2", "n"), "classes")

    def flushed(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        h, rank, tag, *more = (np.concatenate(x) for x in zip(*held, strict=True))
        which, one = R.documents(rank, tag)
        rank, tag = rank[one], tag[one]
        place, blobs = [], []
        for p, i in R._split(plan.owner(h), order=np.argsort(h)):
            place.append(p)
            blobs.append(R.pack(np.diff(h[i], prepend=_U(0)), *R.listed(which[i], rank, tag), *(x[i] for x in more)))
        return R._rows(place, R.ANCHOR, blobs)

    def gathered(found: Iterator[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for arrays in found:
            held.append(arrays)
            if sum(len(x[0]) for x in held) >= 2 * R.HELD_RECORDS:
                yield flushed(held)
                held = []
        if any(len(x[0]) for x in held):
            yield flushed(held)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (owner, ANCHOR, blob of n-grams' differences, documents) of the n-grams whose hash is in the sample."""

        def found() -> Iterator[list[np.ndarray]]:
            for big in batches:
                for batch in R.parts(big, "text", R.PART_BYTES):
                    h, at = shingles(*R.flat(batch.column("text")))
                    rank, tag = batch.column("rank").to_numpy(), batch.column("tag").to_numpy()
                    # Of equal sets in a batch the one of the least document is counted: no other can represent them.
                    by_rank = np.lexsort((tag, rank))
                    keep = np.zeros(batch.num_rows, bool)
                    keep[by_rank[np.unique(_signature(h, at)[by_rank], return_index=True)[1]]] = True
                    doc = owner(at)
                    use = keep[doc] & (h < SAMPLE)
                    yield [mix(h[use]) & R.KEPT_ANCHOR, rank[doc[use]], tag[doc[use]]]  # mixed: the sample is a range of hashes

        return gathered(found())

    def shared_counts(table: pa.Table) -> pa.Table:
        """Rows (bin, VERDICT, blob of ranks, tags and numbers of sampled n-grams that more than one document has)."""
        found = R._by_what(table, R.ANCHOR)
        h = np.concatenate([np.zeros(0, _U), *(np.cumsum(x[0], dtype=_U) for x in found)])
        doc, ranks, tags = R.unlisted(found, 1)
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        same = h[1:] == h[:-1]
        many = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(h) else np.zeros(0, bool)
        count = np.bincount(doc[many], minlength=len(ranks))
        some = np.flatnonzero(count)
        place, blobs = [], []
        for p, i in R._split(plan.bin(tags[some])):
            i = some[i]
            place.append(p)
            blobs.append(R.pack(np.diff(ranks[i], prepend=np.int64(0)), tags[i], count[i].astype(np.uint32)))
        return pa.table([pa.array(place, pa.int32()), pa.array([R.VERDICT] * len(place), pa.int32()), pa.array(blobs, pa.binary())], names=["place", "what", "blob"])

    def survivors(table: pa.Table) -> pa.Table:
        """One packed row of the bin's class representatives that may have a partner, with their class numbers as ranks.

        A partner lacks at most size - ceil(size * percent / 100) of a set's n-grams, so of the sampled ones all but so many are
        in a second document.
        """
        here = R.Bin(table, plan)
        found = R._by_what(table, R.VERDICT)
        rank = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(x[0]) for x in found)])
        tag = np.concatenate([np.zeros(0, np.int64), *(x[1] for x in found)])
        count = np.concatenate([np.zeros(0, np.uint32), *(x[2] for x in found)])
        shared = np.zeros(len(here.tag), np.int64)
        record, doc = here.rows(rank, tag)
        np.add.at(shared, doc, count[record])
        size = np.diff(here.at)
        in_sample = np.bincount(owner(here.at), here.symbols < SAMPLE, len(size)).astype(np.int64) if len(size) else size
        rank, tag, number = (np.concatenate([np.zeros(0, np.int64), *(x[c] for x in R._by_what(table, CLASS))]) for c in range(3))
        record, doc = here.rows(rank, tag)
        node = np.full(len(size), -1)
        node[doc] = number[record]
        first = np.zeros(len(size), bool)
        first[R.documents(here.rank, here.tag)[1]] = True  # of rows that repeat id and text, one
        keep = np.flatnonzero(first & (node >= 0) & (size > 0) & (shared >= in_sample - (prefix_length(size, percent) - 1)))
        texts = [here.data[here.offsets[d] : here.offsets[d + 1]] for d in keep.tolist()]
        blob = R.pack(node[keep], here.tag[keep], np.diff(here.offsets)[keep], np.concatenate([np.zeros(0, np.uint8), *texts]), level=3)
        return R._rows_table([int(table.column("place")[0].as_py())] if len(keep) else [], R.DOCS, [blob] if len(keep) else [])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (owner, ANCHOR, blob of n-grams' differences, documents, place in the set) of packed documents."""

        def found() -> Iterator[list[np.ndarray]]:
            for batch in batches:
                for blob in batch.column("blob").to_pylist():
                    node, tag, sizes, data = R.unpack(blob)
                    h, at = shingles(data, np.concatenate([[0], np.cumsum(sizes)]))
                    doc = owner(at)
                    yield [h & R.KEPT_ANCHOR, node[doc], tag[doc], (np.arange(len(h)) - at[doc]).astype(np.uint32)]

        return gathered(found())

    def frequencies(table: pa.Table) -> pa.Table:
        """Rows (bin, VERDICT, blob of documents, place, frequency) of n-grams that more than one document has."""
        found = R._by_what(table, R.ANCHOR)
        h = np.concatenate([np.zeros(0, _U), *(np.cumsum(x[0], dtype=_U) for x in found)])
        doc, nodes, tags = R.unlisted(found, 1)
        where = np.concatenate([np.zeros(0, np.uint32), *(x[4] for x in found)])
        order = np.argsort(h, kind="stable")
        new = np.ones(len(h), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        count = np.diff(np.append(np.flatnonzero(new), len(h)))
        df = np.empty(len(h), np.uint32)
        df[order] = np.repeat(count, count)
        many = np.flatnonzero(df > 1)
        place, blobs = [], []
        for p, i in R._split(plan.bin(tags[doc[many]]), (where[many], doc[many])):
            i = many[i]
            place.append(p)
            blobs.append(R.pack(*R.listed(doc[i], nodes, tags), where[i], df[i]))
        return pa.table([pa.array(place, pa.int32()), pa.array([R.VERDICT] * len(place), pa.int32()), pa.array(blobs, pa.binary())], names=["place", "what", "blob"])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, tag, node = (batch.column(c).to_numpy() for c in ("rank", "tag", "node"))
            place, blobs = [], []
            for p, i in R._split(plan.bin(tag)):
                place.append(p)
                blobs.append(R.pack(rank[i], tag[i], node[i]))
            yield R._rows(place, CLASS, blobs)

    def order_sets(table: pa.Table) -> pa.Table:
        """Rows POSTING (owner: n-gram, size, node) and SET (node: n-grams in order, frequencies) of documents that may have partners."""
        here = R.Bin(table, plan)
        found = R._by_what(table, R.VERDICT)
        of, nodes, tags = R.unlisted(found)
        where = np.concatenate([np.zeros(0, np.int64), *(x[3] for x in found)]).astype(np.int64)
        count = np.concatenate([np.zeros(0, np.int64), *(x[4] for x in found)])
        df = np.ones(len(here.symbols), np.int64)
        record, doc = here.rows(nodes[of], tags[of])
        df[here.at[doc] + where[record]] = count[record]
        size = np.diff(here.at)
        shared = np.concatenate([[0], np.cumsum(df > 1)])
        out = {"place": [], "what": [], "node": [], "blob": []}
        posts: list[list[np.ndarray]] = []
        for d in range(len(size)):
            a, b = int(here.at[d]), int(here.at[d + 1])
            alone = size[d] - int(shared[b] - shared[a])
            p = int(prefix_length(size[d], percent))
            if not size[d] or alone >= p:
                continue
            h, f = here.symbols[a:b], df[a:b]
            o = np.lexsort((h, f))
            h, f = h[o], f[o]
            use = h[:p][f[:p] > 1]
            posts.append([use, np.full(len(use), size[d]), np.full(len(use), here.rank[d])])
            out["place"].append(0)
            out["what"].append(SET)
            out["node"].append(int(here.rank[d]))
            out["blob"].append(R.pack(h, f.astype(np.uint32)))
        if posts:
            h, s, t = (np.concatenate(x) for x in zip(*posts, strict=True))
            for p, i in R._split(plan.owner(h), (h,)):
                out["place"].append(p)
                out["what"].append(POSTING)
                out["node"].append(0)
                out["blob"].append(R.pack(h[i], s[i].astype(np.uint32), t[i]))
        return pa.table([pa.array(out["place"], pa.int32()), pa.array(out["what"], pa.int32()), pa.array(out["node"], pa.int64()), pa.array(out["blob"], pa.binary())], names=["place", "what", "node", "blob"])

    def neighbours(table: pa.Table) -> pa.Table:
        """Edges between neighbours by size in each n-gram's list, unless the larger is too large for any pair across them."""
        found = [R.unpack(x) for x in table.column("blob").to_pylist()]
        h, s, t = (np.concatenate(x) for x in zip(*found, strict=True))
        o = np.lexsort((t, s, h))
        h, s, t = h[o], s[o].astype(np.int64), t[o]
        ok = (h[1:] == h[:-1]) & (100 * s[:-1] >= percent * s[1:])
        pairs = np.unique(np.stack([t[:-1][ok], t[1:][ok]]), axis=1)
        return pa.table([pa.array(pairs[0]), pa.array(pairs[1])], names=["src", "dst"])

    counted = plan.base.mapInArrow(sampled, R.PACKED).groupBy("place").applyInArrow(shared_counts, R.PACKED)
    left = stored(R.packed_docs(plan).unionAll(counted).unionAll(reps.select("rank", "tag", "node").mapInArrow(chosen, R.PACKED)).groupBy("place").applyInArrow(survivors, R.PACKED), "survivors")
    freq = left.unionAll(left.mapInArrow(tokens, R.PACKED).groupBy("place").applyInArrow(frequencies, R.PACKED))
    ordered = stored(freq.groupBy("place").applyInArrow(order_sets, "place int, what int, node long, blob binary"), "ordered")
    edges = ordered.where(F.col("what") == POSTING).select("place", "blob").groupBy("place").applyInArrow(neighbours, "src long, dst long")
    groups = stored(components(edges), "groups")

    # Groups to tasks: small ones together, large ones as pairs of blocks.
    sizes = groups.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    blocks = F.ceil(F.col("members") / block)
    sets = ordered.where(F.col("what") == SET).select("node", "blob")
    member = sets.join(groups, "node").join(sizes, "label")
    mine = F.pmod(F.xxhash64("node", F.lit(1)), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    spread = member.withColumn("mine", mine).withColumn("other", other)
    spread = spread.select("node", "blob", "label", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "members")
    tasks = spread.withColumn("task", F.pmod(F.xxhash64("label", "i", "j"), F.lit(4 * plan.bins))).select("task", "label", "i", "j", "node", "blob")

    def join(table: pa.Table) -> pa.Table:
        label, i, j, node = (table.column(c).to_numpy() for c in ("label", "i", "j", "node"))
        blob = table.column("blob")
        src, dst = [], []
        order = np.lexsort((node, j, i, label))
        key = np.stack([label, i, j])[:, order]
        edge = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(order)], strict=True):
            rows_ = order[a:b]
            if len(rows_) < 2:
                continue
            found = [R.unpack(blob[int(r)].as_py()) for r in rows_]
            h, f = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
            values, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            rank = np.empty(len(values), np.int64)
            rank[np.lexsort((values, f[first]))] = np.arange(len(values))
            ranks = rank[inverse]
            ends = np.cumsum([len(x[0]) for x in found])
            local = [np.sort(x) for x in np.split(ranks, ends[:-1])]
            for x, y in spanning_links(local, len(values), percent):
                src.append(int(node[rows_[x]]))
                dst.append(int(node[rows_[y]]))
        return pa.table([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    links = tasks.groupBy("task").applyInArrow(join, "src long, dst long")
    labels = components(links)
    by_class = reps.join(labels, "node", "left").select("sig", "sig2", "n", F.coalesce("label", "node").alias("label"))
    all_rows = rows.join(by_class, ["sig", "sig2", "n"], "left")
    least = all_rows.where("n > 0").groupBy("label").agg(F.min("rank").alias("least"))
    out = all_rows.join(least, "label", "left")
    kind = docs.schema[id_col].dataType
    plain = lambda c: F.nullif(c, F.lit(R.LAST)).cast(kind)
    return out.select(plain(F.col("rank")).alias(id_col), F.col("n").alias("n_shingles"), plain(F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("rank"))).alias("component_id"))
