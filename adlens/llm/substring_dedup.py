"""Substring deduplication by words over a log-structured fingerprint index.

Every window of ``width`` words has a fingerprint, 48 bits of a rolling hash, and 32 bits of an independent second hash to verify
it. The index is a folder of immutable runs, each sorted by fingerprint within ranges of fingerprints. For a batch of documents,
the owner of a range sorts the batch's fingerprints, merge-joins them with the runs of earlier batches, and writes what is new
as the next run. Before a batch, ``compact`` merges runs of like sizes. A manifest names the runs; it is replaced as a whole, so an index can be
opened again by any driver and what a lost job left behind is never read.

Of a window that several documents of a task have, only the least document's record is sent to the owner. The others repeat
already and are dealt over all owners on their way to their bins, so a passage in a large share of all documents costs its
owner one record a task.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _repeats as R
from ._bytes import NOT_SPACE, flat, parts, prefix, slices, word_hashes, words
from ._store import dropped, file_system, released, shared_dir

_U = np.uint64
#: Windows that a task gathers before it packs them.
HELD_WINDOWS = 1 << 19


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, at = words(data, offsets, NOT_SPACE)
    return word_hashes(data, starts, ends, lower=False), at


def _owner(f: np.ndarray, owners: int) -> np.ndarray:
    return ((f >> _U(16)) * _U(owners) >> _U(32)).astype(np.int64)


def _sorted(f: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by fingerprint, equal pairs together, and which of the ordered ones differ from the one before."""
    order = np.argsort(f)
    new, other = np.ones(len(f), bool), np.zeros(len(f), bool)
    new[1:] = f[order][1:] != f[order][:-1]
    other[1:] = v[order][1:] != v[order][:-1]
    if (other & ~new).any():
        order = np.lexsort((v, f))
        new[1:] = f[order][1:] != f[order][:-1]
        other[1:] = v[order][1:] != v[order][:-1]
    return order, new | other


def windows(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint and second hash of each window of ``width`` words, its document and its first word's number in it."""
    starts, ends, at = words(data, offsets, NOT_SPACE)
    count = np.maximum(np.diff(at) - width + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = at[doc] + inside
    f = slices(prefix(word_hashes(data, starts, ends, lower=False)), begin, begin + width)
    v = slices(prefix(word_hashes(data, starts, ends, lower=False, seed=2), 2), begin, begin + width, 2)
    return f >> _U(16), (v >> _U(32)).astype(np.uint32), doc, inside.astype(np.uint32)


class FingerprintIndex:
    """The index in the folder ``path``, as its last manifest says; a folder without one is an empty index."""

    def __init__(self, spark: SparkSession, path: str, width: int = 50):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs, where = file_system(spark, self.path)
        found = [f.getPath().getName() for f in self.fs.listStatus(where)] if self.fs.exists(where) else []
        versions = sorted(x for x in found if x.startswith("manifest-"))
        if versions:
            self.state = json.loads(spark.read.text(f"{self.path}/{versions[-1]}", wholetext=True).first()[0])
            if self.state["width"] != width:
                raise ValueError(f"the index has windows of {self.state['width']} words")
        else:
            self.state = {"version": 0, "width": width, "bytes": 0, "runs": [], "batches": {}}

    def _commit(self, **changes) -> None:
        state = {**self.state, **changes, "version": self.state["version"] + 1}
        name = f"{self.path}/manifest-{state['version']:09d}.json"
        made, final = (self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x) for x in (f"{self.path}/new-{uuid.uuid4().hex}", name))
        out = self.fs.create(made)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self.fs.rename(made, final):
            raise RuntimeError(f"another writer has made {name}")
        self.state = state

    def _table(self, path: str, what: int) -> DataFrame:
        rows = self.spark.read.schema("place int, blob binary").parquet(f"{self.path}/{path}")
        return rows.select("place", F.lit(what).alias("what"), "blob")

    def history(self, owners: int, runs: list[dict] | None = None) -> DataFrame | None:
        """The runs, all if none are named, as rows (owner, RUN, blob of fingerprint differences and second hashes) for this many owners."""

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column("blob").to_pylist():
                    f, v = R.unpack(blob)
                    f = np.cumsum(f, dtype=_U)
                    place, blobs = [], []
                    for p, i in R._split(_owner(f, owners), order=np.arange(len(f))):
                        place.append(p)
                        blobs.append(R.pack(np.diff(f[i], prepend=_U(0)), v[i]))
                    yield R._rows(place, R.RUN, blobs)

        out = None
        for run in self.state["runs"] if runs is None else runs:
            rows = self._table(run["path"], R.RUN)
            rows = rows if run["owners"] == owners else rows.mapInArrow(split, R.PACKED)
            out = rows if out is None else out.unionAll(rows)
        return out

    def add(self, plan: R.Plan, size: int, batch: str) -> DataFrame:
        """Judge the plan's documents against the index, compacted before, and add them to it as a run. Rows (bin, VERDICT, blob) of windows that repeat.

        A batch that the index has under this name already gets the verdicts of then.
        """
        known = self.state["batches"].get(batch)
        if known is None:
            self.compact()
            released(self.spark)
            owners = 64
            while owners * R.OWNER_BYTES < self.state["bytes"] + size:
                owners *= 2
            sent = _sent(plan, self.state["width"], owners)
            history = self.history(owners)
            judged = sent if history is None else sent.unionAll(history)
            name = f"batch-{uuid.uuid4().hex}"
            judged.groupBy("place").applyInArrow(_judge(plan), R.PACKED).write.partitionBy("what").parquet(f"{self.path}/{name}")
            run, found = (f"{name}/what={k}" for k in (R.RUN, R.VERDICT))
            has = lambda x: self.fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}"))
            runs = self.state["runs"] + ([{"path": run, "owners": owners, "batches": 1}] if has(run) else [])
            known = {"verdicts": found if has(found) else "", "bins": plan.bins}
            self._commit(runs=runs, bytes=self.state["bytes"] + size, batches={**self.state["batches"], batch: known})
            del sent, history, judged
        if known["bins"] != plan.bins:
            raise ValueError(f"batch {batch} was another one when it was added")
        return self._table(known["verdicts"], R.VERDICT) if known["verdicts"] else self.spark.createDataFrame([], R.PACKED)

    def compact(self, all_runs: bool = False) -> None:
        """Merge the last two runs while the older has no more than twice the batches of the newer, or all runs into one.

        So a window is rewritten about as often as the number of batches has binary digits, and few runs are left to join with.
        """
        while len(runs := self.state["runs"]) > 1 and (all_runs or runs[-2]["batches"] <= 2 * runs[-1]["batches"]):
            released(self.spark)
            kept, merged = ([], runs) if all_runs else (runs[:-2], runs[-2:])
            owners, name = max(r["owners"] for r in merged), f"run-{uuid.uuid4().hex}"
            self.history(owners, merged).groupBy("place").applyInArrow(_merged, R.PACKED).select("place", "blob").write.parquet(f"{self.path}/{name}")
            self._commit(runs=[*kept, {"path": name, "owners": owners, "batches": sum(r["batches"] for r in merged)}])
            for run in merged:
                dropped(self.spark, f"{self.path}/{run['path']}")


def _runs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    found = R._by_what(table, R.RUN)
    f = np.concatenate([np.zeros(0, _U), *(np.cumsum(x[0], dtype=_U) for x in found)])
    return f, np.concatenate([np.zeros(0, np.uint32), *(x[1] for x in found)])


def _merged(table: pa.Table) -> pa.Table:
    f, v = _runs(table)
    order, new = _sorted(f, v)
    i = order[new]
    return R._rows_table([int(table.column("place")[0].as_py())], R.RUN, [R.pack(np.diff(f[i], prepend=_U(0)), v[i])])


def _sent(plan: R.Plan, width: int, owners: int) -> DataFrame:
    """Rows (owner, ANCHOR, blob of fingerprint differences, second hashes, documents, first words) and (any owner, DONE, documents, first words)."""

    def flush(held: list[list[np.ndarray]], ids: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        f, v, d, at = (np.concatenate(x) for x in zip(*held, strict=True))
        rank, tag = (np.concatenate(x) for x in zip(*ids, strict=True))
        order, new = _sorted(f, v)
        least = np.minimum.reduceat(rank[d[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
        again = rank[d[order]] > least
        done, order = order[again], order[~again]
        if len(done):
            yield R._rows([int(f[done[0]] % _U(owners))], R.DONE, [R.pack(*R.listed(d[done], rank, tag), at[done])])
        place, blobs = [], []
        for p, i in R._split(_owner(f, owners), order=order):
            place.append(p)
            blobs.append(R.pack(np.diff(f[i], prepend=_U(0)), v[i], *R.listed(d[i], rank, tag), at[i]))
        yield R._rows(place, R.ANCHOR, blobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        ids: list[list[np.ndarray]] = []
        size = docs = 0
        for big in batches:
            for batch in parts(big, "text", R.PART_BYTES):
                f, v, doc, at = windows(*flat(batch.column("text")), width)
                held.append([f, v, docs + doc, at])
                ids.append([batch.column("rank").to_numpy(), batch.column("tag").to_numpy()])
                size, docs = size + len(f), docs + batch.num_rows
                if size >= HELD_WINDOWS:
                    yield from flush(held, ids)
                    held, ids, size, docs = [], [], 0, 0
        if size:
            yield from flush(held, ids)

    return plan.base.mapInArrow(run, R.PACKED)


def _judge(plan: R.Plan):
    def run(table: pa.Table) -> pa.Table:
        found, done = R._by_what(table, R.ANCHOR), R._by_what(table, R.DONE)
        old_f, old_v = _runs(table)
        f = np.concatenate([*(np.cumsum(x[0], dtype=_U) for x in found), old_f])
        v = np.concatenate([*(x[1] for x in found), old_v])
        doc, ranks, tags = R.unlisted([x[2:5] for x in found] + [x[:3] for x in done])
        start = np.concatenate([np.zeros(0, np.uint32), *(x[5] for x in found), *(x[3] for x in done)])
        n = len(f) - len(old_f)
        # The index's documents come before any of the batch, whatever their ids.
        order, new = _sorted(f, v)
        edge, group = np.flatnonzero(new), np.cumsum(new) - 1
        old = order >= n
        known = np.logical_or.reduceat(old, edge) if len(edge) else old
        rank = np.full(len(f), R.LAST)
        rank[:n] = ranks[doc[:n]]
        least = np.minimum.reduceat(rank[order], edge) if len(edge) else rank
        again = order[~old & (known[group] | (rank[order] > least[group]))]
        fresh = order[edge[~known]]
        chosen = np.concatenate([again, np.arange(n, len(doc))])
        out = R.answers(plan, doc[chosen], ranks, tags, start[chosen])
        here = [int(table.column("place")[0].as_py())] if len(fresh) else []
        return pa.concat_tables([out, R._rows_table(here, R.RUN, [R.pack(np.diff(f[fresh], prepend=_U(0)), v[fresh])] if here else [])])

    return run


def dedup(docs: DataFrame, index: FingerprintIndex | None = None, *, id_col: str = "doc_id", text_col: str = "text", width: int = 50, batches: int = 1, name: str = "") -> DataFrame:
    """One row per input row: id, n_words long, n_removed long, kept string.

    Words are ``[^\\x20\\x09-\\x0D]+``. A word goes if a window of ``width`` words covers it whose words also start in a document of
    the index, or in one of ``docs`` with a smaller id; windows are judged on the input. ``kept`` is what is left, joined by
    one space. Null and wordless texts keep nothing; null ids come last. Rows that repeat an id don't remove each other's
    words. An empty table gives no rows and leaves the index as it was but for a batch; columns besides the two are ignored.

    ``docs`` enters the index, in this call, in ``batches`` ranges of ids of about equal numbers of rows. Under a ``name`` the call can be repeated after a failure: batches that were added
    keep their verdicts. Without an index a new one in the shared folder is used.
    """
    spark = docs.sparkSession
    plan = R.Plan(docs, word_symbols, width=width, k=1, id_col=id_col, text_col=text_col)
    index = index or FingerprintIndex(spark, f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex}", width)
    name = name or uuid.uuid4().hex
    share = [i / batches for i in range(1, batches)]
    cuts = sorted(set(plan.base.agg(F.percentile_approx("rank", share, 10_000)).first()[0] or [])) if share else []
    found = None
    for k, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        mine = index.add(plan.between(low, high), plan.size // (len(cuts) + 1), f"{name}-{k}")
        found = mine if found is None else found.unionAll(mine)
    released(spark)

    def finish(table: pa.Table) -> pa.Table:
        here = R.Bin(table, plan)
        starts, ends, at = words(here.data, here.offsets, NOT_SPACE)
        gone = R.covered(here, table, width)
        keep = ~gone
        # What is kept: the kept words' bytes, each with a space after it.
        size = np.where(keep, ends - starts + 1, 0)
        total = int(size.sum())
        begin = np.cumsum(size) - size
        from_ = np.arange(total) + np.repeat(starts - begin, size)
        out = np.append(here.data, np.uint8(32))[from_]
        tail = (begin + size - 1)[keep]
        out[tail] = 32
        edge = np.concatenate([[0], np.cumsum(size)])[at]
        whole = out.tobytes()
        n_removed = np.concatenate([[0], np.cumsum(gone)])
        kept = [whole[edge[i] : max(edge[i], edge[i + 1] - 1)].decode() for i in range(len(here.rank))]
        ids = pa.array(here.rank, pa.int64(), mask=here.rank == R.LAST)
        return pa.table([ids, pa.array(np.diff(at), pa.int64()), pa.array(n_removed[at[1:]] - n_removed[at[:-1]], pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    kind = docs.schema[id_col].dataType
    out = R.packed_docs(plan).unionAll(found).groupBy("place").applyInArrow(finish, "id long, n_words long, n_removed long, kept string")
    return out.select(F.col("id").cast(kind).alias(id_col), "n_words", "n_removed", "kept")
