"""Conversation structure repair: cheapest edits by a cost recursion, and of these the least audit by prefix doubling.

A conversation is a layered graph. A node is a row's place and what stands before it (nothing, a system row, a user row, an assistant row); arcs are edits of the row
(Delete, Keep, Rerole), or an Insert within the layer.

1. ``cost_to_go`` gives each node's least cost to an end, from the last layer to the first, for all conversations of a chunk at once.
2. Optimal arcs are those on a cheapest path. ``least_paths`` ranks nodes by the labels of their least optimal paths of 1, 2, 4, ... edits: a
   rank and a pointer to where those edits lead give the rank of twice the length. An arc is chosen by its label and its target's rank; the start's path is read through the doubled
   pointers.

Conversations of many rows or bytes are cut into segments in the order of their rows, over any number of tasks. A segment's costs from each way in to
each way out are a matrix of 4 by 4; its conversation's matrices, one a segment, give the costs behind each segment, and what its edits are.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import bounded_batches, dropped, stored_at

START, SYSTEM, USER, ASSISTANT = range(4)
#: Fixed costs, and labels in ASCII order.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
D, I, K, R = range(4)
FAR = np.int64(1) << 40
#: State after a row of each role (system, user, assistant, other) is kept in each state; -1 where it can't be.
_KEPT = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1, -1, -1, -1]])
#: State after an inserted or rewritten row.
_PUT = np.array([USER, USER, ASSISTANT, USER])
#: Bits of a row's code beside its role: it must be deleted, and it is truncated.
MUST, CUT = 4, 8
#: Pairs of roles (first * 4 + second) that may follow each other.
_LEGAL = np.zeros(16, bool)
_LEGAL[[0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]] = True
#: A conversation of more rows or bytes is cut into segments of 2 ** ``SEGMENT_BITS`` rows; rows, or thousands of characters, of a chunk.
MOST_ROWS, MOST_BYTES, SEGMENT_BITS, CHUNK = 1 << 15, 32 << 20, 14, 1 << 13
SPACE = r"\x20\x09-\x0D"
_ENDED = np.array([0, FAR, FAR, 0])


def _row_costs(code: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs (row, state, label) of each edit of rows, with what comes after; inserts are left at FAR."""
    n = len(code)
    out = np.full((n, 4, 4), FAR)
    out[:, :, D] = DELETE + after
    free = (code & MUST) == 0
    extra = np.where(code & CUT, TRUNCATED, 0)[:, None]
    to = _KEPT[code & 3]
    out[:, :, K] = np.where((to >= 0) & free[:, None], extra + np.take_along_axis(after, np.maximum(to, 0), axis=1), FAR)
    out[:, :, R] = np.where(free[:, None], REROLE + extra + after[:, _PUT], FAR)
    return np.minimum(out, FAR)


def _with_inserts(cost: np.ndarray) -> np.ndarray:
    out = cost.copy()
    out[:, USER] = np.minimum(out[:, USER], INSERT + out[:, ASSISTANT])
    for state in (START, SYSTEM, ASSISTANT):
        out[:, state] = np.minimum(out[:, state], INSERT + out[:, USER])
    return np.minimum(out, FAR)


def cost_to_go(code: np.ndarray, at: np.ndarray, final: np.ndarray) -> np.ndarray:
    """Least cost (layer, state) to the end of each sequence of rows ``at[i]:at[i + 1]``, whose last layer costs ``final[i]``.

    Sequence i has a layer for each row and one more; its first is ``at[i] + i``.
    """
    length, n = np.diff(at), len(at) - 1
    base = at[:-1] + np.arange(n)
    out = np.full((len(code) + n, 4), FAR)
    out[base + length] = final
    order = np.argsort(-length, kind="stable")
    down = -length[order]
    for t in range(1, int(length.max(initial=0)) + 1):
        who = order[: np.searchsorted(down, -t, "right")]
        layer = base[who] + length[who] - t
        out[layer] = _with_inserts(_row_costs(code[at[who] + length[who] - t], out[layer + 1]).min(axis=2))
    return out


def optimal_arcs(code: np.ndarray, at: np.ndarray, togo: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Targets (node, label) of arcs on cheapest paths, and which of them there are; the last layer has arcs only where ``ends``."""
    n = len(at) - 1
    last = at[1:] + np.arange(n)
    row_layer = np.delete(np.arange(len(togo)), last)
    cost = np.full((len(togo), 4, 4), FAR)
    cost[row_layer] = _row_costs(code, togo[row_layer + 1])
    inserts = np.ones(len(togo), bool)
    inserts[last] = ends
    cost[inserts, :, I] = (INSERT + togo[:, _PUT])[inserts]
    layer, state = np.arange(len(togo))[:, None], np.arange(4)[None, :]
    role = np.zeros(len(togo), np.int64)
    role[row_layer] = code & 3
    target = np.empty((len(togo), 4, 4), np.int64)
    target[:, :, D] = (layer + 1) * 4 + state
    target[:, :, I] = layer * 4 + _PUT[None, :]
    target[:, :, K] = (layer + 1) * 4 + np.maximum(_KEPT[role], 0)
    target[:, :, R] = (layer + 1) * 4 + _PUT[None, :]
    good = (cost == togo[:, :, None]) & (togo < FAR)[:, :, None]
    return target.reshape(-1, 4), good.reshape(-1, 4)


def least_paths(target: np.ndarray, good: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The least sequence of labels from each start along good arcs: offsets, labels, nodes before each edit, and the nodes at the ends.

    Ranks of nodes by their first 1, 2, 4, ... labels, an end first; of a node's arcs the one of least label and target's rank counts.
    """
    n = len(target)
    rows, end = np.arange(n), ~good.any(axis=1)
    order = np.where(good, np.arange(4)[None, :], 4)
    label = order.min(axis=1)
    rank = np.where(end, 0, label + 1)
    while True:
        chosen = np.where(good, order * np.int64(n + 5) + rank[target * good], np.iinfo(np.int64).max).argmin(axis=1)
        jump = np.where(end, rows, target[rows, chosen])
        steps, jumps, ranked = (~end).astype(np.int64), [jump], rank
        while True:
            # Ranks of twice the length: the first half's rank, then the second's.
            ranked = np.unique(ranked * np.int64(n + 5) + ranked[jumps[-1]], return_inverse=True)[1]
            steps = steps + steps[jumps[-1]]
            if end[jumps[-1]].all():
                break
            jumps.append(jumps[-1][jumps[-1]])
        again = np.where(good, order * np.int64(n + 5) + ranked[target * good], np.iinfo(np.int64).max).argmin(axis=1)
        if (target[rows, again] == target[rows, chosen])[~end].all():
            break
        rank = ranked
    size = steps[starts]
    at = np.concatenate([[0], np.cumsum(size)])
    node = np.repeat(starts, size)
    step = np.arange(at[-1]) - np.repeat(at[:-1], size)
    for k, to in enumerate(jumps):
        far = (step >> k) & 1 == 1
        node[far] = to[node[far]]
    return at, chosen[node], node, jumps[-1][starts]


#: Edits of a row as one letter: an inserted user or assistant row, Delete, Keep, Rerole to user or assistant.
_LETTERS = np.array([list("DDDD"), list("uuau"), list("KKKK"), list("UUAU")])
_OF_ROW = re.compile("[ua]*[DKUA]")
AUDIT = str.maketrans("uaUA", "IIRR")


def edits(code: np.ndarray, at: np.ndarray, final: np.ndarray, ends: np.ndarray, entries: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Letters of the least cheapest edits of each sequence from its entry state; the state they end in; the costs at the first layers."""
    togo = cost_to_go(code, at, final)
    first = at[:-1] + np.arange(len(at) - 1)
    offsets, label, node, out = least_paths(*optimal_arcs(code, at, togo, ends), first * 4 + entries)
    text = "".join(_LETTERS[label, node % 4].tolist())
    return [text[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], out % 4, togo[first]


def by_row(letters: str) -> list[str]:
    """Each row's letters, inserts before it first; those after the last row are the last one's."""
    out = _OF_ROW.findall(letters)
    if out:
        out[-1] += letters[sum(map(len, out)) :]
    return out


class _Report:
    """What is known of one conversation, row by row in order; texts are hashed, not held."""

    FIELDS = "gaps blank duplicate truncated illegal cost".split()

    def __init__(self):
        self.gaps = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit, self.sha, self.any = [], sha256(), False
        self.low = self.high = self.last = None
        self.turns, self.before = 0, None

    def _put(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any = True

    def add(self, turn, role: str, text: str, code: int, blank: bool, letters: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.last
            self.high = self.last = turn
        self.blank += blank
        self.duplicate += not blank and code & MUST > 0
        self.truncated += code & CUT > 0
        self.illegal += self.before is not None and not _LEGAL[self.before * 4 + (code & 3)]
        self.before = code & 3
        self.audit.append(letters.translate(AUDIT))
        for x in letters:
            if x in "ua":
                self._put("user" if x == "u" else "assistant", "")
            elif x != "D":
                self._put(role if x == "K" else "user" if x == "U" else "assistant", text)
            self.cost += DELETE if x == "D" else (0 if x == "K" else INSERT if x in "ua" else REROLE) + (TRUNCATED if code & CUT and x in "KUA" else 0)

    def values(self) -> list:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, 2**63 - 1)
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()]


def _batch(ids: list, reports: list[_Report], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*(r.values() for r in reports), strict=True)) or [[]] * 8
    arrays = [pa.array(ids, kind), *(pa.array(c, pa.int64()) for c in columns[:6]), *(pa.array(c, pa.string()) for c in columns[6:])]
    return pa.RecordBatch.from_arrays(arrays, ["id", *_Report.FIELDS, "audit", "repaired_sha256"])


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damage(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (id, turn, role, text, there) with faults by crc32 of ``conv:turn`` modulo 20, nulls as one space.

    0 drops the row (``there`` is false), 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 sets its role to user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.translate(space(text_col), ".!?", "")).otherwise(space(text_col))
    return rows.select(
        F.col(conv_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), F.when(k == 4, "user").otherwise(space(role_col)).alias("role"), text.alias("text"), (k != 0).alias("there"),
        F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def repair(rows: DataFrame, *, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """One row per conversation id of ``rows`` (id, turn, role, text, there): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation's rows go by turn, nulls first, then by role and text, so that equal rows are side by side. Rows where ``there`` isn't true only make their conversation known: one without
    others has zeros, an empty audit and the empty text's hash. A null role or text counts as one space; null ids are one conversation. Whole texts count. ``gaps`` ends at 2**63 - 1. An empty
    table gives no rows. ``most_rows``, ``most_bytes`` and ``segment_bits`` move work between tasks; results don't depend on them.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    there = F.coalesce(F.col("there"), F.lit(False))
    text = F.when(there, text).otherwise("")
    base = rows.select(F.struct("id").alias("c"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), there.alias("there"))
    sizes = base.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    large, path = stored_at(sizes.where((F.col("n") > most_rows) | (F.col("bytes") > most_bytes)).select("c"), "large", release=False)
    if large.isEmpty():
        dropped(spark, path)
        return _whole(base).select("id", *_Report.FIELDS, "audit", "repaired_sha256")
    small = _whole(base.join(large, "c", "left_anti"))
    return small.unionByName(_segmented(base.join(large, "c", "left_semi"), segment_bits))


def _flagged(rows: DataFrame) -> DataFrame:
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    return rows.withColumn("blank", blank).withColumn("code", _initial(F.col("role")) + F.when(blank, MUST).when(F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), 0).otherwise(CUT))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _whole(base: DataFrame) -> DataFrame:
    """Conversations that fit in a task's chunk."""
    kind = base.schema["c"].dataType["id"].dataType.simpleString()
    ordered = _flagged(base).repartition("c").sortWithinPartitions("c", *_order())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, open_, arrow, nothing = [], None, None, object()
        held, now = 0, nothing

        def solved(convs):
            code = np.array([r[3] for _, rs in convs for r in rs], np.int64)
            at = np.concatenate([[0], np.cumsum([len(rs) for _, rs in convs])]).astype(np.int64)
            n = len(convs)
            final = _with_inserts(np.tile(_ENDED, (n, 1)))
            letters, _, _ = edits(code, at, final, np.ones(n, bool), np.zeros(n, np.int64))
            reports = []
            for (_, rs), own in zip(convs, letters, strict=True):
                report = _Report()
                for r, x in zip(rs, by_row(own), strict=True):
                    report.add(*r, x)
                reports.append(report)
            return _batch([c for c, _ in convs], reports, arrow)

        for batch in batches:
            arrow = batch.column("id").type
            for c, turn, role, text, there, blank, code in zip(*(batch.column(k).to_pylist() for k in ("id", "turn", "role", "text", "there", "blank", "code")), strict=True):
                if now is nothing or c != now:
                    if held >= CHUNK:
                        yield solved(done)
                        done, held = [], 0
                    open_, seen, now = [], set(), c
                    done.append((c, open_))
                if there:
                    if not blank:
                        if (role, text) in seen:
                            code = code & 3 | MUST
                        seen.add((role, text))
                    open_.append((turn, role, text, code, blank))
                    held += 1 + len(text) // 1024
        if done:
            yield solved(done)

    return ordered.select("c.id", "turn", "role", "text", "there", "blank", "code").mapInArrow(run, f"id {kind}, {_RESULT}")


def _segmented(base: DataFrame, bits: int) -> DataFrame:
    """Conversations of any size: their rows, in order, in segments over many tasks."""
    spark = base.sparkSession
    kind = base.schema["c"].dataType["id"].dataType.simpleString()
    keys = ["c", F.col("turn").asc_nulls_first(), "role"]
    # Ranges by the head of texts, as the driver sees a sample of the keys; within a range whole texts are sorted.
    ranged = _flagged(base.where("there")).repartitionByRange(*keys, F.substring("text", 1, 64)).sortWithinPartitions("c", *_order())
    digest = F.sha2(F.concat_ws(":", F.octet_length("role"), "role", "text"), 256)
    ordered, ordered_path = stored_at(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("digest", digest), "ordered")
    first = ordered.where("not blank").groupBy("c", "digest").agg(F.min("at").alias("first"))
    known = ordered.select("c", "at", "digest", "code", "blank").join(first, ["c", "digest"], "left")
    known = known.select("c", "at", F.when(F.col("at") > F.col("first"), F.col("code").bitwiseAND(3) + MUST).otherwise(F.col("code")).alias("code"))
    segment = known.groupBy("c", F.shiftright("at", bits).alias("s")).agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("rows"))
    segments, segments_path = stored_at(segment.select("c", "s", F.col("rows.at").alias("ats"), F.col("rows.code").alias("codes")), "segments")

    def codes(batch):
        column = batch.column("codes")
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)

    def matrices(batches):
        for batch in batches:
            code, at = codes(batch)
            n, ways = len(at) - 1, []
            for out in range(4):
                final = np.full((n, 4), FAR)
                final[:, out] = 0
                ways.append(cost_to_go(code, at, final)[at[:-1] + np.arange(n)])
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("s"), pa.array(np.stack(ways, axis=2).reshape(n, 16).tolist(), pa.list_(pa.int64()))], ["c", "s", "m"])

    def behind(table: pa.Table) -> pa.Table:
        """Costs of the layer behind each segment of a conversation: 16 numbers a segment are in memory."""
        order = np.argsort(table.column("s").to_numpy())
        m = np.array(table.column("m").to_pylist(), np.int64).reshape(-1, 4, 4)[order]
        out, now = [], _with_inserts(_ENDED[None, :])[0]
        for x in m[::-1]:
            out.append(now.tolist())
            now = np.minimum((x + now[None, :]).min(axis=1), FAR)
        taken = table.take(order)
        return pa.table({"c": taken.column("c"), "s": taken.column("s"), "after": pa.array(out[::-1], pa.list_(pa.int64())), "ends": [i == len(m) - 1 for i in range(len(m))]})

    c = base.schema["c"].dataType.simpleString()
    costs = segments.select("c", "s", "codes").mapInArrow(matrices, f"c {c}, s long, m array<long>").groupBy("c").applyInArrow(behind, f"c {c}, s long, after array<long>, ends boolean")

    def ways(batches):
        """Each segment's edits from each state that it may begin in."""
        for batch in batches:
            code, at = codes(batch)
            n = len(at) - 1
            final, ends = np.array(batch.column("after").to_pylist(), np.int64).reshape(n, 4), np.array(batch.column("ends").to_pylist(), bool)
            got = [edits(code, at, final, ends, np.full(n, e)) for e in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("c"), batch.column("s"), batch.column("ats"), pa.array([[g[0][i] for g in got] for i in range(n)], pa.list_(pa.string())), pa.array(np.stack([g[1] for g in got], axis=1).tolist(), pa.list_(pa.int64()))],
                ["c", "s", "ats", "letters", "exits"],
            )

    solved, solved_path = stored_at(segments.join(costs, ["c", "s"]).mapInArrow(ways, f"c {c}, s long, ats array<long>, letters array<string>, exits array<long>"), "solved")

    def entered(table: pa.Table) -> pa.Table:
        """The state in which each segment of a conversation begins."""
        order = np.argsort(table.column("s").to_numpy())
        now, out = START, []
        for exits in table.take(order).column("exits").to_pylist():
            out.append(now)
            now = exits[now]
        return pa.table({"c": table.take(order).column("c"), "s": table.take(order).column("s"), "entry": pa.array(out, pa.int64())})

    entry = solved.select("c", "s", "exits").groupBy("c").applyInArrow(entered, f"c {c}, s long, entry long")

    def rowwise(batches):
        for batch in batches:
            for ats, letters in zip(batch.column("ats").to_pylist(), batch.column("letters").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(ats, pa.int64()), pa.array(by_row(letters), pa.string())], ["at", "letters"])

    told = solved.join(entry, ["c", "s"]).select("ats", F.expr("letters[entry]").alias("letters")).mapInArrow(rowwise, "at long, letters string")
    final = ordered.drop("digest", "code").join(known.select("at", "code"), "at").join(told, "at").repartition("c").sortWithinPartitions("c", "at")

    def reports(batches):
        now, report, arrow, nothing = object(), None, None, object()
        now = nothing
        for batch in batches:
            arrow = batch.column("id").type
            for cid, *row in zip(*(batch.column(k).to_pylist() for k in ("id", "turn", "role", "text", "code", "blank", "letters")), strict=True):
                if now is nothing or cid != now:
                    if report:
                        yield _batch([now], [report], arrow)
                    now, report = cid, _Report()
                report.add(*row)
        if report:
            yield _batch([now], [report], arrow)

    found = final.select("c.id", "turn", "role", "text", "code", "blank", "letters").mapInArrow(reports, f"id {kind}, {_RESULT}")
    # Large conversations all of whose rows are gone.
    ids = base.groupBy("c").agg(F.max("there").alias("any")).where("not any")
    out, _ = stored_at(found.unionByName(_whole(base.join(ids.select("c"), "c", "left_semi").dropDuplicates(["c"]))), "repaired")
    for path in (ordered_path, segments_path, solved_path):
        dropped(spark, path)
    return out
