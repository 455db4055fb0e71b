"""Conversation repair against plain recursion over costs and whole audits."""
import random
import re
import zlib
from functools import cache
from hashlib import sha256

import numpy as np
import pytest

from adlens.llm import conversations as C

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    convs = {}
    for conv, turn, role, text in rows:
        out = convs.setdefault(conv, [])
        name = lambda v: " " if v is None else str(v)
        k = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return {conv: plain_repair(rows) for conv, rows in convs.items()}


def plain_repair(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not found else "duplicate" if (role, text) in seen else "" if found[-1] in ".!?" else "truncated")
        seen.add((role, text))
    keep = {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}

    @cache
    def best(i, state, spent=0):
        """(cost, audit, repaired rows) from row i on."""
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        to = "a" if state == "u" else "u"
        name = {"a": "assistant", "u": "user"}[to]
        if spent < 2:
            cost, audit, done = best(i, to, spent + 1)
            ways.append((cost + 3, "I" + audit, (f"{name}:", *done)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, done = best(i + 1, state)
            ways.append((cost + 4, "D" + audit, done))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                cost, audit, done = best(i + 1, to)
                ways.append((cost + 3 + extra, "R" + audit, (f"{name}:{text}", *done)))
                after = keep.get(role[:1], {}).get(state)
                if after:
                    cost, audit, done = best(i + 1, after)
                    ways.append((cost + extra, "K" + audit, (f"{role}:{text}", *done)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, done = best(0, "")
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[1][:1] for r in rows]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha256("\n".join(done).encode()).hexdigest())


def check(spark, rows, **how):
    got = C.repair(C.damage(spark.createDataFrame(rows, SCHEMA)), **how).collect()
    assert len(got) == len({r.id for r in got})
    assert {r.id: tuple(r)[1:] for r in got} == plain(rows)


def test_conversations(spark):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])


def made(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, longest)):
            text = rng.choice(["yes.", "No", "why? ", "a\n", "\t ", "", "é!\x0b", "…", "x" * 70 + "a.", "x" * 70 + "b."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None, 0]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "sage", "ua"]), rng.choice([text, None, text])))
    return rows


def test_edges(spark):
    rows = made(1, 150, 9) + [(None, None, None, None), (None, 1, "user", "hi."), (-5, 2**63 - 1, "user", "a."), (-5, -(2**63), "assistant", "b.")]
    want = plain(rows)
    assert want[-5][0] > 2**63 - 1
    got = {r.id: tuple(r)[1:] for r in C.repair(C.damage(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got.pop(-5)[1:] == want.pop(-5)[1:]
    assert got == want
    gone = next(c for c in range(10**4) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    check(spark, [(gone, 0, "user", "hello.")])
    check(spark, [])
    odd = spark.createDataFrame([("x", 0, "user", "a.", 1, 2)], "conv_id string, turn int, role string, text string, code int, blank int")
    assert [r.id for r in C.repair(C.damage(odd)).collect()] == ["x"]


@pytest.mark.parametrize("bits", [0, 2])
def test_segments_change_nothing(spark, bits):
    """Conversations cut into segments of 1 and 4 rows over several tasks, beside small ones."""
    rows = made(2, 25, 40) + [(None, i, r, t) for i, (_, _, r, t) in enumerate(made(3, 1, 60))] + [(999, None, "user", "again.")] * 30
    gone = next(c for c in range(1000, 10**5) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "a."), (gone, 0, "user", "b.")] * 8
    check(spark, rows, most_rows=12, segment_bits=bits)
    check(spark, rows[:60], most_bytes=40, segment_bits=bits)


def test_paths_by_ranks_alone():
    """Where arcs of one label lead to different nodes, ranks of their targets decide."""
    # 0 -> 1 or 2, both by label 1; 1 -> 3 by label 2; 2 -> 4 by label 1; 3 and 4 end.
    target, good = np.zeros((5, 4), np.int64), np.zeros((5, 4), bool)
    target[0, 1], target[1, 2], target[2, 1] = 2, 3, 4
    good[0, 1] = good[1, 2] = good[2, 1] = True
    at, labels, nodes, ends = C.least_paths(target, good, np.array([0, 1, 4]))
    assert at.tolist() == [0, 2, 3, 3] and labels.tolist() == [1, 1, 2] and nodes.tolist() == [0, 2, 1] and ends.tolist() == [4, 3, 4]
