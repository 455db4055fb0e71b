"""Canonical JSON and the decision cache against json.dumps and plain Python."""
import json
from datetime import date, datetime
from decimal import Decimal
from hashlib import sha256

import pytest

from adlens.functions.canonical import canonical_hash, canonical_json
from adlens.operators import decisions as D

SCHEMA = "struct<b:string,a:array<struct<z:int,k:boolean>>,`é`:map<string,array<string>>,n:decimal(9,2),d:date,t:timestamp_ntz,l:bigint>"
VALUES = [
    {"b": 'quote " back \\ tab \t nl \n cr \r \x08\x0c \x00\x1f\x7f / é 漢 😀', "a": [{"z": 1, "k": True}, {"z": None, "k": None}, None], "é": {"z": ["1", None], "A": [], "a": None, "ä": ["x"], "\n": ["y"]}, "n": Decimal("12.50"), "d": date(2024, 2, 29), "t": datetime(2024, 1, 2, 3, 4, 5, 60), "l": -(2**63)},
    {"b": "", "a": [], "é": {}, "n": None, "d": None, "t": datetime(2024, 1, 2, 3, 4, 5), "l": 2**63 - 1},
    {"b": None, "a": None, "é": None, "n": Decimal("0.00"), "d": None, "t": None, "l": None},
]


def python(value):
    return json.dumps(value, sort_keys=True, ensure_ascii=False, default=lambda v: v.isoformat() if hasattr(v, "isoformat") else str(v))


def test_json_is_pythons(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*VALUES, None])], f"i int, v {SCHEMA}")
    kind = df.schema["v"].dataType
    got = {r.i: (r.j, r.h) for r in df.select("i", canonical_json(df["v"], kind).alias("j"), canonical_hash(df["v"], kind).alias("h")).collect()}
    for i, v in enumerate([*VALUES, None]):
        assert got[i] == (python(v), sha256(python(v).encode()).hexdigest())


def test_floats_are_refused(spark):
    df = spark.createDataFrame([(0.1,)], "v double")
    with pytest.raises(TypeError, match="double"):
        canonical_json(df["v"], df.schema["v"].dataType)


def test_newest_valid_answer(spark):
    asked = [(i, "t" if i % 2 else "u", "m", "v1", [["system", "s"], ["user", f"text {i % 3}"]], {"type": "object"}) for i in range(12)]
    requests = D.with_key(spark.createDataFrame(asked, "id int, task string, model string, version string, messages array<array<string>>, schema map<string,string>"))
    keys = {r.id: r.key for r in requests.collect()}
    for i, _, model, version, messages, schema in asked:
        assert keys[i] == sha256(json.dumps({"model": model, "version": version, "messages": messages, "schema": schema}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    at = lambda d: datetime(2024, 1, d)
    ledger = spark.createDataFrame([
        (1, "t", keys[0], "m", "v1", "old", True, at(1)), (2, "t", keys[0], "m", "v1", "new", True, at(2)), (3, "t", keys[0], "m", "v1", "wrong", False, at(3)), (4, "t", keys[0], "m", "v1", None, True, at(4)),
        (5, "t", keys[0], "m", "v2", "other prompt", True, at(5)), (6, "u", keys[1], "m", "v1", "a", True, at(2)), (7, "u", keys[1], "m", "v1", "b", True, at(2)),
    ], "decision_id int, task string, key string, model string, version string, response string, valid boolean, created_at timestamp_ntz")
    got = {r.id: (r.decision_id, r.response) for r in D.answered(requests, ledger).collect()}
    assert got == {i: (2, "new") if i % 2 and i % 3 == 0 else (7, "b") if i % 2 == 0 and i % 3 == 1 else (None, None) for i in range(12)}
    rows = sorted((r.task, r.key, r.requests) for r in D.to_ask(requests, ledger).collect())
    assert rows == sorted([("t", keys[1], 2), ("t", keys[2], 2), ("u", keys[0], 2), ("u", keys[2], 2)])
