"""A cache of decisions by what was asked: requests are known by the hash of their canonical JSON, answers are looked up in a ledger."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_hash


def with_key(requests: DataFrame, column: str = "key") -> DataFrame:
    """Requests (model, version, messages: arrays of role and content, schema: a map or struct) with the hash that stands for their content."""
    asked = F.struct("messages", "model", "schema", "version")
    typed = requests.select(asked.alias("asked")).schema["asked"].dataType
    return requests.withColumn(column, canonical_hash(asked, typed))


def answered(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each request with ``response`` and ``decision_id`` of the newest valid answer to the same task, content, model and version, null where there is none.

    Requests have task, model, version and key; the ledger has decision_id, task, key, model, version, response, valid, created_at. Of answers of one moment the largest id counts; an answer without
    a response is none. A content that is asked again and again has one answer row, so the join grows with the requests.
    """
    known = ["task", "key", "model", "version"]
    good = ledger.where(F.col("valid") & F.col("response").isNotNull())
    newest = good.groupBy(*known).agg(F.max_by(F.struct("decision_id", "response"), F.struct("created_at", "decision_id")).alias("_a"))
    return requests.join(newest, known, "left").withColumns({"decision_id": F.col("_a.decision_id"), "response": F.col("_a.response")}).drop("_a")


def to_ask(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """(task, key, model, version, requests) of the contents that nobody has answered yet: each is to be asked once, however many requests wait for it."""
    open_ = answered(requests, ledger).where("decision_id is null")
    return open_.groupBy("task", "key", "model", "version").agg(F.count(F.lit(1)).alias("requests"))
