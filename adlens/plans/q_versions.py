"""Queries through versioned tables: batches that are merged, rows that workers claim, rules that are stored; answers that are known."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions as D
from ..operators import frontier as Q
from ..operators import graph_store as G
from ..operators import merge as M
from ..operators import rules as R
from ..sources.staging import fresh
from ..sources.versions import VersionedTable
from ..sources.views import frontier, table
from .q_frontier import _order_sql
from .q_merge import _SIGHT_SQL, sightings
from .q_rules import _SQL, BUNDLE
from .registry import query


@query("merged_batches", f"WITH {_SIGHT_SQL} SELECT external_id, observed_at, document_id, position, price FROM sight QUALIFY row_number() OVER (PARTITION BY external_id, observed_at ORDER BY document_id DESC, position DESC) = 1")
def merged_batches(spark, d):
    """The history of all sightings, merged in three batches of which the second is tried twice."""
    rows = sightings(spark, d)
    stored = VersionedTable(spark, fresh(spark, "merged_batches").folder("history"), rows.schema, M.KEY)
    for batch in (0, 1, 1, 2):
        M.merge_batch(stored, rows.where(F.pmod("document_id", F.lit(3)) == batch), "query", batch)
    return stored.read().select("external_id", "observed_at", "document_id", "position", "price")


@query("claims_in_turn", f"SELECT id FROM ({_order_sql(True, None)} QUALIFY rank <= 50)")
def claims_in_turn(spark, d):
    """Two claims of 25 rows from a stored queue are the first 50 of its order."""
    none = F.lit(None)
    rows = frontier(spark, d).select("id", "timestamp", "priority", "status", none.cast("timestamp_ntz").alias("next_retry_at"), none.cast("timestamp_ntz").alias("claimed_at"), none.cast("string").alias("claimed_by"))
    stored = VersionedTable(spark, fresh(spark, "claims_in_turn").folder("queue"), rows.schema, ["id"])
    stored.update(lambda _: rows, lambda old, new: new)
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    first, second = (Q.claim_from(stored, now, 25, worker) for worker in ("a", "b"))
    return first.select("id").unionAll(second.select("id"))


@query("stored_routes", f"SELECT n.node, n.decision, count(p.node) AS pages FROM (VALUES ('off_host', 'SKIP'), ('skip_fr', 'SKIP'), ('detail', 'FETCH')) n(node, decision) LEFT JOIN (SELECT {_SQL} AS node FROM pages) p USING (node) GROUP BY ALL")
def stored_routes(spark, d):
    """Pages that each rule of the stored active graph takes; the version before, which has a rule more, is retired."""
    store = G.GraphStore(spark, fresh(spark, "stored_routes").folder("graph"))
    store.install(R.compile_bundle(BUNDLE)[0])
    store.save(store.load().revised(remove=["unused"]), "without what is never used")
    active = store.nodes().where("status = 'ACTIVE'").select(F.col("key").alias("node"), F.get_json_object("action", "$.decision").alias("decision"))
    taken = R.route_urls(table(spark, d, "pages"), store.load(), key="page_id").groupBy("node").agg(F.count(F.lit(1)).alias("pages"))
    return active.join(taken, "node", "left").select("node", "decision", F.coalesce("pages", F.lit(0).cast("long")).alias("pages"))


_ASKED_SQL = """asked AS (SELECT p_partkey AS id, p_brand AS brand, sha256('{"messages": [["system", "' || p_brand || '"], ["user", "' || p_type || '"]], "model": "m", "schema": {"type": "object"}, "version": "v1"}') AS key FROM part)"""


@query(
    "decisions_known",
    f"""WITH {_ASKED_SQL}, ledger AS (SELECT p_partkey AS decision_id, key, 'answer ' || p_partkey AS response, p_size % 2 = 0 AS valid, p_size AS created_at FROM part JOIN asked ON id = p_partkey WHERE p_partkey % 3 = 0),
      newest AS (SELECT key, decision_id, response FROM ledger WHERE valid QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at DESC, decision_id DESC) = 1)
      SELECT id, asked.key, decision_id, response FROM asked LEFT JOIN newest USING (key)""",
)
def decisions_known(spark, d):
    """Requests of parts of one brand and type ask the same; a third of the parts have answers in the ledger, half of these valid."""
    part = table(spark, d, "part")
    messages = F.array(F.array(F.lit("system"), F.col("p_brand")), F.array(F.lit("user"), F.col("p_type")))
    asked = D.with_key(part.select(F.col("p_partkey").alias("id"), "p_size", F.lit("route").alias("task"), F.lit("m").alias("model"), F.lit("v1").alias("version"), messages.alias("messages"), F.create_map(F.lit("type"), F.lit("object")).alias("schema")))
    ledger = asked.where("id % 3 = 0").select(F.col("id").alias("decision_id"), "task", "key", "model", "version", F.concat(F.lit("answer "), F.col("id").cast("string")).alias("response"), (F.col("p_size") % 2 == 0).alias("valid"), F.col("p_size").alias("created_at"))
    return D.answered(asked.select("id", "task", "model", "version", "key"), ledger).select("id", "key", "decision_id", "response")
