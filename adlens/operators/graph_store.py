"""Rule graphs as stored tables: nodes and edges of each version under an atomic manifest, whose newest version is the active one."""
from __future__ import annotations

import json
import uuid
from hashlib import sha256
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Conflict, Manifests
from . import rules as R

NODES = "version long, key string, kind string, action string, origin string, position int"
EDGES = "version long, start string, end string, condition string, priority int, position int"


def canonical(value: Any) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def content(graph: R.Graph) -> str:
    """sha256 of what a graph says, whatever its version."""
    nodes = [[n.key, n.kind, dict(n.action), n.origin] for n in graph.nodes]
    edges = [[e.start, e.end, dict(e.condition), e.priority] for e in graph.edges]
    return sha256(canonical([nodes, edges, {k: list(v) for k, v in graph.vocab.items()}]).encode()).hexdigest()


class GraphStore:
    """The versions of one source's graph for one purpose (navigation or extraction) in a folder."""

    def __init__(self, spark: SparkSession, path: str, tries: int = 20):
        self.spark, self.path, self.tries = spark, path.rstrip("/"), tries
        self.manifests = Manifests(spark, path)

    def save(self, graph: R.Graph, notes: str = "", base: int | None = None) -> R.Graph:
        """Store the graph as the next version, which becomes the active one and retires that before.

        With ``base`` it must still be the active version, else ``Conflict``: for a graph that was made from it. Nodes and edges are written before the manifest names
        them, so a version is there whole or not at all.
        """
        for _ in range(self.tries):
            now = self.manifests.latest()
            if base is not None and (now["version"] if now else 0) != base:
                raise Conflict(f"version {base} isn't the active one")
            version = (now["version"] if now else 0) + 1
            name = f"v{version}-{uuid.uuid4().hex}"
            nodes = [(version, n.key, n.kind, canonical(dict(n.action)), n.origin, i) for i, n in enumerate(graph.nodes)]
            edges = [(version, e.start, e.end, canonical(dict(e.condition)), e.priority, i) for i, e in enumerate(graph.edges)]
            self.spark.createDataFrame(nodes, NODES).coalesce(1).write.parquet(f"{self.path}/nodes/{name}")
            self.spark.createDataFrame(edges, EDGES).coalesce(1).write.parquet(f"{self.path}/edges/{name}")
            if self.manifests.create(version, {"folder": name, "vocab": {k: list(v) for k, v in graph.vocab.items()}, "notes": notes, "content": content(graph)}):
                return R.replace(graph, version=version)
            for kind in ("nodes", "edges"):
                self.manifests.delete(f"{self.path}/{kind}/{name}")
        raise Conflict(f"{self.path}: {self.tries} tries")

    def load(self, version: int | None = None) -> R.Graph | None:
        """A version, or the active one; None where nothing is stored."""
        m = self.manifests.latest() if version is None else self.manifests.read(version)
        if m is None:
            return None
        nodes, edges = (self.spark.read.schema(s).parquet(f"{self.path}/{k}/{m['folder']}").orderBy("position").collect() for k, s in (("nodes", NODES), ("edges", EDGES)))
        return R.Graph(
            tuple(R.Rule(n.key, n.kind, json.loads(n.action), n.origin) for n in nodes), tuple(R.Edge(e.start, e.end, json.loads(e.condition), e.priority) for e in edges), m["vocab"], m["version"]
        )

    def versions(self) -> DataFrame:
        """version, status (ACTIVE or RETIRED), notes, content."""
        found = [self.manifests.read(v) for v in self.manifests.versions()]
        rows = [(m["version"], "ACTIVE" if m is found[-1] else "RETIRED", m["notes"], m["content"]) for m in found]
        return self.spark.createDataFrame(rows, "version long, status string, notes string, content string")

    def nodes(self) -> DataFrame:
        """All versions' nodes, with their version's status."""
        return self._all("nodes", NODES)

    def edges(self) -> DataFrame:
        return self._all("edges", EDGES)

    def _all(self, kind: str, schema: str) -> DataFrame:
        found = [self.manifests.read(v) for v in self.manifests.versions()]
        paths = [f"{self.path}/{kind}/{m['folder']}" for m in found]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.withColumn("status", F.when(F.col("version") == (found[-1]["version"] if found else 0), "ACTIVE").otherwise("RETIRED"))

    def install(self, seed: R.Graph, *, replace_active: bool = False, dry_run: bool = False) -> tuple[str, int]:
        """Install a packaged graph: what was done (``installed``, ``replaced``, ``kept``, ``same``) and the active version.

        An active graph is kept unless ``replace_active``; one that says the same is never stored again. ``dry_run`` only tells.
        """
        now = self.manifests.latest()
        if now is None:
            return "installed", 0 if dry_run else self.save(seed, "initial seed", base=0).version
        if now["content"] == content(seed):
            return "same", now["version"]
        if not replace_active:
            return "kept", now["version"]
        return "replaced", now["version"] if dry_run else self.save(seed, "seed replaced", base=now["version"]).version


def rule_counts(nodes: DataFrame) -> DataFrame:
    """Nodes and templates of each stored version, with its status."""
    return nodes.groupBy("version", "status").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("kind") == "TEMPLATE").alias("templates"))


def removed_between(nodes: DataFrame, before: int, after: int) -> DataFrame:
    """Keys of nodes that a version has and a later one lacks."""
    return nodes.where(F.col("version") == before).select("key").join(nodes.where(F.col("version") == after).select("key"), "key", "left_anti")
