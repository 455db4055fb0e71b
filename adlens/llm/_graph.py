"""Connected components of an edge table, by alternating large and small stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import dropped, stored_at


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, label) for each node of an edge; the label is the least node that it reaches.

    ``edges`` has src and dst (long). Each round sends every node's neighbours to the least of them, first the larger then the
    smaller ones, until nothing changes: then all edges point to their component's least node. Rounds grow with the
    logarithm of the longest path; more than ``most_rounds`` are an error. A node with very many neighbours costs one combined row a
    task. A round's table is deleted when the next one is written.
    """
    now, path = stored_at(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        # Large star: all neighbours both ways; those above the node go to its least neighbour.
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: the smaller neighbours and the node itself go to the least of them.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        after = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before = path
        now, path = stored_at(after, "stars", release=False)
        dropped(edges.sparkSession, before)
        sums = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sums == seen:
            break
        seen = sums
    else:
        raise RuntimeError(f"no components after {most_rounds} rounds")
    labelled = now.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    roots = now.select(F.col("v").alias("node")).distinct().join(labelled.select("node"), "node", "left_anti").select("node", F.col("node").alias("label"))
    return labelled.unionAll(roots)
