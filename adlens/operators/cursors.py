"""Resume points of the archive's index: one row a source and scope."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("source_key", "scope", "resume_key", "done")


def save(cursors: DataFrame, updates: DataFrame) -> DataFrame:
    """Cursors after ``updates`` (one a source and scope), which replace what was saved."""
    keys = list(COLUMNS[:2])
    return cursors.join(updates.select(*keys), keys, "left_anti").select(*COLUMNS).unionByName(updates.select(*COLUMNS))


def adopt(cursors: DataFrame, wanted: DataFrame) -> DataFrame:
    """Resume point of each wanted row (source_key, scope, legacy), and whether it was ``adopted``.

    A scope that was never saved, or has neither a key nor an end, takes over the cursor of its ``legacy`` scope; those rows are the ones
    to save. Without either it starts anew: no key, not done.
    """
    begun = cursors.where("resume_key is not null or done")
    side = lambda name, scope: begun.select("source_key", F.col("scope").alias(scope), F.col("resume_key").alias(f"_{name}_key"), F.col("done").alias(f"_{name}_done"))
    both = wanted.join(side("own", "scope"), ["source_key", "scope"], "left").join(side("old", "legacy"), ["source_key", "legacy"], "left")
    own, old = F.col("_own_done").isNotNull(), F.col("_old_done").isNotNull()
    return both.select(
        "source_key", "scope", F.when(own, F.col("_own_key")).otherwise(F.col("_old_key")).alias("resume_key"),
        F.coalesce("_own_done", "_old_done", F.lit(False)).alias("done"), (~own & old).alias("adopted"),
    )
