"""Exact deduplication over an extendible-hash index on shared files (DataFrame operations only).

1. Entries. Documents are grouped by a 64-bit key hash *and* their text: Spark compares the texts' bytes, and combines copies in each
   task before the shuffle, so a text that a third of all rows share sends one row a task.
2. Directory. A histogram of the entries' leading hash bits (at most ``2 ** max_depth`` rows) goes to the driver, which doubles
   the directory and splits buckets until none holds more than its capacity or the depth is ``max_depth``. The capacity grows with
   the entries beyond ``2 ** (max_depth - 4)`` buckets, so the directory doesn't.
3. Index. Entries, now without text, are written to the shared folder in order of buckets. A bucket is a range of keys; an owner task
   has a range of buckets and chains the entries of a bucket that share a hash.
4. Probe. Documents find their bucket by the directory, and there their hash and chain entry; entries of one document need no
   lookup. The few entries that more than one in ``HOT`` documents share are broadcast, so that no task gets all copies of one.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import stored


def directory(counts: dict[int, int], capacity: int, max_depth: int) -> tuple[int, dict[int, int]]:
    """Global depth, and the bucket of each prefix of that many bits.

    ``counts`` has the entries by their first ``max_depth`` bits. A bucket over ``capacity`` splits in two by
    its next bit; the directory doubles when such a bucket is as deep as the directory.
    """
    depth, buckets, work = 0, [], [(0, 0)]
    by_depth = [counts]
    for _ in range(max_depth):
        up: dict[int, int] = {}
        for k, v in by_depth[-1].items():
            up[k >> 1] = up.get(k >> 1, 0) + v
        by_depth.append(up)
    by_depth.reverse()
    while work:
        local, prefix = work.pop()
        if by_depth[local].get(prefix, 0) > capacity and local < max_depth:
            depth = max(depth, local + 1)
            work += [(local + 1, 2 * prefix), (local + 1, 2 * prefix + 1)]
        else:
            buckets.append((local, prefix))
    slots: dict[int, int] = {}
    for bucket, (local, prefix) in enumerate(sorted(buckets, key=lambda b: b[1] << (max_depth - b[0]))):
        width = depth - local
        for low in range(1 << width):
            slots[(prefix << width) | low] = bucket
    return depth, slots


#: Entries with more than one in so many documents: fewer than this many exist.
HOT = 10_000


def _bucket(key_hash: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key_hash, 64 - depth) if depth else F.lit(0).cast("long")


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_capacity: int = 1024, max_depth: int = 16) -> tuple[DataFrame, DataFrame, int]:
    """The index, the directory, and its depth.

    Index: one row per distinct text: bucket, key_hash, chain, text_sha256, n_bytes, keep_id, group_size. Directory: slot (the first
    ``depth`` bits of a key hash), bucket. ``chain`` numbers the texts that share a 64-bit hash from 1. A null text counts as
    empty; a null id is smaller than any other. An empty table gives an empty index.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    entries = stored(
        docs.select(F.col(id_col).alias("id"), text.alias("body"))
        .groupBy(F.xxhash64("body").alias("key_hash"), "body")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("key_hash", F.sha2("body", 256).alias("text_sha256"), F.octet_length("body").cast("long").alias("n_bytes"), "keep_id", "group_size"),
        "exact-entries",
    )
    top = F.shiftrightunsigned("key_hash", 64 - max_depth)
    counts = {r[0]: r[1] for r in entries.groupBy(top.alias("p")).count().collect()}  # at most 2 ** max_depth rows
    depth, slots = directory(counts, max(bucket_capacity, sum(counts.values()) >> (max_depth - 4)), max_depth)
    table = spark.createDataFrame(list(slots.items()), "slot long, bucket int")  # at most 2 ** max_depth rows
    placed = entries.withColumn("slot", _bucket(F.col("key_hash"), depth)).join(F.broadcast(table), "slot").drop("slot")
    chain = F.row_number().over(Window.partitionBy("bucket", "key_hash").orderBy("text_sha256"))
    index = placed.repartitionByRange("bucket").withColumn("chain", chain)
    return stored(index.select("bucket", "key_hash", "chain", "text_sha256", "n_bytes", "keep_id", "group_size"), "exact-index"), table, depth


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_capacity: int = 1024, max_depth: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the largest id stays; null ids are smaller
    than others and stay only among themselves. Rows that repeat an id with the same text are the same document and share
    its verdict. An empty table gives no rows. Other columns are ignored whatever their names.
    """
    index, table, depth = build_index(docs, id_col=id_col, text_col=text_col, bucket_capacity=bucket_capacity, max_depth=max_depth)
    many = (index.agg(F.sum("group_size")).first()[0] or 0) // HOT + 1
    body = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("key_hash"), F.sha2(body, 256).alias("text_sha256"))
    probing = keyed.withColumn("slot", _bucket(F.col("key_hash"), depth)).join(F.broadcast(table), "slot", "left").drop("slot")
    keys = ["bucket", "key_hash", "text_sha256"]
    found = index.where("group_size > 1").select(*keys, "keep_id", "group_size")
    hot = found.where(F.col("group_size") > many).select(*keys, F.struct("keep_id", "group_size").alias("hot"))  # fewer than HOT rows
    first = probing.join(F.broadcast(hot), keys, "left")
    # A row whose entry is found already takes part in the second lookup under a key of its own, which no entry has.
    spread = F.when(F.col("hot").isNull(), F.col("key_hash")).otherwise(F.xxhash64("id"))
    second = first.select("id", "text_sha256", "hot", F.when(F.col("hot").isNull(), F.col("bucket")).otherwise(-1).alias("at"), spread.alias("hash"))
    cold = found.where(F.col("group_size") <= many).select(F.col("bucket").alias("at"), F.col("key_hash").alias("hash"), "text_sha256", F.struct("keep_id", "group_size").alias("cold"))
    entry = F.coalesce("hot", "cold")
    out = second.join(cold, ["at", "hash", "text_sha256"], "left").select("id", "text_sha256", entry.alias("entry"))
    keep = F.when(F.col("entry").isNull(), F.col("id")).otherwise(F.col("entry.keep_id"))
    return out.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("entry.group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )
