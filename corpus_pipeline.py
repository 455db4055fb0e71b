"""A training corpus from ``documents``: each stage calls one operator of ``adlens.llm`` and works on what its predecessor kept.

Every stage but the last returns the columns of ``documents``; the last returns the kept documents' token ids and the sha256 of what these decode to.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adlens.llm import bpe, decontam, exact_dedup, ngram_join, quality
from adlens.llm._store import dropped, scratch, stored_at
from adlens.llm.queries import contaminated, quality_model, tokenizer_json

#: A document whose score is below this is rejected.
LEAST_QUALITY = 0.5


#: What a stage knows a row by: its id and its text's sha256 (a null text counts as empty). A null id differs from all others.
_KEY = "_row_key"


def _key(sha: Column) -> Column:
    return F.concat_ws("-", F.col("doc_id").cast("string"), sha)


def _keyed(docs: DataFrame) -> DataFrame:
    """Key, id and text of each row, and the whole row as a struct, so that no column of ``docs`` can clash with the stages' own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text", _key(F.sha2(F.coalesce("text", F.lit("")), 256)).alias(_KEY))


def _keep(keyed: DataFrame, verdict: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose key ``verdict`` has."""
    return keyed.join(verdict.select(_KEY).distinct(), _KEY, "left_semi").select("row.*")


def _keep_one(keyed: DataFrame, verdict: DataFrame) -> DataFrame:
    """Of the rows of each key that ``verdict`` has, one: number 1 among the key's repeats, which tasks tell before the shuffle."""
    number = F.row_number().over(Window.partitionBy(_KEY).orderBy("doc_id"))
    return keyed.withColumn("_n", number).where("_n = 1").join(verdict.select(_KEY).distinct(), _KEY).select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    keyed = _keyed(docs)
    return _keep(keyed, quality.score(keyed, model, id_col=_KEY).where(F.col("score") >= LEAST_QUALITY))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, of the largest id."""
    return _keep_one(_keyed(docs), exact_dedup.exact_dedup(docs.select("doc_id", "text")).where("kept").withColumn(_KEY, _key(F.col("text_sha256"))))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents one row stays, of the least id; a null id comes last.

    The join knows documents by 62 bits of a hash of the key, so that components of rows that repeat an id, or have none, stay apart.
    """
    keyed = _keyed(docs)
    hashed = keyed.withColumn("_row", F.shiftrightunsigned(F.xxhash64(_KEY), 2))
    found = ngram_join.ngram_components(hashed, id_col="_row").select("_row", "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", _KEY)
    least = found.join(hashed.select("_row", "doc_id", _KEY).distinct(), "_row").groupBy("component_id").agg(F.min_by(_KEY, order).alias(_KEY))
    return _keep_one(keyed, least)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    found = decontam.contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=_KEY)
    return _keep(keyed, found.where(~contaminated()))


def tokenize_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spec = tokenizer_json()
    return bpe.encode(docs, spec, decoded=True).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("BPE encoding and decoding", tokenize_stage),
]
#: No SQL expresses the classifier or the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result. A stage's own tables, and what its predecessor kept, are deleted once its result is stored."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs, path = stored_at(stage(spark, docs, sf_dir), name.split()[0].lower(), kept=True)
        if before:
            dropped(spark, before)
        before = path
    return docs
