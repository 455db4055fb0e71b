"""The registered queries of this package and their SQL: each applies one operator, with production parameters, to a whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, conversations, decontam, exact_dedup, langid, line_dedup, ngram_join, oracles, quality, simhash, substring_dedup, suffix_dedup, url_filter

#: Fixed rules: verdict, host, path.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Bounds of the training samples: texts a language, and texts a label.
PER_LANG, PER_LABEL = 600, 1500
WINDOW_WORDS = 13
#: Ranges of ids in which the documents enter the fingerprint index.
INDEX_BATCHES = 3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def tokenizer_json() -> str:
    """Of the public tokenizer; read on the driver and sent to the executors."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), tokenizer_json(), decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(*langid.labelled_sample(docs.where(remainder(5) != 0), per_lang=PER_LANG))
    return langid.predict(docs, model).select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=WINDOW_WORDS)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def contaminated():
    """Judged by the words of ``decontam.contamination``: any are hit, and at least one in twenty."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), width=50)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"), n=5, percent=80)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(_table(spark, sf_dir, "documents"), width=50, batches=INDEX_BATCHES)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.QualityModel:
    return quality.train(*quality.labelled_sample(docs, labels.where(remainder(4) != 2), per_label=PER_LABEL))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_model(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"), radius=4)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(_table(spark, sf_dir, "conversations"))).withColumnRenamed("id", "conv_id")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), longest=5, least=100, percent=100, top=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_bpe": op1_bpe,
        "op2_langid": op2_langid,
        "op3_line_dedup": op3_line_dedup,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_url_filter": op5_url_filter,
        "op6_decontam": op6_decontam,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_ngram_join": op8_ngram_join,
        "op9_quality": op9_quality,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_simhash": op11_simhash,
        "op12_conversations": op12_conversations,
        "op13_collocations": op13_collocations,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """SQL can't express the tokenizer, the classifiers, or bounded edits and byte windows in reasonable time; tests cover those."""
    return {
        "op4_exact_dedup": oracles.EXACT,
        "op5_url_filter": oracles.url_filter(URL_RULES, url_filter.SUFFIXES),
        "op6_decontam": oracles.CONTAMINATION,
        "op8_ngram_join": oracles.COMPONENTS,
        "op10_substring_dedup": oracles.SUBSTRING,
        "op12_conversations": oracles.conversations(),
        "op13_collocations": oracles.COLLOCATIONS,
    }
