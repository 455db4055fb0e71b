"""Each stage of the pipeline against the contracts, on what its predecessor kept; and the registered queries."""
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from adlens.llm import queries

from . import brute as B

SF = "/root/testdata/sf0.001"


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], SF)
        assert sorted(out.columns) == sorted(columns)
        kept.append(spark.createDataFrame(out.select(*columns).collect(), docs.schema))
    start, good, unique, near, clean = map(texts, kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {i for i, _ in good}
    wrong = [i for i, q in labels.items() if (i in ids) != bool(q)]
    assert len(wrong) <= 0.03 * len(labels) and 0 < len(good) < len(start)
    last = {t or "": max(i for i, u in good if (u or "") == (t or "")) for _, t in good}
    assert sorted(i for i, _ in unique) == sorted(last.values())
    assert sorted(i for i, _ in near) == sorted(i for i, _, c in B.ngram_components(unique) if i == c)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(i for i, _ in clean) == sorted(r[0] for r in B.contamination(near, items) if not r[-1])
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in clean}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0


@pytest.mark.parametrize("name", [n for n in queries.queries() if n != "pipeline"])
def test_query_has_a_row_for_each_row(spark, name):
    table = "pages" if name == "op5_url_filter" else "documents"
    assert __spark_entry__.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_op7_op10_op8(spark):
    docs = texts(spark.read.parquet(f"{SF}/documents.parquet"))
    for name, want in (("op7_suffix_dedup", B.suffix_dedup), ("op10_substring_dedup", B.substring_dedup), ("op8_ngram_join", B.ngram_components)):
        assert sorted(tuple(r) for r in queries.queries()[name](spark, SF).collect()) == sorted(want(docs))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = queries.op2_langid(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in lang) >= 0.97 * len(lang)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    quality = queries.op9_quality(spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in quality) >= 0.97 * len(quality)
