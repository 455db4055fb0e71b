"""Stages of the pipeline on rows without ids and on rows that repeat an id."""
from collections import Counter

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def rows(spark, docs, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_text_verdicts_are_of_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage in (P.quality_stage, P.decontaminate_stage):
        good = {r.text for r in stage(spark, docs, SF).collect()}
        bad = [r.text for r in docs.collect() if r.text not in good]
        good = sorted(x for x in good if x)
        assert good and bad
        # Each id, and null, has a text that passes and one that doesn't; the labels' own ids aren't used.
        pairs = [(10**9, good[0]), (10**9, bad[0]), (None, good[1]), (None, bad[0]), (None, good[1])]
        more = docs.select("doc_id", "text", "lang", "source", "n_chars")
        # With all documents beside them, the classifier learns the same.
        out = kept(stage(spark, more.unionByName(rows(spark, docs, pairs)), SF))
        assert out[(10**9, good[0])] == 1 and out[(10**9, bad[0])] == 0 and out[(None, good[1])] == 2 and out[(None, bad[0])] == 0


def test_exact_keeps_one_row_of_each_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pairs = [(None, "a"), (None, "a"), (None, "b"), (7, "b"), (7, "b"), (7, "c"), (7, "d"), (3, "d"), (None, None), (None, "")]
    out = kept(P.exact_stage(spark, rows(spark, docs, pairs), SF))
    assert {(i, t or "") for i, t in out} == {(None, "a"), (7, "b"), (7, "c"), (7, "d"), (None, "")} and sum(out.values()) == 5


def test_near_keeps_one_row_of_each_component(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = lambda k: [f"w{k}x{j}" for j in range(100)]
    near = lambda k: (" ".join(words(k)), " ".join([*words(k)[:99], "other"]))
    (a, a2), (b, b2), (c, c2), (d, d2) = map(near, range(4))
    pairs = [(None, a), (None, a2), (None, a), (5, b), (5, b2), (5, c), (9, c2), (8, d), (None, d2), (8, d), (4, ""), (4, ""), (None, "")]
    out = kept(P.near_stage(spark, rows(spark, docs, pairs), SF))
    assert sum(out.values()) == 6
    by = Counter("a" if t in (a, a2) else "b" if t in (b, b2) else "c" if t in (c, c2) else "d" if t in (d, d2) else "" for _, t in out)
    assert by == {"a": 1, "b": 1, "c": 1, "d": 1, "": 2}
    assert (5, c) in out and (8, d) in out


def test_last_stage_decodes(spark):
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = P.tokenize_stage(spark, docs, SF).collect()
    assert len(out) == 40
    for r in out:
        assert r.decoded_sha256 == hashlib.sha256(library.decode(r.ids, skip_special_tokens=False).encode()).hexdigest()
