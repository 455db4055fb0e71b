"""The chunk cache ages: it never stops taking chunks, however many there were before."""
import random

import public_tokenizers
import pyarrow as pa

from adlens.llm import bpe


def spec():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def passage(seed, n=400):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_chunks_are_reused_after_the_cache_was_full(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_CHUNK_BYTES", 200_000)
    encoder = bpe.ChunkEncoder(spec())
    texts = [passage(i) for i in range(120)]  # many times the room
    encoder.encode(pa.array(texts))
    assert encoder.chunk_bytes <= 200_000 and encoder.aged
    new = passage(999, 4000)
    before, missed = encoder.hits, encoder.misses
    got = encoder.encode(pa.array([f"head {i}. " + new for i in range(30)]))
    hits, misses = encoder.hits - before, encoder.misses - missed
    assert hits > 4 * misses  # of each copy after the first all chunks but the one at its head
    plain = encoder.tokenizer.encode_batch([f"head {i}. " + new for i in range(30)], add_special_tokens=False)
    assert got.to_pylist() == [e.ids for e in plain]


def test_chunks_that_come_up_stay(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_CHUNK_BYTES", 60_000)
    encoder = bpe.ChunkEncoder(spec())
    often = passage(1)
    for i in range(60):
        encoder.encode(pa.array([often, passage(1000 + i)]))
    hits = encoder.hits
    encoder.encode(pa.array([often]))
    assert encoder.hits > hits
