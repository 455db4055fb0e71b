"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is the mean embedding of its hashed character n-grams (as bytes, A-Z lower-cased); a linear layer and a softmax give
the languages' probabilities. The rejection threshold is calibrated on rows that the training did not see. Scoring is one
pass of Arrow batches with the product of both layers, ``buckets`` x languages numbers, in the closure.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import LOWER, flat, mix, parts, per_text
from ._store import bounded_batches

#: Languages whose numbers of texts are broadcast to the rows.
MOST_BROADCAST = 100_000
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LangModel:
    labels: tuple[str, ...]
    table: np.ndarray  # buckets x labels: embeddings times the linear layer
    bias: np.ndarray
    temperature: float
    threshold: float
    orders: tuple[int, ...]


def _grams(data: np.ndarray, offsets: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram, and the documents' n + 1 offsets among them; a shorter text has none of that order."""
    low = LOWER[data].astype(np.uint64)
    n = max(0, len(low) - order + 1)
    h = np.full(n, order, np.uint64)
    for i in range(order):
        h = h * np.uint64(257) + low[i : i + n]
    h = (mix(h) % np.uint64(buckets)).astype(np.int64)
    sizes = np.maximum(np.diff(offsets) - order + 1, 0)
    keep = np.ones(n, bool)
    for back in range(1, order):  # those that reach into the next text
        at = offsets[1:-1] - back
        keep[at[(at >= 0) & (at < n)]] = False
    out = h[keep]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return out, ends


def features(texts: pa.Array, orders: tuple[int, ...], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    data, offsets = flat(texts)
    return [_grams(data, offsets, o, buckets) for o in orders]


def _mean(table: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Mean row of ``table`` over each text's n-grams; zeros for a text without any."""
    total, count = np.zeros((n, table.shape[1])), np.zeros(n)
    for grams, ends in found:
        for j in range(table.shape[1]):
            total[:, j] += per_text(table[:, j][grams], ends)
        count += np.diff(ends)
    return total / np.maximum(count, 1)[:, None]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], *, orders: tuple[int, ...] = (2, 3), buckets: int = 1 << 14, dim: int = 16, epochs: int = 8, rate: float = 2.0, seed: int = 7, accept: float = 0.99) -> LangModel:
    """Fit on labelled texts; a fifth of them calibrates temperature and rejection threshold.

    The threshold is the lowest probability at which at least ``accept`` of the calibration texts above it are right.
    """
    labels = tuple(sorted(set(langs)))
    if not labels:
        return LangModel((), np.zeros((buckets, 0)), np.zeros(0), 1.0, 0.0, orders)
    rng = np.random.default_rng(seed)
    y = np.array([labels.index(x) for x in langs])
    bags = []
    for text in texts:  # one at a time: a text's n-grams take many times its size
        ids, counts = np.unique(np.concatenate([g for g, _ in features(pa.array([text], pa.large_string()), orders, buckets)]), return_counts=True)
        bags.append((ids.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)))
    emb, out, bias = rng.normal(0, 0.1, (buckets, dim)), rng.normal(0, 0.1, (dim, len(labels))), np.zeros(len(labels))
    order = rng.permutation(len(y))
    held, seen = order[: len(y) // 5], order[len(y) // 5 :]
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        for i in rng.permutation(seen):
            ids, w = bags[i]
            if not len(ids):
                continue
            x = w @ emb[ids]
            z = x @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= lr * 0.1 * np.outer(x, p)
            bias -= lr * 0.01 * p
            emb[ids] -= lr * 10 * w[:, None] * back[None, :]
    table = emb @ out
    z = np.array([bags[i][1] @ table[bags[i][0]] for i in held]).reshape(len(held), len(labels)) + bias
    best_t, threshold = 1.0, 0.0
    if len(held):
        losses = {t: -np.mean(np.log(np.maximum(_softmax(z / t)[np.arange(len(held)), y[held]], 1e-12))) for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)}
        best_t = min(losses, key=losses.get)
        p = _softmax(z / best_t)
        top, right = p.max(axis=1), p.argmax(axis=1) == y[held]
        rank = np.argsort(-top)
        good = np.cumsum(right[rank]) / np.arange(1, len(rank) + 1) >= accept
        threshold = float(top[rank][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return LangModel(labels, table, bias, float(best_t), threshold, orders)


def predict(docs: DataFrame, model: LangModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score, rejected.

    ``und`` with score 0 for a null text, one without a letter, or an empty model. ``rejected`` says that the score is below
    the calibrated threshold; ``lang_pred`` still has the best guess. Whole texts are read, however long. A row's result depends on
    its text and the model alone, so rows that repeat a text or an id get the same. An empty table gives no rows; columns
    besides the two are ignored, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # buckets x labels numbers, whatever the input

    def run(batches):
        m = held.value
        for big in batches:
            for batch in parts(big, "text"):
                texts = batch.column("text")
                n = batch.num_rows
                letters = np.array([t is not None and _LETTER.search(t) is not None for t in texts.to_pylist()], bool)
                if m.labels:
                    p = _softmax((_mean(m.table, features(texts, m.orders, len(m.table)), n) + m.bias) / m.temperature)
                    best, score = p.argmax(axis=1), p.max(axis=1)
                    lang = np.where(letters, np.array(m.labels, object)[best], "und")
                    score = np.where(letters, score, 0.0)
                else:
                    lang, score = np.full(n, "und", object), np.zeros(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(score < m.threshold)],
                    ["id", "lang_pred", "score", "rejected"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def labelled_sample(docs: DataFrame, *, per_lang: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_bytes: int = 20_000) -> tuple[list[str], list[str]]:
    """About ``per_lang`` labelled texts of each language (all where there are fewer), picked by a hash of id and text.

    Every language of a text that isn't null is learned. Texts over ``max_bytes`` bytes aren't taken: with ``per_lang`` this bounds what
    the driver holds, at most four times ``per_lang`` texts a language. It bounds the sample, not what is scored.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    pool = named.where(F.col("lang").isNotNull() & (F.octet_length("text") <= max_bytes))
    counts = pool.groupBy("lang").count()  # a row a language
    languages = counts.count()
    if languages <= MOST_BROADCAST:  # else a join by language, with the same result
        counts = F.broadcast(counts)
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    drawn = pool.join(counts, "lang").where(draw < (1 << 30) * F.least(F.lit(1.0), F.lit(per_lang) / F.col("count")))
    found = drawn.select("text", "lang", "id").limit(4 * per_lang * max(1, languages)).collect()
    found = sorted(found, key=lambda r: (r[1], str(r[2]), r[0]))
    return [r[0] for r in found], [r[1] for r in found]
