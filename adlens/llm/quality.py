"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's features are its hashed word unigrams and bigrams plus a few hashed shape marks of its words (final punctuation, case,
symbols, repetition of the word before), as shares of its words. A score is the sparse dot product of these with the weights,
through the logistic function. Training runs on the driver over a bounded labelled sample; scoring is one pass of Arrow batches.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import NOT_SPACE, flat, mix, owner, parts, per_text, word_hashes, words
from ._store import bounded_batches


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float


#: Classes of bytes, of which a word's shape is made: other, lower, upper, digit, ASCII symbol.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
_CLASS[0x80:] = 1


def rows(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and value of each feature, and the n + 1 offsets of the texts' features. No words: no features."""
    data, offsets = flat(texts)
    starts, ends, at = words(data, offsets, NOT_SPACE)
    n = len(starts)
    doc = owner(at)
    h = word_hashes(data, starts, ends, lower=True)
    b = np.uint64(buckets)
    same = np.zeros(n, bool)
    same[1:] = doc[1:] == doc[:-1]
    before = np.concatenate([h[:1] * np.uint64(0), h[:-1]]) if n else h
    pair = mix(before * np.uint64(31) + h)
    cls = _CLASS[data]
    head = cls[starts] if n else np.zeros(0, np.uint8)
    tail = cls[ends - 1] if n else np.zeros(0, np.uint8)
    second = cls[np.maximum(ends - 2, starts)] if n else head
    shape = head.astype(np.uint64) * np.uint64(25) + second.astype(np.uint64) * np.uint64(5) + tail.astype(np.uint64)
    shape = shape * np.uint64(2) + (same & (before == h)).astype(np.uint64)
    long = np.minimum(ends - starts, 40).astype(np.uint64)
    # Shapes and lengths have ranges of their own in front of the hashed n-grams.
    cols = [shape % np.uint64(256), np.uint64(256) + long, np.uint64(512) + h % (b - np.uint64(512)), np.uint64(512) + pair[same] % (b - np.uint64(512))]
    docs = [doc, doc, doc, doc[same]]
    weight = [1.0, 1.0, 0.5, 0.5]
    feature = np.concatenate(cols).astype(np.int64)
    who = np.concatenate(docs)
    size = np.maximum(np.diff(at), 1)
    value = np.concatenate([np.full(len(c), w) for c, w in zip(cols, weight, strict=True)]) / size[who]
    order = np.argsort(who, kind="stable")
    return feature[order], value[order], np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(texts)))]).astype(np.int64)


def _merged(feature: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, inverse = np.unique(feature, return_inverse=True)
    return ids, np.bincount(inverse, value, len(ids))


def train(texts: list[str], labels: list[int], *, buckets: int = 1 << 18, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 11) -> QualityModel:
    """FTRL-proximal over ``epochs`` shuffled passes. Without both labels the model is constant at the labels' share (0.5 if none)."""
    if len(set(labels)) < 2:
        share = (sum(labels) + 0.5) / (len(labels) + 1)
        return QualityModel(np.zeros(buckets), float(np.log(share / (1 - share))))
    bags = []
    for text in texts:  # one at a time: a text's raw features are many times its size
        ids, x = _merged(*rows(pa.array([text], pa.large_string()), buckets)[:2])
        bags.append((np.append(ids, buckets).astype(np.int32), np.append(x, 1.0).astype(np.float32)))
    z, n = np.zeros(buckets + 1), np.zeros(buckets + 1)
    y = np.asarray(labels, float)
    rare = np.where(y == (y.mean() < 0.5), 0.5 / min(y.mean(), 1 - y.mean()), 0.5 / max(y.mean(), 1 - y.mean()))

    def weight(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, x = bags[i]
            zi, ni = z[ids], n[ids]
            w = weight(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y[i]) * rare[i] * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[ids] = zi + g - sigma * w
            n[ids] = ni + g * g
    w = weight(z, n)
    return QualityModel(w[:-1], float(w[-1]))


def scores(texts: pa.Array, model: QualityModel) -> np.ndarray:
    """The logistic of the weighted features; a text without words has the bias alone."""
    feature, value, at = rows(texts, len(model.weights))
    return 1 / (1 + np.exp(-np.clip(per_text(model.weights[feature] * value, at) + model.bias, -35, 35)))


def score(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score. Null and empty texts get the model's bias. Whole texts are read.

    A score depends on the text and the model alone, so rows that repeat a text, or an id, score alike to the last bit. An empty
    table gives no rows; columns besides the two are ignored, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights, whatever the input

    def run(batches):
        for big in batches:
            for batch in parts(big, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores(batch.column("text"), held.value))], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def labelled_sample(docs: DataFrame, labels: DataFrame, *, per_label: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_bytes: int = 20_000) -> tuple[list[str], list[int]]:
    """About ``per_label`` texts of each label (all where there are fewer), picked by a hash of the id.

    Ids are drawn from ``labels`` and then looked up, so texts aren't shuffled; at most ``8 * per_label`` ids go to the driver and
    are broadcast. Labels other than 0 and 1 are ignored; an id with both counts as 0. Texts over ``max_bytes`` bytes aren't taken: this
    bounds the sample, not what is scored.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("label in (0, 1) and id is not null").groupBy("id").agg(F.min("label").alias("label"))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    wanted = F.lit(False)
    for label, n in counts.items():
        wanted = F.when(F.col("label") == label, draw < int((1 << 30) * min(1.0, per_label / n))).otherwise(wanted)
    ids = known.where(wanted).limit(8 * per_label).collect()
    if not ids:
        return [], []
    picked = F.broadcast(spark.createDataFrame(ids, known.schema))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    found = sorted(texts.join(picked, "id").select("text", "label", "id").limit(16 * per_label).collect(), key=lambda r: (r[1], str(r[2]), r[0]))
    return [r[0] for r in found], [r[1] for r in found]
