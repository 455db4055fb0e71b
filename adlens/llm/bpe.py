"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last ``WINDOW`` bytes cuts texts where it is 0 modulo ``DIVISOR``, so that passages which documents
share are cut alike. Each chunk is looked up by its bytes in the worker's cache and encoded only if it isn't there. Where two
chunks meet, the stretch around the cut is encoded again and grows until it begins and ends at white space: there the tokens
before and after agree with those of the whole text, as no token of these vocabularies crosses white space.

Cuts lie before an ASCII byte only, so that Unicode composition never looks across one. Caches are bounded and emptied when
full; they are a worker's own, because shipping shared chunks between executors would move more bytes than encoding them
reads. Nothing is shuffled.
"""
from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import flat, parts, prefix, slices
from ._store import bounded_batches

WINDOW, DIVISOR = 16, 512
#: Bounds of a worker's caches: distinct stretches, their tokens, and the bytes of cached chunks.
MOST_WORDS, MOST_TOKENS, MOST_CHUNK_BYTES = 500_000, 5_000_000, 16 << 20
PART_BYTES = 1 << 20
LINE = 40
#: Stretches that must be tokenized beside each other as they are alone.
PROBE = ("Some", "words", "of", "a", "text,", "42", "don't", "été")
_SPLIT = re.compile(r"[ \n\r\t]+")
_SPACE = frozenset(b" \n\r\t")


def _ragged(values: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of ``values`` one after the other, and where each ends."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(begin - (ends - count), count)], ends


class _Words(dict):
    """Number of each stretch between ASCII white space; new ones wait in ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class ChunkEncoder:
    """Encodes batches of texts exactly as ``tokenizers`` does, without special tokens added, truncation or padding."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        whole, *parts = (self.tokenizer.encode(t, add_special_tokens=False).ids for t in (" ".join(PROBE), *PROBE))
        if whole != [i for ids in parts for i in ids]:
            raise ValueError("a tokenizer whose tokens cross white space can't be encoded in stretches")
        self.hits = self.misses = self.repairs = 0
        self._clear()

    def _clear(self) -> None:
        self.words, self.chunks, self.aged, self.chunk_bytes = _Words(), {}, {}, 0
        self.ids, self.starts, self.uses = [np.zeros(0, np.int32)], np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Empty the caches but for stretches that were used three times or more, if those leave half of the room."""
        words, ids, starts, uses = list(self.words), self.ids[0], self.starts, self.uses
        self._clear()
        kept = np.flatnonzero(uses >= 3)
        if len(kept) > MOST_WORDS // 2 or not len(kept):
            return
        for i in kept.tolist():
            self.words[words[i]]
        self.words.fresh.clear()
        self.ids, ends = _ragged(ids, starts[kept], starts[kept + 1] - starts[kept])
        self.ids, self.starts, self.uses = [self.ids], np.concatenate([[0], ends]), np.ones(len(kept), np.int64)

    def _learn(self) -> None:
        """Encode the stretches that came up since the last call."""
        fresh, self.words.fresh = self.words.fresh, []
        if not fresh:
            return
        lines = [" ".join(fresh[i : i + LINE]) for i in range(0, len(fresh), LINE)]
        sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
        ids, counts = [], []
        for k, e in enumerate(self.tokenizer.encode_batch(lines, add_special_tokens=False)):
            begins = np.fromiter((a for a, _ in e.offsets), np.int64, len(e))
            mine = sizes[LINE * k : LINE * k + LINE]
            first = np.cumsum(mine + 1) - (mine + 1)
            counts.append(np.bincount(np.searchsorted(first, begins, "right") - 1, minlength=len(mine)))
            ids.append(np.array(e.ids, np.int32))
        self.ids = [np.concatenate([*self.ids, *ids])]
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(counts))])

    def _chunk(self, raw: bytes) -> tuple[np.ndarray, str, str, bool, bool]:
        """Numbers of its stretches, the first and last one's text, and whether white space opens and closes it."""
        got = self.chunks.get(raw)
        if got is not None:
            self.hits += 1
            return got
        got = self.aged.pop(raw, None)
        if got is None:
            self.misses += 1
            pieces = [x for x in _SPLIT.split(raw.decode("utf-8", "surrogatepass")) if x]
            numbers = np.fromiter(map(self.words.__getitem__, pieces), np.int64, len(pieces))
            got = numbers, pieces[0] if pieces else "", pieces[-1] if pieces else "", raw[0] in _SPACE, raw[-1] in _SPACE
        else:
            self.hits += 1
        # Two generations: when the younger has half of the room, the older's chunks that didn't come up since go.
        self.chunks[raw] = got
        self.chunk_bytes += 2 * len(raw) + 8 * len(got[0]) + 200
        if 2 * self.chunk_bytes > MOST_CHUNK_BYTES:
            self.chunks, self.aged, self.chunk_bytes = {}, self.chunks, 0
        return got

    def _document(self, raw: bytes, cuts: list[int]) -> list[np.ndarray]:
        """Numbers of the stretches of a text that is cut at ``cuts``."""
        out: list[np.ndarray] = []
        open_text, at = "", 0  # the stretch that the last chunk left open, taken back from ``out``
        for end in cuts:
            numbers, first, last, gap_before, gap_after = self._chunk(raw[at:end])
            at = end
            if not len(numbers):
                if open_text:
                    out.append(np.array([self.words[open_text]]))
                    open_text = ""
                continue
            if open_text and gap_before:
                out.append(np.array([self.words[open_text]]))
                open_text = ""
            if open_text:  # joined afresh: what ends the first chunk and begins the second is one stretch
                self.repairs += 1
                open_text += first
                if len(numbers) == 1 and not gap_after:
                    continue  # no agreement yet: the stretch goes on in the next chunk
                out.append(np.array([self.words[open_text]]))
                numbers, open_text = numbers[1:], ""
            if not gap_after and len(numbers):
                open_text = last
                numbers = numbers[:-1]
            out.append(numbers)
        if open_text:
            out.append(np.array([self.words[open_text]]))
        return out

    def encode(self, texts: pa.Array) -> pa.ListArray:
        data, offsets = flat(texts)
        if len(self.words) > MOST_WORDS or self.starts[-1] > MOST_TOKENS:
            self._forget()
        at = np.arange(WINDOW, len(data)) if len(data) > WINDOW else np.zeros(0, np.int64)
        if len(at):
            sums = prefix(data.astype(np.uint64) + np.uint64(1))
            hit = slices(sums, at - WINDOW, at) % np.uint64(DIVISOR) == 0
            cut = at[hit & (data[at] < 0x80)]
        else:
            cut = at
        whole = data.tobytes()
        docs: list[np.ndarray] = []
        sizes = np.zeros(len(offsets) - 1, np.int64)
        bounds = np.searchsorted(cut, offsets)
        for i in range(len(sizes)):
            a, b = int(offsets[i]), int(offsets[i + 1])
            if a == b:
                continue
            cuts = [int(c) - a for c in cut[bounds[i] : bounds[i + 1]] if a < c < b]
            got = self._document(whole[a:b], [*cuts, b - a])
            docs += got
            sizes[i] = sum(map(len, got))
        self._learn()
        numbers = np.concatenate([np.zeros(0, np.int64), *docs])
        used = np.bincount(numbers, minlength=len(self.words))
        used[: len(self.uses)] += self.uses
        self.uses = used
        ids, ends = _ragged(self.ids[0], self.starts[numbers], self.starts[numbers + 1] - self.starts[numbers])
        per_doc = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        return pa.ListArray.from_arrays(pa.array(per_doc.astype(np.int32)), pa.array(ids, pa.int32()))


_encoders: dict[int, ChunkEncoder] = {}


def _encoder(spec: str) -> ChunkEncoder:
    key = hash(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = ChunkEncoder(spec)
    return _encoders[key]


def _decoder(spec: str) -> Callable[[list[int]], str]:
    """The library's decode with special tokens kept: where the tokenizer names no decoder, its tokens joined by a space."""
    if json.loads(spec).get("decoder") is None:
        encoder = _encoder(spec)
        if not hasattr(encoder, "table"):
            encoder.table = [encoder.tokenizer.id_to_token(i) or "" for i in range(encoder.tokenizer.get_vocab_size(True))]
        return lambda ids: " ".join(map(encoder.table.__getitem__, ids))
    tokenizer = _encoder(spec).tokenizer
    return lambda ids: tokenizer.decode(ids, skip_special_tokens=False)


def _decoded(column: pa.ListArray, decoder: Callable[[list[int]], str]) -> pa.Array:
    offsets, values = column.offsets.to_pylist(), column.values
    return pa.array(
        [
            decoder(values.slice(offsets[i], offsets[i + 1] - offsets[i]).to_numpy(zero_copy_only=False).tolist()) if valid else None
            for i, valid in enumerate(column.is_valid().to_pylist())
        ],
        pa.string(),
    )


def encode(docs: DataFrame, tokenizer_json: str, *, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row per input row: id, ids array<int>, and with ``decoded`` the string that ``decode`` makes of them.

    A null or empty text has no ids; whole texts are read, however long. ``tokenizer_json`` is the content of a ``tokenizers``
    file; one whose tokens cross white space is refused in the tasks. Rows that repeat an id or a text are encoded each for itself, an
    empty table gives no rows, and columns besides the two are ignored.
    """
    bounded_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a file of fixed size
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value)
        decoder = _decoder(spec.value) if decoded else None
        for big in batches:
            for batch in parts(big, "text", PART_BYTES):
                ids = encoder.encode(batch.column("text"))
                more = [_decoded(ids, decoder)] if decoder else []
                yield pa.RecordBatch.from_arrays([batch.column("id"), ids, *more], ["id", "ids", *["decoded"] * len(more)])

    schema = f"id {kind}, ids array<int>" + ", decoded string" * decoded
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer_json: str, *, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the column ``decoded``: the library's decode with special tokens kept. Null ids give null."""
    spec = encoded.sparkSession.sparkContext.broadcast(tokenizer_json)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, _decoded(part.column(ids_col), decoder)], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
