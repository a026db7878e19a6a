"""Encoding of the whole corpus by byte-level byte-pair encoding with a public vocabulary.

Texts are split by the vocabulary's pattern; each piece's bytes form a doubly linked list of symbols whose neighbouring pairs wait in a priority
queue by merge rank. A merge unlinks the right symbol and queues the two new pairs; entries whose symbols have changed since are stale and
skipped. A piece of n bytes costs O(n log n), so one endless word is no trap. Decoding concatenates vocabulary strings.

The corpus is only mapped: no shuffle, and a task holds one Arrow batch. The vocabulary (a file of under MAX_VOCABULARY bytes, checked) is
broadcast once and parsed once a worker.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Fixed value: how the vocabulary splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY = 64_000_000
#: Pieces whose ids a worker remembers, and the longest such piece; a matter of speed only.
REMEMBERED, REMEMBERED_LENGTH = 400_000, 64


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.strings = {i: b for b, i in ranks.items()}
        self._known: dict[str, list[int]] = {}

    @classmethod
    def parse(cls, raw: bytes) -> Encoder:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a})

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        ranks, n = self.ranks, len(data)
        if n < 2:
            return [ranks[data]] if n else []
        symbol: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            if (rank := ranks.get(data[i : i + 2])) is not None:
                queue.append((rank, i, 2))
        heapq.heapify(queue)
        while queue:
            rank, i, length = heapq.heappop(queue)
            left = symbol[i]
            if left is None or (j := after[i]) >= n or len(left) + len(symbol[j]) != length or ranks.get(left + symbol[j]) != rank:
                continue  # stale: one of the two has been merged away or has grown
            symbol[i], symbol[j] = left + symbol[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks.get(symbol[i] + symbol[k])) is not None:
                    heapq.heappush(queue, (rank, i, len(symbol[i]) + len(symbol[k])))
            if (h := before[i]) >= 0 and (rank := ranks.get(symbol[h] + symbol[i])) is not None:
                heapq.heappush(queue, (rank, h, len(symbol[h]) + len(symbol[i])))
        out, i = [], 0
        while i < n:
            out.append(ranks[symbol[i]])
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        known, out = self._known, []
        for word in self.split(text):
            ids = known.get(word)
            if ids is None:
                ids = self.piece(word.encode("utf-8", "surrogatepass"))
                if len(word) <= REMEMBERED_LENGTH:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = ids
            out += ids
        return out

    def decode(self, ids) -> bytes:
        return b"".join(self.strings[i] for i in ids)


_encoders: dict[int, Encoder] = {}


def _encoder(raw: bytes) -> Encoder:
    key = hash(raw)
    if key not in _encoders:
        _encoders[key] = Encoder.parse(raw)
    return _encoders[key]


def _vocabulary(df: DataFrame, path: str | None):
    """The vocabulary at path, or where the session's spark.vecstrand.vocabulary says, or VOCABULARY."""
    path = path or df.sparkSession.conf.get("spark.vecstrand.vocabulary", VOCABULARY)
    if os.path.getsize(path) > MAX_VOCABULARY:
        raise ValueError(f"{path} is no vocabulary: more than {MAX_VOCABULARY} bytes")
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_corpus(df: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids) of every row. The text is encoded as it stands, the names of special tokens as ordinary text.

    Defined cases: a null or an empty text has no ids (an empty list, never null); blank texts are encoded like any other; a null id stays null;
    repeated rows stay repeated; other columns are ignored; an empty table gives no rows.
    """
    shared = _vocabulary(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value).encode
        for batch in batches:
            ends, parts = np.zeros(batch.num_rows + 1, np.int32), []
            for k, t in enumerate(batch.column(1).to_pylist()):
                ids = encode(t) if t else []
                ends[k + 1] = ends[k] + len(ids)
                parts.append(np.array(ids, np.int32))
            values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["i", "ids"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(df[id_column].alias("i"), df[text].alias("t")).mapInArrow(run, f"i {kind}, ids array<int>").withColumnRenamed("i", id_column)


def decode_corpus(df: DataFrame, id_column: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(id, text): the bytes of the ids, read as UTF-8. Null ids give a null text."""
    shared = _vocabulary(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _encoder(shared.value).decode
        for batch in batches:
            texts = [None if x is None else decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["i", "text"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(df[id_column].alias("i"), df[ids].alias("t")).mapInArrow(run, f"i {kind}, text string").withColumnRenamed("i", id_column)
