"""Encoding of whole corpora with a public byte-level BPE vocabulary.

Method: contiguous rank array. A text is cut into words by the vocabulary's pattern. For a short word two small
arrays hold the boundaries of its parts and the ranks of adjacent pairs; the smallest rank is scanned for, its inner
boundary deleted and the ranks of the two neighbours refreshed, until no pair has a rank. Words longer than ``LONG``
bytes, where repeated scans would be quadratic, are merged with a heap over a linked list to the same result.

One narrow pass in Arrow batches; nothing is shuffled, but where the scan has fewer tasks than cores. Each Python
worker holds the vocabulary and a bounded memory of the words it met.

Defined cases: null and empty texts give ``[]``; strings that look like special tokens are ordinary text; repeated
rows give repeated rows; white space is encoded as it is.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graftline.runtime import spread

VOCABULARIES = "/opt/tokenizers"
#: The words of the byte_bpe_50k vocabulary; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 400
MEMORY, MEMORY_BYTES = 1 << 16, 48
NONE = 1 << 40


class Encoder:
    """Ranks and words of one vocabulary file (lines of base64 token and rank)."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.words = regex.compile(pattern)
        self.memory: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memory, out = self.memory, []
        for word in self.words.findall(text):
            ids = memory.get(word)
            if ids is None:
                piece = word.encode()
                ids = self.word(piece)
                if len(piece) <= MEMORY_BYTES:
                    if len(memory) >= MEMORY:
                        memory.clear()
                    memory[word] = ids
            out += ids
        return out

    def word(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self._scan(piece) if len(piece) <= LONG else self._heap(piece)

    def _scan(self, piece: bytes) -> list[int]:
        get = self.ranks.get
        cuts = list(range(len(piece) + 1))
        adjacent = [get(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
        while adjacent:
            least = min(adjacent)
            if least == NONE:
                break
            i = adjacent.index(least)
            del cuts[i + 1], adjacent[i]
            if i < len(adjacent):
                adjacent[i] = get(piece[cuts[i] : cuts[i + 2]], NONE)
            if i:
                adjacent[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], NONE)
        ranks = self.ranks
        return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]

    def _heap(self, piece: bytes) -> list[int]:
        get, n = self.ranks.get, len(piece)
        after, before = list(range(1, n + 2)), list(range(-1, n))  # part starting at i ends where after[i] starts
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2], NONE)) != NONE]
        heapq.heapify(queue)
        alive = bytearray([1]) * n
        while queue:
            _, i, end = heapq.heappop(queue)
            if not alive[i] or after[i] >= n or after[after[i]] != end:
                continue
            gone = after[i]
            alive[gone] = 0
            after[i] = end
            if end < n:
                before[end] = i
                if (r := get(piece[i : after[end]], NONE)) != NONE:
                    heapq.heappush(queue, (r, i, after[end]))
            if i and (r := get(piece[before[i] : end], NONE)) != NONE:
                heapq.heappush(queue, (r, before[i], end))
        ranks, out, i = self.ranks, [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per Python worker, which Spark reuses between tasks."""
    return Encoder(path)


def vocabulary(name: str, folder: str = VOCABULARIES) -> str:
    return f"{folder}/{name}.tiktoken"


def encode(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            lists = [enc.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, lists)])
            flat = np.fromiter((i for ids in lists for i in ids), dtype=np.int32, count=int(ends[-1]))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    schema = T.StructType([documents.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spread(documents.select(key, text)).mapInArrow(run, schema)


def count(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens) of every row, without its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            sizes = pa.array([len(enc.encode(t)) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], names=[key, "tokens"])

    schema = T.StructType([documents.schema[key], T.StructField("tokens", T.LongType())])
    return spread(documents.select(key, text)).mapInArrow(run, schema)
