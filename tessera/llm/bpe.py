"""Token ids of a public byte-level BPE vocabulary, merged with a segment tree.

A pre-token's symbols are leaves; a segment tree over the ranks of adjacent pairs has the leftmost
lowest-rank pair at its root. A merge takes it, relinks its neighbours and updates up to three leaves in
log(n) steps, until the root holds no mergeable pair: n log n for a pre-token of n bytes, so that a
run of a million letters is no trap.

Defined cases: a null or empty text has an empty list of ids; marker-like strings are plain text;
lone surrogates, which no UTF-8 holds, count as a question mark; rows keep their identifiers, repeated ones too.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's published pre-token pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = 1 << 62
#: Entries a worker keeps of pre-tokens already encoded; longer pre-tokens are never kept.
KEPT, KEPT_LENGTH = 400_000, 48
#: Tokens of one batch handed back to Spark.
FLUSH = 1_000_000


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    n = len(word)
    if n == 1:
        return [ranks[word]]
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    parts: list[bytes] = [word[i : i + 1] for i in range(n)]
    following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get(word[i : i + 2])
        if r is not None:
            tree[size + i] = (r << 32) | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int) -> None:
        j = following[i]
        r = get(parts[i] + parts[j]) if j < n else None
        i += size
        tree[i] = NONE if r is None else (r << 32) | (i - size)
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
            i >>= 1

    while (root := tree[1]) < NONE:
        i = root & 0xFFFFFFFF
        j = following[i]
        parts[i] += parts[j]
        k = following[i] = following[j]
        if k < n:
            previous[k] = i
        if j < n - 1:
            following[j] = n  # gone: its leaf becomes empty
            put(j)
        put(i)
        if previous[i] >= 0:
            put(previous[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[parts[i]])
        i = following[i]
    return out


class Encoder:
    """One vocabulary, with the pre-tokens met so far."""

    def __init__(self, path: str = VOCABULARY) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(PATTERN).findall
        self.kept: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        ids = merge(raw, self.ranks) if whole is None else [whole]
        if len(word) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            get, word = self.kept.get, self.word
            for w in self.split(text):
                out += get(w) or word(w)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_ids(docs: DataFrame, item: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(item, ids array<int>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode

        def flush(ids: list, values: list, ends: list, kind: pa.DataType) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(values, np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), lists], ["id", "ids"])

        for batch in batches:
            kind = batch.schema.field(0).type
            ids: list = []
            values: list[int] = []
            ends = [0]
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(key)
                values += encode(t.as_py())
                ends.append(len(values))
                if len(values) >= FLUSH:
                    yield flush(ids, values, ends, kind)
                    ids, values, ends = [], [], [0]
            if ids:
                yield flush(ids, values, ends, kind)

    kind = docs.schema[item].dataType.simpleString()
    return docs.select(F.col(item).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", item)


def token_counts(docs: DataFrame, keys: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """keys and n_tokens of every row, without its text."""
    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            n = pa.array([len(encode(t.as_py())) for t in batch.column(len(keys))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], n], [*keys, "n_tokens"])

    return docs.select(*keys, F.col(text).alias("_t")).mapInArrow(run, f"{kinds}, n_tokens bigint")
