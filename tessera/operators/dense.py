"""Vector search of a query set against all rows, in blocks: exact, or over one-byte codes with exact reranking."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a block's vectors, and similarities a task holds at once.
BLOCK_BYTES, CELLS = 64 << 20, 4_000_000


def _matrix(column: pd.Series) -> np.ndarray:
    if isinstance(column.iloc[0], bytes):  # one-byte codes
        m = np.frombuffer(b"".join(column), np.int8).reshape(len(column), -1).astype(np.float64)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    m = np.array([np.asarray(v, np.float64) for v in column], np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def cosine_topk(queries: DataFrame, rows: DataFrame, query: str, item: str, vector: str, k: int, within: list[str] | None = None) -> DataFrame:
    """(query, item, score, rank): the k rows of greatest cosine for each query, itself left out where query and row ids
    are equal. within: columns in which query and row must agree (a filter inside the search). Queries and
    rows meet block by block, one matrix product a pair of blocks, each passing on k rows a query.

    Null, empty and all-zero vectors take no part."""
    within = within or []
    coded = isinstance(rows.schema[vector].dataType, T.BinaryType)
    usable = lambda d: d.where(F.col(vector).isNotNull() if coded else F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0))
    queries, rows = usable(queries), usable(rows)
    width = queries.agg(F.max(F.octet_length(vector) if coded else F.size(vector))).first()[0] or 1
    block_rows = max(1, BLOCK_BYTES // (8 * width))
    qb, rb = (max(1, math.ceil(d.count() / block_rows)) for d in (queries, rows))
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = queries.select(F.col(query).cast("bigint").alias("id"), F.lit(True).alias("asks"), F.col(vector).alias("v"), *within, spread(query, qb).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(rb - 1))).alias("rb"))
    r = rows.select(F.col(item).cast("bigint").alias("id"), F.lit(False).alias("asks"), F.col(vector).alias("v"), *within, F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"), spread(item, rb).alias("rb"))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy()
        out = {"q": np.array([], np.int64), "i": np.array([], np.int64), "score": np.array([], np.float64)}
        if not asks.any() or asks.all():
            return pd.DataFrame(out)
        qi, ri = pdf["id"].to_numpy()[asks], pdf["id"].to_numpy()[~asks]
        left, right = _matrix(pdf["v"][asks]), _matrix(pdf["v"][~asks])
        n = min(k, len(ri))
        # ties are settled by id: one whole number orders by the rounded score, then by the place of the id
        place = np.empty(len(ri), np.int64)
        place[np.argsort(ri, kind="stable")] = np.arange(len(ri))
        parts = []
        step = max(1, CELLS // len(ri))
        for at in range(0, len(qi), step):
            mine = qi[at : at + step]
            score = np.rint((left[at : at + step] @ right.T) * 1e6).astype(np.int64)
            key = score * len(ri) - place
            key[mine[:, None] == ri[None]] = -np.iinfo(np.int64).max
            best = np.argpartition(-key, n - 1, axis=1)[:, :n] if n < len(ri) else np.broadcast_to(np.arange(len(ri)), key.shape)
            rows_ = np.repeat(np.arange(len(mine)), n)
            cols = best.ravel()
            keep = key[rows_, cols] != -np.iinfo(np.int64).max
            parts.append(pd.DataFrame({"q": mine[rows_[keep]], "i": ri[cols[keep]], "score": score[rows_[keep], cols[keep]] / 1e6}))
        return pd.concat(parts)

    found = q.unionByName(r).groupBy(*within, "qb", "rb").applyInPandas(lambda pdf: block(pdf), "q bigint, i bigint, score double")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "i")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query), F.col("i").alias(item), "score", "rank")


def quantised(rows: DataFrame, key: str, vector: str, keep: list[str] | None = None) -> DataFrame:
    """(key, codes): vectors as one byte a dimension, a quarter of their size, to be written as an index. Null, empty and
    all-zero vectors have none."""
    keep = keep or []

    @F.pandas_udf("binary")
    def codes(vectors: pd.Series) -> pd.Series:
        out = []
        for v in vectors:
            x = np.asarray(v, np.float64)
            out.append(np.rint(x / np.abs(x).max() * 127).astype(np.int8).tobytes())
        return pd.Series(out)

    usable = rows.where(F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0))
    return usable.select(key, codes(F.col(vector).cast("array<float>")).alias("codes"), *keep)


def quantised_topk(queries: DataFrame, index: DataFrame, rows: DataFrame, query: str, item: str, vector: str, k: int, oversample: int = 4) -> DataFrame:
    """(query, item, score, rank) as cosine_topk: the best k x oversample by their codes (index), then by exact cosine of the
    vectors themselves (rows)."""
    near = cosine_topk(quantised(queries, query, vector), index, query, item, "codes", k * oversample)
    pairs = near.select(query, item).join(queries.select(query, F.col(vector).alias("_q")), query).join(rows.select(item, F.col(vector).alias("_v")), item)
    total = lambda a, b: F.aggregate(F.zip_with(F.col(a).cast("array<double>"), F.col(b).cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    score = F.round(total("_q", "_v") / F.sqrt(total("_q", "_q") * total("_v", "_v")), 6)
    order = Window.partitionBy(query).orderBy(F.col("score").desc(), item)
    ranked = pairs.select(query, item, score.alias("score")).withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.where(F.col("rank") <= k)
