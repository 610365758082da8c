"""The whole search as one plan over a table of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import dense, fusion, rerank
from tessera.operators.sparse import SparseIndex, query_terms


@dataclass
class Settings:
    lane_size: int = 50
    limit: int = 10
    rrf_k: int = fusion.RRF_K
    weights: tuple[float, float] = (0.5, 0.5)
    min_score: float = 0.1


def lanes(queries: DataFrame, docs: DataFrame, vectors: DataFrame, query_vectors: DataFrame, s: Settings) -> DataFrame:
    """(query_id, doc_id, lane, rank, score) of the sparse and the dense lane."""
    index = SparseIndex.of(docs, "doc_id", "text")
    sparse = index.search(query_terms(queries, "query_id", "text"), "query_id", s.lane_size + 1)
    sparse = fusion.top(sparse.where("query_id <> doc_id").drop("rank"), "query_id", [F.col("score").desc(), F.col("doc_id")], s.lane_size)
    near = dense.cosine_topk(query_vectors, vectors, "query_id", "doc_id", "embedding", s.lane_size)
    columns = ["query_id", "doc_id", "lane", "rank", "score"]
    return sparse.withColumn("lane", F.lit("bm25")).select(columns).unionByName(near.withColumn("lane", F.lit("dense")).select(columns))


def hybrid(queries: DataFrame, docs: DataFrame, vectors: DataFrame, query_vectors: DataFrame, s: Settings | None = None) -> DataFrame:
    """Both lanes fused by reciprocal rank, cut at min_score, the best ``limit`` of each query with the lane they came from."""
    s = s or Settings()
    both = lanes(queries, docs, vectors, query_vectors, s)
    fused = fusion.reciprocal_rank_fusion(both, {"bm25": s.weights[0], "dense": s.weights[1]}, "query_id", "doc_id", s.rrf_k)
    source = fusion.union_lanes(both, "query_id", "doc_id").select("query_id", "doc_id", "lane")
    ranked = fused.where(F.col("score") >= s.min_score).join(source, ["query_id", "doc_id"])
    return fusion.top(ranked, "query_id", [F.col("score").desc(), F.col("doc_id")], s.limit)


def rank_hybrid(lanes_: DataFrame, meta: DataFrame, weights: dict[str, float], limit: int, top_n: int, task: str = "general", preference: str = "auto", rrf_k: int = fusion.RRF_K) -> DataFrame:
    """(query_id, id, score, place): lanes (query_id, id, lane, rank, score) fused by reciprocal rank, over-fetched, and reranked
    deterministically by query, name, path and kind (meta: query_id, query, id, path, name, kind)."""
    fused = fusion.reciprocal_rank_fusion(lanes_, weights, "query_id", "id", rrf_k)
    size = max(4 * limit, 3 * top_n, 6 * limit)
    head = fusion.top(fused, "query_id", [F.col("score").desc(), F.col("id")], size, "position")
    rows = head.join(meta, ["query_id", "id"])
    order = rerank.deterministic(rows, top_n, task, preference)
    return rows.select("query_id", "id", "score").join(order.select("query_id", "id", "place"), ["query_id", "id"]).where(F.col("place") <= limit)


def rank_one_lane(lane: DataFrame, meta: DataFrame, limit: int, top_n: int, task: str = "semantic", preference: str = "source") -> DataFrame:
    """The same for one lane whose scores stay: what a search by a snippet of code gives."""
    head = fusion.top(lane, "query_id", [F.col("score").desc(), F.col("id")], 4 * limit, "position")
    rows = head.select("query_id", "id", "score", "position").join(meta, ["query_id", "id"])
    order = rerank.deterministic(rows, top_n, task, preference)
    return rows.select("query_id", "id", "score").join(order.select("query_id", "id", "place"), ["query_id", "id"]).where(F.col("place") <= limit)
