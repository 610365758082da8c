"""Fusion, reranking and merging of ranked lists. Lanes are rows (query, item, lane, rank, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import ranking_tokens

RRF_K = 60


def reciprocal_rank_fusion(lanes: DataFrame, weights: dict[str, float], query: str, item: str, k: int = RRF_K) -> DataFrame:
    """(query, item, score): sum of weight / (k + rank), divided by what first places in all of the query's lanes would
    give. Lanes without rows or weight count in neither."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    live = lanes.withColumn("w", F.try_element_at(table, F.col("lane"))).where("w > 0")
    norm = live.groupBy(query, "lane").agg(F.max("w").alias("w")).groupBy(query).agg((F.sum("w") / (k + 1)).alias("norm"))
    sums = live.groupBy(query, item).agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("s"))
    return sums.join(norm, query).select(query, item, F.round(F.col("s") / F.col("norm"), 6).alias("score"))


def weighted_fusion(lanes: DataFrame, weights: dict[str, float], query: str, item: str) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    live = lanes.withColumn("w", F.try_element_at(table, F.col("lane"))).where("w > 0")
    return live.groupBy(query, item).agg(F.round(F.sum(F.col("w") * F.col("score")), 6).alias("score"))


def union_lanes(lanes: DataFrame, query: str, item: str) -> DataFrame:
    """One row per candidate with its greatest score; candidates of several lanes are hybrid."""
    sets = lanes.groupBy(query, item).agg(F.max("score").alias("score"), F.min("lane").alias("first"), F.max("lane").alias("last"))
    return sets.select(query, item, "score", F.when(F.col("first") == F.col("last"), F.col("first")).otherwise("hybrid").alias("lane"))


def tiered(tiers: DataFrame, query: str, item: str, limit: int) -> DataFrame:
    """Tiers (query, item, tier, rank) in order, each candidate where it stands first."""
    once = tiers.groupBy(query, item).agg(F.min(F.struct("tier", "rank")).alias("p")).select(query, item, "p.*")
    order = Window.partitionBy(query).orderBy("tier", "rank", item)
    return once.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= limit)


def top(df: DataFrame, query: str, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(query).orderBy(*order)).cast("bigint")).where(F.col(name) <= k)


def heuristic_boost(query_text: Column, name: Column, path: Column, kind: Column, is_test: Column) -> Column:
    """Additive boost of a candidate by overlap of query words with its name, path and type."""
    words = ranking_tokens(query_text)
    hits = lambda c: F.size(F.array_intersect(words, ranking_tokens(F.regexp_replace(F.coalesce(c, F.lit("")), r"([a-z0-9])([A-Z])", "$1 $2"))))
    coverage = F.when(F.size(words) > 0, hits(name) / F.size(words)).otherwise(0.0)
    return F.round(0.08 * hits(name) + 0.03 * hits(path) + 0.02 * hits(kind) + F.least(F.lit(0.12), 0.06 * coverage) + F.when(is_test, -0.12).otherwise(0.08), 6)


def consecutive_slices(df: DataFrame, query: str, rank: str, same: list[str], position: str) -> DataFrame:
    """Inside each run of neighbours in rank that agree in ``same``, rows stand by position; runs keep their places."""
    order = Window.partitionBy(query).orderBy(rank)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(order))
    runs = df.withColumn("_new", (changed | (F.row_number().over(order) == 1)).cast("int")).withColumn("run", F.sum("_new").over(order))
    again = Window.partitionBy(query).orderBy("run", F.col(position).asc_nulls_last(), rank)
    return runs.withColumn("place", F.row_number().over(again).cast("bigint")).drop("_new")
