"""Retrieval evaluation: per-query measures, their summary, comparison and gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ranking import overlaps, path_fits
from tessera.session import bounded


def per_query(results: DataFrame, queries: DataFrame, query: str, k: int = 10) -> DataFrame:
    """results (query, rank, relevant): hits at 1, 3, 5 and 10, reciprocal rank and nDCG at k. The ideal order is that of
    the returned labels themselves. Queries without results score 0."""
    rel = F.col("relevant").cast("int")
    within = results.where(F.col("rank") <= k)
    again = Window.partitionBy(query).orderBy(rel.desc(), "rank")
    scored = within.withColumn("ideal", F.row_number().over(again))
    hit = lambda n: F.max(F.when(F.col("rank") <= n, rel).otherwise(0))
    per = scored.groupBy(query).agg(
        *[hit(n).alias(f"hit{n}") for n in (1, 3, 5, 10)],
        F.min(F.when(rel == 1, F.col("rank"))).alias("first"),
        F.sum(rel / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.sum(rel / F.log2(F.col("ideal") + 1)).alias("idcg"),
    )
    out = queries.select(query).distinct().join(per, query, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(query, *[F.coalesce(f"hit{n}", F.lit(0)).cast("int").alias(f"hit{n}") for n in (1, 3, 5, 10)], F.round(zero(1 / F.col("first")), 6).alias("rr"), F.round(zero(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))), 6).alias("ndcg"))


def failure_bucket(hit_k: Column, file_hit: Column, top1_test: Column, top1_relevant: Column) -> Column:
    """Why a query failed: no exact hit is wrong-symbol if its file was found, else no-relevant-hit; then the first place is looked at."""
    return F.when(hit_k == 0, F.when(file_hit == 1, "wrong-symbol").otherwise("no-relevant-hit-top-k")).when(~top1_relevant & top1_test, "docs-tests-outranking-source").when(~top1_relevant, "wrong-file")


def summary(per: DataFrame, measures: list[str]) -> DataFrame:
    return per.agg(F.count("*").alias("queries"), *[F.round(F.avg(m), 6).alias(m) for m in measures])


def percentiles(df: DataFrame, value: str, points: list[float], by: list[str] | None = None) -> DataFrame:
    """Linear and nearest-rank percentiles."""
    aggs = []
    for p in points:
        name = f"p{round(p * 100)}"
        aggs += [F.round(F.percentile(value, F.lit(p)), 6).alias(name), F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"{name}_rank")]
    return df.groupBy(*(by or [])).agg(*aggs)


def compare(current: DataFrame, baseline: DataFrame, measures: list[str]) -> DataFrame:
    """(measure, current, baseline, change, change_percent): the percentage is 100 where a zero grew."""
    rows = current.select(*[F.col(m).cast("double").alias(m) for m in measures]).unpivot([], measures, "measure", "current")
    base = baseline.select(*[F.col(m).cast("double").alias(m) for m in measures]).unpivot([], measures, "measure", "baseline")
    change = F.col("current") - F.col("baseline")
    relative = F.when(F.col("baseline") == 0, F.when(F.col("current") == 0, 0.0).otherwise(100.0)).otherwise(change / F.col("baseline") * 100)
    return rows.join(base, "measure").select("measure", "current", "baseline", F.round(change, 6).alias("change"), F.round(relative, 6).alias("change_percent"))


def gate(comparison: DataFrame, max_drop: dict[str, float]) -> DataFrame:
    """Measures that fell by more than allowed."""
    limits = F.create_map(*[F.lit(x) for kv in max_drop.items() for x in kv])
    return comparison.withColumn("allowed_drop", F.try_element_at(limits, F.col("measure"))).withColumn("passes", F.coalesce(-F.col("change") <= F.col("allowed_drop"), F.lit(True)))

GOLDEN_ROWS = 100_000


def expected_hits(results: DataFrame, golden: DataFrame) -> DataFrame:
    """results (query_id, path, name, start_line, end_line, ...) with ``relevant``: the path fits one of the query's paths, and symbol
    and lines fit where the query expects any. golden: query_id, paths, symbol, first_line, last_line."""
    met = results.join(bounded(golden, GOLDEN_ROWS), "query_id", "left")
    path = F.exists(F.coalesce("paths", F.array().cast("array<string>")), lambda p: path_fits(F.col("path"), p))
    symbol = F.col("symbol").isNull() | F.col("name").eqNullSafe(F.col("symbol"))
    lines = F.col("first_line").isNull() | F.col("last_line").isNull() | overlaps(F.col("start_line"), F.col("end_line"), F.col("first_line"), F.col("last_line"))
    return met.withColumn("relevant", F.coalesce(path & symbol & lines, F.lit(False))).drop("paths", "symbol", "first_line", "last_line")


IDENTITY = ["path", "kind", "start_line", "end_line", "name"]


def same_results(left: DataFrame, right: DataFrame) -> DataFrame:
    """(query_id, place, other): where each result of one run stands in the other, by query and the five columns of IDENTITY,
    nulls being equal; null where it doesn't."""
    a, b = left.alias("a"), right.groupBy("query_id", *IDENTITY).agg(F.min("place").alias("place")).alias("b")
    on = F.col("a.query_id") == F.col("b.query_id")
    for c in IDENTITY:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, on, "left").select(F.col("a.query_id").alias("query_id"), F.col("a.place").alias("place"), F.col("b.place").alias("other"))
