"""Evaluation of retrieval runs: relevance is an equal label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.operators import dense, evaluate
from tessera.queries.retrieval import COSINE, _query_vectors, _vectors
from tessera.session import table

METRICS = f"""
WITH c AS ({COSINE}), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c) WHERE rank <= 10),
l AS (SELECT query_id, rank, CASE WHEN label = wanted THEN 1 ELSE 0 END AS rel FROM r), i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS ideal FROM l),
per AS (SELECT query_id, max(CASE WHEN rank <= 1 THEN rel ELSE 0 END)::INTEGER AS hit1, max(CASE WHEN rank <= 3 THEN rel ELSE 0 END)::INTEGER AS hit3, max(CASE WHEN rank <= 5 THEN rel ELSE 0 END)::INTEGER AS hit5, max(rel)::INTEGER AS hit10,
  round(coalesce(1.0 / min(CASE WHEN rel = 1 THEN rank END), 0), 6)::DOUBLE AS rr, round(CASE WHEN sum(rel) > 0 THEN sum(rel / log2(rank + 1)) / sum(rel / log2(ideal + 1)) ELSE 0 END, 6) AS ndcg FROM i GROUP BY query_id)
"""
MEASURES = ["hit1", "hit3", "hit5", "hit10", "rr", "ndcg"]


def run(spark: SparkSession, root: str) -> DataFrame:
    v = _vectors(spark, root)
    found = dense.cosine_topk(_query_vectors(v), v, "query_id", "doc_id", "embedding", 10)
    labels = v.select("doc_id", "label")
    asked = _query_vectors(v).select("query_id", F.col("label").alias("wanted"))
    return found.join(labels, "doc_id").join(asked, "query_id").select("query_id", "rank", (F.col("label") == F.col("wanted")).alias("relevant"))


def per_query(spark: SparkSession, root: str) -> DataFrame:
    return evaluate.per_query(run(spark, root), _query_vectors(_vectors(spark, root)).select("query_id"), "query_id")


@query("eval_per_query", METRICS + "SELECT * FROM per")
def eval_per_query(spark: SparkSession, root: str) -> DataFrame:
    return per_query(spark, root)


@query("eval_summary", METRICS + "SELECT count(*)::BIGINT AS queries, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in MEASURES) + " FROM per")
def eval_summary(spark: SparkSession, root: str) -> DataFrame:
    return evaluate.summary(per_query(spark, root), MEASURES)


@query("latency_percentiles", "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{round(p * 100)}, quantile_disc(value, {p}) AS p{round(p * 100)}_rank" for p in (0.5, 0.95, 0.99)) + " FROM events GROUP BY ALL")
def latency_percentiles(spark: SparkSession, root: str) -> DataFrame:
    return evaluate.percentiles(table(spark, root, "events"), "value", [0.5, 0.95, 0.99], ["event_type"])


RUNS = "WITH a AS (SELECT avg(base_score) AS base, avg(score) AS fused, count(reranker_score)::DOUBLE AS reranked FROM (SELECT DISTINCT query_id, chunk_id, base_score, score, reranker_score FROM search_results WHERE lane = 'hybrid')), b AS (SELECT avg(base_score) AS base, avg(score) AS fused, count(reranker_score)::DOUBLE AS reranked FROM (SELECT DISTINCT query_id, chunk_id, base_score, score, reranker_score FROM search_results WHERE lane = 'semantic')), u AS (" + " UNION ALL ".join(f"SELECT '{m}' AS measure, a.{m} AS current, b.{m} AS baseline FROM a, b" for m in ("base", "fused", "reranked")) + "), d AS (SELECT measure, current, baseline, current - baseline AS change, CASE WHEN baseline = 0 THEN CASE WHEN current = 0 THEN 0.0 ELSE 100.0 END ELSE (current - baseline) / baseline * 100 END AS change_percent FROM u)"


def _comparison(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "search_results").select("query_id", "chunk_id", "base_score", "score", "reranker_score", "lane").distinct()
    figures = lambda lane: rows.where(F.col("lane") == lane).agg(F.avg("base_score").alias("base"), F.avg("score").alias("fused"), F.count("reranker_score").cast("double").alias("reranked"))
    return evaluate.compare(figures("hybrid"), figures("semantic"), ["base", "fused", "reranked"])


@query("compare_runs", RUNS + "SELECT measure, round(current, 6) AS current, round(baseline, 6) AS baseline, round(change, 6) AS change, round(change_percent, 6) AS change_percent FROM d")
def compare_runs(spark: SparkSession, root: str) -> DataFrame:
    return _comparison(spark, root).withColumns({c: F.round(c, 6) for c in ("current", "baseline")})


@query("budget_gate", RUNS + "SELECT measure, round(change, 6) AS change, CASE measure WHEN 'base' THEN 0.05 WHEN 'fused' THEN 0.03 END::DOUBLE AS allowed_drop, coalesce(-round(change, 6) <= CASE measure WHEN 'base' THEN 0.05 WHEN 'fused' THEN 0.03 END, true) AS passes FROM d")
def budget_gate(spark: SparkSession, root: str) -> DataFrame:
    return evaluate.gate(_comparison(spark, root), {"base": 0.05, "fused": 0.03}).select("measure", "change", "allowed_drop", "passes")


SWEEP = """
WITH u AS (SELECT DISTINCT query_id, chunk_id, base_score, score FROM search_results), r AS (SELECT query_id, chunk_id, CASE WHEN base_score IS NULL THEN NULL ELSE row_number() OVER (PARTITION BY query_id ORDER BY base_score DESC NULLS LAST, chunk_id) END AS br, CASE WHEN score IS NULL THEN NULL ELSE row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, chunk_id) END AS fr FROM u),
g AS (SELECT unnest([10, 60, 100]) AS k), w AS (SELECT unnest([0.25, 0.5, 0.75]) AS w),
x AS (SELECT query_id, k, w, max(round(coalesce(w / (k + br), 0) + coalesce((1 - w) / (k + fr), 0), 9)) AS best FROM r CROSS JOIN g CROSS JOIN w GROUP BY ALL)
SELECT k::INTEGER AS k, w::DOUBLE AS w, round(avg(best), 6) AS mean_best, count(*)::BIGINT AS queries FROM x GROUP BY ALL
"""


@query("param_sweep", SWEEP)
def param_sweep(spark: SparkSession, root: str) -> DataFrame:
    """The grid (nine rows) is exploded beside each candidate, and each candidate's ranks are made once."""
    from pyspark.sql import Window

    u = table(spark, root, "search_results").select("query_id", "chunk_id", "base_score", "score").distinct()
    rank = lambda c: F.when(F.col(c).isNotNull(), F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(c).desc_nulls_last(), "chunk_id")))
    r = u.select("query_id", rank("base_score").alias("br"), rank("score").alias("fr"))
    grid = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k in (10, 60, 100) for w in (0.25, 0.5, 0.75)])
    x = r.select("query_id", "br", "fr", F.explode(grid).alias("g")).select("query_id", "br", "fr", "g.*")
    part = lambda w, c: F.coalesce(w / (F.col("k") + F.col(c)), F.lit(0.0))
    best = x.groupBy("query_id", "k", "w").agg(F.max(F.round(part(F.col("w"), "br") + part(1 - F.col("w"), "fr"), 9)).alias("best"))
    return best.groupBy("k", "w").agg(F.round(F.avg("best"), 6).alias("mean_best"), F.count("*").alias("queries"))


@query("cost_estimate", "SELECT source, count(*)::BIGINT AS files, sum(strlen(text))::BIGINT AS bytes, sum(greatest(1, ceil(strlen(text) / 400.0)))::BIGINT AS chunks, round(sum(greatest(1, ceil(strlen(text) / 400.0))) * 150 / 1e6 * 0.02, 8)::DOUBLE AS price FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def cost_estimate(spark: SparkSession, root: str) -> DataFrame:
    chunks = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / 400))
    out = table(spark, root, "documents").where("text IS NOT NULL").groupBy("source").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).cast("bigint").alias("bytes"), F.sum(chunks).cast("bigint").alias("chunks"))
    return out.withColumn("price", F.round(F.col("chunks") * 150 / 1e6 * 0.02, 8))
