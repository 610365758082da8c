"""Search queries. The query set is every row whose id is divisible by 20, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.operators import dense, fusion
from tessera.operators.sparse import SparseIndex, query_terms
from tessera.plans.search import Settings, hybrid, lanes
from tessera.session import cut, table

POSTINGS = r"""
raw AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_/.\\-]+')) AS w FROM documents),
rawn AS (SELECT doc_id, w, count(*) AS n FROM raw GROUP BY ALL),
camel AS (SELECT DISTINCT w, regexp_replace(regexp_replace(w, '([\p{Ll}0-9])(\p{Lu})', '\1 \2', 'g'), '(\p{Lu}+)(\p{Lu}\p{Ll})', '\1 \2', 'g') AS c FROM rawn),
variants AS (SELECT DISTINCT w, lower(v) AS term FROM (
  SELECT w, unnest(list_concat([w], regexp_split_to_array(w, '[/\\]'), regexp_split_to_array(w, '[/\\.]'), regexp_split_to_array(w, '[/\\_\-]'), regexp_split_to_array(w, '[/\\._\-]'), regexp_split_to_array(c, '[/\\._\- ]'))) AS v FROM camel) WHERE v <> ''),
post AS (SELECT doc_id, term, sum(n) AS tf FROM rawn JOIN variants USING (w) GROUP BY ALL),
lens AS (SELECT doc_id, sum(tf) AS len FROM post GROUP BY ALL),
stats AS (SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS n, avg(len) AS avglen FROM lens),
qterms AS (SELECT doc_id AS query_id, term, tf AS weight FROM post WHERE doc_id % 20 = 0 AND doc_id IN (SELECT doc_id FROM qset)),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (SELECT query_id, post.doc_id, sum(weight * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avglen))) AS raw
  FROM qterms JOIN post USING (term) JOIN df USING (term) JOIN lens ON lens.doc_id = post.doc_id CROSS JOIN stats GROUP BY ALL),
bms AS (SELECT query_id, doc_id, round(raw, 6) AS raw, round(round(raw, 6) / greatest(1.0, max(round(raw, 6)) OVER (PARTITION BY query_id)), 6) AS score FROM bm WHERE raw > 0)
"""
ALL_QUERIES = "WITH qset AS (SELECT doc_id FROM documents WHERE doc_id % 20 = 0),"


def _docs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", "text", "repo", "source", "layout")


def _terms(docs: DataFrame) -> DataFrame:
    return query_terms(docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text"), "query_id", "text")


@query(
    "bm25_topk",
    ALL_QUERIES + POSTINGS + "SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id)::BIGINT AS rank FROM bms) WHERE rank <= 10",
)
def bm25_topk(spark: SparkSession, root: str) -> DataFrame:
    docs = _docs(spark, root)
    return SparseIndex.of(docs, "doc_id", "text").search(_terms(docs), "query_id", 10)


@query(
    "bm25_repo_topk",
    ALL_QUERIES
    + POSTINGS.rstrip()
    + """, kept AS (SELECT query_id, doc_id, round(raw, 6) AS raw, max(round(raw, 6)) OVER (PARTITION BY query_id) AS top FROM bm b JOIN documents d USING (doc_id) WHERE d.repo = 'lumen-index' AND raw > 0)
SELECT * FROM (SELECT query_id, doc_id, round(raw / greatest(1.0, top), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id)::BIGINT AS rank FROM kept) WHERE rank <= 10""",
)
def bm25_repo_topk(spark: SparkSession, root: str) -> DataFrame:
    """Candidates of one repository only; the corpus figures stay global."""
    docs = _docs(spark, root)
    return SparseIndex.of(docs, "doc_id", "text").search(_terms(docs), "query_id", 10, docs.where("repo = 'lumen-index'").select("doc_id"))


@query(
    "corpus_figures",
    "WITH qset AS (SELECT doc_id FROM documents)," + POSTINGS + "SELECT n::BIGINT AS documents, (SELECT count(*) FROM post)::BIGINT AS postings, (SELECT count(DISTINCT term) FROM post)::BIGINT AS terms, round(avglen, 6) AS avg_length FROM stats",
)
def corpus_figures(spark: SparkSession, root: str) -> DataFrame:
    docs = _docs(spark, root)
    index = SparseIndex.of(docs, "doc_id", "text")
    terms = index.postings.groupBy("term").agg(F.count("*").alias("n")).agg(F.sum("n").cast("bigint").alias("postings"), F.count("*").cast("bigint").alias("terms"))
    sizes = index.docs.agg(F.round(F.avg("len"), 6).alias("avg_length"))  # one row each
    return terms.select(F.lit(index.total).cast("bigint").alias("documents"), "postings", "terms").join(sizes, how="cross")


COSINE = "SELECT q.vec_id AS query_id, v.vec_id AS doc_id, v.label, q.label AS wanted, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0"


def _vectors(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _query_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")


@query("cosine_topk", f"WITH c AS ({COSINE}) SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM c) WHERE rank <= 10")
def cosine_topk(spark: SparkSession, root: str) -> DataFrame:
    v = _vectors(spark, root)
    return dense.cosine_topk(_query_vectors(v), v, "query_id", "doc_id", "embedding", 10)


@query("quantised_topk", f"WITH c AS ({COSINE}) SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM c) WHERE rank <= 10")
def quantised_topk(spark: SparkSession, root: str) -> DataFrame:
    """As cosine_topk, over an index of one-byte codes written once and reranked by the vectors."""
    v = _vectors(spark, root)
    index = cut(dense.quantised(v, "doc_id", "embedding"))
    return dense.quantised_topk(_query_vectors(v), index, v, "query_id", "doc_id", "embedding", 10)


@query("cosine_label_topk", f"WITH c AS ({COSINE} AND q.label = v.label) SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM c) WHERE rank <= 5")
def cosine_label_topk(spark: SparkSession, root: str) -> DataFrame:
    """The filter holds inside the search: only rows of the query's label are met."""
    v = _vectors(spark, root)
    return dense.cosine_topk(_query_vectors(v), v, "query_id", "doc_id", "embedding", 5, ["label"])


HYBRID = (
    "WITH qset AS (SELECT doc_id FROM documents WHERE doc_id % 20 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)),"
    + POSTINGS.rstrip()
    + f""",
c AS ({COSINE} AND q.vec_id IN (SELECT doc_id FROM qset)),
sparse AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id) AS r0 FROM bms) WHERE r0 <= 51) WHERE query_id <> doc_id) WHERE rank <= 50),
near AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c) WHERE rank <= 50),
lanes AS (SELECT query_id, doc_id, 'bm25' AS lane, rank, score FROM sparse UNION ALL SELECT query_id, doc_id, 'dense', rank, score FROM near),
norm AS (SELECT query_id, sum(0.5) / 61 AS norm FROM (SELECT DISTINCT query_id, lane FROM lanes) GROUP BY ALL),
rrf AS (SELECT query_id, doc_id, round(sum(0.5 / (60 + rank)) / any_value(norm), 6) AS score, CASE WHEN min(lane) = max(lane) THEN min(lane) ELSE 'hybrid' END AS lane FROM lanes JOIN norm USING (query_id) GROUP BY ALL)
"""
)


def _hybrid_inputs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    docs, v = _docs(spark, root), _vectors(spark, root)
    queries = docs.where("doc_id % 20 = 0").join(v.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), "text")
    asked = _query_vectors(v).join(queries.select("query_id"), "query_id", "left_semi")
    return queries, docs, v, asked


@query("hybrid_search", HYBRID + "SELECT * FROM (SELECT query_id, doc_id, score, lane, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM rrf WHERE score >= 0.1) WHERE rank <= 10")
def hybrid_search(spark: SparkSession, root: str) -> DataFrame:
    return hybrid(*_hybrid_inputs(spark, root)).select("query_id", "doc_id", "score", "lane", "rank")


@query("rrf_fusion", HYBRID + "SELECT query_id, doc_id, score FROM rrf")
def rrf_fusion(spark: SparkSession, root: str) -> DataFrame:
    both = lanes(*_hybrid_inputs(spark, root), Settings())
    return fusion.reciprocal_rank_fusion(both, {"bm25": 0.5, "dense": 0.5}, "query_id", "doc_id")


LANES = "WITH l AS (SELECT DISTINCT query_id, chunk_id, base_score, score, reranker_score, coalesce(lane, 'none') AS lane FROM search_results),"


def _lanes(spark: SparkSession, root: str, *extra: str) -> DataFrame:
    return table(spark, root, "search_results").select("query_id", "chunk_id", "base_score", "score", "reranker_score", F.coalesce("lane", F.lit("none")).alias("lane"), *extra).distinct()


SCORED = LANES + """
u AS (SELECT query_id, chunk_id, 'base' AS lane, base_score AS score FROM l WHERE base_score IS NOT NULL UNION ALL SELECT query_id, chunk_id, 'fused', score FROM l WHERE score IS NOT NULL UNION ALL SELECT query_id, chunk_id, 'rerank', reranker_score FROM l WHERE reranker_score IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, lane ORDER BY score DESC, chunk_id)::BIGINT AS rank FROM u)
"""


def _score_lanes(spark: SparkSession, root: str) -> DataFrame:
    """The three scores as lanes, ranked. A query has tens of candidates."""
    from pyspark.sql import Window

    rows = _lanes(spark, root)
    long = rows.select("query_id", "chunk_id", F.explode(F.create_map(F.lit("base"), "base_score", F.lit("fused"), "score", F.lit("rerank"), "reranker_score")).alias("lane", "score")).where("score IS NOT NULL")
    return long.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "lane").orderBy(F.col("score").desc(), "chunk_id")).cast("bigint"))


@query("rrf_lane_dropout", SCORED + """, w AS (SELECT *, CASE lane WHEN 'base' THEN 0.2 WHEN 'fused' THEN 0.0 ELSE 0.6 END AS weight FROM r), n AS (SELECT query_id, sum(weight) / 61 AS norm FROM (SELECT DISTINCT query_id, lane, weight FROM w WHERE weight > 0) GROUP BY ALL)
SELECT query_id, chunk_id, round(sum(weight / (60 + rank)) / any_value(norm), 6) AS score FROM w JOIN n USING (query_id) WHERE weight > 0 GROUP BY ALL""")
def rrf_lane_dropout(spark: SparkSession, root: str) -> DataFrame:
    """A lane without weight, or without rows for a query, counts neither in the sum nor in its norm."""
    return fusion.reciprocal_rank_fusion(_score_lanes(spark, root), {"base": 0.2, "fused": 0.0, "rerank": 0.6}, "query_id", "chunk_id")


@query("weighted_fusion", SCORED + "SELECT query_id, chunk_id, round(sum(CASE lane WHEN 'base' THEN 0.3 ELSE 0.7 END * score), 6) AS score FROM r WHERE lane <> 'rerank' GROUP BY ALL")
def weighted_fusion(spark: SparkSession, root: str) -> DataFrame:
    return fusion.weighted_fusion(_score_lanes(spark, root), {"base": 0.3, "fused": 0.7}, "query_id", "chunk_id")


@query("lane_union_max", LANES + " x AS (SELECT query_id, chunk_id, lane, score FROM l WHERE score IS NOT NULL) SELECT query_id, chunk_id, max(score) AS score, CASE WHEN min(lane) = max(lane) THEN min(lane) ELSE 'hybrid' END AS lane FROM x GROUP BY ALL")
def lane_union_max(spark: SparkSession, root: str) -> DataFrame:
    return fusion.union_lanes(_lanes(spark, root).where("score IS NOT NULL"), "query_id", "chunk_id")


@query("tiered_merge", SCORED + """, t AS (SELECT query_id, chunk_id, CASE lane WHEN 'rerank' THEN 1 WHEN 'fused' THEN 2 ELSE 3 END AS tier, rank FROM r WHERE rank <= 8),
o AS (SELECT query_id, chunk_id, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY tier, rank) AS n FROM t) WHERE n = 1)
SELECT * FROM (SELECT query_id, chunk_id, tier::INTEGER AS tier, rank, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank, chunk_id)::BIGINT AS place FROM o) WHERE place <= 12""")
def tiered_merge(spark: SparkSession, root: str) -> DataFrame:
    tiers = _score_lanes(spark, root).where("rank <= 8").withColumn("tier", F.expr("CASE lane WHEN 'rerank' THEN 1 WHEN 'fused' THEN 2 ELSE 3 END")).select("query_id", "chunk_id", "tier", "rank")
    return fusion.tiered(tiers, "query_id", "chunk_id", 12)


@query("score_breakdown", SCORED + "SELECT query_id, chunk_id, max(CASE WHEN lane = 'base' THEN rank END) AS base_rank, max(CASE WHEN lane = 'fused' THEN rank END) AS fused_rank, max(CASE WHEN lane = 'rerank' THEN rank END) AS rerank_rank, count(*)::BIGINT AS lanes FROM r GROUP BY ALL")
def score_breakdown(spark: SparkSession, root: str) -> DataFrame:
    """Each candidate's rank in every lane beside each other."""
    rank = lambda lane: F.max(F.when(F.col("lane") == lane, F.col("rank"))).alias(f"{lane}_rank")
    return _score_lanes(spark, root).groupBy("query_id", "chunk_id").agg(rank("base"), rank("fused"), rank("rerank"), F.count("*").alias("lanes"))


@query("reranker_effect", SCORED + "SELECT query_id, chunk_id, a.rank AS rank_before, b.rank AS rank_after, CASE WHEN b.rank < a.rank THEN 'helped' WHEN b.rank > a.rank THEN 'hurt' ELSE 'neutral' END AS effect FROM (SELECT * FROM r WHERE lane = 'fused') a JOIN (SELECT * FROM r WHERE lane = 'rerank') b USING (query_id, chunk_id)")
def reranker_effect(spark: SparkSession, root: str) -> DataFrame:
    ranks = score_breakdown(spark, root).where("fused_rank IS NOT NULL AND rerank_rank IS NOT NULL")
    effect = F.when(F.col("rerank_rank") < F.col("fused_rank"), "helped").when(F.col("rerank_rank") > F.col("fused_rank"), "hurt").otherwise("neutral")
    return ranks.select("query_id", "chunk_id", F.col("fused_rank").alias("rank_before"), F.col("rerank_rank").alias("rank_after"), effect.alias("effect"))


@query("consecutive_slices", """
WITH l AS (SELECT DISTINCT query_id, chunk_id, file_path, start_line, score FROM search_results WHERE score IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM l),
m AS (SELECT *, CASE WHEN rank = 1 OR file_path IS DISTINCT FROM lag(file_path) OVER (PARTITION BY query_id ORDER BY rank) THEN 1 ELSE 0 END AS fresh FROM r),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY query_id ORDER BY rank) AS run FROM m)
SELECT query_id, chunk_id, rank::BIGINT AS rank, run::BIGINT AS run, row_number() OVER (PARTITION BY query_id ORDER BY run, start_line NULLS LAST, rank)::BIGINT AS place FROM g""")
def consecutive_slices(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "search_results").select("query_id", "chunk_id", "file_path", "start_line", "score").distinct().where("score IS NOT NULL")
    ranked = fusion.top(rows, "query_id", [F.col("score").desc(), F.col("chunk_id")], 1 << 40)
    return fusion.consecutive_slices(ranked, "query_id", "rank", ["file_path"], "start_line").select("query_id", "chunk_id", "rank", F.col("run").cast("bigint").alias("run"), "place")


@query("path_penalty_rerank", """
WITH l AS (SELECT DISTINCT query_id, chunk_id, file_path, score FROM search_results WHERE score IS NOT NULL),
p AS (SELECT *, score * CASE WHEN regexp_matches('/' || file_path, '/tests/|__tests__|\\.test\\.|\\.spec\\.|/docs/|README|CHANGELOG|\\.md') THEN 0.05 ELSE 1.0 END AS adjusted FROM l)
SELECT * FROM (SELECT query_id, chunk_id, round(adjusted, 6) AS adjusted, row_number() OVER (PARTITION BY query_id ORDER BY round(adjusted, 6) DESC, chunk_id)::BIGINT AS rank FROM p) WHERE rank <= 10""".replace("\\\\", "\\"))
def path_penalty_rerank(spark: SparkSession, root: str) -> DataFrame:
    """Tests and documents behind sources, as for a bug query."""
    from tessera.functions.text import is_test_or_doc

    rows = table(spark, root, "search_results").select("query_id", "chunk_id", "file_path", "score").distinct().where("score IS NOT NULL")
    adjusted = rows.withColumn("adjusted", F.round(F.col("score") * F.when(is_test_or_doc("file_path"), 0.05).otherwise(1.0), 6))
    return fusion.top(adjusted, "query_id", [F.col("adjusted").desc(), F.col("chunk_id")], 10).select("query_id", "chunk_id", "adjusted", "rank")


@query("best_result_per_file", "WITH l AS (SELECT DISTINCT query_id, chunk_id, file_path, score FROM search_results WHERE score IS NOT NULL) SELECT query_id, file_path, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file_path ORDER BY score DESC, chunk_id) AS n FROM l) WHERE n = 1")
def best_result_per_file(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "search_results").where("score IS NOT NULL").groupBy("query_id", "file_path").agg(F.min_by(F.struct("chunk_id", "score"), F.struct(-F.col("score"), "chunk_id")).alias("r"))
    return rows.select("query_id", "file_path", "r.chunk_id", "r.score")
