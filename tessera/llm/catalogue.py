"""Named queries of this subpackage, each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue import Query
from tessera.llm import borda, bpe, credentials, mixing, neighbours, sentences, splitting, syntax
from tessera.session import table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


@query(
    "p2_found",
    """SELECT DISTINCT pending_id FROM pending_chunks p LEFT JOIN chunk_limits l ON lower(trim(p.language)) = lower(l.language)
WHERE strlen(p.text) > coalesce(l.max_bytes, (SELECT max_bytes FROM chunk_limits WHERE language = 'default'))""",
)
def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return splitting.oversized_ids(table(spark, root, "pending_chunks"), table(spark, root, "chunk_limits"), "pending_id")


@query("p2_pieces")
def p2_pieces(spark: SparkSession, root: str) -> DataFrame:
    return splitting.split_items(table(spark, root, "pending_chunks"), table(spark, root, "chunk_limits"), "pending_id")


BORDA_CTES = """
WITH d AS (SELECT query_id, chunk_id, max(base_score) AS a, max(score) AS b, max(reranker_score) AS c FROM search_results GROUP BY ALL),
l AS (SELECT query_id, chunk_id, unnest(['a', 'b', 'c']) AS kind, unnest([a, b, c]) AS v FROM d),
g AS (SELECT * FROM l WHERE v IS NOT NULL),
r AS (SELECT query_id, chunk_id, (count(*) OVER (PARTITION BY query_id, kind) + 1) / 2.0
  - (rank() OVER (PARTITION BY query_id, kind ORDER BY v DESC) + (count(*) OVER (PARTITION BY query_id, kind, v) - 1) / 2.0) AS points FROM g),
p AS (SELECT d.query_id, d.chunk_id, round(coalesce(sum(r.points), 0), 6)::DOUBLE AS points FROM d LEFT JOIN r USING (query_id, chunk_id) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, chunk_id)::BIGINT AS place FROM p)
"""


@query("p5_found", BORDA_CTES + "SELECT query_id, chunk_id FROM o WHERE place <= 5")
def p5_found(spark: SparkSession, root: str) -> DataFrame:
    points = borda.borda_points(table(spark, root, "search_results"), "query_id", "chunk_id")
    return borda.borda_top(points, "query_id", "chunk_id", 5).select("query_id", "chunk_id")


@query("p5_ranking", BORDA_CTES + "SELECT query_id, chunk_id, points, place FROM o")
def p5_ranking(spark: SparkSession, root: str) -> DataFrame:
    points = borda.borda_points(table(spark, root, "search_results"), "query_id", "chunk_id")
    return borda.borda_ranking(points, "query_id", "chunk_id")


@query("p8_ids")
def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return bpe.token_ids(table(spark, root, "documents"))


def _vectors(spark: SparkSession, root: str) -> DataFrame:
    digest = F.lower(F.btrim("content_hash", F.lit(" \t\r\n")))
    return table(spark, root, "chunk_embeddings").select(digest.alias("content_hash"), "embedding", "model").where("content_hash <> ''")


@query(
    "p6_found",
    """WITH v AS (SELECT DISTINCT lower(trim(content_hash)) AS h, model, embedding::DOUBLE[] AS e FROM chunk_embeddings WHERE embedding IS NOT NULL),
u AS (SELECT h, model, e FROM v WHERE list_dot_product(e, e) > 0)
SELECT DISTINCT a.h AS content_hash_a, b.h AS content_hash_b FROM u a JOIN u b ON a.model = b.model AND a.h < b.h
WHERE list_cosine_similarity(a.e, b.e) >= 0.9""",
)
def p6_found(spark: SparkSession, root: str) -> DataFrame:
    pairs, members = neighbours.neighbours(_vectors(spark, root), "content_hash", "embedding", "model", k=10, floor=0.9)
    found = neighbours.similar_keys(pairs, members, "content_hash")
    return found.select(F.col("a").alias("content_hash_a"), F.col("b").alias("content_hash_b"))


@query("p6_neighbours")
def p6_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """The 10 most similar vectors of every distinct vector, as classes named by their least content hash.
    The vectors have next to no structure below 0.9, so all lists are scanned."""
    pairs, members = neighbours.neighbours(_vectors(spark, root), "content_hash", "embedding", "model", k=10, list_size=16384, share=1.0, rerank=400)
    names = members.groupBy("class").agg(F.min("content_hash").alias("name"), F.min("model").alias("model"), F.count("*").alias("n_rows"))
    a = names.select(F.col("class").alias("a"), F.col("name").alias("content_hash"), "model", "n_rows")
    b = names.select(F.col("class").alias("b"), F.col("name").alias("similar_hash"))
    return pairs.join(a, "a").join(b, "b").select("content_hash", "model", "n_rows", F.col("place").cast("int").alias("place"), "similar_hash", F.round("similarity", 5).alias("similarity"))


@query(
    "p6_recall",
    """WITH v AS (SELECT DISTINCT model || '/' || len(embedding) AS model, embedding::DOUBLE[] AS e FROM chunk_embeddings WHERE embedding IS NOT NULL AND trim(content_hash) <> '')
SELECT model, true AS at_least_nine_tenths FROM v WHERE list_dot_product(e, e) > 0 GROUP BY model""",
)
def p6_recall(spark: SparkSession, root: str) -> DataFrame:
    """Whether p6_neighbours finds at least nine tenths of the ten nearest, by brute force for every class whose id is divisible by 20."""
    vectors = _vectors(spark, root)
    pairs, _ = neighbours.neighbours(vectors, "content_hash", "embedding", "model", k=10, list_size=16384, share=1.0, rerank=400)
    units = neighbours.unit_vectors(vectors, "content_hash", "embedding", "model")
    exact = neighbours.brute_force(units, 10).select("a", "b", "model")
    met = exact.join(pairs.select("a", "b", F.lit(1).alias("found")), ["a", "b"], "left")
    return met.groupBy("model").agg((F.avg(F.coalesce("found", F.lit(0))) >= 0.9).alias("at_least_nine_tenths"))


@query("p6_members")
def p6_members(spark: SparkSession, root: str) -> DataFrame:
    """Which class of p6_neighbours, named by its least content hash, each content hash and model belongs to."""
    units = neighbours.unit_vectors(_vectors(spark, root), "content_hash", "embedding", "model").select(F.xxhash64("model", "unit").alias("class"), F.col("k").alias("content_hash"), "model")
    names = units.groupBy("class").agg(F.min("content_hash").alias("name"))
    return units.join(names, "class").select("content_hash", "model", F.col("name").alias("class_hash")).distinct()


@query("p9_mix")
def p9_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(table(spark, root, "documents"), table(spark, root, "mix_targets"))[0]


@query("p9_shares")
def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(table(spark, root, "documents"), table(spark, root, "mix_targets"))[1]


@query("p7_found")
def p7_found(spark: SparkSession, root: str) -> DataFrame:
    texts = credentials.hashed(table(spark, root, "chunk_embeddings"), "chunk_text")
    paths = credentials.hashed(table(spark, root, "chunks"), "file_path")
    return credentials.credential_lines(texts, paths, "content_hash", "chunk_text")


@query("p7_redacted")
def p7_redacted(spark: SparkSession, root: str) -> DataFrame:
    texts = credentials.hashed(table(spark, root, "chunk_embeddings"), "chunk_text")
    paths = credentials.hashed(table(spark, root, "chunks"), "file_path")
    return credentials.redact(texts, paths, "content_hash", "chunk_text")


@query("p4_found")
def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return syntax.failing(syntax.current_files(table(spark, root, "source_files")))


@query(
    "p4_json_found",
    r"""WITH f AS (SELECT file_id, arg_max(file_path, scanned_at) AS file_path, arg_max(content, scanned_at) AS content FROM source_files GROUP BY file_id),
s AS (SELECT file_id, content, regexp_replace(content, '"(\\.|[^"\\])*"', '""', 'g') AS bare FROM f WHERE lower(file_path) LIKE '%.json' AND content IS NOT NULL)
SELECT file_id FROM s WHERE NOT json_valid(ltrim(content, chr(65279))) OR regexp_matches(bare, ',\s*[\]}]|NaN|Infinity|//|/\*')""",
)
def p4_json_found(spark: SparkSession, root: str) -> DataFrame:
    """p4_found for the one language whose validity SQL can tell as well (json_valid and what it lets pass: trailing commas,
    NaN and comments)."""
    return syntax.failing(syntax.current_files(table(spark, root, "source_files")).where("language = 'json'"))


@query("p4_rates")
def p4_rates(spark: SparkSession, root: str) -> DataFrame:
    files = syntax.current_files(table(spark, root, "source_files"))
    return syntax.failure_rates(files, syntax.failing(files), table(spark, root, "index_stats"))


@query("p10_found")
def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return sentences.sentence_units(table(spark, root, "documents"))
