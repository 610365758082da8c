"""Queries over chunks, branches and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.functions.text import content_id
from tessera.operators import catalog as c
from tessera.session import clean_key, table

BLANK = "chr(9)||chr(10)||chr(13)||' '"
LIVE = f"""
WITH k AS (SELECT * REPLACE (lower(trim(chunk_id, {BLANK})) AS chunk_id, lower(trim(content_hash, {BLANK})) AS content_hash, list_sort(symbol_aliases) AS symbol_aliases) FROM chunks),
gone AS (SELECT DISTINCT chunk_id FROM k WHERE deleted_at IS NOT NULL),
lc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST, content_hash DESC NULLS LAST, embedding_input_hash DESC NULLS LAST, repo DESC, file_path DESC, start_line DESC, end_line DESC, node_type DESC NULLS LAST, name DESC NULLS LAST, language DESC, chunk_kind DESC NULLS LAST, symbol_kind DESC NULLS LAST) AS rn
  FROM k WHERE chunk_id NOT IN (SELECT chunk_id FROM gone)) WHERE rn = 1),
bm AS (SELECT DISTINCT lower(trim(branch)) AS branch, lower(trim(chunk_id, {BLANK})) AS chunk_id FROM branch_chunks)
"""


def live(spark: SparkSession, root: str) -> DataFrame:
    return c.live_chunks(table(spark, root, "chunks"))


def members(spark: SparkSession, root: str) -> DataFrame:
    return c.members(table(spark, root, "branch_chunks"))


@query("live_chunks", LIVE + "SELECT chunk_id, content_hash, repo, file_path, start_line, end_line, name, language FROM lc")
def live_chunks(spark: SparkSession, root: str) -> DataFrame:
    return live(spark, root).select("chunk_id", "content_hash", "repo", "file_path", "start_line", "end_line", "name", "language")


@query("hard_filter_ids", LIVE + r"SELECT chunk_id FROM lc WHERE lower(file_path) LIKE '%.ts' AND (file_path = 'src' OR starts_with(file_path, 'src/')) AND lower(language) = 'typescript' AND (regexp_matches(file_path, '^src/.*_[^/]*\.ts$') OR regexp_matches(file_path, '^(?:.*/)?src/.*_[^/]*\.ts$'))")
def hard_filter_ids(spark: SparkSession, root: str) -> DataFrame:
    keep = c.hard_filter(extension="ts", directory="src", language="typescript", glob="src/**_*.ts")
    return live(spark, root).where(keep).select("chunk_id")


@query("file_on_branch", LIVE + "SELECT bm.branch, file_path, count(*)::BIGINT AS chunks, min(start_line) AS first_line, max(end_line) AS last_line FROM lc JOIN bm USING (chunk_id) GROUP BY ALL")
def file_on_branch(spark: SparkSession, root: str) -> DataFrame:
    joined = members(spark, root).join(live(spark, root), "chunk_id")
    return joined.groupBy("branch", "file_path").agg(F.count("*").alias("chunks"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"))


@query("symbol_lookup", LIVE + """, keys AS (SELECT DISTINCT chunk_id, unnest(list_concat(CASE WHEN name IS NULL THEN [] ELSE [name] END, coalesce(symbol_aliases, []))) AS key FROM lc),
wanted AS (SELECT DISTINCT symbol_name AS wanted FROM pending_chunks WHERE symbol_name IS NOT NULL),
exact AS (SELECT DISTINCT wanted, chunk_id, 'exact' AS how FROM wanted JOIN keys ON wanted = key)
SELECT * FROM exact UNION ALL SELECT DISTINCT wanted, chunk_id, 'ignoring case' FROM wanted JOIN keys ON lower(wanted) = lower(key) WHERE wanted NOT IN (SELECT wanted FROM exact)""")
def symbol_lookup(spark: SparkSession, root: str) -> DataFrame:
    wanted = table(spark, root, "pending_chunks").select(F.col("symbol_name").alias("wanted")).where("wanted IS NOT NULL").distinct()
    return c.named(live(spark, root), wanted)


@query("branch_delta", LIVE + """, base AS (SELECT chunk_id FROM bm WHERE branch = 'main')
SELECT branch, sum(CASE WHEN base.chunk_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS added, ((SELECT count(*) FROM base) - sum(CASE WHEN base.chunk_id IS NULL THEN 0 ELSE 1 END))::BIGINT AS removed
FROM bm LEFT JOIN base USING (chunk_id) WHERE branch <> 'main' GROUP BY branch""")
def branch_delta(spark: SparkSession, root: str) -> DataFrame:
    return c.delta(members(spark, root), "main")


@query("known_files", "SELECT DISTINCT repo, file_path FROM source_files UNION SELECT DISTINCT repo, file_path FROM chunks")
def known_files(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "source_files").select("repo", "file_path").unionByName(table(spark, root, "chunks").select("repo", "file_path")).distinct()


@query("missing_embeddings", LIVE + """SELECT w.embedding_input_hash, m.model FROM (SELECT DISTINCT embedding_input_hash FROM lc WHERE embedding_input_hash IS NOT NULL) w CROSS JOIN (SELECT DISTINCT model FROM chunk_embeddings) m
WHERE NOT EXISTS (SELECT 1 FROM chunk_embeddings e WHERE e.embedding_input_hash = w.embedding_input_hash AND e.model = m.model)""")
def missing_embeddings(spark: SparkSession, root: str) -> DataFrame:
    vectors = table(spark, root, "chunk_embeddings")
    return c.missing_vectors(live(spark, root), vectors, vectors.select("model").distinct()).select("embedding_input_hash", "model")


@query("gc_orphans", LIVE + """, o AS (SELECT chunk_id FROM lc WHERE chunk_id NOT IN (SELECT chunk_id FROM bm WHERE chunk_id IS NOT NULL)),
kept AS (SELECT DISTINCT embedding_input_hash AS h FROM lc WHERE chunk_id IN (SELECT chunk_id FROM bm) AND embedding_input_hash IS NOT NULL)
SELECT 'chunk' AS kind, chunk_id AS id FROM o UNION ALL SELECT DISTINCT 'vector', embedding_input_hash FROM chunk_embeddings WHERE embedding_input_hash NOT IN (SELECT h FROM kept)""")
def gc_orphans(spark: SparkSession, root: str) -> DataFrame:
    return c.collect_garbage(live(spark, root), members(spark, root), table(spark, root, "chunk_embeddings"))


@query("catalog_stats", LIVE + "SELECT (SELECT count(*) FROM lc)::BIGINT AS chunks, (SELECT count(*) FROM bm)::BIGINT AS memberships, (SELECT count(DISTINCT branch) FROM bm)::BIGINT AS branches, (SELECT count(DISTINCT embedding_input_hash) FROM chunk_embeddings)::BIGINT AS vectors")
def catalog_stats(spark: SparkSession, root: str) -> DataFrame:
    one = lambda df, name, what: df.agg(what.cast("bigint").alias(name))
    m = members(spark, root).agg(F.count("*").cast("bigint").alias("memberships"), F.count_distinct("branch").cast("bigint").alias("branches"))
    v = one(table(spark, root, "chunk_embeddings"), "vectors", F.count_distinct("embedding_input_hash"))
    return one(live(spark, root), "chunks", F.count("*")).join(m, how="cross").join(v, how="cross").select("chunks", "memberships", "branches", "vectors")


@query("best_enclosing_chunk", LIVE + """, s AS (SELECT DISTINCT 'p' || pending_id AS symbol, repo, file_path, symbol_name AS name, start_line, end_line FROM pending_chunks WHERE end_line IS NOT NULL UNION ALL SELECT chunk_id, repo, file_path, name, start_line, end_line FROM lc WHERE name IS NOT NULL)
SELECT symbol, chunk_id FROM (SELECT s.symbol, lc.chunk_id, row_number() OVER (PARTITION BY s.symbol ORDER BY CASE WHEN lc.name IS NOT DISTINCT FROM s.name THEN 0 ELSE 1 END, lc.end_line - lc.start_line, lc.chunk_id) AS n
FROM s JOIN lc ON s.repo = lc.repo AND s.file_path = lc.file_path AND lc.start_line <= s.start_line AND lc.end_line >= s.end_line) WHERE n = 1""")
def best_enclosing_chunk(spark: SparkSession, root: str) -> DataFrame:
    """The chunk around each symbol: of the pending ones and of those that name a chunk."""
    chunks = live(spark, root)
    columns = ["symbol", "repo", "file_path", "name", "start_line", "end_line"]
    pending = table(spark, root, "pending_chunks").where("end_line IS NOT NULL").select(F.concat(F.lit("p"), "pending_id").alias("symbol"), "repo", "file_path", F.col("symbol_name").alias("name"), "start_line", "end_line").distinct()
    named = chunks.where("name IS NOT NULL").withColumnRenamed("chunk_id", "symbol").select(columns)
    return c.best_enclosing(pending.unionByName(named), chunks, ["repo", "file_path"], "symbol")


@query("call_site_chunk", LIVE + """SELECT query_id, hit, chunk_id FROM (SELECT r.query_id, r.chunk_id AS hit, lc.chunk_id, row_number() OVER (PARTITION BY r.query_id, r.chunk_id ORDER BY lc.end_line - lc.start_line, lc.chunk_id) AS n
FROM (SELECT DISTINCT query_id, chunk_id, file_path, start_line FROM search_results) r JOIN lc ON r.file_path = lc.file_path AND r.start_line BETWEEN lc.start_line AND lc.end_line) WHERE n = 1""")
def call_site_chunk(spark: SparkSession, root: str) -> DataFrame:
    """The innermost chunk around a line: a point-in-interval join on the file."""
    r = table(spark, root, "search_results").select("query_id", F.col("chunk_id").alias("hit"), F.col("file_path").alias("f"), F.col("start_line").alias("line")).distinct()
    ch = live(spark, root).select("chunk_id", "file_path", "start_line", "end_line")
    inside = (F.col("f") == F.col("file_path")) & F.col("line").between(F.col("start_line"), F.col("end_line"))
    best = F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "chunk_id")).alias("b")
    return r.join(ch, inside).groupBy("query_id", "hit").agg(best).select("query_id", "hit", "b.chunk_id")


@query("chunk_cap", LIVE + """, o AS (SELECT repo, file_path, chunk_id, row_number() OVER (PARTITION BY repo, file_path ORDER BY CASE WHEN name IS NOT NULL THEN 0 WHEN node_type IS NOT NULL THEN 1 ELSE 2 END, start_line, chunk_id) AS n FROM lc)
SELECT repo, file_path, sum(CASE WHEN n <= 5 THEN 1 ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN n > 5 THEN 1 ELSE 0 END)::BIGINT AS dropped FROM o GROUP BY ALL""")
def chunk_cap(spark: SparkSession, root: str) -> DataFrame:
    """A cap of five chunks a file, named ones first, with the number dropped: the operator's report, not a shortcut."""
    priority = F.when(F.col("name").isNotNull(), 0).when(F.col("node_type").isNotNull(), 1).otherwise(2)
    n = F.row_number().over(Window.partitionBy("repo", "file_path").orderBy(priority, "start_line", "chunk_id"))
    rows = live(spark, root).withColumn("n", n)
    return rows.groupBy("repo", "file_path").agg(F.count_if(F.col("n") <= 5).alias("kept"), F.count_if(F.col("n") > 5).alias("dropped"))


@query("coverage_report", LIVE + "SELECT repo, language, count(*)::BIGINT AS chunks, count(DISTINCT file_path)::BIGINT AS files, count(name)::BIGINT AS named, round(avg(end_line - start_line + 1), 6) AS avg_lines FROM lc GROUP BY ALL")
def coverage_report(spark: SparkSession, root: str) -> DataFrame:
    return live(spark, root).groupBy("repo", "language").agg(F.count("*").alias("chunks"), F.count_distinct("file_path").alias("files"), F.count("name").alias("named"), F.round(F.avg(F.col("end_line") - F.col("start_line") + 1), 6).alias("avg_lines"))


@query("chunk_texts", "SELECT embedding_input_hash, min(chunk_text) AS chunk_text FROM chunk_embeddings GROUP BY ALL")
def chunk_texts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunk_embeddings").groupBy("embedding_input_hash").agg(F.min("chunk_text").alias("chunk_text"))


@query("latest_vectors", "SELECT embedding_input_hash, model, max(created_at) AS created_at, arg_max(len(embedding), created_at)::INTEGER AS dimension FROM (SELECT DISTINCT embedding_input_hash, model, created_at, embedding FROM chunk_embeddings WHERE embedding IS NOT NULL) GROUP BY ALL")
def latest_vectors(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "chunk_embeddings").where("embedding IS NOT NULL").select("embedding_input_hash", "model", "created_at", F.size("embedding").alias("dimension"))
    return c.upsert_latest(rows, ["embedding_input_hash", "model"], ["created_at"])


@query("unfinished_files", """
WITH done AS (SELECT repo, branch, count(*) AS runs, max(started_at) AS last FROM index_stats WHERE coalesce(failed_chunks, 0) = 0 GROUP BY ALL),
need AS (SELECT DISTINCT repo, branch FROM index_stats), stages AS (SELECT unnest(['chunk', 'embed', 'index', 'graph']) AS stage),
state AS (SELECT repo, branch, 'chunk' AS stage FROM need UNION ALL SELECT repo, branch, 'embed' FROM done UNION ALL SELECT repo, branch, 'index' FROM done WHERE runs > 1 UNION ALL SELECT repo, branch, 'graph' FROM done WHERE runs > 1)
SELECT n.repo, n.branch, count(*)::BIGINT AS missing_stages FROM need n CROSS JOIN stages s LEFT JOIN state t ON t.repo = n.repo AND t.branch = n.branch AND t.stage = s.stage WHERE t.stage IS NULL GROUP BY ALL""")
def unfinished_files(spark: SparkSession, root: str) -> DataFrame:
    """Work that lacks one of the four stages; the stages are exploded beside each unit instead of a cross join."""
    stats = table(spark, root, "index_stats")
    done = stats.where("coalesce(failed_chunks, 0) = 0").groupBy("repo", "branch").agg(F.count("*").alias("runs"))
    need = stats.select("repo", "branch").distinct()
    stages = F.array(*[F.lit(s) for s in ("chunk", "embed", "index", "graph")])
    have = F.when(F.col("runs") > 1, F.array(F.lit("embed"), F.lit("index"), F.lit("graph"))).otherwise(F.array(F.lit("embed")))
    state = need.select("repo", "branch", F.lit("chunk").alias("stage")).unionByName(done.select("repo", "branch", F.explode(have).alias("stage")))
    wanted = need.withColumn("stage", F.explode(stages))
    return wanted.join(state, ["repo", "branch", "stage"], "left_anti").groupBy("repo", "branch").agg(F.count("*").alias("missing_stages"))


@query("chunk_ids", "SELECT pending_id, 'chunk_' || substr(md5(concat_ws(':', file_path, start_line, text)), 1, 16) AS made_id, md5(text) AS made_hash FROM pending_chunks GROUP BY ALL")
def chunk_ids(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "pending_chunks").select("pending_id", content_id("chunk_", "file_path", "start_line", "text").alias("made_id"), F.md5(F.col("text").cast("binary")).alias("made_hash")).distinct()


@query("stage_digest", f"SELECT repo, file_path, md5(string_agg(line, chr(10) ORDER BY line)) AS digest, count(*)::BIGINT AS chunks FROM (SELECT DISTINCT repo, file_path, lower(trim(chunk_id, {BLANK})) || ':' || coalesce(lower(trim(content_hash, {BLANK})), '') AS line FROM chunks) GROUP BY ALL")
def stage_digest(spark: SparkSession, root: str) -> DataFrame:
    """A file's digest over its sorted chunk:content pairs, whatever their order."""
    line = F.concat_ws(":", clean_key("chunk_id"), F.coalesce(clean_key("content_hash"), F.lit("")))
    rows = table(spark, root, "chunks").select("repo", "file_path", line.alias("line")).distinct()
    return rows.groupBy("repo", "file_path").agg(F.md5(F.concat_ws("\n", F.array_sort(F.collect_list("line"))).cast("binary")).alias("digest"), F.count("*").alias("chunks"))


@query("branch_apply_delta", LIVE + ", d AS (SELECT DISTINCT chunk_id FROM bm WHERE branch = 'main' EXCEPT SELECT chunk_id FROM gone) SELECT 'main' AS branch, chunk_id FROM d UNION SELECT 'main', chunk_id FROM lc WHERE repo = 'lumen-index'")
def branch_apply_delta(spark: SparkSession, root: str) -> DataFrame:
    """main without deleted chunks and with all living ones of a repository."""
    chunks = table(spark, root, "chunks")
    dead = chunks.where("deleted_at IS NOT NULL").select(clean_key("chunk_id").alias("chunk_id")).distinct().withColumn("branch", F.lit("main"))
    more = live(spark, root).where("repo = 'lumen-index'").select(F.lit("main").alias("branch"), "chunk_id")
    return c.apply_delta(members(spark, root).where("branch = 'main'"), dead, more)
