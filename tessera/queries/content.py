"""Contents, digests, reports and upkeep over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.functions import content as c
from tessera.operators import reports, tree
from tessera.queries.catalog import LIVE, live
from tessera.queries.index_store import TABLES, Tables
from tessera.session import clean_key, table

TEXTS = "WITH tx AS (SELECT lower(trim(content_hash)) AS hash, max(chunk_text) AS text FROM chunk_embeddings WHERE trim(content_hash) <> '' GROUP BY ALL)"
FILES = "WITH f AS (SELECT DISTINCT file_id, content FROM source_files WHERE content IS NOT NULL)"


def texts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunk_embeddings").groupBy(clean_key("content_hash").alias("hash")).agg(F.max("chunk_text").alias("text")).where("hash IS NOT NULL")


def files(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "source_files").where("content IS NOT NULL").select("file_id", "content").distinct()


@query("semantic_chunk_types", LIVE + "SELECT chunk_id, CASE symbol_kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in c.TYPES.items()) + " ELSE 'other' END AS chunk_type, CASE lower(symbol_kind) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in c.KINDS.items()) + " ELSE 'unknown' END AS kind FROM lc")
def semantic_chunk_types(spark: SparkSession, root: str) -> DataFrame:
    return live(spark, root).select("chunk_id", c.chunk_type(F.col("symbol_kind")).alias("chunk_type"), c.structural_kind(F.col("symbol_kind")).alias("kind"))


@query("chunk_signatures", TEXTS + r"SELECT hash, list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT starts_with(x, '//') AND NOT starts_with(x, '#') AND NOT starts_with(x, '/*') AND NOT starts_with(x, '*') AND NOT starts_with(x, '<!--'))[1] AS signature FROM tx")
def chunk_signatures(spark: SparkSession, root: str) -> DataFrame:
    return texts(spark, root).select("hash", c.signature(F.col("text")).alias("signature"))


@query("line_slices", FILES + "SELECT file_id, md5(array_to_string(string_split(content, chr(10))[3:7], chr(10))) AS part FROM f")
def line_slices(spark: SparkSession, root: str) -> DataFrame:
    return files(spark, root).select("file_id", F.md5(c.line_slice(F.col("content"), F.lit(3), F.lit(7)).cast("binary")).alias("part"))


@query("line_offsets", FILES + ", l AS (SELECT file_id, string_split(content, chr(10)) AS l FROM f) SELECT file_id, n::INT AS line, (coalesce(list_sum(list_transform(l[:n - 1], lambda x: strlen(x) + 1)), 0) + 2)::BIGINT AS at FROM (SELECT file_id, l, unnest(range(1, len(l) + 1)) AS n FROM l)")
def line_offsets(spark: SparkSession, root: str) -> DataFrame:
    """The byte offset of column 2 of every line."""
    rows = files(spark, root).withColumn("starts", c.line_starts(F.col("content")))
    return rows.select("file_id", "starts", F.explode(F.sequence(F.lit(1), F.size("starts"))).alias("line")).select("file_id", "line", c.byte_offset(F.col("starts"), F.col("line"), F.lit(2)).cast("bigint").alias("at"))


@query("stage_inputs", FILES + "SELECT file_id, md5(md5(content) || 'chunker-1') AS chunk_stage, md5(md5(content) || 'graph-2') AS graph_stage, md5(content) AS file_hash FROM f")
def stage_inputs(spark: SparkSession, root: str) -> DataFrame:
    own = F.md5(F.col("content").cast("binary"))
    return files(spark, root).select("file_id", c.digest(own, F.lit("chunker-1")).alias("chunk_stage"), c.digest(own, F.lit("graph-2")).alias("graph_stage"), own.alias("file_hash"))


@query("config_digests", "SELECT p_partkey, md5('chunker=' || p_brand || '|dimension=' || p_size || '|model=' || p_name) AS version, md5('dimension=' || p_size || '|model=' || p_name) AS embed FROM part")
def config_digests(spark: SparkSession, root: str) -> DataFrame:
    v = {"model": F.col("p_name"), "dimension": F.col("p_size"), "chunker": F.col("p_brand")}
    return table(spark, root, "part").select("p_partkey", c.config_digest(**v).alias("version"), c.config_digest(model=v["model"], dimension=v["dimension"]).alias("embed"))


@query("named_exports", FILES + ", x AS (SELECT file_id, unnest(list_concat(" + ", ".join(f"regexp_extract_all(content, '{p}', 1)" for p in c.EXPORTS) + r", list_transform(list_filter(flatten(list_transform(regexp_extract_all(content, 'export\s*\{([^}]+)\}', 1), lambda b: list_transform(string_split(b, ','), lambda e: trim(e)))), lambda e: e <> ''), lambda e: trim(string_split_regex(e, '(?i)\s+as\s+')[-1])))) AS name FROM f) SELECT DISTINCT file_id, name FROM x WHERE regexp_matches(name, '^[A-Za-z_$][A-Za-z0-9_$]*$')")
def named_exports(spark: SparkSession, root: str) -> DataFrame:
    return files(spark, root).select("file_id", F.explode(c.named_exports(F.col("content"))).alias("name")).distinct()


@query("search_patterns", r"WITH p AS (SELECT DISTINCT pending_id, symbol_name, file_path FROM pending_chunks) SELECT pending_id, array_to_string(list_transform(list_filter(t, lambda x, n: list_position(t, x) = n)[:6], lambda x: regexp_replace(x, '[.*+?^${}()|\[\]\\]', '\\\0', 'g')), '|') AS pattern FROM (SELECT pending_id, list_concat(CASE WHEN symbol_name IS NULL THEN [] ELSE [symbol_name] END, list_filter(list_transform(regexp_split_to_array('where is the ' || replace(file_path, '/', ' '), '\s+'), lambda w: regexp_replace(w, '[^A-Za-z0-9_$]', '', 'g')), lambda w: length(w) >= 3)) AS t FROM p)")
def search_patterns(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "pending_chunks").select("pending_id", "symbol_name", "file_path").distinct()
    return rows.select("pending_id", c.search_pattern(F.col("symbol_name"), F.concat(F.lit("where is the "), F.replace("file_path", F.lit("/"), F.lit(" ")))).alias("pattern"))


@query("alias_texts", LIVE + "SELECT chunk_id, array_to_string(symbol_aliases, ',') AS aliases, len(symbol_aliases)::INT AS n FROM lc WHERE symbol_aliases IS NOT NULL")
def alias_texts(spark: SparkSession, root: str) -> DataFrame:
    """Aliases as text, and their number once read back."""
    text = c.aliases_text(F.col("symbol_aliases"))
    return live(spark, root).where("symbol_aliases IS NOT NULL").select("chunk_id", text.alias("aliases"), F.size(c.aliases_of(text)).alias("n"))


@query("tagged_documents", LIVE + "SELECT chunk_id, concat_ws(' ', '[name: ' || nullif(name, '') || ']', '[kind: ' || nullif(chunk_kind, '') || ']', '[symbol: ' || nullif(symbol_kind, '') || ']', file_path) AS document FROM lc")
def tagged_documents(spark: SparkSession, root: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return live(spark, root).select("chunk_id", c.tagged_document(F.col("name"), F.col("chunk_kind"), F.col("symbol_kind"), none, F.col("file_path")).alias("document"))


@query("changed_paths", r"WITH p AS (SELECT DISTINCT path, regexp_replace(regexp_replace(regexp_replace(replace(trim(path), '\', '/'), '^(?:\./)+', ''), '/+', '/', 'g'), '/$', '') AS q FROM merkle_nodes) SELECT path, CASE WHEN NOT starts_with(q, '/') AND NOT regexp_matches(q, '(?:^|/)\.\.(?:/|$)') AND q <> '' THEN q END AS kept FROM p")
def changed_paths(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "merkle_nodes").select("path").distinct().select("path", c.repository_path(F.col("path"), "/repo").alias("kept"))


RULES = [("", "tests/"), ("", "*.json"), ("", "!package.json"), ("src", "/digest/"), ("", "lib/**/load_*.py")]


@query("ignored_files", r"SELECT DISTINCT file_path, CASE WHEN regexp_matches(file_path, '^lib/(?:.*/)?load_[^/]*\.py(?:/|$)') THEN true WHEN regexp_matches(file_path, '^src/digest/') THEN true WHEN regexp_matches(file_path, '^(?:.*/)?package\.json(?:/|$)') THEN false WHEN regexp_matches(file_path, '^(?:.*/)?[^/]*\.json(?:/|$)') THEN true ELSE regexp_matches(file_path, '^(?:.*/)?tests/') END AS ignored FROM source_files")
def ignored_files(spark: SparkSession, root: str) -> DataFrame:
    """Rules of a root folder and of an inner one; the last that fits decides."""
    return table(spark, root, "source_files").select("file_path").distinct().withColumn("ignored", c.ignored(F.col("file_path"), RULES))


@query("spaceless_tokens", TEXTS + r"SELECT hash, ceil(length(regexp_replace(text, '\s', '', 'g')) * 1.4 / 4)::BIGINT AS tokens FROM tx")
def spaceless_tokens(spark: SparkSession, root: str) -> DataFrame:
    return texts(spark, root).select("hash", c.spaceless_tokens(F.col("text")).alias("tokens"))


@query("branch_status", TABLES + ", m AS (SELECT l.chunk_id, l.embedding_input_hash, v.hash IS NOT NULL AS has FROM lc l LEFT JOIN (SELECT DISTINCT hash FROM ve) v ON v.hash = l.embedding_input_hash) SELECT branch, count(*)::BIGINT AS chunks, count(embedding_input_hash)::BIGINT AS living, count(*) FILTER (WHERE has)::BIGINT AS embedded, count(embedding_input_hash) = count(*) FILTER (WHERE has) AS ready FROM bm LEFT JOIN m USING (chunk_id) GROUP BY branch")
def branch_status(spark: SparkSession, root: str) -> DataFrame:
    t = Tables(spark, root)
    return reports.branch_status(t.bm, t.lc, t.ve)


@query("median_runs", "SELECT repo, round(median(duration_ms), 6)::DOUBLE AS duration_ms, round(median(total_chunks), 6)::DOUBLE AS total_chunks FROM (SELECT DISTINCT run_id, repo, duration_ms, total_chunks FROM index_stats) GROUP BY repo")
def median_runs(spark: SparkSession, root: str) -> DataFrame:
    return reports.medians(table(spark, root, "index_stats").select("run_id", "repo", "duration_ms", "total_chunks").distinct(), ["repo"], ["duration_ms", "total_chunks"])


RUNS = """WITH s AS (SELECT query_id, chunk_id AS id, max(base_score) AS a, max(score) AS b, max(reranked::INT) = 1 AS reranked FROM search_results GROUP BY ALL),
l AS (SELECT query_id, id, a AS score, reranked, row_number() OVER (PARTITION BY query_id ORDER BY a DESC NULLS LAST, id) - 1 AS place FROM s), r AS (SELECT query_id, id, b AS score, row_number() OVER (PARTITION BY query_id ORDER BY b DESC NULLS LAST, id) - 1 AS place FROM s)"""


def two_runs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    s = table(spark, root, "search_results").groupBy("query_id", F.col("chunk_id").alias("id")).agg(F.max("base_score").alias("a"), F.max("score").alias("b"), F.max("reranked").alias("reranked"))
    run = lambda m: s.select("query_id", "id", F.col(m).alias("score"), "reranked", (F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(m).desc_nulls_last(), "id")) - 1).alias("place"))
    return run("a"), run("b")


@query("quality_drift", RUNS + ", m AS (SELECT l.*, r.score AS other, r.id IS NULL AS gone, abs(l.score - r.score) > CASE WHEN reranked THEN 0.005 WHEN l.place < 3 THEN 0.005 ELSE 0.015 END AS far FROM l LEFT JOIN (SELECT * FROM r WHERE place < 10) r ON l.query_id = r.query_id AND l.id = r.id WHERE l.place < 10) SELECT count(*) FILTER (WHERE far AND reranked)::BIGINT AS reranked_jitter, count(*) FILTER (WHERE far AND NOT reranked AND place < 3)::BIGINT AS top_jitter, count(*) FILTER (WHERE far AND NOT reranked AND place >= 3)::BIGINT AS tail_jitter, count(*) FILTER (WHERE gone)::BIGINT AS pool_changes FROM m")
def quality_drift(spark: SparkSession, root: str) -> DataFrame:
    left, right = two_runs(spark, root)
    return reports.drift(left, right.where("place < 10"))


@query("combined_recall", RUNS + ", j AS (SELECT query_id, id, min(lp) AS lp, min(place) AS place FROM (SELECT query_id, id, 0 AS lp, place FROM l WHERE place < 3 UNION ALL SELECT query_id, id, 1, place FROM r WHERE place < 10) GROUP BY ALL), o AS (SELECT query_id, id, arg_min(place, lp * 1000 + place) AS place, min(lp * 1000 + place) AS k FROM (SELECT query_id, id, 0 AS lp, place FROM l WHERE place < 3 UNION ALL SELECT query_id, id, 1, place FROM r WHERE place < 10) GROUP BY ALL), h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k, id) AS n FROM o) SELECT query_id, max((ascii(right(id, 1)) % 4 = 0)::INT) AS recall FROM h WHERE n <= 5 GROUP BY query_id")
def combined_recall(spark: SparkSession, root: str) -> DataFrame:
    left, right = two_runs(spark, root)
    known = lambda df: df.select("query_id", "id", "place", (F.ascii(F.right("id", F.lit(1))) % 4 == 0).alias("relevant"))
    return reports.combined_recall(known(left.where("place < 3")), known(right.where("place < 10")), 5)


@query("graph_json", TABLES + """SELECT repo, 'node' AS kind, row_number() OVER (PARTITION BY repo ORDER BY file_path, start_line, name, id)::BIGINT AS place, id FROM sy
UNION ALL SELECT s.repo, 'edge', row_number() OVER (PARTITION BY s.repo ORDER BY from_symbol_id, coalesce(to_symbol_id, ''), line, e.id)::BIGINT, e.id FROM ed e JOIN sy s ON s.id = e.from_symbol_id""")
def graph_json(spark: SparkSession, root: str) -> DataFrame:
    """The export of each repository's graph, told by the ids in its objects."""
    t = Tables(spark, root)
    edges = t.ed.join(t.sy.select(F.col("id").alias("from_symbol_id"), "repo"), "from_symbol_id")
    return reports.graph_json(t.sy, edges).select("repo", "kind", "place", F.get_json_object("json", "$.id").alias("id"))


@query("requeued_files", 'SELECT path, max(c.seen) AS "at" FROM (SELECT repo || $$/$$ || file_path AS path, scanned_at AS seen FROM source_files) c JOIN (SELECT repo || $$/$$ || file_path AS path, min(modified_at) AS started_at FROM source_files GROUP BY ALL) r USING (path) WHERE c.seen > started_at GROUP BY path')
def requeued_files(spark: SparkSession, root: str) -> DataFrame:
    f = table(spark, root, "source_files").withColumn("path", F.concat_ws("/", "repo", "file_path"))
    return reports.requeued(f.select("path", F.col("scanned_at").alias("at")), f.groupBy("path").agg(F.min("modified_at").alias("started_at")))


@query("health_check", TABLES + "SELECT 'chunk' AS kind, chunk_id AS id FROM lc WHERE (repo, file_path) NOT IN (SELECT (repo, file_path) FROM source_files WHERE content IS NOT NULL) UNION ALL SELECT 'symbol', id FROM sy WHERE id NOT IN (SELECT symbol_id FROM bs)")
def health_check(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of files that are gone, and symbols on no branch."""
    t = Tables(spark, root)
    there = t.raw("source_files").where("content IS NOT NULL").select("repo", "file_path").distinct()
    lost = t.lc.join(there, ["repo", "file_path"], "left_anti").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"))
    return lost.unionByName(t.sy.join(t.bs.select(F.col("symbol_id").alias("id")).distinct(), "id", "left_anti").select(F.lit("symbol").alias("kind"), "id"))


@query("symbol_info", TABLES + "SELECT id, name, count(*) OVER (PARTITION BY name) > 1 AS ambiguous, list_filter(list_transform(string_split_regex(ct.t, '\\r?\\n'), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT starts_with(x, '//') AND NOT starts_with(x, '#') AND NOT starts_with(x, '/*') AND NOT starts_with(x, '*') AND NOT starts_with(x, '<!--'))[1] AS signature FROM sy JOIN lc l ON l.chunk_id = sy.id LEFT JOIN (SELECT lower(trim(content_hash)) AS h, max(chunk_text) AS t FROM chunk_embeddings GROUP BY ALL) ct ON ct.h = l.content_hash".replace("SELECT id, name, count", "SELECT sy.id, sy.name, count").replace("PARTITION BY name", "PARTITION BY sy.name"))
def symbol_info(spark: SparkSession, root: str) -> DataFrame:
    """Symbols with the first line of their chunk and whether their name is another's too."""
    t = Tables(spark, root)
    names = t.sy.groupBy("name").agg((F.count("*") > 1).alias("ambiguous"))
    rows = t.sy.join(names, "name").join(t.lc.select(F.col("chunk_id").alias("id"), F.col("content_hash").alias("hash")), "id").join(texts(spark, root), "hash", "left")
    return rows.select("id", "name", "ambiguous", c.signature(F.col("text")).alias("signature"))


@query("tree_after_events", r"""WITH n AS (SELECT repo, branch, snapshot_no, regexp_replace(regexp_replace(replace(trim(path), '\', '/'), '^(\./)+', ''), '/$', '') AS path, kind, lower(trim(hash)) AS hash, delivered_at FROM merkle_nodes),
s AS (SELECT path, max(hash) AS hash FROM n WHERE kind = 'file' GROUP BY path), x AS (SELECT path, CASE WHEN length(path) % 3 = 0 THEN NULL ELSE 'new' END AS hash FROM s WHERE length(path) % 2 = 0),
a AS (SELECT path, hash FROM s WHERE path NOT IN (SELECT path FROM x) UNION ALL SELECT path, hash FROM x WHERE hash IS NOT NULL)
SELECT DISTINCT array_to_string(string_split(path, '/')[:k], '/') AS folder FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS k FROM a)""")
def tree_after_events(spark: SparkSession, root: str) -> DataFrame:
    """The folders that remain after point changes to a tree: those above surviving files."""
    from tessera.operators import snapshots

    rows = snapshots.tree_nodes(table(spark, root, "merkle_nodes")).where("kind = 'file'").groupBy("path").agg(F.max("hash").alias("hash"))
    changes = rows.where(F.length("path") % 2 == 0).select("path", F.when(F.length("path") % 3 != 0, "new").alias("hash"))
    return tree.directories(reports.tree_after(rows, changes), [], "path").select(F.col("path").alias("folder"))


@query("reranker_counters", "SELECT backend, count(*) FILTER (WHERE reranked)::BIGINT AS applied, count(*) FILTER (WHERE NOT reranked)::BIGINT AS skipped FROM (SELECT DISTINCT query_id, backend, reranked FROM search_results) GROUP BY backend")
def reranker_counters(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "search_results").select("query_id", "backend", "reranked").distinct()
    return rows.groupBy("backend").agg(F.count_if("reranked").alias("applied"), F.count_if(~F.col("reranked")).alias("skipped"))


@query("overview_clusters")
def overview_clusters(spark: SparkSession, root: str) -> DataFrame:
    return reports.clusters(table(spark, root, "source_files").select("repo", "file_path").distinct(), "file_path")
