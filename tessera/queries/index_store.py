"""Lookups and writes of the index's own tables, one query each, over tables derived from the test data:

lc live chunks, bm memberships, sy symbols (named chunks), bs memberships of symbols, ed call edges (a symbol to the next one of its file), ve
vectors by key, ru pipeline runs (orders), st stage states (files), kv metadata (nations), cv configuration versions (parts)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.operators import catalog as c
from tessera.operators import store as s
from tessera.operators import structure
from tessera.queries.catalog import LIVE
from tessera.session import clean_key, table

TABLES = (
    LIVE
    + """, sy AS (SELECT chunk_id AS id, name, coalesce(symbol_kind, 'other') AS kind, repo, file_path, start_line, end_line FROM lc WHERE name IS NOT NULL),
bs AS (SELECT branch, chunk_id AS symbol_id FROM bm WHERE chunk_id IN (SELECT id FROM sy)),
ed AS (SELECT id || '>' AS id, id AS from_symbol_id, file_path AS caller_file_path, nn AS target_name, CASE WHEN start_line % 3 <> 0 THEN ni END AS to_symbol_id, start_line % 3 <> 0 AS is_resolved, start_line AS line, kind AS call_type
  FROM (SELECT *, lead(id) OVER w AS ni, lead(name) OVER w AS nn FROM sy WINDOW w AS (PARTITION BY repo, file_path ORDER BY start_line, id)) WHERE ni IS NOT NULL),
ve AS (SELECT lower(trim(embedding_input_hash)) AS hash, model, max(created_at) AS created_at FROM chunk_embeddings GROUP BY ALL),
ru AS (SELECT o_orderkey AS run_id, 'b' || (o_custkey % 7) AS branch, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'pending' END AS status, o_orderdate AS started_at, o_orderdate AS completed_at FROM orders),
st AS (SELECT DISTINCT repo AS branch, file_path, CASE WHEN file_id % 2 = 0 THEN 'embed' ELSE 'graph' END AS stage, CASE WHEN file_id % 5 = 0 THEN 'failed' ELSE 'complete' END AS status, md5(coalesce(max(content) OVER (PARTITION BY file_id), '')) AS input_hash FROM source_files),
kv AS (SELECT n_name AS key, 'r' || n_regionkey AS value FROM nation),
cv AS (SELECT 'c' || p_partkey AS config_hash, p_size % 2 = 0 AS active, p_retailprice AS created_at FROM part)
"""
)
MAIN = "main"


class Tables:
    """The derived tables, made as they are asked for."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)

    @property
    def lc(self) -> DataFrame:
        return c.live_chunks(self.raw("chunks"))

    @property
    def bm(self) -> DataFrame:
        return c.members(self.raw("branch_chunks"))

    @property
    def sy(self) -> DataFrame:
        return self.lc.where("name IS NOT NULL").select(F.col("chunk_id").alias("id"), "name", F.coalesce("symbol_kind", F.lit("other")).alias("kind"), "repo", "file_path", "start_line", "end_line")

    @property
    def bs(self) -> DataFrame:
        return self.bm.withColumnRenamed("chunk_id", "symbol_id").join(self.sy.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi").select("branch", "symbol_id")

    @property
    def ed(self) -> DataFrame:
        w = Window.partitionBy("repo", "file_path").orderBy("start_line", "id")
        rows = self.sy.withColumn("ni", F.lead("id").over(w)).withColumn("nn", F.lead("name").over(w)).where("ni IS NOT NULL")
        hit = F.col("start_line") % 3 != 0
        return rows.select(F.concat("id", F.lit(">")).alias("id"), F.col("id").alias("from_symbol_id"), F.col("file_path").alias("caller_file_path"), F.col("nn").alias("target_name"), F.when(hit, F.col("ni")).alias("to_symbol_id"), hit.alias("is_resolved"), F.col("start_line").alias("line"), F.col("kind").alias("call_type"))

    @property
    def ve(self) -> DataFrame:
        return self.raw("chunk_embeddings").groupBy(clean_key("embedding_input_hash").alias("hash"), "model").agg(F.max("created_at").alias("created_at"))

    @property
    def ru(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("pending")
        return self.raw("orders").select(F.col("o_orderkey").alias("run_id"), F.concat(F.lit("b"), F.col("o_custkey") % 7).alias("branch"), status.alias("status"), F.col("o_orderdate").alias("started_at"), F.col("o_orderdate").alias("completed_at"))

    @property
    def st(self) -> DataFrame:
        files = self.raw("source_files").groupBy("file_id", "repo", "file_path").agg(F.max("content").alias("content"))
        return files.select(F.col("repo").alias("branch"), "file_path", F.when(F.col("file_id") % 2 == 0, "embed").otherwise("graph").alias("stage"), F.when(F.col("file_id") % 5 == 0, "failed").otherwise("complete").alias("status"), F.md5(F.coalesce("content", F.lit("")).cast("binary")).alias("input_hash")).distinct()

    @property
    def kv(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_name").alias("key"), F.concat(F.lit("r"), "n_regionkey").alias("value"))

    @property
    def cv(self) -> DataFrame:
        return self.raw("part").select(F.concat(F.lit("c"), "p_partkey").alias("config_hash"), (F.col("p_size") % 2 == 0).alias("active"), F.col("p_retailprice").alias("created_at"))

    @property
    def asked(self) -> DataFrame:
        """The chunk ids that searches returned."""
        return self.raw("search_results").select(clean_key("chunk_id").alias("chunk_id")).distinct()


ASKED = "(SELECT lower(trim(chunk_id, chr(9)||chr(10)||chr(13)||' ')) FROM search_results)"
CHUNK = "chunk_id, content_hash, file_path, start_line, end_line, name"
SYMBOL = "id, name, kind, file_path, start_line, end_line"


def columns(names: str) -> list[str]:
    return [x.strip() for x in names.split(",")]


def entry(name: str, sql: str, f: Callable[[Tables], DataFrame]) -> None:
    query(name, TABLES + sql)(lambda spark, root, f=f: f(Tables(spark, root)))


def one(df: DataFrame, column: str, how: str = "min") -> object:
    """A parameter for a lookup of one value."""
    return df.agg(getattr(F, how)(column)).first()[0]


def verdict(df: DataFrame, **found: bool) -> DataFrame:
    return df.sparkSession.createDataFrame([tuple(found.values())], ", ".join(f"{k} boolean" for k in found))


# lookups
entry("get_chunk", f"SELECT {CHUNK} FROM lc WHERE chunk_id = (SELECT min(chunk_id) FROM lc)", lambda t: s.lookup(t.lc, chunk_id=one(t.lc, "chunk_id")).select(columns(CHUNK)))
entry("get_chunks_by_file", f"SELECT {CHUNK} FROM lc WHERE file_path = (SELECT max(file_path) FROM lc)", lambda t: s.lookup(t.lc, file_path=one(t.lc, "file_path", "max")).select(columns(CHUNK)))
entry("get_chunk_kinds_batch", f"SELECT chunk_id, chunk_kind FROM lc WHERE chunk_id IN {ASKED}", lambda t: s.lookup_batch(t.lc, t.asked, ["chunk_id"]).select("chunk_id", "chunk_kind"))
entry("get_chunk_metadata_batch", f"SELECT {CHUNK}, language, symbol_kind FROM lc WHERE chunk_id IN {ASKED}", lambda t: s.lookup_batch(t.lc, t.asked, ["chunk_id"]).select([*columns(CHUNK), "language", "symbol_kind"]))
entry("embedding_exists", "SELECT true AS known, false AS unknown", lambda t: verdict(t.ve, known=s.contains(t.ve, hash=one(t.ve, "hash")), unknown=s.contains(t.ve, hash="no such hash")))
entry("get_embedding", "SELECT hash, model, created_at FROM ve WHERE hash = (SELECT min(hash) FROM ve)", lambda t: s.lookup(t.ve, hash=one(t.ve, "hash")))
entry("get_embeddings_batch", "SELECT hash, model, created_at FROM ve WHERE hash IN (SELECT embedding_input_hash FROM lc)", lambda t: s.lookup_batch(t.ve, t.lc.select(F.col("embedding_input_hash").alias("hash")), ["hash"]))
entry("get_embeddings_for_model_batch", "SELECT hash, model, created_at FROM ve WHERE model = (SELECT min(model) FROM ve) AND hash IN (SELECT embedding_input_hash FROM lc)", lambda t: s.lookup_batch(s.lookup(t.ve, model=one(t.ve, "model")), t.lc.select(F.col("embedding_input_hash").alias("hash")), ["hash"]))
entry("get_symbol_by_id", f"SELECT {SYMBOL} FROM sy WHERE id = (SELECT min(id) FROM sy)", lambda t: s.lookup(t.sy, id=one(t.sy, "id")).select(columns(SYMBOL)))
entry("get_symbols_by_file", f"SELECT {SYMBOL} FROM sy WHERE file_path = (SELECT min(file_path) FROM sy)", lambda t: s.lookup(t.sy, file_path=one(t.sy, "file_path")).select(columns(SYMBOL)))
entry("get_symbol_by_name", f"SELECT {SYMBOL} FROM sy WHERE name = (SELECT max(name) FROM sy)", lambda t: s.lookup(t.sy, name=one(t.sy, "name", "max")).select(columns(SYMBOL)))
entry("get_symbols_by_ids", f"SELECT {SYMBOL} FROM sy WHERE id IN {ASKED}", lambda t: s.lookup_batch(t.sy, t.asked.withColumnRenamed("chunk_id", "id"), ["id"]).select(columns(SYMBOL)))
entry("get_callers", "SELECT id, from_symbol_id, line FROM ed WHERE target_name = (SELECT min(target_name) FROM ed)", lambda t: s.lookup(t.ed, target_name=one(t.ed, "target_name")).select("id", "from_symbol_id", "line"))
entry("get_callees", "SELECT id, target_name, to_symbol_id, line FROM ed WHERE from_symbol_id = (SELECT max(from_symbol_id) FROM ed)", lambda t: s.lookup(t.ed, from_symbol_id=one(t.ed, "from_symbol_id", "max")).select("id", "target_name", "to_symbol_id", "line"))
entry("get_branch_chunk_ids", f"SELECT chunk_id FROM bm WHERE branch = '{MAIN}'", lambda t: s.lookup(t.bm, branch=MAIN).select("chunk_id"))
entry("get_branch_symbol_ids", f"SELECT symbol_id FROM bs WHERE branch = '{MAIN}'", lambda t: s.lookup(t.bs, branch=MAIN).select("symbol_id"))
entry("chunk_exists_on_branch", f"SELECT true AS there, false AS missing FROM (SELECT min(chunk_id) AS x FROM bm WHERE branch = '{MAIN}')", lambda t: verdict(t.bm, there=s.contains(t.bm, branch=MAIN, chunk_id=one(s.lookup(t.bm, branch=MAIN), "chunk_id")), missing=s.contains(t.bm, branch=MAIN, chunk_id="none")))
entry("chunk_exists_on_other_branches", f"SELECT DISTINCT chunk_id FROM bm WHERE branch = '{MAIN}' AND chunk_id IN (SELECT chunk_id FROM bm WHERE branch <> '{MAIN}')", lambda t: s.on_other_branches(t.bm, MAIN, "chunk_id"))
entry("symbol_exists_on_other_branches", f"SELECT DISTINCT symbol_id FROM bs WHERE branch = '{MAIN}' AND symbol_id IN (SELECT symbol_id FROM bs WHERE branch <> '{MAIN}')", lambda t: s.on_other_branches(t.bs, MAIN, "symbol_id"))
entry("get_metadata", "SELECT value FROM kv WHERE key = 'NATION_3'", lambda t: s.lookup(t.kv, key="NATION_3").select("value"))
entry("get_metadata_batch", "SELECT key, value FROM kv WHERE key IN (SELECT 'NATION_' || s_nationkey FROM supplier)", lambda t: s.lookup_batch(t.kv, t.raw("supplier").select(F.concat(F.lit("NATION_"), "s_nationkey").alias("key")), ["key"]))
entry("get_all_metadata", "SELECT key, value FROM kv", lambda t: t.kv)
entry("get_all_keys", "SELECT key FROM kv", lambda t: t.kv.select("key"))
entry("get_pipeline_state", "SELECT * FROM st WHERE branch = (SELECT min(branch) FROM st)", lambda t: s.lookup(t.st, branch=one(t.st, "branch")))
entry("get_pipeline_run", "SELECT * FROM ru WHERE run_id = 77", lambda t: s.lookup(t.ru, run_id=77))
entry("get_active_pipeline_runs", "SELECT run_id, branch FROM ru WHERE status = 'running'", lambda t: s.lookup(t.ru, status="running").select("run_id", "branch"))
entry("get_pipeline_runs_by_status", "SELECT run_id, status FROM ru WHERE status IN ('pending', 'completed')", lambda t: t.ru.where(F.col("status").isin("pending", "completed")).select("run_id", "status"))
entry("get_config_version", "SELECT * FROM cv WHERE config_hash = 'c12'", lambda t: s.lookup(t.cv, config_hash="c12"))
entry("get_active_config_version", "SELECT config_hash FROM cv WHERE active ORDER BY created_at DESC, config_hash DESC LIMIT 1", lambda t: s.latest_active(t.cv).select("config_hash"))
entry("get_all_branches", "SELECT DISTINCT branch FROM bm", lambda t: t.bm.select("branch").distinct())
entry("branch_sizes", "SELECT branch, count(*)::BIGINT AS n FROM bm GROUP BY ALL", lambda t: t.bm.groupBy("branch").agg(F.count("*").alias("n")))
entry("document_count", "SELECT count(DISTINCT doc_id)::BIGINT AS n FROM documents WHERE length(text) > 0", lambda t: t.raw("documents").where(F.length("text") > 0).agg(F.count_distinct("doc_id").alias("n")))
entry("has_chunk", f"SELECT count(*)::BIGINT AS known FROM (SELECT DISTINCT chunk_id FROM lc WHERE chunk_id IN {ASKED})", lambda t: s.lookup_batch(t.lc, t.asked, ["chunk_id"]).agg(F.count_distinct("chunk_id").alias("known")))
entry("get_symbols_by_file_on_branch", f"SELECT {SYMBOL} FROM sy WHERE file_path = (SELECT min(file_path) FROM sy) AND id IN (SELECT symbol_id FROM bs WHERE branch = '{MAIN}')", lambda t: s.lookup(t.sy, file_path=one(t.sy, "file_path")).join(s.lookup(t.bs, branch=MAIN).select(F.col("symbol_id").alias("id")), "id", "left_semi").select(columns(SYMBOL)))
entry("get_symbols_by_ids_on_branch", f"SELECT {SYMBOL} FROM sy WHERE id IN {ASKED} AND id IN (SELECT symbol_id FROM bs WHERE branch = '{MAIN}')", lambda t: s.lookup_batch(t.sy, t.asked.withColumnRenamed("chunk_id", "id"), ["id"]).join(s.lookup(t.bs, branch=MAIN).select(F.col("symbol_id").alias("id")), "id", "left_semi").select(columns(SYMBOL)))
entry("get_symbols_by_name_on_branch", f"SELECT {SYMBOL} FROM sy WHERE name IN (SELECT symbol_name FROM pending_chunks) AND id IN (SELECT symbol_id FROM bs WHERE branch = '{MAIN}')", lambda t: s.lookup_batch(t.sy, t.raw("pending_chunks").select(F.col("symbol_name").alias("name")), ["name"]).join(s.lookup(t.bs, branch=MAIN).select(F.col("symbol_id").alias("id")), "id", "left_semi").select(columns(SYMBOL)))
# structure
entry("search_symbols", "SELECT id, name FROM (SELECT *, row_number() OVER (ORDER BY length(name), name, id) AS n FROM sy WHERE contains(lower(name), 'walk')) WHERE n <= 20", lambda t: structure.search_symbols(t.sy, "Walk").select("id", "name"))
entry("structural_callers", "SELECT e.id, e.from_symbol_id, s.name AS caller, e.line FROM ed e JOIN sy s ON s.id = e.from_symbol_id WHERE lower(e.target_name) = lower((SELECT max(target_name) FROM ed))", lambda t: structure.callers(t.ed, t.sy, one(t.ed, "target_name", "max")).select("id", "from_symbol_id", "caller", "line"))
entry("structural_callers_page", "SELECT id, caller_file_path, line FROM ed ORDER BY caller_file_path, line, id LIMIT 10 OFFSET 20", lambda t: structure.page(t.ed.select("id", "caller_file_path", "line"), [F.col("caller_file_path"), F.col("line"), F.col("id")], 10, structure.encode_cursor(20)))
entry("structural_callees_page", "SELECT id, is_resolved, line FROM ed ORDER BY is_resolved DESC, caller_file_path, line NULLS LAST, target_name, id LIMIT 25", lambda t: structure.page(t.ed, [F.col("is_resolved").desc(), F.col("caller_file_path"), F.col("line").asc_nulls_last(), F.col("target_name"), F.col("id")], 25).select("id", "is_resolved", "line"))
entry("incident_edges", f"SELECT id FROM ed WHERE from_symbol_id IN {ASKED} OR to_symbol_id IN {ASKED}", lambda t: structure.incident(t.ed, t.asked.withColumnRenamed("chunk_id", "id")).select("id"))
entry("induced_edges", f"SELECT id FROM ed WHERE from_symbol_id IN {ASKED} AND to_symbol_id IN {ASKED}", lambda t: structure.induced(t.ed, t.asked.withColumnRenamed("chunk_id", "id")).select("id"))
entry("unresolved_outgoing", f"SELECT id, target_name FROM ed WHERE to_symbol_id IS NULL AND from_symbol_id IN {ASKED}", lambda t: s.lookup_batch(s.lookup(t.ed, to_symbol_id=None), t.asked.withColumnRenamed("chunk_id", "from_symbol_id"), ["from_symbol_id"]).select("id", "target_name"))
entry("unresolved_callers_by_name", "SELECT id, from_symbol_id, target_name FROM ed WHERE to_symbol_id IS NULL AND target_name IN (SELECT name FROM sy) AND from_symbol_id IN (SELECT symbol_id FROM bs WHERE branch = 'main')", lambda t: s.lookup_batch(s.lookup(t.ed, to_symbol_id=None), t.sy.select(F.col("name").alias("target_name")), ["target_name"]).join(s.lookup(t.bs, branch=MAIN).select(F.col("symbol_id").alias("from_symbol_id")), "from_symbol_id", "left_semi").select("id", "from_symbol_id", "target_name"))
entry("callers_by_target_ids", f"SELECT e.id, e.to_symbol_id, s.name AS caller FROM ed e JOIN sy s ON s.id = e.from_symbol_id WHERE e.to_symbol_id IN {ASKED}", lambda t: s.lookup_batch(t.ed, t.asked.withColumnRenamed("chunk_id", "to_symbol_id"), ["to_symbol_id"]).join(t.sy.select(F.col("id").alias("from_symbol_id"), F.col("name").alias("caller")), "from_symbol_id").select("id", "to_symbol_id", "caller"))
entry("edge_frontier", f"SELECT 'caller' AS direction, id FROM ed WHERE to_symbol_id IN {ASKED} UNION ALL SELECT 'callee', id FROM ed WHERE from_symbol_id IN {ASKED}", lambda t: structure.frontier(t.ed, t.asked.withColumnRenamed("chunk_id", "id")).select("direction", "id"))
entry("chunks_of_symbols", f"SELECT s.id AS symbol_id, l.chunk_id FROM sy s JOIN lc l ON l.chunk_id = s.id JOIN bm ON bm.chunk_id = l.chunk_id AND bm.branch = '{MAIN}' WHERE s.id IN {ASKED}", lambda t: structure.chunks_of_symbols(t.sy.select(F.col("id").alias("symbol_id"), F.col("id").alias("chunk_id")), t.lc, s.lookup(t.bm, branch=MAIN), t.asked.withColumnRenamed("chunk_id", "symbol_id")).select("symbol_id", "chunk_id"))
entry("has_symbol_links", f"SELECT count(*) > 0 AS linked FROM sy WHERE id IN {ASKED}", lambda t: verdict(t.sy, linked=not s.lookup_batch(t.sy, t.asked.withColumnRenamed("chunk_id", "id"), ["id"]).isEmpty()))
entry("handoff_report", f"""SELECT role, id, count(*)::BIGINT AS calls FROM (
SELECT 'caller' AS role, from_symbol_id AS id FROM ed WHERE to_symbol_id IN {ASKED} AND from_symbol_id NOT IN {ASKED}
UNION ALL SELECT 'callee', to_symbol_id FROM ed WHERE from_symbol_id IN {ASKED} AND to_symbol_id IS NOT NULL AND to_symbol_id NOT IN {ASKED}
UNION ALL SELECT 'unresolved', target_name FROM ed WHERE from_symbol_id IN {ASKED} AND to_symbol_id IS NULL) GROUP BY ALL""", lambda t: structure.handoff(t.ed, t.asked.withColumnRenamed("chunk_id", "id")))
# writes: the table after them
entry("upsert_chunks", "SELECT chunk_id, max(v)::INT AS v FROM (SELECT chunk_id, 0 AS v FROM lc UNION ALL SELECT chunk_id, 1 FROM lc WHERE start_line % 2 = 0) GROUP BY chunk_id", lambda t: s.upsert(t.lc.select("chunk_id", F.lit(0).alias("v")), t.lc.where("start_line % 2 = 0").select("chunk_id", F.lit(1).alias("v")), ["chunk_id"]))
entry("upsert_symbols", "SELECT id, CASE WHEN end_line % 2 = 0 THEN upper(name) ELSE name END AS name FROM sy", lambda t: s.upsert(t.sy.select("id", "name"), t.sy.where("end_line % 2 = 0").select("id", F.upper("name").alias("name")), ["id"]))
entry("upsert_call_edges", "SELECT id, CASE WHEN line % 2 = 0 THEN 'changed' ELSE call_type END AS call_type FROM ed", lambda t: s.upsert(t.ed.select("id", "call_type"), t.ed.where("line % 2 = 0").select("id", F.lit("changed").alias("call_type")), ["id"]))
entry("upsert_embeddings", "SELECT hash, model, created_at + 1 AS created_at FROM ve", lambda t: s.upsert(t.ve, t.ve.withColumn("created_at", F.col("created_at") + 1), ["hash", "model"], "created_at"))
entry("upsert_chunk_symbols", "SELECT DISTINCT id AS symbol_id, id AS chunk_id FROM sy", lambda t: s.insert_ignore(t.sy.select(F.col("id").alias("symbol_id"), F.col("id").alias("chunk_id")), t.sy.select(F.col("id").alias("symbol_id"), F.col("id").alias("chunk_id")), ["symbol_id", "chunk_id"]))
entry("add_chunks_to_branch", f"SELECT branch, chunk_id FROM bm UNION SELECT '{MAIN}', chunk_id FROM lc", lambda t: s.insert_ignore(t.bm, t.lc.select(F.lit(MAIN).alias("branch"), "chunk_id"), ["branch", "chunk_id"]))
entry("add_symbols_to_branch", f"SELECT branch, symbol_id FROM bs UNION SELECT '{MAIN}', id FROM sy", lambda t: s.insert_ignore(t.bs, t.sy.select(F.lit(MAIN).alias("branch"), F.col("id").alias("symbol_id")), ["branch", "symbol_id"]))
entry("set_metadata", "SELECT key, CASE WHEN key = 'NATION_1' THEN 'new' ELSE value END AS value FROM kv UNION ALL SELECT 'added', 'x'", lambda t: s.upsert(t.kv, t.spark.createDataFrame([("NATION_1", "new"), ("added", "x")], "key string, value string"), ["key"]))
entry("delete_metadata", "SELECT key, value FROM kv WHERE key <> 'NATION_1'", lambda t: s.delete(t.kv, key="NATION_1"))
entry("delete_chunks_by_file", "SELECT chunk_id FROM lc WHERE file_path <> (SELECT min(file_path) FROM lc)", lambda t: s.delete(t.lc, file_path=one(t.lc, "file_path")).select("chunk_id"))
entry("delete_symbols_by_file", "SELECT id FROM sy WHERE file_path <> (SELECT min(file_path) FROM sy)", lambda t: s.delete(t.sy, file_path=one(t.sy, "file_path")).select("id"))
entry("delete_symbol", "SELECT id FROM sy WHERE id <> (SELECT min(id) FROM sy)", lambda t: s.delete(t.sy, id=one(t.sy, "id")).select("id"))
entry("delete_call_edges_by_file", "SELECT id FROM ed WHERE caller_file_path <> (SELECT min(caller_file_path) FROM ed)", lambda t: s.delete(t.ed, caller_file_path=one(t.ed, "caller_file_path")).select("id"))
entry("delete_call_edges_by_symbol", "SELECT id FROM ed WHERE from_symbol_id <> (SELECT min(from_symbol_id) FROM ed)", lambda t: s.delete(t.ed, from_symbol_id=one(t.ed, "from_symbol_id")).select("id"))
entry("delete_call_edges_by_target", "SELECT id FROM ed WHERE to_symbol_id IS NULL OR to_symbol_id <> (SELECT min(to_symbol_id) FROM ed)", lambda t: s.delete(t.ed, to_symbol_id=one(t.ed, "to_symbol_id")).select("id"))
entry("delete_call_edges_of_branch", f"SELECT id FROM ed WHERE from_symbol_id NOT IN (SELECT symbol_id FROM bs WHERE branch = '{MAIN}')", lambda t: s.delete_batch(t.ed, s.lookup(t.bs, branch=MAIN).select(F.col("symbol_id").alias("from_symbol_id")), ["from_symbol_id"]).select("id"))
entry("delete_chunk_symbols", f"SELECT id AS symbol_id FROM sy WHERE id NOT IN {ASKED}", lambda t: s.delete_batch(t.sy.select(F.col("id").alias("symbol_id")), t.asked.withColumnRenamed("chunk_id", "symbol_id"), ["symbol_id"]))
entry("remove_chunks", f"SELECT chunk_id FROM lc WHERE chunk_id NOT IN {ASKED}", lambda t: s.delete_batch(t.lc, t.asked, ["chunk_id"]).select("chunk_id"))
entry("clear_branch", f"SELECT branch, chunk_id FROM bm WHERE branch <> '{MAIN}'", lambda t: s.delete(t.bm, branch=MAIN))
entry("clear_branch_symbols", f"SELECT branch, symbol_id FROM bs WHERE branch <> '{MAIN}'", lambda t: s.delete(t.bs, branch=MAIN))
entry("clear_all_branches", "SELECT count(*)::BIGINT AS n FROM bm WHERE false", lambda t: s.cleared(t.bm).agg(F.count("*").alias("n")))
entry("set_branch_membership", f"SELECT branch, chunk_id FROM bm WHERE branch <> '{MAIN}' UNION ALL SELECT '{MAIN}', chunk_id FROM lc", lambda t: s.replace_branch(t.bm, MAIN, t.lc.select(F.lit(MAIN).alias("branch"), "chunk_id")))
entry("resolve_call_edges", "SELECT id, CASE WHEN is_resolved THEN to_symbol_id ELSE 'sym' END AS to_symbol_id, true AS is_resolved FROM ed", lambda t: s.set_where(t.ed, ~F.col("is_resolved"), to_symbol_id="sym", is_resolved=True).select("id", "to_symbol_id", "is_resolved"))
entry("unresolve_call_edges", f"SELECT id, CASE WHEN to_symbol_id NOT IN {ASKED} THEN to_symbol_id END AS to_symbol_id FROM ed WHERE from_symbol_id NOT IN {ASKED}", lambda t: s.unresolve(t.ed, t.asked.withColumnRenamed("chunk_id", "id")).select("id", "to_symbol_id"))
entry("gc_orphan_symbols", f"SELECT id FROM sy WHERE id NOT IN (SELECT symbol_id FROM bs)", lambda t: s.lookup_orphans(t.sy.select("id"), t.bs.select(F.col("symbol_id").alias("id")), "id"))
entry("gc_orphan_call_edges", f"SELECT id FROM ed WHERE from_symbol_id NOT IN (SELECT symbol_id FROM bs) OR (to_symbol_id IS NOT NULL AND to_symbol_id NOT IN (SELECT symbol_id FROM bs))", lambda t: s.orphan_edges(t.ed, t.bs.select(F.col("symbol_id").alias("id"))).select("id"))
entry("start_pipeline_run", "SELECT run_id, status FROM ru UNION ALL SELECT -1, 'running'", lambda t: s.upsert(t.ru.select("run_id", "status"), t.spark.createDataFrame([(-1, "running")], "run_id bigint, status string"), ["run_id"]))
entry("update_pipeline_run_status", "SELECT run_id, CASE WHEN run_id = 77 THEN 'completed' ELSE status END AS status FROM ru", lambda t: s.set_where(t.ru, F.col("run_id") == 77, status="completed").select("run_id", "status"))
entry("cancel_active_pipeline_runs", "SELECT run_id, CASE WHEN status = 'running' AND branch = 'b2' THEN 'cancelled' ELSE status END AS status FROM ru", lambda t: s.set_where(t.ru, s.equal(status="running", branch="b2"), status="cancelled").select("run_id", "status"))
entry("prune_finished_pipeline_runs", "SELECT run_id FROM ru WHERE NOT (status = 'completed' AND completed_at < TIMESTAMP '1999-01-01')", lambda t: s.prune_runs(t.ru, "1999-01-01 00:00:00").select("run_id"))
entry("activate_config_version", "SELECT config_hash, config_hash = 'c3' AS active FROM cv", lambda t: s.activate(t.cv, "config_hash", "c3").select("config_hash", "active"))
entry("upsert_pipeline_state", "SELECT branch, file_path, stage, CASE WHEN status = 'failed' THEN 'complete' ELSE status END AS status FROM st", lambda t: s.upsert(t.st.select("branch", "file_path", "stage", "status"), t.st.where("status = 'failed'").select("branch", "file_path", "stage", F.lit("complete").alias("status")), ["branch", "file_path", "stage"]))
entry("reset_pipeline_stage", "SELECT branch, file_path, stage, CASE WHEN stage = 'embed' THEN 'pending' ELSE status END AS status, CASE WHEN stage <> 'embed' THEN input_hash END AS input_hash FROM st", lambda t: s.set_where(t.st, F.col("stage") == "embed", status="pending", input_hash=None))
entry("clear_pipeline_state_for_branch", "SELECT branch, file_path FROM st WHERE branch <> (SELECT min(branch) FROM st)", lambda t: s.delete(t.st, branch=one(t.st, "branch")).select("branch", "file_path"))
entry("clear_pipeline_state_for_file", "SELECT branch, file_path FROM st WHERE file_path <> (SELECT min(file_path) FROM st)", lambda t: s.delete(t.st, file_path=one(t.st, "file_path")).select("branch", "file_path"))
entry("is_stage_stale", "SELECT branch, file_path, stage FROM st WHERE status <> 'complete' OR ascii(input_hash) % 2 = 0", lambda t: s.stale(t.st.select("branch", "file_path", "stage", F.when(F.ascii("input_hash") % 2 == 0, "other").otherwise(F.col("input_hash")).alias("input_hash")), t.st, ["branch", "file_path", "stage"]).select("branch", "file_path", "stage"))
entry("mark_stage_complete", "SELECT branch, file_path, stage, 'complete' AS status FROM st", lambda t: s.upsert(t.st.select("branch", "file_path", "stage", "status"), t.st.select("branch", "file_path", "stage", F.lit("complete").alias("status")), ["branch", "file_path", "stage"]))
entry("record_embedding_debt", "SELECT DISTINCT repo, file_path FROM lc WHERE embedding_input_hash NOT IN (SELECT hash FROM ve WHERE hash IS NOT NULL)", lambda t: c.missing_keys(t.lc.select("repo", "file_path", F.col("embedding_input_hash").alias("hash")), t.ve, "hash").select("repo", "file_path").distinct())
entry("upsert_chunk_cap_drop", "SELECT repo, file_path, (count(*) - 5)::BIGINT AS dropped FROM lc GROUP BY ALL HAVING count(*) > 5", lambda t: c.cap_drops(t.lc, ["repo", "file_path"], 5))
entry("kept_under_chunk_cap", "SELECT chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY repo, file_path ORDER BY start_line, end_line, chunk_id) AS n FROM lc) WHERE n <= 5", lambda t: c.kept_under_cap(t.lc, ["repo", "file_path"], ["start_line", "end_line", "chunk_id"], 5).select("chunk_id"))
entry("upsert_reranker_health", "SELECT backend, count(*)::BIGINT AS calls, sum(CASE WHEN reranked THEN 0 ELSE 1 END)::BIGINT AS failures FROM (SELECT DISTINCT query_id, chunk_id, backend, reranked FROM search_results) GROUP BY ALL", lambda t: t.raw("search_results").select("query_id", "chunk_id", "backend", "reranked").distinct().groupBy("backend").agg(F.count("*").alias("calls"), F.sum(F.when(F.col("reranked"), 0).otherwise(1)).cast("bigint").alias("failures")))
entry("ensure_tracked_files", "SELECT DISTINCT repo, file_path FROM source_files", lambda t: s.insert_ignore(t.lc.select("repo", "file_path").distinct(), t.raw("source_files").select("repo", "file_path"), ["repo", "file_path"]).join(t.raw("source_files").select("repo", "file_path").distinct(), ["repo", "file_path"], "left_semi"))
entry("diff_chunks_for_file", "SELECT repo, file_path, count(*) FILTER (WHERE o AND n)::BIGINT AS kept, count(*) FILTER (WHERE n AND NOT o)::BIGINT AS added, count(*) FILTER (WHERE o AND NOT n)::BIGINT AS removed FROM (SELECT repo, file_path, content_hash, bool_or(start_line % 2 = 0) AS o, bool_or(start_line % 3 = 0) AS n FROM lc WHERE content_hash IS NOT NULL GROUP BY ALL) GROUP BY ALL", lambda t: c.diff_by_key(t.lc.where("content_hash IS NOT NULL AND start_line % 2 = 0"), t.lc.where("content_hash IS NOT NULL AND start_line % 3 = 0"), t.lc.where("content_hash IS NOT NULL"), ["repo", "file_path"], "content_hash"))
entry("promoted_branch", f"SELECT count(*)::BIGINT AS n FROM (SELECT chunk_id FROM bm WHERE branch = '{MAIN}' UNION SELECT chunk_id FROM bm WHERE branch = (SELECT max(branch) FROM bm))", lambda t: s.insert_ignore(s.lookup(t.bm, branch=MAIN).select("chunk_id"), s.lookup(t.bm, branch=one(t.bm, "branch", "max")).select("chunk_id"), ["chunk_id"]).agg(F.count("*").alias("n")))
