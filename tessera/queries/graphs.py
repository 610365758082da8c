"""Call-graph queries. Calls are order lines (supplier calls part); walks run over customers and the nations they
trade with, over users in turn, and over source files by the names they call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.operators import graph as g
from tessera.operators import snapshots, tree
from tessera.session import clean_key, table

EDGES = """
WITH RECURSIVE o AS (SELECT user_id, lead(user_id) OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts, event_id) AS nxt FROM events),
edges AS (SELECT DISTINCT user_id AS src, nxt AS dst FROM o WHERE nxt IS NOT NULL AND nxt <> user_id),
seeds AS (SELECT DISTINCT user_id AS id FROM events WHERE user_id % 20 = 0)
"""


def user_edges(spark: SparkSession, root: str) -> DataFrame:
    """Each user to the next one with the same type of event on the day."""
    from pyspark.sql import Window

    turn = Window.partitionBy("event_type", F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    e = table(spark, root, "events").select(F.col("user_id").alias("src"), F.lead("user_id").over(turn).alias("dst"))
    return e.where("dst IS NOT NULL AND src <> dst").distinct()


def seeds(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").where("user_id % 20 = 0").select(F.col("user_id").alias("id")).distinct()


def calls(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), "l_returnflag", "l_linenumber", "l_suppkey", "l_partkey")


CALLS = "WITH c AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_returnflag, l_linenumber, l_suppkey, l_partkey FROM lineitem)"


@query("degrees", CALLS + ", e AS (SELECT src AS id, 1 AS o, 0 AS i FROM c UNION ALL SELECT dst, 0, 1 FROM c) SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(*)::BIGINT AS degree FROM e GROUP BY id")
def degrees(spark: SparkSession, root: str) -> DataFrame:
    return g.degrees(calls(spark, root))


@query("callers_with_context", CALLS + "SELECT dst AS target, s_name AS caller, n_name AS caller_file, count(*)::BIGINT AS sites FROM c JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL")
def callers_with_context(spark: SparkSession, root: str) -> DataFrame:
    """Call sites summed by supplier and part before names are joined on."""
    sites = calls(spark, root).groupBy("dst", "l_suppkey").agg(F.count("*").alias("sites"))
    named = sites.join(table(spark, root, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(table(spark, root, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return named.groupBy(F.col("dst").alias("target"), F.col("s_name").alias("caller"), F.col("n_name").alias("caller_file")).agg(F.sum("sites").cast("bigint").alias("sites"))


@query("callees_batch", CALLS + "SELECT src, count(DISTINCT dst)::BIGINT AS callees, min(l_linenumber)::INTEGER AS first_line FROM c WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY src")
def callees_batch(spark: SparkSession, root: str) -> DataFrame:
    wanted = table(spark, root, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    return calls(spark, root).join(wanted, "l_suppkey", "left_semi").groupBy("src").agg(F.count_distinct("dst").cast("bigint").alias("callees"), F.min("l_linenumber").cast("int").alias("first_line"))


FILES = "WITH f AS (SELECT n_name AS source, p_brand AS target, r_name AS region FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"


def file_calls(spark: SparkSession, root: str) -> DataFrame:
    n, r = table(spark, root, "nation"), table(spark, root, "region")
    places = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    s = table(spark, root, "supplier").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")
    line = table(spark, root, "lineitem").select("l_suppkey", "l_partkey").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return line.join(table(spark, root, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("n_name").alias("source"), F.col("p_brand").alias("target"), F.col("r_name").alias("region"))


@query("file_graph_edges", FILES + "SELECT source, target, count(*)::BIGINT AS calls FROM f WHERE source <> target GROUP BY ALL")
def file_graph_edges(spark: SparkSession, root: str) -> DataFrame:
    return g.rollup(file_calls(spark, root), "source", "target")


@query("file_graph_nodes", "SELECT repo, file_path, min(language) AS language, count(*)::BIGINT AS symbols FROM chunks WHERE name IS NOT NULL GROUP BY ALL")
def file_graph_nodes(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunks").where("name IS NOT NULL").groupBy("repo", "file_path").agg(F.min("language").alias("language"), F.count("*").alias("symbols"))


@query("overview_rollup", FILES + ", w AS (SELECT region, target, count(*) AS calls FROM f GROUP BY ALL), m AS (SELECT region, target AS main_target FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY calls DESC, target) AS n FROM w) WHERE n = 1) SELECT region, sum(calls)::BIGINT AS calls, count(*)::BIGINT AS targets, any_value(main_target) AS main_target FROM w JOIN m USING (region) GROUP BY region")
def overview_rollup(spark: SparkSession, root: str) -> DataFrame:
    w = file_calls(spark, root).groupBy("region", "target").agg(F.count("*").alias("calls"))
    mode = g.weighted_mode(w, "region", "target", "calls").withColumnRenamed("target", "main_target")
    return w.groupBy("region").agg(F.sum("calls").alias("calls"), F.count("*").alias("targets")).join(mode, "region")


@query("directory_boundary", "WITH e AS (SELECT regexp_replace(p.file_path, '/[^/]*$', '') AS source, regexp_replace(c.file_path, '/[^/]*$', '') AS target FROM (SELECT DISTINCT pending_id, repo, file_path, symbol_name FROM pending_chunks) p JOIN (SELECT DISTINCT chunk_id, file_path, name FROM chunks) c ON p.symbol_name = c.name), x AS (SELECT source AS external, 'caller' AS role FROM e WHERE NOT starts_with(source, 'src/') AND starts_with(target, 'src/') UNION ALL SELECT target, 'callee' FROM e WHERE starts_with(source, 'src/') AND NOT starts_with(target, 'src/')) SELECT external, CASE WHEN min(role) = max(role) THEN min(role) ELSE 'bidirectional' END AS role, count(*)::BIGINT AS calls FROM x GROUP BY external")
def directory_boundary(spark: SparkSession, root: str) -> DataFrame:
    from tessera.functions.text import parent_path

    p = table(spark, root, "pending_chunks").select("pending_id", "repo", F.col("file_path").alias("pf"), "symbol_name").distinct()
    ch = table(spark, root, "chunks").select("chunk_id", "file_path", "name").distinct()
    e = p.join(ch, p["symbol_name"] == ch["name"]).select(parent_path("pf").alias("source"), parent_path("file_path").alias("target"))
    return g.boundary_roles(e, "startswith({}, 'src/')", "source", "target")


@query("dead_and_hotspot_nodes", CALLS + ", d AS (SELECT dst AS id, count(*) AS n FROM c GROUP BY dst), p AS (SELECT 'p' || p_partkey AS id FROM part) SELECT 'hotspot' AS class, id, n::BIGINT AS degree FROM (SELECT *, row_number() OVER (ORDER BY n DESC, id) AS r FROM d) WHERE r <= 10 UNION ALL SELECT 'dead', id, 0 FROM p WHERE id NOT IN (SELECT id FROM d)")
def dead_and_hotspot_nodes(spark: SparkSession, root: str) -> DataFrame:
    called = calls(spark, root).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))
    hot = called.orderBy(F.col("degree").desc(), "id").limit(10)
    dead = table(spark, root, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id")).join(called, "id", "left_anti")
    return hot.select(F.lit("hotspot").alias("class"), "id", "degree").unionByName(dead.select(F.lit("dead").alias("class"), "id", F.lit(0).cast("bigint").alias("degree")))


@query("neighborhood", EDGES + ", ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), w AS (SELECT id AS seed, id, 0 AS depth FROM seeds UNION SELECT seed, dst, depth + 1 FROM w JOIN ways ON src = id WHERE depth < 2) SELECT seed, id, min(depth)::INTEGER AS depth FROM w GROUP BY ALL")
def neighborhood(spark: SparkSession, root: str) -> DataFrame:
    return g.traverse(seeds(spark, root), user_edges(spark, root), 2, "both")


@query("blast_radius", EDGES + ", w AS (SELECT id AS seed, id, 0 AS depth FROM seeds UNION SELECT seed, src, depth + 1 FROM w JOIN edges ON dst = id WHERE depth < 3) SELECT seed, id, min(depth)::INTEGER AS depth FROM w GROUP BY ALL")
def blast_radius(spark: SparkSession, root: str) -> DataFrame:
    return g.traverse(seeds(spark, root), user_edges(spark, root), 3, "in")


@query("call_chain", EDGES + ", w AS (SELECT id AS seed, id, 0 AS depth, [id] AS path FROM seeds UNION ALL SELECT seed, dst, depth + 1, list_append(path, dst) FROM w JOIN edges ON src = id WHERE depth < 2) SELECT seed, id, depth::INTEGER AS depth, path FROM (SELECT *, row_number() OVER (PARTITION BY seed, id ORDER BY depth, path) AS n FROM w) WHERE n = 1")
def call_chain(spark: SparkSession, root: str) -> DataFrame:
    return g.shortest_paths(seeds(spark, root), user_edges(spark, root), 2)


RESOLVE = r"""
WITH s AS (SELECT DISTINCT lower(trim(chunk_id, chr(9)||chr(10)||chr(13)||' ')) AS id, repo || '/' || file_path AS file, name, symbol_kind AS kind, start_line FROM chunks WHERE name IS NOT NULL),
e AS (SELECT DISTINCT pending_id AS id, repo || '/' || file_path AS caller_file, symbol_name AS target_name, CASE WHEN start_byte % 2 = 0 THEN repo || '/' || file_path END AS target_file, CASE WHEN start_line % 3 = 0 THEN symbol_kind END AS target_kind FROM pending_chunks WHERE symbol_name IS NOT NULL),
m AS (SELECT e.id, e.caller_file, e.target_file, s.id AS sid, s.file, s.start_line FROM e LEFT JOIN s ON e.target_name = s.name AND (e.target_kind IS NULL OR lower(e.target_kind) = lower(s.kind))),
a AS (SELECT id, count(sid) AS total, count(DISTINCT file) AS files, count(CASE WHEN file = caller_file THEN sid END) AS own,
  min(CASE WHEN file = caller_file THEN (start_line, sid, file) END) AS own_first, min(CASE WHEN sid IS NOT NULL THEN (start_line, sid, file) END) AS any_first, min(CASE WHEN file = target_file THEN (start_line, sid, file) END) AS asked_first FROM m GROUP BY id),
t AS (SELECT id, CASE WHEN own = 1 THEN own_first WHEN total = 1 THEN any_first WHEN asked_first IS NOT NULL THEN asked_first WHEN files = 1 THEN any_first END AS target, CASE WHEN own = 1 THEN 1 WHEN total = 1 THEN 2 WHEN asked_first IS NOT NULL OR files = 1 THEN 3 END AS pass FROM a)
SELECT id, target[2] AS to_id, target[3] AS to_file, pass::INTEGER AS pass FROM t
"""


@query("resolve_edges", RESOLVE)
def resolve_edges(spark: SparkSession, root: str) -> DataFrame:
    name = F.concat_ws("/", "repo", "file_path")
    s = table(spark, root, "chunks").where("name IS NOT NULL").select(clean_key("chunk_id").alias("id"), name.alias("file"), "name", F.col("symbol_kind").alias("kind"), "start_line").distinct()
    p = table(spark, root, "pending_chunks").where("symbol_name IS NOT NULL")
    e = p.select(F.col("pending_id").alias("id"), name.alias("caller_file"), F.col("symbol_name").alias("target_name"), F.when(F.col("start_byte") % 2 == 0, name).alias("target_file"), F.when(F.col("start_line") % 3 == 0, F.col("symbol_kind")).alias("target_kind")).distinct()
    return g.resolve_edges(e, s)


HASHES = r"""
WITH RECURSIVE f AS (SELECT repo, branch, snapshot_no, path, hash FROM (SELECT *, row_number() OVER (PARTITION BY repo, branch, snapshot_no, path ORDER BY delivered_at DESC, kind DESC, hash DESC NULLS LAST) AS rn FROM
  (SELECT repo, branch, snapshot_no, regexp_replace(regexp_replace(replace(trim(path), '\', '/'), '^(\./)+', ''), '/$', '') AS path, kind, lower(trim(hash)) AS hash, delivered_at FROM merkle_nodes)) WHERE rn = 1 AND kind = 'file'),
a AS (SELECT repo, branch, snapshot_no, path, coalesce(hash, '') AS hash, len(string_split(path, '/')) AS depth FROM f)
"""


def tree_files(spark: SparkSession, root: str) -> DataFrame:
    rows = snapshots.tree_nodes(table(spark, root, "merkle_nodes"))
    return snapshots.latest(rows, ["repo", "branch", "snapshot_no", "path"], "delivered_at", ["kind", "hash"]).where("kind = 'file'")


def _levels(deepest: int) -> str:
    ctes, parts = [], ["SELECT repo, branch, snapshot_no, path, hash, depth, 'file' AS kind FROM a"]
    for level in range(deepest, 1, -1):
        child = " UNION ALL ".join([f"SELECT repo, branch, snapshot_no, path, hash, 'file' AS kind FROM a WHERE depth = {level}"] + ([f"SELECT repo, branch, snapshot_no, path, hash, 'directory' FROM d{level}"] if level < deepest else []))
        ctes.append(f"d{level - 1} AS (SELECT repo, branch, snapshot_no, regexp_replace(path, '/[^/]*$', '') AS path, md5(string_agg(kind || ':' || path || ':' || hash, chr(10) ORDER BY kind || ':' || path || ':' || hash)) AS hash FROM ({child}) GROUP BY ALL)")
        parts.append(f"SELECT repo, branch, snapshot_no, path, hash, {level - 1}, 'directory' FROM d{level - 1}")
    return HASHES.rstrip().replace("WITH RECURSIVE", "WITH") + ", " + ", ".join(ctes) + " SELECT repo, branch, snapshot_no, path, kind, hash FROM (" + " UNION ALL ".join(parts) + ")"


@query("merkle_hashes", _levels(6))
def merkle_hashes(spark: SparkSession, root: str) -> DataFrame:
    return tree.directory_hashes(tree_files(spark, root), ["repo", "branch", "snapshot_no"])


@query("tree_directories", HASHES.replace("RECURSIVE", "") .rstrip() + ", x AS (SELECT repo, branch, snapshot_no, array_to_string(string_split(path, '/')[1:n], '/') AS path FROM (SELECT *, unnest(range(1, depth)) AS n FROM a)) SELECT DISTINCT * FROM x")
def tree_directories(spark: SparkSession, root: str) -> DataFrame:
    return tree.directories(tree_files(spark, root), ["repo", "branch", "snapshot_no"], "path")
