"""Queries over the index's own tables: orphan references and snapshot changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.operators import orphans, snapshots
from tessera.session import cut, table

ORPHAN_CTES = """
WITH c AS (SELECT lower(trim(chunk_id, chr(9)||chr(10)||chr(13)||' ')) AS id, lower(trim(content_hash, chr(9)||chr(10)||chr(13)||' ')) AS h, indexed_at AS seen, deleted_at FROM chunks),
dead AS (SELECT DISTINCT id FROM c WHERE deleted_at IS NOT NULL),
live AS (SELECT id, h, min(seen) AS seen FROM c WHERE id NOT IN (SELECT id FROM dead) GROUP BY ALL),
e AS (SELECT lower(trim(embedding_input_hash)) AS eih, lower(trim(content_hash)) AS h, min(make_timestamp(created_at * 1000)) AS seen FROM chunk_embeddings GROUP BY ALL),
b AS (SELECT lower(trim(branch)) AS branch, lower(trim(chunk_id, chr(9)||chr(10)||chr(13)||' ')) AS id, min(added_at) AS seen FROM branch_chunks GROUP BY ALL),
refs AS (
  SELECT 'branch_chunks' AS t, branch AS holder, id AS k, seen FROM b
  UNION ALL SELECT 'chunks', id, h, seen FROM live WHERE h IS NOT NULL
  UNION ALL SELECT 'chunk_embeddings', eih, h, seen FROM e WHERE h IS NOT NULL),
parents AS (
  SELECT 'branch_chunks' AS t, id AS k, min(seen) AS pat FROM live GROUP BY id
  UNION ALL SELECT 'chunks', h, min(seen) FROM e GROUP BY h
  UNION ALL SELECT 'chunk_embeddings', h, min(seen) FROM live WHERE h IS NOT NULL GROUP BY h),
pending AS (
  SELECT r.t AS relation, r.holder, r.k AS key, r.seen, CASE WHEN p.k IS NULL THEN 'absent' ELSE 'late' END AS cause
  FROM refs r LEFT JOIN parents p ON r.t = p.t AND r.k = p.k
  WHERE p.k IS NULL OR p.pat > r.seen + INTERVAL 24 HOUR)
"""


def _feed(spark: SparkSession, root: str) -> orphans.Feed:
    return orphans.index_feed(*(table(spark, root, t) for t in ("branch_chunks", "chunks", "chunk_embeddings")))


def _replayed(spark: SparkSession, root: str) -> orphans.OrphanState:
    """The state after the last month of the feed, every month having been a step."""
    state = orphans.empty_state(spark)
    for _, state in orphans.replay(_feed(spark, root)):  # noqa: B007
        pass
    return state


@query("p1_found", ORPHAN_CTES + "SELECT DISTINCT relation AS table_name, holder AS holder_key, key AS missing_key FROM pending")
def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Read off the state after the feed has come in month by month."""
    return orphans.found(_replayed(spark, root).pending)


@query(
    "p1_counts",
    ORPHAN_CTES
    + """SELECT relation AS table_name, strftime(seen, '%Y-%m') AS month, count(*)::BIGINT AS n_orphans,
  sum(CASE WHEN cause = 'absent' THEN 1 ELSE 0 END)::BIGINT AS n_absent, sum(CASE WHEN cause = 'late' THEN 1 ELSE 0 END)::BIGINT AS n_late
FROM pending GROUP BY ALL""",
)
def p1_counts(spark: SparkSession, root: str) -> DataFrame:
    """Counts of the state after the feed has come in month by month."""
    return orphans.counts(_replayed(spark, root).pending)


COUNTED = """relation AS table_name, strftime(seen, '%Y-%m') AS month, count(*)::BIGINT AS n_orphans,
  sum(CASE WHEN cause = 'absent' THEN 1 ELSE 0 END)::BIGINT AS n_absent, sum(CASE WHEN cause = 'late' THEN 1 ELSE 0 END)::BIGINT AS n_late
FROM pending GROUP BY ALL"""
LAST_MONTH = "(SELECT date_trunc('month', max(added_at)) FROM branch_chunks)"
BEFORE = (
    ORPHAN_CTES.replace("FROM chunks)", f"FROM chunks WHERE indexed_at IS NULL OR indexed_at < {LAST_MONTH})")
    .replace("FROM chunk_embeddings GROUP", f"FROM chunk_embeddings WHERE make_timestamp(created_at * 1000) < {LAST_MONTH} GROUP")
    .replace("FROM branch_chunks GROUP", f"FROM branch_chunks WHERE added_at IS NULL OR added_at < {LAST_MONTH} GROUP")
    .replace("SELECT DISTINCT id FROM c WHERE deleted_at IS NOT NULL", f"SELECT DISTINCT lower(trim(chunk_id, chr(9)||chr(10)||chr(13)||' ')) AS id FROM chunks WHERE deleted_at < {LAST_MONTH}")
)


@query("p1_history", f"SELECT * FROM ({BEFORE} SELECT 0::INT AS step, {COUNTED}) UNION ALL SELECT * FROM ({ORPHAN_CTES} SELECT 1::INT AS step, {COUNTED})")
def p1_history(spark: SparkSession, root: str) -> DataFrame:
    """The counts before the last month of the memberships and at the end of the replay: what comes between resolves, adds and reopens."""
    last = table(spark, root, "branch_chunks").agg(orphans.month_number(F.max("added_at")).alias("m")).first()["m"]
    before = after = orphans.counts(orphans.empty_state(spark).pending)
    for month, state in orphans.replay(_feed(spark, root)):
        after = cut(orphans.counts(state.pending))
        if month < (orphans.UNTIMED + 1 if last is None else last):
            before = after
    return before.select(F.lit(0).alias("step"), "*").unionByName(after.select(F.lit(1).alias("step"), "*"))


TREE_CTES = r"""
WITH n AS (SELECT repo, branch, snapshot_no, regexp_replace(regexp_replace(replace(trim(path), '\', '/'), '^(\./)+', ''), '/$', '') AS path, kind, lower(trim(hash)) AS hash, delivered_at FROM merkle_nodes),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, branch, snapshot_no, path ORDER BY delivered_at DESC NULLS LAST, kind DESC, hash DESC NULLS LAST) AS rn FROM n) WHERE rn = 1),
s AS (SELECT *, lag(snapshot_no) OVER (PARTITION BY repo, branch ORDER BY snapshot_no) AS prev FROM (SELECT DISTINCT repo, branch, snapshot_no FROM n)),
f AS (SELECT d.*, s.prev FROM d JOIN s USING (repo, branch, snapshot_no) WHERE kind = 'file'),
diff AS (
  SELECT a.repo, a.branch, a.snapshot_no, a.path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.hash <> b.hash THEN 'changed' END AS change_kind
  FROM f a LEFT JOIN f b ON a.repo = b.repo AND a.branch = b.branch AND b.snapshot_no = a.prev AND a.path = b.path WHERE a.prev IS NOT NULL
  UNION ALL
  SELECT b.repo, b.branch, s.snapshot_no, b.path, 'removed'
  FROM f b JOIN s ON s.repo = b.repo AND s.branch = b.branch AND s.prev = b.snapshot_no
  LEFT JOIN f a ON a.repo = b.repo AND a.branch = b.branch AND a.snapshot_no = s.snapshot_no AND a.path = b.path WHERE a.path IS NULL),
changes AS (SELECT * FROM diff WHERE change_kind IS NOT NULL)
"""


@query("p3_found", TREE_CTES + "SELECT repo, branch, snapshot_no, path, change_kind FROM changes")
def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return snapshots.tree_changes(table(spark, root, "merkle_nodes")).select("repo", "branch", "snapshot_no", "path", "change_kind")


@query("p3_counts", TREE_CTES + "SELECT repo, branch, snapshot_no, change_kind, count(*)::BIGINT AS n FROM changes GROUP BY ALL")
def p3_counts(spark: SparkSession, root: str) -> DataFrame:
    return snapshots.tree_changes(table(spark, root, "merkle_nodes")).groupBy("repo", "branch", "snapshot_no", "change_kind").agg(F.count("*").alias("n"))
