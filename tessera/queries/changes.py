"""Queries over change streams and the job queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.operators import catalog
from tessera.session import table
from tessera.streaming import changes as s


def events(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select("event_id", "ts", "user_id", "event_type", "value")


ISLANDS = """
WITH m AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY {key} ORDER BY ts, event_id) + INTERVAL {gap} SECOND OR lag(ts) OVER (PARTITION BY {key} ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS s FROM m)
SELECT {key}, min(ts) AS started, max(ts) AS ended, count(*)::BIGINT AS events, arg_max(event_type, (ts, event_id)) AS last FROM g GROUP BY {key}, s
"""


@query("debounce_per_path", ISLANDS.format(key="user_id", gap=3600))
def debounce_per_path(spark: SparkSession, root: str) -> DataFrame:
    return s.sessions(events(spark, root), ["user_id"], "ts", ["event_id"], 3600, "event_type")


@query("debounce_per_day", ISLANDS.format(key="day", gap=60).replace("FROM events)", "FROM (SELECT *, date_trunc('day', ts)::TIMESTAMP AS day FROM events))"))
def debounce_per_day(spark: SparkSession, root: str) -> DataFrame:
    """One timer for all paths within each day; debounce_global has the whole feed."""
    return s.sessions(events(spark, root).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz")), ["day"], "ts", ["event_id"], 60, "event_type")


@query("debounce_global", """
WITH m AS (SELECT *, CASE WHEN ts > lag(ts) OVER (ORDER BY ts, event_id) + INTERVAL 60 SECOND OR lag(ts) OVER (ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (ORDER BY ts, event_id) AS s FROM m)
SELECT min(ts) AS started, max(ts) AS ended, count(*)::BIGINT AS events, arg_max(event_type, (ts, event_id)) AS last FROM g GROUP BY s
""")
def debounce_global(spark: SparkSession, root: str) -> DataFrame:
    """One timer for all paths over the whole feed, as the watcher has it."""
    return s.global_sessions(events(spark, root), "ts", ["event_id"], 60, "event_type")


@query("last_write_wins", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last, max(ts) AS ended, count(*)::BIGINT AS events FROM events GROUP BY user_id")
def last_write_wins(spark: SparkSession, root: str) -> DataFrame:
    return s.last_writes(events(spark, root), ["user_id"], "ts", ["event_id"], "event_type")


@query("branch_switches", "SELECT user_id, ts, old, event_type AS new FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events) WHERE old IS NOT NULL AND old <> event_type")
def branch_switches(spark: SparkSession, root: str) -> DataFrame:
    return s.switches(events(spark, root), ["user_id"], "ts", ["event_id"], "event_type")


@query("upsert_latest", "SELECT user_id, event_type, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC, value DESC) AS n FROM events) WHERE n = 1")
def upsert_latest(spark: SparkSession, root: str) -> DataFrame:
    return catalog.upsert_latest(events(spark, root), ["user_id", "event_type"], ["ts", "event_id"])


@query("queue_order", """
WITH j AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE left(o_orderpriority, 1) WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 3 ELSE 4 END AS p FROM orders),
now AS (SELECT max(o_orderdate) AS now FROM orders),
m AS (SELECT o_custkey, min(p) AS p, min((o_orderdate, o_orderkey)) AS f, count(*) AS requests FROM j GROUP BY ALL)
SELECT o_custkey, (CASE WHEN p = 4 AND f[1] < now - INTERVAL 30 SECOND THEN 3 ELSE p END)::INTEGER AS class, f[1] AS enqueued, f[2] AS o_orderkey, requests::BIGINT AS requests FROM m CROSS JOIN now""")
def queue_order(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    digit = F.substring("o_orderpriority", 1, 1)
    priority = F.when(digit == "1", "critical").when(digit == "2", "high").when(digit == "3", "normal").otherwise("low")
    now = F.lit(o.agg(F.max("o_orderdate")).first()[0])
    return s.queue_order(o, ["o_custkey"], priority, "o_orderdate", now.cast("timestamp_ntz"), ["o_orderkey"]).select("o_custkey", "class", "enqueued", "o_orderkey", "requests")


@query("queue_stats", "SELECT o_orderpriority AS priority, count(*)::BIGINT AS jobs, count(CASE WHEN o_orderstatus = 'O' THEN 1 END)::BIGINT AS open_jobs, count(DISTINCT o_custkey)::BIGINT AS keys FROM orders GROUP BY ALL")
def queue_stats(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("jobs"), F.count_if(F.col("o_orderstatus") == "O").alias("open_jobs"), F.count_distinct("o_custkey").cast("bigint").alias("keys"))


@query("time_to_index", """
WITH d AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done FROM events),
t AS (SELECT user_id, epoch(done) - epoch(ts) AS seconds FROM d WHERE done IS NOT NULL)
SELECT user_id, count(*)::BIGINT AS n, round(max(seconds), 3) AS longest, round(avg(seconds), 3) AS mean, count(CASE WHEN seconds > 7200 THEN 1 END)::BIGINT AS over_target FROM t GROUP BY user_id""")
def time_to_index(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.sql import Window

    done = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    seconds = (F.col("done") - F.col("ts")).cast("interval day to second")
    t = events(spark, root).withColumn("done", done).where("done IS NOT NULL").withColumn("seconds", F.extract(F.lit("DAY"), seconds) * 86400 + F.extract(F.lit("HOUR"), seconds) * 3600 + F.extract(F.lit("MINUTE"), seconds) * 60 + F.extract(F.lit("SECOND"), seconds).cast("double"))
    return t.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max("seconds"), 3).alias("longest"), F.round(F.avg("seconds"), 3).alias("mean"), F.count_if(F.col("seconds") > 7200).alias("over_target"))


@query("stale_stages", """
WITH r AS (SELECT repo, branch, started_at, total_chunks, lag(total_chunks) OVER (PARTITION BY repo, branch ORDER BY started_at, run_id) AS stored FROM (SELECT DISTINCT run_id, repo, branch, started_at, total_chunks FROM index_stats))
SELECT repo, branch, count(*)::BIGINT AS runs, count(CASE WHEN stored IS NULL OR stored <> total_chunks THEN 1 END)::BIGINT AS stale FROM r GROUP BY ALL""")
def stale_stages(spark: SparkSession, root: str) -> DataFrame:
    """A stage is stale without a stored input, or when that differs from the present one."""
    from pyspark.sql import Window

    rows = table(spark, root, "index_stats").select("run_id", "repo", "branch", "started_at", "total_chunks").distinct()
    stored = F.lag("total_chunks").over(Window.partitionBy("repo", "branch").orderBy("started_at", "run_id"))
    return rows.withColumn("stored", stored).groupBy("repo", "branch").agg(F.count("*").alias("runs"), F.count_if(F.col("stored").isNull() | (F.col("stored") != F.col("total_chunks"))).alias("stale"))
