"""Change streams: debouncing, last write wins, branch switches and the job queue, in batch and as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import cut, parallelism

# Queue classes in order of service, and the wait after which a low job counts as normal.
PRIORITIES = ["critical", "high", "normal", "low"]
STARVED_SECONDS = 30


def sessions(events: DataFrame, key: list[str], at: str, order: list[str], gap_seconds: int, value: str) -> DataFrame:
    """Batches of changes that a pause of more than gap_seconds ends: (key, started, ended, events, last value).
    With an empty key one timer serves all paths; that form is a single sequence by nature."""
    seq = Window.partitionBy(*key).orderBy(at, *order)
    pause = F.col(at) > F.lag(at).over(seq) + F.expr(f"INTERVAL '{gap_seconds}' SECOND")
    marked = events.withColumn("_new", F.coalesce(pause, F.lit(True)).cast("int")).withColumn("_s", F.sum("_new").over(seq))
    return marked.groupBy(*key, "_s").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("events"), F.max_by(value, F.struct(at, *order)).alias("last")).drop("_s")


def global_sessions(events: DataFrame, at: str, order: list[str], gap_seconds: int, value: str) -> DataFrame:
    """sessions with one timer for all paths: (started, ended, events, last value), without a task that holds the
    whole feed. Ranges of time are cut into sessions of their own; each range's last time is carried over to the
    next one, and a range's first session that follows without a pause continues the one before it."""
    gap = F.expr(f"INTERVAL '{gap_seconds}' SECOND")
    ranged = events.select(at, *order, F.col(value).alias("_v")).repartitionByRange(parallelism(events.sparkSession), F.col(at), *[F.col(o) for o in order])
    placed = cut(ranged.withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range").orderBy(at, *order)
    fresh = F.coalesce(F.col(at) > F.lag(at).over(inside) + gap, F.lit(True))
    numbered = placed.withColumn("_new", fresh.cast("int")).withColumn("_part", F.sum("_new").over(inside))
    parts = cut(numbered.groupBy("_range", "_part").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("events"), F.max_by(F.struct("_v"), F.struct(at, *order)).alias("_last")))
    # one row a range: where it begins and ends, and whether it is one session throughout
    spans = parts.groupBy("_range").agg(F.min("started").alias("_first"), F.max("ended").alias("_end"), F.max("_part").alias("_parts"))
    across = Window.orderBy("_range")
    continues = F.coalesce(F.col("_first") <= F.lag("_end").over(across) + gap, F.lit(False))
    # the range in which the session that a range's first part belongs to has begun
    begun = F.when(~F.col("_continues") | (F.lag("_parts").over(across) > 1), F.when(F.col("_continues"), F.lag("_range").over(across)).otherwise(F.col("_range")))
    spans = spans.withColumn("_continues", continues).withColumn("_begun", F.last(begun, ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    homes = spans.select("_range", F.col("_begun").alias("_home"))
    ends = spans.select(F.col("_range").alias("_home"), F.col("_parts").alias("_home_part"))
    homes = F.broadcast(homes.join(F.broadcast(ends), "_home"))
    whole = parts.join(homes, "_range").withColumn("_s", F.when(F.col("_part") == 1, F.struct(F.col("_home").alias("r"), F.when(F.col("_home") == F.col("_range"), F.col("_part")).otherwise(F.col("_home_part")).alias("p"))).otherwise(F.struct(F.col("_range").alias("r"), F.col("_part").alias("p"))))
    return whole.groupBy("_s").agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("events").alias("events"), F.max_by("_last", F.struct("_range", "_part")).alias("_last")).select("started", "ended", "events", F.col("_last._v").alias("last"))


def last_writes(events: DataFrame, key: list[str], at: str, order: list[str], value: str) -> DataFrame:
    return events.groupBy(*key).agg(F.max_by(value, F.struct(at, *order)).alias("last"), F.max(at).alias("ended"), F.count("*").alias("events"))


def switches(events: DataFrame, key: list[str], at: str, order: list[str], value: str) -> DataFrame:
    """Rows where a value differs from the key's last one: (key, at, old, new)."""
    seq = Window.partitionBy(*key).orderBy(at, *order)
    return events.withColumn("old", F.lag(value).over(seq)).where(F.col("old").isNotNull() & (F.col("old") != F.col(value))).select(*key, at, "old", F.col(value).alias("new"))


def queue_order(jobs: DataFrame, key: list[str], priority: Column, enqueued: str, now: Column, order: list[str]) -> DataFrame:
    """One job per key (its best priority, its first time), starved low jobs as normal, with the class and time it is served by."""
    classes = F.array(*[F.lit(p) for p in PRIORITIES])
    level = F.array_position(classes, priority).cast("int")
    merged = jobs.withColumn("_p", level).groupBy(*key).agg(F.min("_p").alias("_p"), F.min(F.struct(enqueued, *order)).alias("_f"), F.count("*").alias("requests"))
    waited = F.col(f"_f.{enqueued}") < now - F.expr(f"INTERVAL '{STARVED_SECONDS}' SECOND")
    served = F.when((F.col("_p") == 4) & waited, 3).otherwise(F.col("_p"))
    return merged.select(*key, served.alias("class"), F.col(f"_f.{enqueued}").alias("enqueued"), *[F.col(f"_f.{o}").alias(o) for o in order], "requests")


def stream_sessions(events: DataFrame, key: str, at: str, gap: str, delay: str) -> DataFrame:
    """The streaming form of sessions: event-time sessions per key behind a watermark."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay)
    grouped = timed.groupBy(F.session_window("_at", gap).alias("w"), key)
    return grouped.agg(F.count("*").alias("events"), F.max("_at").alias("ended")).select(key, F.col("w.start").alias("started"), "ended", "events")


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Everything that has arrived, in one run that a later run continues."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def upsert_sink(spark: SparkSession, path: str, key: list[str], version: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the latest row per key under path/<batch>; the newest folder is the table.
    A repeated batch rewrites its own folder."""
    from tessera.operators.catalog import upsert_latest

    def write(batch: DataFrame, number: int) -> None:
        old = f"{path}/{number - 1}"
        rows = batch if number == 0 else spark.read.parquet(old).unionByName(batch)
        upsert_latest(rows, key, version).write.mode("overwrite").parquet(f"{path}/{number}")

    return write
