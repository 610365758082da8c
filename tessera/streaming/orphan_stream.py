"""Orphan references kept current by a stream of changes; see tessera.operators.orphans.

The state lies in one folder a batch: what the batch brought (refs, provides, dead), cut into BUCKETS by key, and the pending orphans
and counts after it. A batch reads the buckets its keys are in and writes only what is new. Every COMPACT batches the state is
written whole as a base for what follows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import orphans

TABLES = ("refs", "provides", "dead", "pending")
SCHEMA = "kind string, relation string, key string, holder string, entity string, at timestamp_ntz"
SCHEMAS = {"refs": "relation string, key string, holder string, entity string, at timestamp_ntz", "provides": "relation string, key string, entity string, at timestamp_ntz", "dead": "entity string, at timestamp_ntz", "pending": "relation string, key string, holder string, at timestamp_ntz, cause string"}
BUCKETS = 64
COMPACT = 50


def changes(feed: orphans.Feed) -> DataFrame:
    """A feed as one stream of changes; kind is ref, provide or dead."""
    columns = ("relation", "key", "holder", "entity", "at")

    def tagged(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), *[F.col(c) if c in df.columns else F.lit(None).cast("timestamp_ntz" if c == "at" else "string").alias(c) for c in columns])

    return tagged(feed.refs, "ref").unionByName(tagged(feed.provides, "provide")).unionByName(tagged(feed.dead, "dead"))


def batch_feed(batch: DataFrame) -> orphans.Feed:
    return orphans.Feed(
        batch.where("kind = 'ref'").select("relation", "key", "holder", "entity", "at"),
        batch.where("kind = 'provide'").select("relation", "key", "entity", "at"),
        batch.where("kind = 'dead'").select("entity", "at"),
    )


def bucketed(df: DataFrame) -> DataFrame:
    """Rows with the bucket of their key; those of ``dead`` have none."""
    return df.withColumn("bucket", F.pmod(F.xxhash64("relation", "key"), F.lit(BUCKETS)).cast("int") if "key" in df.columns else F.lit(0))


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def load(spark: SparkSession, path: str, number: int, buckets: list[int] | None = None) -> orphans.OrphanState | None:
    """The state after batch ``number``; of references and parents only the given buckets."""
    if number < 0:
        return None
    base = number // COMPACT * COMPACT
    base = base if base and _exists(spark, f"{path}/base/_done/batch={base}") else -1

    def read(name: str) -> DataFrame:
        parts = [("delta", range(base + 1, number + 1))] + ([("base", [base])] if base >= 0 else [])
        out = None
        for kind, batches in parts:
            folders = [f"{path}/{kind}/{name}/batch={n}" for n in batches]
            if folders:
                df = spark.read.schema(SCHEMAS[name] + ", batch int, bucket int").option("basePath", f"{path}/{kind}/{name}").parquet(*folders).drop("batch")
                out = df if out is None else out.unionByName(df)
        return (out.where(F.col("bucket").isin(buckets)) if buckets is not None and name in ("refs", "provides") else out).drop("bucket")

    pending = spark.read.schema(SCHEMAS["pending"]).parquet(f"{path}/after/{number}/pending")
    return orphans.OrphanState(*[read(t) for t in TABLES[:3]], pending, loose=())


def sink(spark: SparkSession, path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: state number n is made from state n - 1 and the batch, so a repeated batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        feed = batch_feed(batch)
        for name in TABLES[:3]:
            bucketed(getattr(feed, name)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/delta/{name}/batch={number}")
        new = orphans.Feed(*[spark.read.schema(SCHEMAS[t] + ", bucket int").parquet(f"{path}/delta/{t}/batch={number}").drop("bucket") for t in TABLES[:3]])
        before = load(spark, path, number - 1)
        if before is not None:
            keys = bucketed(orphans.touched_keys(before, new)).select("bucket").distinct()
            before = load(spark, path, number - 1, [r["bucket"] for r in keys.collect()])  # at most BUCKETS
        state = orphans.advance(before, new)
        state.pending.write.mode("overwrite").parquet(f"{path}/after/{number}/pending")
        done = spark.read.parquet(f"{path}/after/{number}/pending")
        orphans.counts(done).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/counts/{number}")
        if number and number % COMPACT == 0:
            whole = load(spark, path, number)
            for name, by in (("refs", orphans.REF), ("provides", orphans.PROVIDE), ("dead", ["entity"])):
                bucketed(orphans._merge(getattr(whole, name), by)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/base/{name}/batch={number}")
            spark.range(1).write.mode("overwrite").parquet(f"{path}/base/_done/batch={number}")

    return write


def history(spark: SparkSession, path: str) -> DataFrame:
    """The counts after every batch: batch, table_name, month, n_orphans, n_absent, n_late."""
    return spark.read.option("recursiveFileLookup", True).parquet(f"{path}/counts")
