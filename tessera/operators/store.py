"""Table maintenance on plain DataFrames: every write is a new DataFrame, every lookup a filter or a semi join.

One small set of functions serves all tables of the index (chunks, symbols, edges, vectors, memberships, pipeline states and
runs, configurations, debts, drops, metadata): only the key differs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.catalog import upsert_latest


def equal(**values: object) -> Column:
    """The AND of column = value; None means IS NULL."""
    return reduce(lambda a, b: a & b, [F.col(c).isNull() if v is None else F.col(c) == F.lit(v) for c, v in values.items()])


def lookup(table: DataFrame, **values: object) -> DataFrame:
    """Rows with the given values; the filter reaches the scan."""
    return table.where(equal(**values))


def lookup_batch(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is among keys."""
    return table.join(keys.select(*on).distinct(), on, "left_semi")


def contains(table: DataFrame, **values: object) -> bool:
    return not lookup(table, **values).limit(1).isEmpty()


def on_other_branches(membership: DataFrame, branch: str, key: str) -> DataFrame:
    """Keys of a branch that some other branch has too."""
    here, there = membership.where(F.col("branch") == branch), membership.where(F.col("branch") != branch)
    return here.select(key).join(there.select(key).distinct(), key, "left_semi")


def upsert(table: DataFrame, rows: DataFrame, key: list[str], version: str | None = None) -> DataFrame:
    """The last write of each key wins: rows over table, and within both the greatest version."""
    order = ["_write"] if version is None else ["_write", version]
    both = table.withColumn("_write", F.lit(0)).unionByName(rows.withColumn("_write", F.lit(1)))
    return upsert_latest(both, key, order).drop("_write").select(*table.columns)


def insert_ignore(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Adds rows whose key isn't there."""
    return table.unionByName(rows.dropDuplicates(key).join(table.select(*key), key, "left_anti").select(*table.columns))


def delete(table: DataFrame, **values: object) -> DataFrame:
    return table.where(~F.coalesce(equal(**values), F.lit(False)))


def delete_batch(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def cleared(table: DataFrame) -> DataFrame:
    return table.limit(0)


def replace_branch(table: DataFrame, branch: str, rows: DataFrame) -> DataFrame:
    """A branch's rows, replaced as a whole."""
    return delete(table, branch=branch).unionByName(rows.select(*table.columns))


def set_where(table: DataFrame, condition: Column, **values: object) -> DataFrame:
    """Columns set on the rows where condition holds."""
    hit = F.coalesce(condition, F.lit(False))
    return table.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)).cast(table.schema[c].dataType) for c, v in values.items()})


def activate(table: DataFrame, key: str, value: str) -> DataFrame:
    """One active row, all others inactive."""
    return table.withColumn("active", F.col(key) == value)


def unresolve(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without their targets among gone (id), and without the edges whose source is gone."""
    ids = gone.select(F.col("id").alias("_gone")).distinct()
    kept = edges.join(ids, edges["from_symbol_id"] == ids["_gone"], "left_anti")
    marked = kept.join(ids, kept["to_symbol_id"] == ids["_gone"], "left")
    lost = F.col("_gone").isNotNull()
    return marked.withColumn("to_symbol_id", F.when(~lost, F.col("to_symbol_id"))).withColumn("is_resolved", F.col("is_resolved") & ~lost).drop("_gone")


def stale(wanted: DataFrame, state: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose stage has to run: no state, not complete, or made from another input. wanted has input_hash."""
    have = state.select(*key, "status", F.col("input_hash").alias("_stored"))
    joined = wanted.join(have, key, "left")
    fresh = (F.col("status") == "complete") & F.col("_stored").eqNullSafe(F.col("input_hash")) & F.col("_stored").isNotNull()
    return joined.where(~F.coalesce(fresh, F.lit(False))).select(*wanted.columns)


def latest_active(versions: DataFrame) -> DataFrame:
    """The newest active version; ties by the greater hash."""
    return versions.where("active").orderBy(F.col("created_at").desc(), F.col("config_hash").desc()).limit(1)


def prune_runs(runs: DataFrame, before: str) -> DataFrame:
    """Without completed runs older than a time."""
    return runs.where(~F.coalesce((F.col("status") == "completed") & (F.col("completed_at") < F.lit(before).cast("timestamp_ntz")), F.lit(False)))


def lookup_orphans(rows: DataFrame, referenced: DataFrame, key: str) -> DataFrame:
    """Rows whose key nothing refers to."""
    return rows.join(referenced.select(key).distinct(), key, "left_anti")


def orphan_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end that isn't among ids (id); an unresolved end is none."""
    known = ids.select(F.col("id").alias("_id")).distinct()
    lost = edges.join(known, edges["from_symbol_id"] == known["_id"], "left_anti")
    kept = edges.join(known, edges["from_symbol_id"] == known["_id"], "left_semi").where("to_symbol_id IS NOT NULL")
    return lost.unionByName(kept.join(known, kept["to_symbol_id"] == known["_id"], "left_anti"))
