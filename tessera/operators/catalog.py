"""The branch catalogue: filters, membership, upserts, deltas and garbage collection as joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import glob_regex
from tessera.session import clean_key


def upsert_latest(rows: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """One row per key, that of the greatest version (ties: the greatest remaining values)."""
    rest = [c for c in rows.columns if c not in key and c not in version]
    pick = F.max(F.struct(*version, *rest)).alias("_r")
    return rows.groupBy(*key).agg(pick).select(*key, *[F.col(f"_r.{c}").alias(c) for c in [*version, *rest]])


def live_chunks(chunks: DataFrame) -> DataFrame:
    """Each chunk's latest row, without chunks that any row marks as deleted."""
    rows = chunks.withColumn("chunk_id", clean_key("chunk_id")).withColumn("content_hash", clean_key("content_hash")).withColumn("symbol_aliases", F.array_sort("symbol_aliases"))
    dead = rows.where("deleted_at IS NOT NULL").select("chunk_id").distinct()
    return upsert_latest(rows.where("deleted_at IS NULL").drop("deleted_at"), ["chunk_id"], ["indexed_at"]).join(dead, "chunk_id", "left_anti")


def members(branch_chunks: DataFrame) -> DataFrame:
    return branch_chunks.select(clean_key("branch").alias("branch"), clean_key("chunk_id").alias("chunk_id")).where("chunk_id IS NOT NULL").distinct()


def on_branch(chunks: DataFrame, membership: DataFrame, branch: str) -> DataFrame:
    return chunks.join(membership.where(F.col("branch") == branch), "chunk_id", "left_semi")


def hard_filter(extension: str | None = None, directory: str | None = None, node_type: str | None = None, exclude: str | None = None, chunk_kind: str | None = None, language: str | None = None, glob: str | None = None) -> Column | None:
    """The AND of the given filters; None without any, so that callers skip the join altogether."""
    path = F.col("file_path")
    parts = []
    if extension:
        parts.append(F.lower(path).endswith("." + extension.lower().lstrip(".")))
    if directory:
        parts.append((path == directory) | path.startswith(directory.rstrip("/") + "/"))
    if node_type:
        parts.append(F.lower("node_type") == node_type.lower())
    if exclude:
        parts.append(path != exclude)
    if chunk_kind:
        parts.append(F.col("chunk_kind") == chunk_kind)
    if language:
        parts.append(F.lower("language") == language.lower())
    if glob:
        parts.append(path.rlike(glob_regex(glob)) | path.rlike(glob_regex("**/" + glob)))
    return reduce(lambda a, b: a & b, parts) if parts else None


def named(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """Chunks whose name or alias equals one of the names (column wanted), exactly; without an exact one, ignoring case."""
    keys = chunks.select("chunk_id", F.explode(F.array_distinct(F.array_compact(F.concat(F.array("name"), F.coalesce("symbol_aliases", F.array().cast("array<string>")))))).alias("key"))
    exact = names.join(keys, F.col("wanted") == F.col("key")).select("wanted", "chunk_id", F.lit("exact").alias("how")).distinct()
    rest = names.join(exact.select("wanted").distinct(), "wanted", "left_anti")
    loose = rest.join(keys, F.lower("wanted") == F.lower("key")).select("wanted", "chunk_id", F.lit("ignoring case").alias("how")).distinct()
    return exact.unionByName(loose)


def delta(membership: DataFrame, base: str) -> DataFrame:
    """What each branch has and lacks against a base branch, in one aggregation instead of two EXCEPTs a branch."""
    base_ids = membership.where(F.col("branch") == base).select("chunk_id", F.lit(1).alias("in_base"))
    added = membership.where(F.col("branch") != base).join(base_ids, "chunk_id", "left")
    counts = added.groupBy("branch").agg(F.count("*").alias("n"), F.sum(F.when(F.col("in_base").isNull(), 1).otherwise(0)).alias("added"))
    size = base_ids.count()
    return counts.select("branch", F.col("added").cast("bigint").alias("added"), (size - (F.col("n") - F.col("added"))).cast("bigint").alias("removed"))


def apply_delta(membership: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Removals first, then additions."""
    keys = ["branch", "chunk_id"]
    return membership.join(removed.select(*keys), keys, "left_anti").unionByName(added.select(*keys)).distinct()


def missing_vectors(chunks: DataFrame, vectors: DataFrame, models: DataFrame) -> DataFrame:
    """(model, embedding_input_hash) wanted by a chunk and not stored; models is a short list."""
    wanted = chunks.select("embedding_input_hash").where("embedding_input_hash IS NOT NULL").distinct().join(F.broadcast(models), how="cross")
    return wanted.join(vectors.select("embedding_input_hash", "model").distinct(), ["embedding_input_hash", "model"], "left_anti")


def collect_garbage(chunks: DataFrame, membership: DataFrame, vectors: DataFrame) -> DataFrame:
    """(kind, id) of chunks on no branch and of vectors that no remaining chunk needs."""
    orphan = chunks.join(membership, "chunk_id", "left_anti").select("chunk_id", "embedding_input_hash")
    kept = chunks.join(membership, "chunk_id", "left_semi").select("embedding_input_hash")
    unused = vectors.select("embedding_input_hash").distinct().join(kept, "embedding_input_hash", "left_anti")
    return orphan.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id")).unionByName(unused.select(F.lit("vector").alias("kind"), F.col("embedding_input_hash").alias("id")))


#: Lines of a bucket: a file's chunks and symbols only meet in the buckets they share.
LINES = 512


def best_enclosing(symbols: DataFrame, chunks: DataFrame, file: list[str], symbol: str) -> DataFrame:
    """For each symbol (start, end, name) the chunk of its file that contains it: same name first, then the shortest, then by id.
    A chunk is in every bucket of lines it covers, a symbol in that of its first line, so a long file isn't one task."""
    bucket = lambda c: F.floor(F.col(c) / LINES).cast("int")
    s = symbols.withColumn("_b", bucket("start_line")).alias("s")
    c = chunks.withColumn("_b", F.explode(F.sequence(bucket("start_line"), F.greatest(bucket("start_line"), bucket("end_line"))))).alias("c")
    on = reduce(lambda a, b: a & b, [F.col(f"s.{f}") == F.col(f"c.{f}") for f in [*file, "_b"]])
    inside = (F.col("c.start_line") <= F.col("s.start_line")) & (F.col("c.end_line") >= F.col("s.end_line"))
    rank = F.struct(
        F.when(F.col("c.name").eqNullSafe(F.col("s.name")), 0).otherwise(1).alias("a"),
        (F.col("c.end_line") - F.col("c.start_line")).alias("b"),
        F.col("c.chunk_id").alias("chunk_id"),
    )
    return s.join(c, on & inside).groupBy(F.col(f"s.{symbol}").alias(symbol)).agg(F.min(rank).alias("r")).select(symbol, F.col("r.chunk_id").alias("chunk_id"))


def missing_keys(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't stored."""
    return rows.join(stored.select(key).distinct(), key, "left_anti")


def cap_drops(chunks: DataFrame, file: list[str], most: int) -> DataFrame:
    """How many chunks of each file go beyond the most a file may have."""
    return chunks.groupBy(*file).agg((F.count("*") - most).alias("dropped")).where("dropped > 0")


def kept_under_cap(chunks: DataFrame, file: list[str], order: list[str], most: int) -> DataFrame:
    """The first chunks of each file, up to the most it may have."""
    return chunks.withColumn("_n", F.row_number().over(Window.partitionBy(*file).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def diff_by_key(old: DataFrame, new: DataFrame, every: DataFrame, group: list[str], key: str) -> DataFrame:
    """Per group of ``every``: keys in both versions, only in the new and only in the old one."""
    mark = lambda df, o, n: df.select(*group, key, F.lit(o).alias("o"), F.lit(n).alias("n"))
    rows = mark(old, 1, 0).unionByName(mark(new, 0, 1)).unionByName(mark(every, 0, 0))
    per = rows.groupBy(*group, key).agg(F.max("o").alias("o"), F.max("n").alias("n"))
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    o, n = F.col("o") == 1, F.col("n") == 1
    return per.groupBy(*group).agg(count(o & n).alias("kept"), count(n & ~o).alias("added"), count(o & ~n).alias("removed"))
