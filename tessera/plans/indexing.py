"""The index over a repository's files as plans: from nothing, and brought up to date.

A file's state is the digest of its content and of the chunker's version. An update reads only the files whose state changed,
takes the chunks of changed and vanished files off and adds the new ones; so its result is that of a fresh start."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import content
from tessera.functions.text import content_id
from tessera.session import cut
from tessera.sources import chunker

CHUNKER = "1"


@dataclass
class Index:
    """chunks (path, chunk_id, start_line, end_line, content_hash, text) and state (path, input_hash)."""

    chunks: DataFrame
    state: DataFrame


def states(files: DataFrame) -> DataFrame:
    """files: (path, content). Files without content have none."""
    return files.where("content IS NOT NULL").select("path", content.digest(F.md5(F.col("content").cast("binary")), F.lit(CHUNKER)).alias("input_hash"))


def chunks_of(files: DataFrame) -> DataFrame:
    rows = chunker.chunk_files(files.select("path", "content"), "path", "content")
    return rows.select("path", content_id("chunk_", "path", "start_line", "end_line", "text").alias("chunk_id"), "start_line", "end_line", F.md5(F.col("text").cast("binary")).alias("content_hash"), "text")


def cold_start(files: DataFrame) -> Index:
    return Index(cut(chunks_of(files)), cut(states(files)))


def settled(files: DataFrame, scanned_at: Column) -> tuple[DataFrame, DataFrame]:
    """(files to index, files deferred): those that changed after the scan (modified_at) wait for the next update."""
    late = F.coalesce(F.col("modified_at") > scanned_at, F.lit(False))
    return files.where(~late), files.where(late)


def hot_update(index: Index, files: DataFrame) -> Index:
    """The index of the files as they are now."""
    wanted = cut(states(files))
    dirty = wanted.join(index.state, ["path", "input_hash"], "left_anti").select("path")
    gone = index.state.join(wanted, "path", "left_anti").select("path")
    kept = index.chunks.join(dirty.unionByName(gone), "path", "left_anti")
    fresh = chunks_of(files.join(dirty, "path", "left_semi"))
    return Index(cut(kept.unionByName(fresh)), wanted)


def embedded(index: Index, vectors: DataFrame, model: str) -> DataFrame:
    """vectors (content_hash, model, embedding) with those that chunks of the index lack, each text once."""
    have = vectors.where(F.col("model") == model).select("content_hash")
    missing = index.chunks.join(have, "content_hash", "left_anti").groupBy("content_hash").agg(F.min("text").alias("text"))
    made = missing.select("content_hash", F.lit(model).alias("model"), chunker.embedder()(F.col("text")).alias("embedding"))
    return vectors.unionByName(made.select(*vectors.columns))


def published(membership: DataFrame, branch: str, index: Index) -> DataFrame:
    """Memberships (branch, chunk_id) with a branch replaced by what the index holds."""
    mine = index.chunks.select(F.lit(branch).alias("branch"), "chunk_id").distinct()
    return membership.where(F.col("branch") != branch).unionByName(mine)
