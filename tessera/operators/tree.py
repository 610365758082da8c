"""Directory trees: ancestors, digests and subtrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import ancestors, depth, parent_path
from tessera.session import cut


def directories(files: DataFrame, series: list[str], path: str) -> DataFrame:
    """All directories above the files, once each."""
    return files.select(*series, F.explode(ancestors(path)).alias("path")).distinct()


def directory_hashes(files: DataFrame, series: list[str]) -> DataFrame:
    """(series, path, kind, hash) with digests of directories from the bottom up: the md5 of their
    children's ordered lines kind:path:hash. files: (series, path, hash). One aggregation a level."""
    nodes = cut(files.select(*series, "path", F.lit("file").alias("kind"), F.coalesce("hash", F.lit("")).alias("hash"), depth("path").alias("depth")))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    columns = [*series, "path", "kind", "hash"]
    done, made = nodes.select(columns), None
    for level in range(int(deepest), 1, -1):
        here = nodes.where(F.col("depth") == level).select(columns)
        here = here if made is None else here.unionByName(made)
        line = F.concat_ws(":", "kind", "path", "hash")
        up = here.groupBy(*series, parent_path("path").alias("path")).agg(F.md5(F.concat_ws("\n", F.array_sort(F.collect_list(line))).cast("binary")).alias("hash"))
        made = cut(up.select(*series, "path", F.lit("directory").alias("kind"), "hash"))
        done = done.unionByName(made)
    return done


def subtree(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where((F.col("path") == path) | F.col("path").startswith(path + "/"))
