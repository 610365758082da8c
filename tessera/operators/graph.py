"""Call-graph queries over an edge table (src, dst and what else it has) and a symbol table.

Traversals are level by level for many seeds at once; every level is written to the shared folder, so that
plans stay short and a lost executor costs one level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut


def resolve_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Targets of edges that name one (id, caller_file, target_name, target_file?, target_kind?), in three passes:
    the only candidate of the caller's file; the only candidate at all; the earliest in the requested file, or
    in the one file that has candidates. Names must be equal in case, kinds needn't.

    The candidates of a name are reduced to counts and firsts before the join, so a frequent name is one row."""
    place = lambda: F.struct("start_line", "id", "file", "kind")
    by_file = symbols.groupBy("name", F.lower("kind").alias("k"), "file").agg(F.count("*").alias("n"), F.min(place()).alias("first"))
    any_kind = by_file.groupBy("name", "file").agg(F.sum("n").alias("n"), F.min("first").alias("first")).withColumn("k", F.lit(None).cast("string"))
    files = by_file.select("name", "k", "file", "n", "first").unionByName(any_kind.select("name", "k", "file", "n", "first"))
    names = files.groupBy("name", "k").agg(F.sum("n").alias("total"), F.count("*").alias("n_files"), F.min("first").alias("first"))
    e = edges.withColumn("k", F.lower("target_kind"))
    same = e["k"].eqNullSafe
    own = files.select(F.col("name").alias("n1"), F.col("k").alias("k1"), F.col("file").alias("f1"), F.col("n").alias("own_n"), F.col("first").alias("own_first"))
    asked = files.select(F.col("name").alias("n2"), F.col("k").alias("k2"), F.col("file").alias("f2"), F.col("first").alias("asked_first"))
    whole = names.select(F.col("name").alias("n3"), F.col("k").alias("k3"), "total", "n_files", F.col("first").alias("any_first"))
    out = e.join(own, (e["target_name"] == F.col("n1")) & (e["caller_file"] == F.col("f1")) & same(F.col("k1")), "left")
    out = out.join(asked, (e["target_name"] == F.col("n2")) & (e["target_file"] == F.col("f2")) & same(F.col("k2")), "left")
    out = out.join(whole, (e["target_name"] == F.col("n3")) & same(F.col("k3")), "left")
    target = F.when(F.col("own_n") == 1, F.col("own_first")).when(F.col("total") == 1, F.col("any_first")).when(F.col("asked_first").isNotNull(), F.col("asked_first")).when(F.col("n_files") == 1, F.col("any_first"))
    passed = F.when(F.col("own_n") == 1, 1).when(F.col("total") == 1, 2).when(target.isNotNull(), 3)
    return out.select(e["id"], target.getField("id").alias("to_id"), target.getField("file").alias("to_file"), passed.cast("int").alias("pass"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): a self-loop counts twice."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").cast("bigint").alias("out_degree"), F.sum("i").cast("bigint").alias("in_degree"), F.count("*").alias("degree"))


def traverse(seeds: DataFrame, edges: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """(seed, id, depth): nodes within ``depth`` steps of each seed at their least depth, the seed at 0. direction: out
    (callees), in (callers) or both. A level meets the edges once, aggregated before the visited nodes are taken off."""
    out = edges.select("src", "dst")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    steps = cut({"out": out, "in": back, "both": out.unionAll(back)}[direction].distinct())
    seen = frontier = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth"))
    for level in range(1, depth + 1):
        reached = frontier.join(steps, frontier["id"] == steps["src"]).select("seed", F.col("dst").alias("id")).distinct()
        frontier = cut(reached.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("depth", F.lit(level)))
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen


def shortest_paths(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(seed, id, depth, path): one shortest directed path to each node within reach, the least by its ids."""
    steps = cut(edges.select("src", "dst").distinct())
    seen = frontier = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth"), F.array("id").alias("path"))
    for level in range(1, depth + 1):
        reached = frontier.join(steps, frontier["id"] == steps["src"]).select("seed", F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        reached = reached.groupBy("seed", "id").agg(F.min("path").alias("path"))
        frontier = cut(reached.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").select("seed", "id", F.lit(level).alias("depth"), "path"))
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen


def rollup(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Calls between groups (files, directories), those inside a group left out."""
    return edges.where(F.col(source) != F.col(target)).groupBy(F.col(source).alias("source"), F.col(target).alias("target")).agg(F.count("*").alias("calls"))


def boundary_roles(edges: DataFrame, inside: str, source: str, target: str) -> DataFrame:
    """Outer groups that call into, or are called from, the groups where ``inside`` holds, with their role."""
    s, t = F.expr(inside.replace("{}", source)), F.expr(inside.replace("{}", target))
    callers = edges.where(~s & t).select(F.col(source).alias("external"), F.lit("caller").alias("role"))
    callees = edges.where(s & ~t).select(F.col(target).alias("external"), F.lit("callee").alias("role"))
    both = callers.unionAll(callees).groupBy("external").agg(F.min("role").alias("a"), F.max("role").alias("b"), F.count("*").alias("calls"))
    return both.select("external", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("bidirectional").alias("role"), "calls")


def weighted_mode(df: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """The value of greatest summed weight in each group; ties: the least value."""
    sums = df.groupBy(group, value).agg(F.sum(weight).alias("w"))
    order = Window.partitionBy(group).orderBy(F.col("w").desc(), value)
    return sums.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(group, value)
