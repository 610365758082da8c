"""Counts, medians, drift and layouts of the index and its evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import content


def branch_status(membership: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per branch: chunks, those that live, those with a vector, and whether all have one."""
    meta = chunks.select("chunk_id", "embedding_input_hash").join(vectors.select(F.col("hash").alias("embedding_input_hash"), F.lit(1).alias("v")).distinct(), "embedding_input_hash", "left")
    rows = membership.join(meta, "chunk_id", "left")
    out = rows.groupBy("branch").agg(F.count("*").alias("chunks"), F.count("embedding_input_hash").alias("living"), F.count("v").alias("embedded"))
    return out.withColumn("ready", F.col("living") == F.col("embedded"))


def medians(runs: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    return runs.groupBy(*by).agg(*[F.round(F.percentile(m, F.lit(0.5)), 6).alias(m) for m in measures])


def combined_recall(primary: DataFrame, expanded: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): 1 if one of the first k different results of both lists, the primary ones first, is relevant. Rows:
    query_id, id, place, relevant."""
    both = primary.withColumn("_l", F.lit(0)).unionByName(expanded.withColumn("_l", F.lit(1)))
    once = both.groupBy("query_id", "id").agg(F.min(F.struct("_l", "place", "relevant")).alias("r"))
    order = Window.partitionBy("query_id").orderBy("r._l", "r.place", "id")
    head = once.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    return head.groupBy("query_id").agg(F.max(F.col("r.relevant").cast("int")).alias("recall"))


def drift(left: DataFrame, right: DataFrame, k: int = 10) -> DataFrame:
    """Changes between the first k results of two runs (query_id, id, place from 0, score, reranked): scores beyond their
    tolerance by class, and results that only one run has."""
    head = lambda df: df.where(F.col("place") < k)
    a, b = head(left), right.select("query_id", "id", F.col("score").alias("other"), F.lit(True).alias("_there"))
    met = a.join(b, ["query_id", "id"], "left")
    far = F.abs(F.col("score") - F.col("other")) > content.tolerance(F.col("place"), F.col("reranked"))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    rr = F.col("reranked")
    return met.agg(count(far & rr).alias("reranked_jitter"), count(far & ~rr & (F.col("place") < 3)).alias("top_jitter"), count(far & ~rr & (F.col("place") >= 3)).alias("tail_jitter"), count(F.col("_there").isNull()).alias("pool_changes"))


def merged_sets(*sets: DataFrame) -> DataFrame:
    """Evaluation sets in one; raises on an id that comes twice."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    double = out.groupBy("id").count().where("count > 1").limit(1).collect()
    if double:
        raise ValueError(f"query id {double[0]['id']} comes twice")
    return out


def clusters(files: DataFrame, path: str, least: int = 8, most: int = 25, share: float = 0.55) -> DataFrame:
    """(cluster, files): path prefixes that split a tree into least to most parts, none with more than its share of all files where
    it can be split. Every prefix is counted once; the choice runs over directories, level by level, until there are enough."""
    parts = F.split(path, "/")
    prefixes = files.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("prefix")))).alias("p"))
    counted = prefixes.groupBy("p.depth", "p.prefix").agg(F.count("*").alias("n"))
    total, chosen = files.count(), [("", 0)]
    sizes = {"": total}
    depth = 0
    while True:
        rows = counted.where(F.col("depth") == depth + 1).orderBy(F.col("n").desc(), "prefix").limit(4 * most).collect()
        children: dict[str, list] = {}
        for r in rows:
            children.setdefault(r["prefix"].rpartition("/")[0] if "/" in r["prefix"] else "", []).append((r["prefix"], r["n"]))
        split = [(p, d) for p, d in chosen if d == depth and p in children and (len(chosen) < least or sizes[p] > share * total)]
        if not split:
            break
        for p, d in split:
            if len(chosen) - 1 + len(children[p]) > most:
                continue
            chosen.remove((p, d))
            chosen += [(c, depth + 1) for c, _ in children[p]]
            sizes.update(children[p])
        depth += 1
    spark = files.sparkSession
    return spark.createDataFrame([(p or "/", int(sizes[p])) for p, _ in sorted(chosen)], "cluster string, files bigint")


def summary_markdown(title: str, row: dict[str, object]) -> str:
    """A one-row summary as a table in Markdown."""
    lines = [f"# {title}", "", "| Measure | Value |", "|---|---|"]
    return "\n".join(lines + [f"| {k} | {round(v, 6) if isinstance(v, float) else v} |" for k, v in row.items()]) + "\n"


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, place, json): nodes and edges in their fixed order as one JSON object each."""
    def ranked(df: DataFrame, kind: str, keys: list) -> DataFrame:  # noqa: ANN001
        w = Window.partitionBy("repo").orderBy(*keys)
        return df.withColumn("place", F.row_number().over(w).cast("bigint")).select("repo", F.lit(kind).alias("kind"), "place", F.to_json(F.struct(*[c for c in df.columns if c != "repo"])).alias("json"))

    return ranked(nodes, "node", ["file_path", "start_line", "name", "id"]).unionByName(ranked(edges, "edge", ["from_symbol_id", F.coalesce("to_symbol_id", F.lit("")), "line", "id"]))


def requeued(changed: DataFrame, running: DataFrame) -> DataFrame:
    """What changed (path, at) after its run had begun (path, started_at): it goes to the queue again."""
    return changed.join(running, "path").where("at > started_at").groupBy("path").agg(F.max("at").alias("at"))


def tree_after(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """The files of a snapshot (path, hash) after point changes (path, hash; a null hash removes). Empty folders go with their
    last file, as folders are what lies above files."""
    kept = snapshot.join(changes.select("path"), "path", "left_anti")
    return kept.unionByName(changes.where("hash IS NOT NULL").select(*kept.columns))


def cost(tokens: Column, price_per_million: Column) -> Column:
    return tokens / 1_000_000 * price_per_million


def symbol_candidates(chunks: DataFrame) -> DataFrame:
    """(path, symbol, exported): named functions and classes of files (path, name, kind, text), each once; an exported one goes
    before another of its name."""
    exported = F.col("text").rlike(r"(?:^|\n)\s*export\s+") | F.col("text").rlike(r"module\.exports|exports\.")
    rows = chunks.where(F.col("name").isNotNull() & F.col("kind").isin("function", "method", "class")).select("path", F.col("name").alias("symbol"), F.coalesce(exported, F.lit(False)).alias("exported"))
    return rows.groupBy("path", "symbol").agg(F.max("exported").alias("exported"))


def drained(jobs: DataFrame, place: str, most: int | None = None) -> DataFrame:
    """The jobs a worker takes now: all, or the first so many in the queue's order."""
    return jobs if most is None else jobs.where(F.col(place) <= most)
