"""Structural answers over symbols and edges: paged callers, callees, tests of a symbol, hotspots."""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import is_test_or_doc

# How sure each way of finding a symbol's tests is.
CONFIDENCE = {"call graph": 0.95, "name": 0.7, "file": 0.5}
PAGE_MOST = 100


def encode_cursor(offset: int) -> str:
    return base64.b64encode(str(offset).encode()).decode()


def decode_cursor(cursor: str | None) -> int:
    """The offset of a cursor; 0 for none or a broken one."""
    try:
        return max(0, int(base64.b64decode(cursor or "", validate=True)))
    except ValueError:
        return 0


def page(rows: DataFrame, order: list[Column], limit: int, cursor: str | None = None) -> DataFrame:
    return rows.orderBy(*order).offset(decode_cursor(cursor)).limit(min(PAGE_MOST, max(1, limit)))


def search_symbols(symbols: DataFrame, part: str, limit: int = 20) -> DataFrame:
    """Symbols whose name holds a text in any case, the shortest names first."""
    hit = F.contains(F.lower("name"), F.lit(part.lower()))
    return symbols.where(hit).orderBy(F.length("name"), "name", "id").limit(limit)


def callers(edges: DataFrame, symbols: DataFrame, target: str) -> DataFrame:
    """Call sites of a name in any case, with the caller's symbol; the edge's own file goes before the symbol's."""
    sites = edges.where(F.lower("target_name") == target.lower())
    joined = sites.join(symbols.select(F.col("id").alias("from_symbol_id"), F.col("name").alias("caller"), F.col("file_path").alias("_f")), "from_symbol_id")
    return joined.select("id", "from_symbol_id", "caller", F.coalesce("caller_file_path", "_f").alias("file_path"), "line", "call_type").distinct()


def incident(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with either end among ids, as two semi joins instead of an OR."""
    i = ids.select("id").distinct()
    out = edges.join(i, edges["from_symbol_id"] == i["id"], "left_semi")
    back = edges.join(i, edges["to_symbol_id"] == i["id"], "left_semi")
    return out.unionByName(back).dropDuplicates(["id"])


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids."""
    a = ids.select(F.col("id").alias("from_symbol_id")).distinct()
    b = ids.select(F.col("id").alias("to_symbol_id")).distinct()
    return edges.join(a, "from_symbol_id", "left_semi").join(b, "to_symbol_id", "left_semi")


def tests_of(symbols: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, test, method, confidence): tests that call a target, are named after it, or stand in its file's
    test file; each test once, by its surest method."""
    tests = symbols.where(is_test_or_doc("file_path"))
    calls = edges.join(targets.select(F.col("id").alias("to_symbol_id")), "to_symbol_id").join(tests.select(F.col("id").alias("from_symbol_id")), "from_symbol_id").select(F.col("to_symbol_id").alias("target"), F.col("from_symbol_id").alias("test"), F.lit("call graph").alias("method"))
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    keyed = targets.select(F.col("id").alias("target"), F.explode(F.array_distinct(F.array(F.concat(F.lit("test"), plain("name")), F.concat(plain("name"), F.lit("test")), F.concat(plain("name"), F.lit("tests")), F.concat(F.lit("should"), plain("name"))))).alias("k"))
    named = keyed.join(tests.select(F.col("id").alias("test"), plain("name").alias("k")), "k").select("target", "test", F.lit("name").alias("method"))
    stem = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_extract(c, r"([^/]+)$", 1), r"\.[^.]+$", ""), r"^test_|[._](test|spec)$", "")
    files = targets.select(F.col("id").alias("target"), stem("file_path").alias("s")).join(tests.select(F.col("id").alias("test"), stem("file_path").alias("s")), "s").select("target", "test", F.lit("file").alias("method"))
    sure = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    every = calls.unionByName(named).unionByName(files).where("target <> test").withColumn("confidence", sure[F.col("method")])
    best = Window.partitionBy("target", "test").orderBy(F.col("confidence").desc())
    return every.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def handoff(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(role, id, calls): who outside a selection calls it, whom outside it calls, and what it calls unresolved."""
    a = ids.select(F.col("id").alias("_i")).distinct()
    out = edges.join(a, edges["from_symbol_id"] == a["_i"], "left_semi")
    back = edges.join(a, edges["to_symbol_id"] == a["_i"], "left_semi").join(a, edges["from_symbol_id"] == a["_i"], "left_anti")
    outside = out.where("to_symbol_id IS NOT NULL").join(a, out["to_symbol_id"] == a["_i"], "left_anti")
    rows = back.select(F.lit("caller").alias("role"), F.col("from_symbol_id").alias("id")).unionByName(outside.select(F.lit("callee").alias("role"), F.col("to_symbol_id").alias("id"))).unionByName(out.where("to_symbol_id IS NULL").select(F.lit("unresolved").alias("role"), F.col("target_name").alias("id")))
    return rows.groupBy("role", "id").agg(F.count("*").alias("calls"))


def frontier(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """One level of a walk both ways: the edges into and out of ids, with their direction."""
    i = ids.select(F.col("id").alias("_i")).distinct()
    into = edges.join(i, edges["to_symbol_id"] == i["_i"], "left_semi").withColumn("direction", F.lit("caller"))
    out = edges.join(i, edges["from_symbol_id"] == i["_i"], "left_semi").withColumn("direction", F.lit("callee"))
    return into.unionByName(out)


def chunks_of_symbols(links: DataFrame, chunks: DataFrame, membership: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks linked with the wanted symbols (symbol_id) that are on the branch of membership."""
    mine = links.join(wanted.select("symbol_id").distinct(), "symbol_id", "left_semi")
    return mine.join(chunks, "chunk_id").join(membership.select("chunk_id").distinct(), "chunk_id", "left_semi")
