import random

from pyspark.sql import functions as F

from tessera.functions import query, ranking
from tessera.operators import store, structure
from tessera.sources import chunker

EDGE = "id string, from_symbol_id string, to_symbol_id string, target_name string, caller_file_path string, line int, call_type string, is_resolved boolean"


def test_writes(spark, rows):
    t = spark.createDataFrame([("main", "a", 1), ("dev", "a", 2), ("dev", None, 3)], "branch string, key string, v int")
    assert rows(store.upsert(t, spark.createDataFrame([("dev", "a", 9), ("x", "b", 0)], t.schema), ["branch", "key"])) == [("dev", "a", 9), ("dev", None, 3), ("main", "a", 1), ("x", "b", 0)]
    assert rows(store.insert_ignore(t, spark.createDataFrame([("dev", "a", 9), ("x", "b", 0), ("x", "b", 0)], t.schema), ["branch", "key"])) == [("dev", "a", 2), ("dev", None, 3), ("main", "a", 1), ("x", "b", 0)]
    assert rows(store.delete(t, key="a")) == [("dev", None, 3)] and rows(store.delete(t, key=None)) == [("dev", "a", 2), ("main", "a", 1)]
    assert rows(store.replace_branch(t, "dev", spark.createDataFrame([("dev", "z", 5)], t.schema))) == [("dev", "z", 5), ("main", "a", 1)]
    assert store.contains(t, branch="dev", key="a") and not store.contains(t, branch="dev", key="q")
    assert rows(store.on_other_branches(t, "main", "key")) == [("a",)]
    assert rows(store.set_where(t, F.col("key") == "a", v=7)) == [("dev", "a", 7), ("dev", None, 3), ("main", "a", 7)]
    assert rows(store.lookup_batch(t, t.where("v = 1"), ["branch"])) == [("main", "a", 1)] and rows(store.cleared(t)) == []


def test_stale_stages(spark, rows):
    wanted = spark.createDataFrame([("f1", "h1"), ("f2", "h2"), ("f3", "h3"), ("f4", "h4")], "file string, input_hash string")
    state = spark.createDataFrame([("f1", "complete", "h1"), ("f2", "complete", "old"), ("f3", "failed", "h3")], "file string, status string, input_hash string")
    assert [r[0] for r in rows(store.stale(wanted, state, ["file"]))] == ["f2", "f3", "f4"]


def edges(spark):
    return spark.createDataFrame([("e1", "a", "b", "B", None, 1, "direct", True), ("e2", "t", "b", "b", "x.ts", 2, "direct", True), ("e3", "b", None, "nowhere", None, 3, "direct", False), ("e4", "b", "c", "c", None, 4, "method", True)], EDGE)


def symbols(spark):
    return spark.createDataFrame([("a", "alpha", "src/a.ts"), ("b", "beta", "src/b.ts"), ("c", "gamma", "src/c.ts"), ("t", "checks", "tests/x.test.ts"), ("u", "testBeta", "src/__tests__/q.ts"), ("w", "other", "src/b.test.ts")], "id string, name string, file_path string")


def test_structure(spark, rows):
    e, s = edges(spark), symbols(spark)
    assert rows(structure.callers(e, s, "b").select("caller", "file_path")) == [("alpha", "src/a.ts"), ("checks", "x.ts")]
    assert [r[0] for r in rows(structure.incident(e, spark.createDataFrame([("b",)], "id string")))] == ["e1", "e2", "e3", "e4"]
    assert [r[2] for r in rows(structure.induced(e, spark.createDataFrame([("a",), ("b",)], "id string")).select("from_symbol_id", "to_symbol_id", "id"))] == ["e1"]
    got = rows(structure.tests_of(s, e, s.where("id = 'b'")))
    assert got == [("b", "t", "call graph", 0.95), ("b", "u", "name", 0.7), ("b", "w", "file", 0.5)]
    assert rows(structure.handoff(e, spark.createDataFrame([("b",)], "id string"))) == [("callee", "c", 1), ("caller", "a", 1), ("caller", "t", 1), ("unresolved", "nowhere", 1)]
    lost = {r["id"]: r for r in store.unresolve(e, spark.createDataFrame([("c",), ("a",)], "id string")).collect()}
    assert set(lost) == {"e2", "e3", "e4"} and lost["e4"]["to_symbol_id"] is None and not lost["e4"]["is_resolved"]
    assert [r["id"] for r in structure.search_symbols(s, "ET").collect()] == ["b", "u"]


def test_paging(spark):
    df = spark.range(10)
    one = [r["id"] for r in structure.page(df, [F.col("id")], 4).collect()]
    two = [r["id"] for r in structure.page(df, [F.col("id")], 4, structure.encode_cursor(4)).collect()]
    assert one + two == list(range(8)) and structure.decode_cursor("?!") == 0 and structure.decode_cursor(None) == 0


def test_scores(spark):
    r = spark.range(1).select(ranking.sigmoid(F.lit(0.0)), ranking.sigmoid(F.lit(-800.0)), *ranking.fusion_weights(F.lit(-1.0), F.lit(2.0), 0.5), ranking.path_fits(F.lit("a/b.ts"), F.lit("b.ts")), ranking.overlaps(F.lit(1), F.lit(3), F.lit(3), F.lit(9)), query.task_type(F.lit("what calls the parser")), query.relation(F.lit("who calls parse"))).first()
    assert tuple(r) == (0.5, 0.0, 0.0, 1.0, True, True, "definition", "caller")
    assert ranking.token_budget(8000) == 6400


def test_chunks_tile_files():
    rng = random.Random(2)
    for _ in range(40):
        text = "\n".join(rng.choice(["def f():", "    x = 1", "", "}", "class A:", "y" * rng.randint(1, 900)]) for _ in range(rng.randint(0, 60)))
        spans = chunker.chunk_lines(text)
        n = len(text.splitlines() or [""])
        assert [x for a, b in spans for x in range(a, b + 1)] == list(range(1, n + 1))


def test_chunk_files_and_embedder(spark, rows):
    files = spark.createDataFrame([(1, "def f():\n    pass\n\ndef g():\n    pass\n"), (2, None), (3, "")], "id int, content string")
    got = rows(chunker.chunk_files(files, "id", "content").select("id", "chunk_no", "start_line", "end_line", "whole_file"))
    assert got == [(1, 0, 1, 5, False), (3, 0, 1, 1, False)]
    vectors = rows(files.select("id", chunker.embedder()(F.col("content")).alias("v")))
    assert len(vectors[0][1]) == 8 and vectors[1][1] is None and vectors[2][1][0] == 0.0


def test_batches(spark, rows):
    items = spark.createDataFrame([("g", i, n) for i, n in enumerate([4, 4, 4, 20, 1, None])], "g string, i int, n int")
    assert [r[3] for r in rows(chunker.dynamic_batches(items, "g", "i", "n", 10))] == [0, 0, 1, 2, 3, 3]
