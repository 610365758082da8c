import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import content as c
from tessera.functions import identifiers as i
from tessera.functions import intent
from tessera.operators import reports
from tessera.operators import rerank as r

ROWS = "query_id bigint, query string, id string, score double, path string, name string, kind string, chunk_kind string, position int, note string"


def results(spark, *rows):
    return spark.createDataFrame([(1, rows[0], *x[:6], n + 1, "x") for n, x in enumerate(rows[1:])], ROWS)


def first(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_relations_tasks_and_intents(spark):
    q = F.lit
    assert first(spark, intent.relation(q("Who calls `parseFile`?")), intent.relation_target(q("Who calls `parseFile`?")))[:] == ("caller", "parseFile")
    assert first(spark, intent.relation(q("what does run call")), intent.relation(q("where is x")))[:] == ("callee", None)
    assert first(spark, *[intent.task_type(q(t)) for t in ("callers of f", "failing tests", "TypeError: x", "it should work but not", "cache", "")])[:] == ("definition", "test_debug", "bug", "bug", "general", "general")
    assert first(spark, intent.sub_intent(q("where is the parser function defined"), q("definition")), intent.sub_intent(q(" "), q("bug")))[:] == ("definition:executable", None)


def test_identifier_functions(spark):
    q = F.lit("find parseFile in src/io/reader.ts")
    assert first(spark, i.hints(q), i.file_hint(q), i.without_file_hint(q))[:] == (["parsefile"], "src/io/reader.ts", "find parseFile")
    none = F.lit(None).cast("string")
    assert first(spark, i.tokens(none), i.name_tokens(none), i.match_score(none, F.lit("a/parsefile.ts"), i.hints(q)))[:] == ([], [], 0.6)
    parts = lambda *x: F.array(*[F.lit(v) for v in x])
    assert first(spark, *[i.compound_specificity(p) for p in (parts("cache"), parts("cache", "data"), parts("cache", "parserstate"), parts("walker", "tokenizer"))])[:] == ("not-compound", "generic-compound", "mixed-compound", "strong-compound")


def test_named_chunks_go_before_unnamed_siblings(spark):
    rows = results(spark, "where is loadCache", ("a", 0.5, "src/a.ts", None, "module", None), ("b", 0.48, "src/a.ts", "other", "variable", None), ("c", 0.47, "tests/a.ts", "loadCache", "function", None))
    got = [x["id"] for x in r.deterministic(rows, 20).orderBy("place").collect()]
    assert got[0] == "c" and got.index("b") < got.index("a") or got == ["c", "a", "b"]
    assert r.deterministic(rows.limit(0), 20).count() == 0
    kept = {x["id"]: x["boosted"] for x in r.deterministic(rows, 2).collect()}
    assert kept["c"] is None and kept["a"] is not None


def test_policies(spark, rows):
    found = results(spark, "which function builds Options", ("t", 0.9, "src/a.ts", "AOptions", "type", None), ("f", 0.88, "src/a.ts", "build", "function", "File"), ("o", 0.8, "src/b.ts", "x", "function", None))
    assert [(x["id"], x["score"]) for x in r.definition_policy(found).orderBy("place").collect()] == [("f", 0.94), ("t", 0.82), ("o", 0.8)]
    coarse = results(spark, "find AOptions", ("t", 0.9, "src/a.ts", "AOptions", "type", None), ("f", 0.88, "src/a.ts", "a", "module", "File"))
    assert rows(r.without_coarse(coarse).select("id")) == [("t",)]
    asked = results(spark, "who calls build", ("x", 0.9, "src/a.ts", "run", "function", None), ("b", 0.7, "src/b.ts", "BUILD", "function", None))
    assert rows(r.graph_seeds(asked).select("id")) == [("b",)]
    scored = r.relation_scores(asked.withColumn("content", F.lit("build()")).withColumn("relation", F.lit(None).cast("string")))
    assert rows(scored.select("id", "score")) == [("b", 0.19), ("x", 1.08)]
    assert (r.pool_size(5), r.pool_size(20), r.pool_size(5, True)) == (50, 80, 250)


def test_content_functions(spark):
    text = F.lit("// a\n\n  fn x() {\n}\né")
    starts = c.line_starts(text)
    assert first(spark, c.signature(text), c.line_slice(text, F.lit(4), F.lit(9)), starts, c.byte_offset(starts, F.lit(3), F.lit(2)), c.byte_offset(starts, F.lit(9), F.lit(0)))[:] == ("fn x() {", "}\né", [0, 5, 6, 17, 19], 8, None)
    none = F.lit(None).cast("string")
    assert first(spark, c.signature(none), c.line_slice(none, F.lit(1), F.lit(2)), c.chunk_type(none), c.structural_kind(none))[:] == (None, "", "other", "unknown")
    assert first(spark, c.named_exports(F.lit("export { a as b, c }; export default function d() {} exports.e = 1")))[0] == ["b", "c", "d", "e"]
    assert first(spark, *[c.repository_path(F.lit(p), "/r") for p in ("/r/a/b", "./a\\b/", "../x", "/x", "")])[:] == ("a/b", "a/b", None, None, None)
    rules = [("", "*.log"), ("a", "!keep.log"), ("", "build/")]
    assert first(spark, *[c.ignored(F.lit(p), rules) for p in ("x.log", "a/keep.log", "b/keep.log", "build/x", "a/build/y", "src/b.ts")])[:] == (True, False, True, True, True, False)
    assert c.hue("") == 0 and 0 <= c.hue("abc" * 50) < 360 and c.embedding_budget(1000) == 872 and c.embedding_budget(1) == 1
    assert all(0 <= c.backoff_ms(n, 100, 250, random.Random(n)) <= 100 * 2 ** (n - 1) + 250 for n in range(1, 6))


def test_reports(spark, rows):
    a = spark.createDataFrame([(1, "x", "p")], "id bigint, query string, repo string")
    assert reports.merged_sets(a, a.withColumn("id", F.lit(2).cast("bigint"))).count() == 2
    with pytest.raises(ValueError, match="comes twice"):
        reports.merged_sets(a, a)
    assert "| hits | 0.5 |" in reports.summary_markdown("Run", {"hits": 0.5})
    paths = [(f"src/m{k}/f{j}.ts",) for k in range(12) for j in range(4)] + [("a.md",)]
    got = rows(reports.clusters(spark.createDataFrame(paths, "p string"), "p"))
    assert len(got) == 12 and all(n == 4 for _, n in got)
    tree = spark.createDataFrame([("a/b", "1"), ("a/c", "2")], "path string, hash string")
    events = spark.createDataFrame([("a/b", None), ("d/e", "3")], "path string, hash string")
    assert rows(reports.tree_after(tree, events)) == [("a/c", "2"), ("d/e", "3")]
