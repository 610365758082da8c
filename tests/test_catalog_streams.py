import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import catalog as c
from tessera.operators import evaluate
from tessera.sources import files
from tessera.streaming import changes as s

CHUNKS = "chunk_id string, content_hash string, embedding_input_hash string, repo string, file_path string, start_line int, end_line int, node_type string, name string, language string, chunk_kind string, symbol_kind string, symbol_aliases array<string>, indexed_at timestamp_ntz, deleted_at timestamp_ntz"
D = dt.datetime(2025, 1, 1)


def chunk(i, name=None, aliases=(), start=1, end=10, at=0, dead=None, path="src/a.ts"):
    return (i, "h", "e" + i.strip(), "r", path, start, end, "function", name, "typescript", "code", "Function", list(aliases), D + dt.timedelta(hours=at), dead)


def test_live_chunks(spark, rows):
    df = spark.createDataFrame([chunk("c1", "old"), chunk(" C1", "new", at=1), chunk("c2"), chunk("c2", dead=D)], CHUNKS)
    assert rows(c.live_chunks(df).select("chunk_id", "name")) == [("c1", "new")]


def test_named(spark, rows):
    df = spark.createDataFrame([chunk("c1", "Foo", ["bar"]), chunk("c2", "foo"), chunk("c3", None, ["Foo"])], CHUNKS)
    wanted = spark.createDataFrame([("Foo",), ("BAR",), ("none",)], "wanted string")
    assert rows(c.named(df, wanted)) == [("BAR", "c1", "ignoring case"), ("Foo", "c1", "exact"), ("Foo", "c3", "exact")]


def test_filter(spark, rows):
    assert c.hard_filter() is None
    df = spark.createDataFrame([chunk("c1", path="src/a.ts"), chunk("c2", path="lib/a.ts"), chunk("c3", path="src/x/a.py")], CHUNKS)
    assert rows(df.where(c.hard_filter(extension=".ts", directory="src/")).select("chunk_id")) == [("c1",)]


def test_delta_and_garbage(spark, rows):
    m = spark.createDataFrame([("main", "a"), ("main", "b"), ("dev", "b"), ("dev", "c")], "branch string, chunk_id string")
    assert rows(c.delta(m, "main")) == [("dev", 1, 1)]
    changed = c.apply_delta(m, m.where("branch = 'dev'"), spark.createDataFrame([("dev", "z")], "branch string, chunk_id string"))
    assert rows(changed) == [("dev", "z"), ("main", "a"), ("main", "b")]
    chunks = spark.createDataFrame([chunk("a"), chunk("q")], CHUNKS)
    vectors = spark.createDataFrame([("ea", "m"), ("eq", "m")], "embedding_input_hash string, model string")
    assert rows(c.collect_garbage(chunks, m, vectors)) == [("chunk", "q"), ("vector", "eq")]


def test_best_enclosing(spark, rows):
    chunks = spark.createDataFrame([chunk("wide", start=1, end=50), chunk("tight", start=5, end=20), chunk("same", "f", start=1, end=40)], CHUNKS)
    symbols = spark.createDataFrame([(1, "r", "src/a.ts", "f", 6, 7), (2, "r", "src/a.ts", "g", 6, 7), (3, "r", "other", "g", 6, 7)], "id int, repo string, file_path string, name string, start_line int, end_line int")
    assert rows(c.best_enclosing(symbols, chunks, ["repo", "file_path"], "id")) == [(1, "same"), (2, "tight")]


def events(spark, data):
    return spark.createDataFrame([(i, k, D + dt.timedelta(seconds=x), v) for i, (k, x, v) in enumerate(data)], "id int, k string, ts timestamp_ntz, v string")


def test_sessions(spark, rows):
    e = events(spark, [("a", 0, "add"), ("a", 5, "change"), ("a", 30, "unlink"), ("b", 1, "add")])
    got = rows(s.sessions(e, ["k"], "ts", ["id"], 10, "v").select("k", "events", "last"))
    assert got == [("a", 1, "unlink"), ("a", 2, "change"), ("b", 1, "add")]
    assert rows(s.sessions(e, [], "ts", ["id"], 10, "v").select("events", "last")) == [(1, "unlink"), (3, "change")]


@pytest.mark.parametrize("step", [1, 7, 200, 20_000])
def test_global_sessions_cross_midnight_and_ranges(spark, rows, step):
    import random

    rng = random.Random(step)
    at, data = 86_400 - 40 * step, []
    for i in range(300):
        at += rng.choice([0, step, 61]) if i % 9 else rng.randint(0, 2 * step)
        data.append((f"k{i % 3}", at, f"v{i}"))
    e = events(spark, data)
    got = rows(s.global_sessions(e, "ts", ["id"], 60, "v"))
    assert got == rows(s.sessions(e, [], "ts", ["id"], 60, "v")) and sum(r[2] for r in got) == 300
    assert rows(s.global_sessions(e.limit(0), "ts", ["id"], 60, "v")) == []


def test_debounce_global_is_a_query():
    import __spark_entry__ as entry

    assert "debounce_global" in entry.queries() and "PARTITION BY" not in entry.oracle_sql()["debounce_global"]


def test_switches_and_last_writes(spark, rows):
    e = events(spark, [("a", 0, "x"), ("a", 1, "x"), ("a", 2, "y"), ("a", 3, "x")])
    assert [(r[2], r[3]) for r in rows(s.switches(e, ["k"], "ts", ["id"], "v"))] == [("x", "y"), ("y", "x")]
    assert rows(s.last_writes(e, ["k"], "ts", ["id"], "v").select("k", "last", "events")) == [("a", "x", 4)]


def test_queue(spark, rows):
    e = events(spark, [("a", 0, "low"), ("a", 5, "high"), ("b", 0, "low"), ("c", 100, "low")])
    got = rows(s.queue_order(e, ["k"], F.col("v"), "ts", F.lit(D + dt.timedelta(seconds=101)).cast("timestamp_ntz"), ["id"]).select("k", "class", "requests"))
    assert got == [("a", 2, 2), ("b", 3, 1), ("c", 4, 1)]


def test_stream_sessions_equal_batch_for_closed_sessions(spark, rows, tmp_path):
    data = [("a", 0, "x"), ("a", 5, "y"), ("a", 100, "x"), ("b", 3, "x"), ("z", 10_000, "end")]
    events(spark, data).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, k string, ts timestamp_ntz, v string").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    s.run_available(s.stream_sessions(stream, "k", "ts", "10 seconds", "1 minute"), str(tmp_path / "cp"), lambda b, n: b.write.mode("overwrite").parquet(f"{out}/{n}"))
    got = rows(spark.read.parquet(*[str(p) for p in (tmp_path / "out").iterdir()]).select("k", "events"))
    assert got == [("a", 1), ("a", 2), ("b", 1)]


def test_upsert_sink_is_idempotent(spark, rows, tmp_path):
    write = s.upsert_sink(spark, str(tmp_path), ["k"], ["ts", "id"])
    write(events(spark, [("a", 0, "x")]), 0)
    for _ in range(2):
        write(events(spark, [("b", 0, "q"), ("a", 1, "y")]), 1)
    assert rows(spark.read.parquet(f"{tmp_path}/1").select("k", "v")) == [("a", "y"), ("b", "q")]


def test_metrics(spark, rows):
    r = spark.createDataFrame([(1, 1, False), (1, 2, False), (1, 3, True), (2, 1, True)], "q int, rank int, relevant boolean")
    got = rows(evaluate.per_query(r, spark.createDataFrame([(1,), (2,), (3,)], "q int"), "q"))
    assert got == [(1, 0, 1, 1, 1, 0.333333, 0.5), (2, 1, 1, 1, 1, 1.0, 1.0), (3, 0, 0, 0, 0, 0.0, 0.0)]


@pytest.mark.parametrize(("values", "want"), [([10.0], (10, 10, 10)), ([10.0, 110.0], (60, 105, 109)), ([1.0, 2.0, 3.0, 4.0, 5.0], (3, 4.8, 4.96))])
def test_percentiles(spark, values, want):
    r = evaluate.percentiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", [0.5, 0.95, 0.99]).first()
    assert (r["p50"], r["p95"], r["p99"]) == want


def test_gate(spark, rows):
    a, b = (spark.createDataFrame([x], "hit double, mrr double") for x in ((0.8, 0.5), (0.9, 0.0)))
    cmp = evaluate.compare(a, b, ["hit", "mrr"])
    assert rows(cmp.select("measure", "change", "change_percent")) == [("hit", -0.1, -11.111111), ("mrr", 0.5, 100.0)]
    assert rows(evaluate.gate(cmp, {"hit": 0.05}).select("measure", "passes")) == [("hit", False), ("mrr", True)]


def test_scan_and_snapshot_store(spark, rows, tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    for name, size in (("src/a.ts", 5), ("src/big.ts", 500), ("src/b.md", 1), ("skip.ts", 1)):
        (root / name).write_text("x" * size)
    df = files.scan(spark, str(root), ["**/*.ts"], ["skip.ts"], ["node_modules/"], 100)
    assert rows(df.select("file_path", "language", "reason")) == [("skip.ts", "typescript", "excluded"), ("src/a.ts", "typescript", None), ("src/b.md", "markdown", "not-included"), ("src/big.ts", "typescript", "too-large")]
    store = str(tmp_path / "store")
    one = spark.createDataFrame([("a", "h", "main"), ("b", "h", "dev")], "path string, hash string, branch string")
    files.save_snapshot(one, store)
    files.save_snapshot(spark.createDataFrame([("z", "h", "dev")], "path string, hash string, branch string"), store)
    assert rows(files.load_snapshot(spark, store, "main").select("path")) == [("a",)]
    assert rows(files.load_snapshot(spark, store, "dev").select("path")) == [("z",)]


def test_golden_and_config(spark, tmp_path):
    good = tmp_path / "g.json"
    good.write_text(json.dumps({"version": "1", "queries": [{"id": "a", "query": "q", "expected": {"filePath": "x"}}]}))
    assert files.golden_queries(spark, str(good)).count() == 1
    bad = tmp_path / "b.json"
    bad.write_text(json.dumps({"queries": [{"id": "a"}, {"id": "a"}]}))
    with pytest.raises(ValueError, match="repeated"):
        files.golden_queries(spark, str(bad))
    assert files.substituted({"k": ["{env:A}", "$A", "$a", "x"]}, {"A": "1"}) == {"k": ["1", "1", "$a", "x"]}
    with pytest.raises(ValueError, match=r"\$root.k\[0\]"):
        files.substituted({"k": ["{env:A}-x"]}, {"A": "1"})
    with pytest.raises(KeyError):
        files.substituted("{env:NOPE_NOT_SET}", {})
    assert files.Config(min_score=7, rrf_k=0).min_score == 1.0


def test_globs_and_excluded_folders(spark):
    import re

    from tessera.functions.text import glob_regex

    for pattern, yes, no in (("a,b", "a,b", "a"), ("**/*.{ts,tsx}", "a/b.ts", "b.js"), ("src/?.py", "src/a.py", "src/ab.py"), ("a{b", "a{b", "ab")):
        assert re.match(glob_regex(pattern), yes) and not re.match(glob_regex(pattern), no)
    rows = spark.createDataFrame([("docs",), ("docs/a.md",), ("src/docs/a.md",), ("docs2/a",)], "p string")
    assert sorted(r[0] for r in rows.where(files.matches(F.col("p"), ["docs/"])).collect()) == ["docs", "docs/a.md"]
