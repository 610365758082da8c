import math

from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators import dense, fusion, ranking
from tessera.operators.sparse import SparseIndex, query_terms


def variants(spark, token):
    return sorted(spark.range(1).select(t.token_variants(F.lit(token))).first()[0])


def test_token_variants(spark):
    assert variants(spark, "getUserId") == ["get", "getuserid", "id", "user"]
    assert "load" in variants(spark, "src/config/load-env.ts") and "env" in variants(spark, "src/config/load-env.ts")
    assert variants(spark, "HTTPServer") == ["http", "httpserver", "server"]


def test_bm25_against_formula(spark, rows):
    docs = spark.createDataFrame([(1, "user authentication login"), (2, "authentication middleware validates tokens"), (3, "database connection"), (4, None), (5, "")], "id int, text string")
    terms = query_terms(spark.createDataFrame([(7, "authentication")], "q int, text string"), "q", "text")
    got = rows(SparseIndex(docs, "id", "text").search(terms, "q", 10))
    n, df, avg = 5, 2, 3.0
    idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
    raw = {d: idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / avg)) for d, length in ((1, 3), (2, 4))}
    assert [(r[0], r[1], r[3]) for r in got] == [(7, 1, 1), (7, 2, 2)]
    assert abs(got[0][2] - raw[1]) < 1e-5 and abs(got[1][2] - raw[2]) < 1e-5


def test_bm25_empty_corpus(spark, rows):
    docs = spark.createDataFrame([], "id int, text string")
    terms = query_terms(spark.createDataFrame([(1, "a b")], "q int, text string"), "q", "text")
    assert rows(SparseIndex(docs, "id", "text").search(terms, "q", 3)) == []


def test_cosine(spark, rows):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id bigint, v array<double>")
    got = rows(dense.cosine_topk(v.withColumnRenamed("id", "q"), v, "q", "id", "v", 1))
    assert [(r[0], r[1]) for r in got] == [(1, 2), (2, 1), (3, 2)]


def test_rrf(spark, rows):
    lanes = spark.createDataFrame([(1, i, "semantic", r, s) for r, (i, s) in enumerate([("a", 0.91), ("b", 0.89), ("c", 0.88)], 1)] + [(1, i, "keyword", r, s) for r, (i, s) in enumerate([("d", 50.0), ("c", 30.0), ("a", 1.0)], 1)], "q int, id string, lane string, rank int, score double")
    fused = fusion.reciprocal_rank_fusion(lanes, {"semantic": 1.0, "keyword": 1.0, "off": 0.0}, "q", "id")
    top = [r["id"] for r in fused.orderBy(F.col("score").desc(), "id").limit(3).collect()]
    assert top == ["a", "c", "d"]
    assert all(0 < r[2] <= 1 for r in rows(fused))


def test_union_and_tiers(spark, rows):
    lanes = spark.createDataFrame([(1, "a", "x", 1.0), (1, "a", "y", 2.0), (1, "b", "x", 3.0)], "q int, id string, lane string, score double")
    assert rows(fusion.union_lanes(lanes, "q", "id")) == [(1, "a", 2.0, "hybrid"), (1, "b", 3.0, "x")]
    tiers = spark.createDataFrame([(1, "a", 2, 1), (1, "a", 1, 5), (1, "b", 2, 2)], "q int, id string, tier int, rank int")
    assert rows(fusion.tiered(tiers, "q", "id", 5)) == [(1, "a", 1, 5, 1), (1, "b", 2, 2, 2)]


def test_positions_without_one_task_per_group(spark, rows):
    df = spark.createDataFrame([("g", float(i % 7), 1 + i % 3) for i in range(7)] + [("h", 1.0, 2)], "g string, v double, n bigint")
    got = {(r[0], r[1]): r[3] for r in rows(ranking.value_positions(df, ["g"], [F.col("v").desc()]))}
    before = 0
    for v in range(6, -1, -1):
        assert got[("g", float(v))] == before
        before += 1 + v % 3
    assert got[("h", 1.0)] == 0


def test_paths(spark):
    r = spark.range(1).select(t.ancestors(F.lit("a/b/c.ts")), t.parent_path(F.lit("x")), t.depth(F.lit("a/b")), t.language_of(F.lit("a/B.PY")), t.language_of(F.lit("x"))).first()
    assert tuple(r) == (["a", "a/b"], None, 2, "python", "unknown")


def test_globs():
    import re

    for glob, path, fits in [("**/*.ts", "a/b.ts", True), ("**/*.ts", "b.ts", True), ("*.ts", "a/b.ts", False), ("src/**/x.{js,ts}", "src/a/b/x.ts", True), ("a?.py", "ab.py", True), ("a.py", "abpy", False)]:
        assert bool(re.match(t.glob_regex(glob), path)) is fits


def test_index_is_saved_loaded_and_updated(spark, rows, tmp_path):
    first = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, "gamma")], "i bigint, t string")
    later = spark.createDataFrame([(2, "delta"), (4, "alpha gamma")], "i bigint, t string")
    whole = spark.createDataFrame([(1, "alpha beta"), (2, "delta"), (4, "alpha gamma")], "i bigint, t string")
    SparseIndex(first, "i", "t").save(str(tmp_path / "x"))
    index = SparseIndex.load(spark, str(tmp_path / "x")).updated(later, "t", spark.createDataFrame([(3,)], "i bigint"))
    terms = query_terms(spark.createDataFrame([(9, "alpha delta gamma")], "q bigint, t string"), "q", "t")
    assert index.total == 3
    assert rows(index.search(terms, "q", 5)) == rows(SparseIndex(whole, "i", "t").search(terms, "q", 5))


def test_many_terms_go_by_join_and_give_the_same(spark, rows, monkeypatch):
    from tessera.operators import sparse

    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} common") for i in range(60)], "i bigint, t string")
    terms = query_terms(docs.where("i % 20 = 0").withColumnRenamed("i", "q"), "q", "t")
    here = rows(SparseIndex(docs, "i", "t").search(terms, "q", 4))
    monkeypatch.setattr(sparse, "QUERY_TERMS", 1)
    assert rows(SparseIndex(docs, "i", "t").search(terms, "q", 4)) == here


def test_codes_find_what_the_vectors_find(spark, rows):
    import numpy as np

    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 24)))] + [(900, None), (901, [0.0] * 24), (902, [])]
    v = spark.createDataFrame(data, "i bigint, v array<float>")
    q = v.where("i % 20 = 0").withColumnRenamed("i", "q")
    exact = {(r["q"], r["i"]) for r in dense.cosine_topk(q, v, "q", "i", "v", 10).collect()}
    near = {(r["q"], r["i"]) for r in dense.quantised_topk(q, dense.quantised(v, "i", "v"), v, "q", "i", "v", 10).collect()}
    assert len(exact & near) / len(exact) >= 0.98
    assert dense.quantised_topk(q.limit(0), dense.quantised(v, "i", "v"), v, "q", "i", "v", 3).count() == 0
