import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.functions.tokens import variants
from tessera.operators import bm25, sparse
from tessera.operators.sparse import SparseIndex, query_terms


def test_more_query_terms_than_one_block_are_not_joined_posting_by_posting(spark, rows, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} x{i % 11} common") for i in range(200)], "i bigint, t string")
    terms = query_terms(docs.where("i % 4 = 0").withColumnRenamed("i", "q"), "q", "t")
    index = SparseIndex(docs, "i", "t")
    whole = rows(index.search(terms, "q", 4))
    monkeypatch.setattr(sparse, "QUERY_TERMS", 40)  # 24 distinct ones, 200 in all
    monkeypatch.setattr(sparse, "BLOCK", 40, raising=False)
    found = index.search(terms, "q", 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and plan.count("MapInArrow") > 1
    assert rows(found) == whole and len(whole) == 200


@pytest.mark.parametrize("words", [False, True])
def test_blocks_give_what_all_scores_give(monkeypatch, words):
    for name, value in {"TILE": 8, "CHUNK": 16, "PAIRS": 50, "PENDING": 20, "PAIR_COST": 30, "GROUPS": 3, "GROUP_QUERIES": 10}.items():
        monkeypatch.setattr(bm25, name, value)
    rng = np.random.default_rng(5)
    terms, k, n = 60, 5, 45
    chance = 1 / np.arange(2, terms + 2)
    queries = [np.flatnonzero(rng.random(terms) < chance * 3) for _ in range(n)]
    queries = [q if len(q) else np.array([1]) for q in queries]
    weights = [rng.integers(1, 4, len(q)) * 0.7 for q in queries]
    search = bm25.Search(bm25.pointers([len(q) for q in queries]), np.concatenate(queries).astype(np.int32), np.concatenate(weights), k, np.ones(terms))
    scores, names = np.zeros((n, 0)), []
    for at in range(0, 300, 100):
        docs = [np.flatnonzero(rng.random(terms) < chance * 2) for _ in range(100)]
        docs = [d if len(d) else np.array([2]) for d in docs]
        parts = [rng.integers(1, 3, len(d)) / 2 for d in docs]  # few values, many ties
        items = rng.permutation(100) + at
        items = [f"d{(i * 37) % 1000:03d}" for i in items] if words else items.tolist()
        search.add(pa.array(items), bm25.pointers([len(d) for d in docs]), np.concatenate(docs).astype(np.int32), np.concatenate(parts))
        full = np.zeros((n, 100))
        for x, (d, p) in enumerate(zip(docs, parts, strict=True)):
            one = np.zeros(terms)
            one[d] = p
            full[:, x] = [float(one[q] @ w) for q, w in zip(queries, weights, strict=True)]
        scores, names = np.hstack([scores, np.round(full, 6)]), names + items
    want = {(q, -raw, item) for q in range(n) for raw, item in sorted((-scores[q, x], names[x]) for x in range(300) if scores[q, x] > 0)[:k]}
    got = [(int(q), float(r), i) for qs, raws, found in search.results() for q, r, i in zip(qs, raws, found.to_pylist(), strict=True)]
    assert len(got) == len(want) and {(q, round(r, 5), i) for q, r, i in got} == {(q, round(r, 5), i) for q, r, i in want}


def test_one_token_by_token_variants_as_in_sql(spark):
    tokens = ["getUserId", "src/config/load-env.ts", "HTTPServer", "_", "...", "a__b", "ΟΔΟΣ", "ÄrgerÜber", "İstanbul", "Ǆungla", "x\\y.Z", "9Lives", "ſ", "日本語Text"]
    got = spark.createDataFrame([(x,) for x in tokens], "w string").select("w", t.token_variants("w").alias("v")).collect()
    assert all(sorted(r["v"]) == sorted(variants(r["w"])) for r in got)


def test_a_document_in_several_rows_is_one(spark, rows):
    parts = spark.createDataFrame([(1, "alpha beta"), (1, "beta Gamma"), (2, "gamma"), (3, None)], "i int, t string")
    whole = spark.createDataFrame([(1, "alpha beta beta Gamma"), (2, "gamma"), (3, None)], "i int, t string")
    terms = query_terms(spark.createDataFrame([("q", "beta gamma")], "q string, t string"), "q", "t")
    one, other = SparseIndex(parts, "i", "t"), SparseIndex(whole, "i", "t")
    assert one.total == 3 and rows(one.search(terms, "q", 3)) == rows(other.search(terms, "q", 3))
    assert rows(one.search(terms, "q", 3, whole.where(F.col("i") == 2))) == rows(other.search(terms, "q", 3, whole.where("i = 2")))
