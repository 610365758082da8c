import numpy as np

from tessera.llm import mixing, neighbours

VECTORS = "content_hash string, embedding array<float>, model string, class bigint, a int"


def frame(spark, items):
    return spark.createDataFrame([(k, None if v is None else [float(x) for x in v], m, 0, 0) for k, v, m in items], VECTORS)


def brute(items, k):
    ok = [(n, np.array(v, np.float64), m) for n, v, m in items if v is not None and n and m and np.any(np.array(v)) and np.all(np.isfinite(v))]
    x = {}
    for n, v, m in ok:
        x.setdefault(m, {})[n] = v / np.linalg.norm(v)
    return {m: {a: sorted(((float(u @ w), b) for b, w in d.items() if b != a), key=lambda t: (-t[0], t[1]))[:k] for a, u in d.items()} for m, d in x.items()}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(1200, 24))
    near = base[:200] + 0.1 * rng.normal(size=(200, 24))
    items = [(f"k{i}", v, "m") for i, v in enumerate(np.concatenate([base, near]))]
    want = brute(items, 10)["m"]
    pairs, members = neighbours.neighbours(frame(spark, items), "content_hash", "embedding", "model", k=10, list_size=500, share=1.0, rerank=200)
    names = {r["class"]: r["content_hash"] for r in members.collect()}
    got = {}
    for r in pairs.collect():
        got.setdefault(names[r["a"]], set()).add(names[r["b"]])
    recall = np.mean([len(got[a] & {b for _, b in w}) / 10 for a, w in want.items()])
    assert recall >= 0.97
    found, members = neighbours.neighbours(frame(spark, items), "content_hash", "embedding", "model", k=10, list_size=128, probes=4, floor=0.9)
    links = {(r["a"], r["b"]) for r in neighbours.similar_keys(found, members, "content_hash").collect()}
    true = {tuple(sorted((a, b))) for a, w in want.items() for s, b in w if s >= 0.9}
    assert len(true) > 100 and len(links & true) / len(true) >= 0.98 and not {p for p in links if p not in true}


def test_copies_nulls_models_and_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 3)
    items = [("a", [1, 0, 0], "m"), ("b", [2, 0, 0], "m"), ("a", [1, 0, 0], "m"), ("c", [0, 1, 0], "m"), ("d", None, "m"), ("e", [0, 0, 0], "m"), ("f", [float("nan"), 0, 1], "m"), (None, [1, 0, 0], "m"), ("g", [1, 0, 0], "other"), ("h", [1, 0.01, 0], "m"), ("i", [], "m")]
    items += [(f"x{i}", [0, np.cos(i), np.sin(i)], "m") for i in range(9)]
    pairs, members = neighbours.neighbours(frame(spark, items), "content_hash", "embedding", "model", k=3, list_size=4, share=1.0, floor=0.9)
    got = {(r["a"], r["b"]) for r in neighbours.similar_keys(pairs, members, "content_hash").collect()}
    unit = {k: np.array(v, float) / np.linalg.norm(v) for k, v, m in items if m == "m" and k and v and np.any(v) and np.all(np.isfinite(v))}
    want = {(p, q) for p in unit for q in unit if p < q and unit[p] @ unit[q] >= 0.9}
    assert got == want and ("a", "b") in got


def test_every_model_is_searched_in_waves(spark, monkeypatch):
    """300 models, a few to a wave."""
    monkeypatch.setattr(neighbours, "WAVE_BYTES", 100 * 2 * 3 * 3 * 4)
    items = [(f"{c}{i}", v, f"m{i}") for i in range(300) for c, v in (("a", [1, 0, 0]), ("b", [1, 0.1, 0]), ("c", [0, 1, 0]))]
    pairs, members = neighbours.neighbours(frame(spark, items), "content_hash", "embedding", "model", k=2, floor=0.9)
    got = {(r["a"], r["b"]) for r in neighbours.similar_keys(pairs, members, "content_hash").collect()}
    assert got == {(f"a{i}", f"b{i}") for i in range(300)}


def test_large_models_have_their_lists_divided(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LISTS", 8)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1500, 16))
    items = [(f"k{i}", v, "m") for i, v in enumerate(np.concatenate([base, base[:300] + 0.05 * rng.normal(size=(300, 16))]))]
    pairs, members = neighbours.neighbours(frame(spark, items), "content_hash", "embedding", "model", k=10, list_size=32, probes=6, floor=0.9)
    links = {(r["a"], r["b"]) for r in neighbours.similar_keys(pairs, members, "content_hash").collect()}
    true = {tuple(sorted((a, b))) for a, w in brute(items, 10)["m"].items() for s, b in w if s >= 0.9}
    assert len(true) >= 300 and len(links & true) / len(true) >= 0.95 and links <= true


def test_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "KEYS", 4)
    items = [(f"a{i:02}", [1, 0], "m") for i in range(15)] + [(f"b{i}", [1, 0.05], "m") for i in range(6)] + [("z", [0, 1], "m")]
    pairs, members = neighbours.neighbours(frame(spark, items), "content_hash", "embedding", "model", k=3, floor=0.9)
    got = [(r["a"], r["b"]) for r in neighbours.similar_keys(pairs, members, "content_hash").collect()]
    names = sorted(k for k, *_ in items if k != "z")
    assert sorted(got) == [(x, y) for i, x in enumerate(names) for y in names[i + 1 :]]


def test_no_vectors(spark, rows):
    pairs, members = neighbours.neighbours(frame(spark, [("a", None, "m")]), "content_hash", "embedding", "model")
    assert rows(neighbours.similar_keys(pairs, members, "content_hash")) == []


def test_score_aware_codes_keep_parallel_error_small():
    rng = np.random.default_rng(0)
    x = neighbours._unit(rng.normal(size=(3000, 32))).astype(np.float32)
    errors = []
    for eta in (1.0, 31 / 3):
        words = neighbours.fit_words(x, eta)
        codes = neighbours.assign(x, words, eta)
        back = words[np.arange(len(words))[None], codes].reshape(len(x), -1)
        errors.append(np.mean(((x - back) * x).sum(1) ** 2))
        t = neighbours.tables(x[:5], words)
        packed = neighbours.pack(codes)
        scan = sum(np.take(t[:, b], packed[:, b], axis=1) for b in range(packed.shape[1]))
        assert np.allclose(scan, x[:5] @ back.T, atol=1e-4)
    assert errors[1] < errors[0] / 2


DOCS = "doc_id bigint, text string, source string, n_tokens int, h string"
TARGETS = "source string, target_share double, max_repeats int"


def test_mix_reaches_targets(spark):
    docs = [(i, "word " * (5 + i % 40), ("Big One", " big_one", "big-one")[i % 3], 0, "") for i in range(900)] + [(1000 + i, "word " * 20, "small", 0, "") for i in range(30)] + [(2000, None, "small", 0, ""), (2001, "", "small", 0, ""), (2002, "x", None, 0, ""), (2003, "x", "unknown", 0, "")]
    targets = [("big_one", 0.8, 1), ("small", 0.2, 4), ("absent", 0.0, 1)]
    uses, report = mixing.mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS))
    report = {r["source"]: r for r in report.collect()}
    assert abs(report["big_one"]["actual_share"] - 0.8) < 0.01 and abs(report["small"]["actual_share"] - 0.2) < 0.01
    assert report["small"]["most_uses"] <= 4 and report["big_one"]["most_uses"] <= 1
    got = uses.collect()
    assert len({r["doc_id"] for r in got}) == len(got) and not {2000, 2001, 2002, 2003} & {r["doc_id"] for r in got}
    for r in report.values():
        assert r["budget"] - 50 <= r["tokens"] <= r["budget"]


def test_thresholds_are_nested_and_exact(spark):
    sized = spark.range(500).selectExpr("id AS doc_id", "'s' AS source", "cast(1 + id % 9 AS bigint) AS n_tokens", "shiftrightunsigned(xxhash64(id), 4) AS h").cache()
    rows_ = sorted((r["h"], r["n_tokens"]) for r in sized.collect())
    last = -1
    for part in (0, 10, 400, 2477, 10**9):
        limit = mixing.thresholds(sized, spark.createDataFrame([("s", part)], "source string, part bigint")).first()["threshold"]
        taken = [n for h, n in rows_ if h < limit]
        assert sum(taken) <= part and (len(taken) == len(rows_) or sum(taken) + rows_[len(taken)][1] > part)
        assert limit >= last
        last = limit


def test_mix_of_nothing(spark):
    uses, report = mixing.mix(spark.createDataFrame([], DOCS), spark.createDataFrame([("s", 1.0, 2)], TARGETS))
    assert uses.count() == 0 and [r["actual_share"] for r in report.collect()] == [0.0]


def test_groups_beyond_the_indexed_ones_are_compared(spark, monkeypatch):
    from tessera.llm import neighbours as own

    monkeypatch.setattr(own, "WAVE_BYTES", 1)  # a wave a model; no model goes without an index
    monkeypatch.setattr(own, "BLOCK", 2)
    data = [(f"a{i}", "many", [1.0, float(i), 2.0]) for i in range(6)]
    data += [("x", "few", [1.0, 0.0]), ("y", "few", [1.0, 0.1]), ("z", "few", [-1.0, 0.0]), ("w", "few", [0.0, 1.0]), ("v", "few", [1.0, 0.05])]
    rows_ = spark.createDataFrame(data, "h string, m string, v array<float>")
    pairs, members = own.neighbours(rows_, "h", "v", "m", k=2, floor=0.9)
    got = {tuple(r) for r in own.similar_keys(pairs, members, "h").collect()}
    assert {g for g in got if g[0] in "vwxyz"} == {("x", "y"), ("v", "x"), ("v", "y")}


def test_membership_is_a_query():
    from tessera.llm import catalogue

    assert "p6_members" in catalogue.QUERIES
