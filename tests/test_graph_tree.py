import random
from collections import deque

from tessera.operators import graph as g
from tessera.operators import tree


def bfs(edges, seed, depth):
    seen, todo = {seed: 0}, deque([seed])
    while todo:
        x = todo.popleft()
        if seen[x] < depth:
            for a, b in edges:
                if a == x and b not in seen:
                    seen[b] = seen[x] + 1
                    todo.append(b)
    return {(seed, n, d) for n, d in seen.items()}


def test_traversal_against_bfs(spark, rows):
    rng = random.Random(3)
    edges = [(rng.randint(0, 19), rng.randint(0, 19)) for _ in range(45)]
    df = spark.createDataFrame(edges, "src int, dst int")
    seeds = spark.createDataFrame([(0,), (5,), (77,)], "id int")
    want = set().union(*(bfs(edges, s, 3) for s in (0, 5, 77)))
    assert set(rows(g.traverse(seeds, df, 3))) == want
    paths = rows(g.shortest_paths(seeds, df, 3))
    assert {(r[0], r[1], r[2]) for r in paths} == want
    assert all(len(r[3]) == r[2] + 1 and all((a, b) in edges for a, b in zip(r[3], r[3][1:])) for r in paths)


def test_degrees_count_self_loops_twice(spark, rows):
    df = spark.createDataFrame([(1, 1), (1, 2)], "src int, dst int")
    assert rows(g.degrees(df)) == [(1, 2, 1, 3), (2, 0, 1, 1)]


def test_resolution_passes(spark, rows):
    symbols = spark.createDataFrame([("s1", "f1", "foo", "function", 1), ("s2", "f2", "foo", "class", 1), ("s3", "f3", "only", "function", 9), ("s4", "f4", "twin", "function", 5), ("s5", "f4", "twin", "function", 2)], "id string, file string, name string, kind string, start_line int")
    edges = spark.createDataFrame([("e1", "f1", "foo", None, None), ("e2", "x", "only", None, None), ("e3", "x", "foo", None, None), ("e4", "x", "foo", "f2", None), ("e5", "x", "twin", None, None), ("e6", "x", "foo", None, "CLASS"), ("e7", "x", "nothing", None, None), ("e8", "x", "FOO", None, None)], "id string, caller_file string, target_name string, target_file string, target_kind string")
    assert rows(g.resolve_edges(edges, symbols).select("id", "to_id", "pass")) == [("e1", "s1", 1), ("e2", "s3", 2), ("e3", None, None), ("e4", "s2", 3), ("e5", "s5", 3), ("e6", "s2", 2), ("e7", None, None), ("e8", None, None)]


def test_directory_hashes_see_a_change_below(spark, rows):
    files = lambda h: spark.createDataFrame([("s", "a/b/c", h), ("s", "a/d", "1"), ("s", "e", None)], "s string, path string, hash string")
    one = {r[1]: r[3] for r in rows(tree.directory_hashes(files("x"), ["s"]))}
    two = {r[1]: r[3] for r in rows(tree.directory_hashes(files("y"), ["s"]))}
    assert set(one) == {"a/b/c", "a/d", "e", "a/b", "a"}
    assert one["a"] != two["a"] and one["a/b"] != two["a/b"] and one["a/d"] == two["a/d"]
    assert rows(tree.directories(files("x"), ["s"], "path")) == [("s", "a"), ("s", "a/b")]
