import datetime as dt

from tessera.operators import snapshots as s

SCHEMA = "repo string, branch string, snapshot_no int, path string, kind string, hash string, delivered_at timestamp_ntz, field string, sign int"


def nodes(spark, data):
    return spark.createDataFrame([("r", "main", n, p, k, h, dt.datetime(2025, 1, 1, 0, d), "f", 1) for n, p, k, h, d in data], SCHEMA)


def test_changes(spark, rows):
    data = [
        (1, "a", "file", "H1", 0), (1, "./b", "file", "h2", 0), (1, "c", "file", None, 0), (1, "d\\e", "file", "h5", 0), (1, "dir", "directory", "x", 0), (1, "A", "file", "q", 0),
        (4, "a", "file", "h1", 0), (4, "b", "file", "h3", 0), (4, "b", "file", "h3", 0), (4, "b", "file", "h2", 1), (4, "c", "file", "h9", 0), (4, "d/e", "file", "h6", 0), (4, "n", "file", None, 0), (4, "dir", "directory", "y", 0),
        (9, "a", "file", "h1", 0),
        (None, "z", "file", "h", 0), (4, None, "file", "h", 0),
    ]
    got = rows(s.tree_changes(nodes(spark, data)).select("snapshot_no", "path", "change_kind", "changed_fields"))
    assert got == sorted([(4, "d/e", "changed", ["hash"]), (4, "n", "added", []), (4, "A", "removed", []), *[(9, p, "removed", []) for p in ("b", "c", "d/e", "n")]], key=str)


def test_empty(spark, rows):
    assert rows(s.tree_changes(nodes(spark, []))) == []


def test_single_snapshot_has_no_changes(spark, rows):
    assert rows(s.tree_changes(nodes(spark, [(3, "a", "file", "h", 0)]))) == []


def test_several_fields(spark, rows):
    df = spark.createDataFrame([("s", 1, "k", "x", 1), ("s", 2, "k", "y", 2), ("s", 1, "l", "x", None), ("s", 2, "l", "x", 5)], "g string, n int, key string, a string, b int")
    got = rows(s.snapshot_changes(df, ["g"], "n", "key", ["a", "b"], s.next_snapshots(df, ["g"], "n")))
    assert got == [("s", 2, "k", ["a", "b"], "changed")]
