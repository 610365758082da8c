from pyspark.sql import functions as F

from tessera.plans import indexing as x

FILES = "path string, content string, modified_at timestamp_ntz"


def files(spark, **contents):
    return spark.createDataFrame([(k, v, None) for k, v in contents.items()], FILES)


def test_an_update_gives_what_a_fresh_start_does(spark, rows):
    old = files(spark, a="one\n\ntwo\n", b="x = 1\n" * 200, c="gone", d=None)
    new = files(spark, a="one\n\nthree\n", b="x = 1\n" * 200, e="added", d=None)
    index = x.hot_update(x.cold_start(old), new)
    fresh = x.cold_start(new)
    assert rows(index.chunks) == rows(fresh.chunks) and rows(index.state) == rows(fresh.state)
    assert {r["path"] for r in index.chunks.collect()} == {"a", "b", "e"}
    again = x.hot_update(index, new.limit(0))
    assert again.chunks.count() == 0 and again.state.count() == 0


def test_vectors_memberships_and_deferred_files(spark, rows):
    index = x.cold_start(files(spark, a="same", b="same", c="other"))
    none = spark.createDataFrame([], "content_hash string, model string, embedding array<float>")
    vectors = x.embedded(index, none, "m")
    assert vectors.count() == 2 and x.embedded(index, vectors, "m").count() == 2
    members = x.published(spark.createDataFrame([("main", "old"), ("dev", "k")], "branch string, chunk_id string"), "main", index)
    assert members.where("branch = 'dev'").count() == 1 and members.where("chunk_id = 'old'").count() == 0 and members.count() == 4
    timed = spark.sql("SELECT 'a' AS path, 'x' AS content, timestamp_ntz'2025-01-02 00:00:00' AS modified_at UNION ALL SELECT 'b', 'y', NULL")
    now, later = x.settled(timed, F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))
    assert rows(now.select("path")) == [("b",)] and rows(later.select("path")) == [("a",)]


def test_snapshots_budgets_and_single_paths(spark, rows, tmp_path):
    import json

    import pytest

    from tessera.sources import files as f

    nodes = spark.createDataFrame([("main", "a"), ("dev", "b")], "branch string, path string")
    f.save_snapshot(nodes, str(tmp_path / "s"))
    f.delete_snapshot(spark, str(tmp_path / "s"), "main")
    assert rows(spark.read.parquet(str(tmp_path / "s")).select("path")) == [("b",)]
    f.clear_snapshots(spark, str(tmp_path / "s"))
    assert not (tmp_path / "s").exists()
    (tmp_path / "b.json").write_text(json.dumps({"thresholds": {"minHitAt1": 0.5, "expansionHitRate": 0.1, "x": 1}}))
    assert f.load_budget(str(tmp_path / "b.json")) == {"minHitAt1": 0.5, "expansionHitRateMaxDrop": 0.1}
    (tmp_path / "b.json").write_text(json.dumps({"thresholds": {"minHitAt1": "x"}}))
    with pytest.raises(ValueError, match="minHitAt1"):
        f.load_budget(str(tmp_path / "b.json"))
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.py").write_text("x")
    one = lambda p: f.scan_path(spark, str(tmp_path / "r"), p, ["**/*.py"], [], [], 100).count()
    assert (one("./a.py"), one(str(tmp_path / "r" / "a.py")), one("b.py"), one("../a.py")) == (1, 1, 0, 0)
