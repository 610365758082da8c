import datetime as dt
import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.operators import orphans as o
from tessera.session import shared_dir
from tessera.streaming import orphan_stream
from tessera.streaming.changes import run_available

T0 = dt.datetime(2025, 1, 1)
BC = "branch string, chunk_id string, added_at timestamp_ntz, note string"
CH = "chunk_id string, content_hash string, indexed_at timestamp_ntz, deleted_at timestamp_ntz, entity string"
CE = "embedding_input_hash string, content_hash string, created_at bigint, model string"


def ms(hours):
    return int((T0 + dt.timedelta(hours=hours) - dt.datetime(1970, 1, 1)).total_seconds() * 1000)


def at(hours):
    return None if hours is None else T0 + dt.timedelta(hours=hours)


def feed(spark, bc, ch, ce):
    return o.index_feed(
        spark.createDataFrame([(b, c, at(h), "x") for b, c, h in bc], BC),
        spark.createDataFrame([(c, x, at(h), at(d), "x") for c, x, h, d in ch], CH),
        spark.createDataFrame([(e, x, ms(h), "m") for e, x, h in ce], CE),
    )


CASE = (
    [("main", " C1\t", 0), ("main", "c1", 50), ("main", "c2", 0), ("dev", "c3", 1), ("dev", "c3", None), ("dev", None, 1), ("dev", "c4", 0), ("x", "c5", None)],
    [("c1", "H1", 24, None), ("c2", "h2", 25, None), ("c2", "h2", 26, None), ("c3", "h3", 0, None), ("c3", "h3", 5, 5), ("c5", None, 99, None), (None, "h9", 0, None)],
    [("e1", "h1", 10), ("e2", " h3", 10), ("e3", "h2", 60), ("e4", None, 1)],
)
WANT = [("branch_chunks", "dev", "c3"), ("branch_chunks", "dev", "c4"), ("branch_chunks", "main", "c2"), ("chunk_embeddings", "e2", "h3"), ("chunks", "c2", "h2")]


def test_found_in_one_batch(spark, rows):
    assert rows(o.found(o.advance(None, feed(spark, *CASE)).pending)) == sorted(WANT)


def test_empty_tables(spark, rows):
    state = o.advance(None, feed(spark, [], [], []))
    assert rows(o.found(state.pending)) == [] and rows(o.counts(state.pending)) == []


def test_hot_keys_are_salted(spark, rows, monkeypatch):
    monkeypatch.setattr(o, "HOT_ROWS", 5)
    bc = [(f"b{i}", "gone", 0) for i in range(40)] + [(f"b{i}", "late", 0) for i in range(40)] + [(f"b{i}", "there", 3) for i in range(40)]
    f = feed(spark, bc, [("late", None, 30, None), ("there", None, 0, None)], [])
    got = rows(o.found(o.advance(None, f).pending))
    assert got == sorted(("branch_chunks", f"b{i}", k) for i in range(40) for k in ("gone", "late"))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_into_batches_gives_the_same(spark, rows, seed):
    rng = random.Random(seed)
    keys = [f"k{i}" for i in range(8)]
    bc = [(rng.choice("ab"), rng.choice(keys), rng.choice([None, rng.randint(0, 80)])) for _ in range(25)]
    ch = [(rng.choice(keys), rng.choice([None, "h1", "h2", "h3", "h4"]), rng.randint(0, 80), rng.choice([None] * 6 + [5])) for _ in range(12)]
    ce = [(f"e{rng.randint(0, 5)}", rng.choice(["h1", "h2", "h3", "h5", None]), rng.randint(0, 80)) for _ in range(8)]
    whole = rows(o.found(o.advance(None, feed(spark, bc, ch, ce)).pending))
    state = None
    for part in range(3):
        state = o.advance(state, feed(spark, bc[part::3], ch[part::3], ce[part::3])).written()
    assert rows(o.found(state.pending)) == whole


def test_stream_gives_the_same_as_a_batch(spark, rows, tmp_path):
    feeds = [feed(spark, *[part[i::2] for part in CASE]) for i in range(2)]
    source, table = str(tmp_path / "in"), str(tmp_path / "state")
    for i, f in enumerate(feeds):
        orphan_stream.changes(f).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(orphan_stream.SCHEMA).parquet(source)
        run_available(stream, str(tmp_path / "checkpoint"), orphan_stream.sink(spark, table))
        state = orphan_stream.load(spark, table, i)
    assert rows(o.found(state.pending)) == sorted(WANT)


def test_counts_by_month(spark, rows):
    got = rows(o.counts(o.advance(None, feed(spark, *CASE)).pending))
    assert ("branch_chunks", "2025-01", 3, 2, 1) in got and sum(r[2] for r in got) == len(WANT)


def test_deletions_reopen_and_history_is_kept(spark, rows, tmp_path):
    """The second batch deletes what the first one found; only its keys are looked at again."""
    first = feed(spark, [("main", "c1", 0), ("main", "c2", 0)], [("c1", None, 0, None)], [])
    second = feed(spark, [], [("c1", None, 0, 40), ("c2", None, 1, None)], [])
    state = o.advance(None, first)
    assert rows(o.found(state.pending)) == [("branch_chunks", "main", "c2")]
    after = o.advance(state.written(), second)
    assert rows(o.found(after.pending)) == [("branch_chunks", "main", "c1")]
    path = str(tmp_path / "s")
    write = orphan_stream.sink(spark, path)
    for n, f in enumerate((first, second, second)):
        write(orphan_stream.changes(f), min(n, 1))
    assert rows(o.found(orphan_stream.load(spark, path, 1).pending)) == [("branch_chunks", "main", "c1")]
    assert rows(orphan_stream.history(spark, path).select("batch", "n_orphans")) == [(0, 1), (1, 1)]


def test_stream_state_is_compacted(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(orphan_stream, "COMPACT", 2)
    path = str(tmp_path / "s")
    write = orphan_stream.sink(spark, path)
    for n in range(4):
        write(orphan_stream.changes(feed(spark, *[part[n::4] for part in CASE])), n)
    assert rows(o.found(orphan_stream.load(spark, path, 3).pending)) == sorted(WANT)
    assert "delta/refs/batch=0" not in "".join(orphan_stream.load(spark, path, 3).refs.inputFiles())


def test_references_without_a_record_stay_out_of_the_join(spark):
    """A third of all rows has no record; no partition gets them all."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        gone = spark.createDataFrame([("x",)], "entity string")
        held = spark.range(9_000).selectExpr("'r' AS relation", "cast(id AS string) AS key", "'h' AS holder", "if(id % 3 = 0, NULL, cast(id AS string)) AS entity", "timestamp_ntz'2025-01-01 00:00:00' AS at")
        sizes = [len(p) for p in o._alive(held, gone).select("key").rdd.glom().collect()]
        assert sum(sizes) == 9_000 and max(sizes) < 9_000 / 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


MONTH = 24 * 31
MONTHS = (
    [("main", "c1", 0), ("main", "c2", 1), ("dev", "c3", MONTH), ("dev", "c1", 2 * MONTH), ("x", "c4", None), ("x", "c2", 2 * MONTH + 1), ("main", "c5", 3 * MONTH)],
    [("c1", "h1", 2, None), ("c2", "h2", 3, MONTH + 5), ("c3", "h3", 2 * MONTH, None), ("c4", "h4", 5, 3 * MONTH + 1), ("c5", "h1", 3 * MONTH + 2, None), ("c1", "h1", 2 * MONTH, None)],
    [("e1", "h1", 1), ("e2", "h3", MONTH + 3), ("e3", "h9", 2 * MONTH), ("e4", "h4", 6)],
)


def index(spark, root, bc, ch, ce):
    """The tables as files, and a connection that has them as views."""
    con = duckdb.connect()
    tables = {
        "branch_chunks": spark.createDataFrame([(b, c, at(h), "x") for b, c, h in bc], BC),
        "chunks": spark.createDataFrame([(c, x, at(h), at(d), "x") for c, x, h, d in ch], CH),
        "chunk_embeddings": spark.createDataFrame([(e, x, ms(h), "m") for e, x, h in ce], CE),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{root}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet/*.parquet'")
    return con


def same_as_sql(spark, rows, con, root, name):
    got = entry.queries()[name](spark, str(root))
    sql = con.execute(entry.oracle_sql()[name])
    order = [[d[0] for d in sql.description].index(c) for c in got.columns]
    assert rows(got) == sorted((tuple(r[i] for i in order) for r in sql.fetchall()), key=str)


@pytest.mark.parametrize("name", ["p1_found", "p1_history"])
def test_queries_take_the_feed_month_by_month(spark, rows, tmp_path, monkeypatch, name):
    con = index(spark, tmp_path, *MONTHS)
    sizes, advance = [], o.advance

    def counted(state, batch, *rest):
        sizes.append((state.refs.count(), batch.refs.count(), batch.provides.count(), batch.dead.count()))
        return advance(state, batch, *rest)

    monkeypatch.setattr(o, "advance", counted)
    same_as_sql(spark, rows, con, tmp_path, name)
    assert sizes == [(0, 1, 0, 0), (1, 7, 8, 0), (8, 2, 1, 1), (10, 5, 5, 0), (15, 2, 2, 1)]


def test_history_without_times_of_memberships(spark, rows, tmp_path):
    con = index(spark, tmp_path, [(b, c, None) for b, c, _ in MONTHS[0]], *MONTHS[1:])
    same_as_sql(spark, rows, con, tmp_path, "p1_history")


def test_replay_leaves_the_feed_and_one_state(spark, tmp_path):
    """A step's scratch files and the state before it are deleted."""
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    for _ in o.replay(feed(spark, *MONTHS)):
        pass
    assert len(set(os.listdir(folder)) - before) == 4


def jobs_run(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


def test_a_month_of_the_replay_takes_few_jobs(spark):
    """Each is a thread and code of the driver's, which ran out of memory with some 30 a month."""
    f = feed(spark, *MONTHS)
    before = jobs_run(spark)
    months = [month for month, _ in o.replay(f)]
    assert len(months) == 5 and jobs_run(spark) - before <= 16 * len(months)


@pytest.mark.parametrize("limit", ["HOT_ROWS", "TOUCHED"])
def test_replay_with_hot_keys_or_without_broadcasts(spark, rows, tmp_path, monkeypatch, limit):
    """A limit of nothing: every key with references is hot, or nothing is broadcast."""
    monkeypatch.setattr(o, limit, 0)
    bc, ch, ce = MONTHS
    con = index(spark, tmp_path, bc + [("main", "c2", 3), ("main", "c2", MONTH + 9)], ch, ce)
    same_as_sql(spark, rows, con, tmp_path, "p1_history")


def test_a_record_deleted_twice_and_repeated_references(spark, rows, tmp_path):
    """Deletions of one record in two months, references repeated in another month, with and without a time."""
    bc, ch, ce = MONTHS
    con = index(spark, tmp_path, bc + [("main", "c2", None), ("dev", "c3", 0), ("dev", "c3", None), ("x", "c9", 2 * MONTH), ("x", "c9", 5)], ch + [("c2", "h2", 3, 2 * MONTH), ("c1", "h1", 4, 2 * MONTH)], ce)
    same_as_sql(spark, rows, con, tmp_path, "p1_found")
    same_as_sql(spark, rows, con, tmp_path, "p1_counts")
