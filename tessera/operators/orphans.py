"""References to records that do not exist, kept as incremental state.

A feed of references, record arrivals and record deletions is folded into three state tables
whose merges are associative (min of times, max of deletion marks), so batches may come late,
repeated or in any order:

* ``provides`` (relation, key, entity, at): the parent index; entity is the record that gives the key, null if it can't be deleted,
* ``refs`` (relation, key, holder, entity, at): who refers to a key; entity is the record that
  holds the reference, null if that can't be deleted,
* ``dead`` (entity, at): deleted records,

and the derived ``pending`` (relation, key, holder, at, cause). The first three only grow by what a batch brings (repeated rows are
merged when they are read). One step re-evaluates only the keys that its batch touches: new references probe the parent index, arriving
parents resolve waiting orphans, deletions reopen them.

Defined cases: null or blank keys are no references and no parents; a null time never makes
a reference late; repeated rows count once with their earliest time; empty feeds give empty state;
columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import bounded, clean_key, cut, discard

KEY = ["relation", "key"]
GRACE_HOURS = 24
#: Keys with more references than this, and than a MOST_HOT-th of all, are spread over SALTS; so there are at most MOST_HOT.
HOT_ROWS = 200_000
MOST_HOT = 20_000
#: Keys a batch touches, or records that are deleted, up to which they are broadcast.
TOUCHED = 1_000_000
SALTS = 64
#: The step of rows without a time, before all months.
UNTIMED = -(2**31)


@dataclass
class Known:
    """What a replay knows of a feed, so that a step needn't count it. Every count is a job and every shuffle a thread of the driver
    for a minute, whatever the size of the tables."""

    #: rows of dead, each a record of its own that isn't in what came before
    deaths: int
    #: the keys to be spread, those that are hot in the whole feed; None if there are none
    hot: DataFrame | None


@dataclass
class Feed:
    """One batch of changes; the columns are those of the state tables."""

    refs: DataFrame
    provides: DataFrame
    dead: DataFrame
    known: Known | None = field(default=None, kw_only=True)


@dataclass
class OrphanState(Feed):
    pending: DataFrame
    #: which tables aren't files of their own yet
    loose: tuple[str, ...] = ("refs", "provides", "dead", "pending")
    #: files that only the making of pending reads
    scratch: tuple[DataFrame, ...] = ()

    def written(self) -> OrphanState:
        """The state as files in the shared folder."""
        tables = {t: getattr(self, t) for t in ("refs", "provides", "dead", "pending")}
        state = OrphanState(**{t: cut(df) if t in self.loose else df for t, df in tables.items()}, loose=(), known=self.known)
        discard(*self.scratch)
        return state


REF, PROVIDE = ["relation", "key", "holder", "entity"], ["relation", "key", "entity"]


def _merge(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.min("at").alias("at"))


def _hot(refs: DataFrame, rows: int) -> DataFrame:
    """The hot keys of refs, which has so many rows."""
    most = max(HOT_ROWS, rows // MOST_HOT)
    return refs.groupBy(*KEY).count().where(F.col("count") > most).select(*KEY)


def _alive(rows: DataFrame, gone: DataFrame, sent: bool = False) -> DataFrame:
    """Rows whose record isn't deleted. Those without a record can't be and stay out of the join, where they would be one key,
    unless gone is sent to all tasks and nothing is gathered by key."""
    if sent:
        return rows.join(gone, "entity", "left_anti").select(*rows.columns)
    return rows.where("entity IS NULL").unionByName(rows.where("entity IS NOT NULL").join(gone, "entity", "left_anti").select(*rows.columns))


def evaluate(refs: DataFrame, provides: DataFrame, dead: DataFrame, grace_hours: int = GRACE_HOURS, known: Known | None = None) -> DataFrame:
    """Orphans among refs: key without a living parent ("absent") or with one that came more than
    grace_hours after the reference ("late"). Repeated references are merged where the join has left them, without
    another shuffle: the earliest of them is late if any is."""
    if known is None or known.deaths:
        sent = known is not None and known.deaths <= TOUCHED
        gone = F.broadcast(dead.select("entity")) if sent else bounded(dead.select("entity").distinct(), TOUCHED)
        refs, provides = _alive(refs, gone, sent), _alive(provides, gone, sent)
    living = _merge(provides, KEY).withColumnRenamed("at", "parent_at").withColumn("there", F.lit(True))
    hot, by = _hot(refs, refs.count()) if known is None else known.hot, KEY
    if hot is not None:
        hot, by = F.broadcast(hot.withColumn("hot", F.lit(True))), [*KEY, "salt"]
        salt = F.when(F.col("hot"), F.pmod(F.xxhash64("holder"), F.lit(SALTS))).otherwise(0).cast("int")
        salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        refs = refs.join(hot, KEY, "left").withColumn("salt", salt).drop("hot")
        living = living.join(hot, KEY, "left").withColumn("salt", F.explode(salts)).drop("hot")
    late = F.col("parent_at") > F.col("at") + F.expr(f"INTERVAL '{grace_hours}' HOUR")
    cause = F.when(F.col("there").isNull(), "absent").when(late, "late")
    orphaned = refs.join(living, by, "left").withColumn("cause", cause).where("cause IS NOT NULL")
    return _merge(orphaned, list(dict.fromkeys([*by, *REF, "cause"]))).select("relation", "key", "holder", "at", "cause")


def touched_keys(state: Feed, batch: Feed) -> DataFrame:
    """The keys whose references or parents a batch may change."""
    keys = batch.refs.select(*KEY).unionByName(batch.provides.select(*KEY))
    if batch.known is None:
        newly = bounded(batch.dead.select("entity").distinct().join(state.dead.select("entity"), "entity", "left_anti"), TOUCHED)
    elif batch.known.deaths:
        newly = F.broadcast(batch.dead.select("entity")) if batch.known.deaths <= TOUCHED else batch.dead.select("entity")
    else:
        return keys.distinct()
    held = lambda rows: rows.where("entity IS NOT NULL").join(newly, "entity", "left_semi").select(*KEY)
    for table in (state.refs, state.provides):
        keys = keys.unionByName(held(table))
    return keys.distinct()


def advance(state: OrphanState | None, batch: Feed, grace_hours: int = GRACE_HOURS) -> OrphanState:
    """The state after one more batch."""
    dead = batch.dead.groupBy("entity").agg(F.min("at").alias("at"))
    if state is None:
        refs, provides = cut(_merge(batch.refs, REF)), cut(_merge(batch.provides, PROVIDE))
        return OrphanState(refs, provides, dead, evaluate(refs, provides, dead, grace_hours), ("dead", "pending"))
    known = None
    if state.known and batch.known:
        dead, known = batch.dead, Known(state.known.deaths + batch.known.deaths, batch.known.hot)
    keys = cut(touched_keys(state, batch))
    touched = bounded(keys, TOUCHED)
    both = Feed(state.refs.unionByName(batch.refs.select(*state.refs.columns)), state.provides.unionByName(batch.provides.select(*state.provides.columns)), state.dead.unionByName(dead))
    refs, provides = (rows.join(touched, KEY, "left_semi") for rows in (both.refs, both.provides))
    scratch = (keys,)
    if known is None or known.deaths > TOUCHED:
        refs = cut(_merge(refs, REF))  # read more than once
        scratch = (keys, refs)
    elif known.hot is not None:
        refs = _merge(refs, REF)  # a reference repeated without end has one salt
    again = evaluate(refs, provides, both.dead, grace_hours, known)
    pending = state.pending.join(touched, KEY, "left_anti").unionByName(again)
    return OrphanState(both.refs, both.provides, both.dead, pending, scratch=scratch, known=known)


def replay(feed: Feed) -> Iterator[tuple[int, OrphanState]]:
    """The whole feed month by month: after every month that has rows its number (``month_number``, or UNTIMED) and the state.
    The feed is written once, by months, and is the state's refs, provides and dead as far as it has come; a record is
    deleted once, in its first month. A step's pending is gone when the next is asked for."""
    refs, provides, dead = (df.withColumn("step", F.coalesce(month_number("at"), F.lit(UNTIMED))) for df in (feed.refs, feed.provides, feed.dead))
    dead = dead.groupBy("entity").agg(F.min("at").alias("at"), F.min("step").alias("step"))
    log = Feed(*(cut(df.hint("rebalance", "step"), "step") for df in (refs, provides, dead)))  # else every task would write a file a month
    steps = sizes(log)
    hot = _all_hot(log.refs, sum(n for _, n, _ in steps))
    state = empty_state(feed.refs.sparkSession)
    state.known = Known(0, hot)
    for step, _, newly in steps:
        batch, whole = (Feed(*(df.where(upto).drop("step") for df in (log.refs, log.provides, log.dead))) for upto in (F.col("step") == step, F.col("step") <= step))
        batch.known = Known(newly, hot)
        after = advance(state, batch)
        before, state = state, OrphanState(whole.refs, whole.provides, whole.dead, after.pending, ("pending",), after.scratch, known=after.known).written()
        discard(before.pending)
        yield step, state
    discard(*([] if hot is None else [hot]))


def _all_hot(refs: DataFrame, rows: int) -> DataFrame | None:
    """The hot keys of all of refs, which has so many rows, as files; the others have no more rows in any part of it.
    None if there are none."""
    if rows <= HOT_ROWS:
        return None
    hot = cut(_hot(refs, rows))
    if hot.isEmpty():
        discard(hot)
        return None
    return hot


def month_number(at: str | Column) -> Column:
    at = F.col(at) if isinstance(at, str) else at
    return F.year(at) * 12 + F.month(at) - 1


def sizes(log: Feed) -> list[tuple[int, int, int]]:
    """The steps that have rows, in order, a number a month of the feed's span; each with its rows in refs and in dead."""
    counted = (df.groupBy("step").agg(F.count("*").alias("n")).withColumn("of", F.lit(t)) for t, df in (("refs", log.refs), ("provides", log.provides), ("dead", log.dead)))
    rows: dict[int, dict[str, int]] = {}
    for r in reduce(DataFrame.unionByName, counted).collect():
        rows.setdefault(r["step"], {})[r["of"]] = r["n"]
    return [(step, n.get("refs", 0), n.get("dead", 0)) for step, n in sorted(rows.items())]


def _epoch_ms(column: str) -> Column:
    return F.expr(f"timestampadd(MILLISECOND, {column}, TIMESTAMP_NTZ'1970-01-01 00:00:00')")


def index_feed(branch_chunks: DataFrame, chunks: DataFrame, chunk_embeddings: DataFrame) -> Feed:
    """The three relations of the index as a feed. A chunk's rows give its id as a key and its
    content hash as another; a mark in deleted_at makes it dead."""
    none = F.lit(None).cast("string")
    members = branch_chunks.select(F.lit("branch_chunks").alias("relation"), clean_key("chunk_id").alias("key"), clean_key("branch").alias("holder"), none.alias("entity"), F.col("added_at").alias("at"))
    rows = chunks.select(clean_key("chunk_id").alias("entity"), clean_key("content_hash").alias("hash"), F.col("indexed_at").alias("at"), "deleted_at")
    vectors = chunk_embeddings.select(clean_key("content_hash").alias("key"), clean_key("embedding_input_hash").alias("holder"), _epoch_ms("created_at").alias("at"))
    by_chunk = rows.select(F.lit("chunks").alias("relation"), F.col("hash").alias("key"), F.col("entity").alias("holder"), "entity", "at")
    by_vector = vectors.select(F.lit("chunk_embeddings").alias("relation"), "key", "holder", none.alias("entity"), "at")
    refs = members.unionByName(by_chunk).unionByName(by_vector).where("key IS NOT NULL AND holder IS NOT NULL")
    ids = rows.select(F.lit("branch_chunks").alias("relation"), F.col("entity").alias("key"), "entity", "at")
    hashes = rows.select(F.lit("chunk_embeddings").alias("relation"), F.col("hash").alias("key"), "entity", "at")
    stored = vectors.select(F.lit("chunks").alias("relation"), "key", none.alias("entity"), "at")
    provides = ids.unionByName(hashes).unionByName(stored).where("key IS NOT NULL")
    return Feed(refs, provides, rows.where("deleted_at IS NOT NULL AND entity IS NOT NULL").select("entity", F.col("deleted_at").alias("at")))


def found(pending: DataFrame) -> DataFrame:
    return pending.select(F.col("relation").alias("table_name"), F.col("holder").alias("holder_key"), F.col("key").alias("missing_key")).distinct()


def counts(pending: DataFrame) -> DataFrame:
    """Orphans per table and month of the referring row; a null month holds rows without a time."""
    month = F.date_format(F.date_trunc("month", "at"), "yyyy-MM")
    return pending.groupBy(F.col("relation").alias("table_name"), month.alias("month")).agg(
        F.count("*").cast("bigint").alias("n_orphans"),
        F.sum(F.when(F.col("cause") == "absent", 1).otherwise(0)).cast("bigint").alias("n_absent"),
        F.sum(F.when(F.col("cause") == "late", 1).otherwise(0)).cast("bigint").alias("n_late"),
    )


def empty_state(spark: SparkSession) -> OrphanState:
    make = lambda ddl: spark.createDataFrame([], ddl)
    return OrphanState(
        make("relation string, key string, holder string, entity string, at timestamp_ntz"),
        make("relation string, key string, entity string, at timestamp_ntz"),
        make("entity string, at timestamp_ntz"),
        make("relation string, key string, holder string, at timestamp_ntz, cause string"),
    )
