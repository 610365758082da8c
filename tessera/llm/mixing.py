"""Mixing sources to target weights by hash-threshold histograms.

Sizes are tokens of a public tokenizer. The total is the greatest at which every source can give its
share with at most max_repeats uses of a document: min over sources of size x max_repeats / share.
A source's budget is then so many whole copies of itself and a part. The part is the documents whose
hash lies under a threshold: tokens are summed by source and the hash's leading BITS bits, the bucket in
which the running sum passes the budget is found, and only that bucket is split by the next BITS bits,
down to single hashes. Choosing is a filter; documents are never sorted, and thresholds are nested: a
larger budget keeps all that a smaller one chose.

Defined cases: sources are compared in lower case, blanks and hyphens as underscores; documents of
no target source are left out; null and empty texts have size 0 and are never used; a source with a target but no size
limits the others no more and is reported with share 0; shares are scaled to sum 1; equal hashes fall together, so a
part may miss its budget by less than one document (or group of equal hashes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import VOCABULARY, token_counts
from tessera.session import bounded, cut

BITS, LEVELS = 12, 5
SOURCES = 100_000


def source_name(column: str) -> Column:
    return F.regexp_replace(F.lower(F.btrim(F.col(column), F.lit(" \t\r\n"))), r"[\s\-]+", "_")


def sizes(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, h): h is 60 bits of the id's hash."""
    named = docs.select("doc_id", source_name("source").alias("source"), "text").where("source IS NOT NULL AND text <> ''")
    counted = token_counts(named, ["doc_id", "source"], "text", path).where("n_tokens > 0")
    return counted.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("mix")), 4))


def budgets(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: its size, budget, whole copies and the tokens still to choose."""
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("size"))
    want = targets.select(source_name("source").alias("source"), "target_share", "max_repeats").where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0")
    want = want.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    joined = want.join(have, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    alone = Window.partitionBy(F.lit(0))  # the targets: a row per source
    share = F.col("target_share") / F.sum("target_share").over(alone)
    joined = joined.withColumn("target_share", share).withColumn("_cap", F.when(F.col("size") > 0, F.col("size") * F.col("max_repeats") / F.col("target_share")))
    joined = joined.withColumn("budget", F.when(F.col("size") > 0, F.floor(F.min("_cap").over(alone) * F.col("target_share"))).otherwise(0).cast("bigint"))
    copies = F.when(F.col("size") > 0, F.least("max_repeats", F.floor(F.col("budget") / F.col("size")))).otherwise(0).cast("int")
    return joined.withColumn("copies", copies).withColumn("part", F.col("budget") - F.col("copies") * F.col("size")).drop("_cap")


def thresholds(sized: DataFrame, budget: DataFrame) -> DataFrame:
    """(source, threshold): documents with h < threshold fill the source's part without passing it;
    each level sums only the documents of the boundary bucket of the level before."""
    state = budget.select("source", F.lit(0).cast("bigint").alias("low"), F.col("part").alias("left"))
    near = F.broadcast if budget.limit(SOURCES + 1).count() <= SOURCES else (lambda df: df)  # all below have a row per target
    for level in range(LEVELS):
        width = 60 - BITS * (level + 1)
        step = near(state)
        inside = sized.join(step, "source").where((F.col("h") >= F.col("low")) & (F.col("h") - F.col("low") < (1 << (width + BITS)) if level else F.lit(True)))
        bucket = F.shiftrightunsigned(F.col("h") - F.col("low"), width)
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("n_tokens").alias("n"))
        running = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))  # at most 2^BITS rows a source
        sums = sums.join(step, "source").withColumn("upto", running)
        # the first bucket that doesn't fit whole is the boundary; where all fit, the one after the last
        fits = F.col("upto") <= F.col("left")
        boundary = F.coalesce(F.min(F.when(~fits, F.col("bucket"))), F.max("bucket") + 1)
        edge = sums.groupBy("source").agg(boundary.alias("edge"), F.max(F.when(fits, F.col("upto"))).alias("used"))
        state = state.join(near(edge), "source", "left")
        low = F.col("low") + F.shiftleft(F.coalesce("edge", F.lit(0)).cast("bigint"), width)
        state = cut(state.select("source", low.alias("low"), (F.col("left") - F.coalesce("used", F.lit(0))).alias("left")))
    return state.select("source", F.col("low").alias("threshold"))


def mix(docs: DataFrame, targets: DataFrame, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(uses, report): uses is (doc_id, source, n_tokens, uses) of each document in the mix; report has
    a row per target source with the share reached."""
    sized = cut(sizes(docs, path))
    budget = cut(budgets(sized, targets))
    plan = budget.join(thresholds(sized, budget), "source").select("source", "copies", "threshold", "max_repeats")
    uses = sized.join(bounded(plan, SOURCES), "source")
    times = F.least(F.col("copies") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0), F.col("max_repeats"))
    uses = uses.withColumn("uses", times.cast("int")).where("uses > 0").select("doc_id", "source", "n_tokens", "uses")
    got = uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    alone = Window.partitionBy(F.lit(0))
    report = budget.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    actual = F.coalesce(F.try_divide("tokens", F.sum("tokens").over(alone)), F.lit(0.0))
    return uses, report.select("source", "target_share", actual.alias("actual_share"), "size", "budget", "tokens", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats")
