"""One ranking from several differently scaled scores: Borda count over average ranks.

Each score gives its candidates competition ranks within their query (ties share the mean of their
places); a candidate's points for a score are (n + 1) / 2 - rank, weighted: zero at mid-rank, which is
also what a missing score gets, so that it counts neither for nor against. The points are summed and
sorted, the identifier settling ties.

Ranks come from counted values, range-partitioned, so that a query with a third of all rows is no
single task; see tessera.operators.ranking.

Defined cases: null and NaN scores are missing; repeated (query, candidate) rows count once, with the
greatest value of each score; rows with a null query or candidate are ignored; a query whose scores
are all missing is ordered by identifier; an empty table gives an empty result; other columns are
dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import value_positions

SCORES = {"base_score": 1.0, "score": 1.0, "reranker_score": 1.0}


def borda_points(rows: DataFrame, query: str, item: str, weights: dict[str, float] | None = None) -> DataFrame:
    """(query, item, points), one row per candidate."""
    weights = SCORES if weights is None else weights
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    # -0.0 and 0.0 are one value
    once = rows.where(F.col(query).isNotNull() & F.col(item).isNotNull()).groupBy(query, item).agg(*[(F.max(number(c)) + F.lit(0.0)).alias(c) for c in weights])
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.lit(float(w)).alias("weight"), F.col(c).alias("value")) for c, w in weights.items()])
    long = once.select(query, item, F.explode(pairs).alias("_p")).select(query, item, "_p.*")
    given = long.where("value IS NOT NULL")
    values = given.groupBy(query, "kind", "value").agg(F.count("*").alias("n"))
    placed = value_positions(values, [query, "kind"], [F.col("value").desc()])
    size = given.groupBy(query, "kind").agg(F.count("*").alias("size"))
    places = placed.join(size, [query, "kind"]).select(query, "kind", "value", ((F.col("size") - F.col("n")) / 2 - F.col("before")).alias("points"))
    scored = long.join(places, [query, "kind", "value"], "left")
    return scored.groupBy(query, item).agg(F.round(F.sum(F.coalesce(F.col("points") * F.col("weight"), F.lit(0.0))), 6).alias("points"))


def borda_top(points: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """The k leading candidates of each query; each task passes on at most k rows of a query."""
    order = Window.partitionBy(query).orderBy(F.col("points").desc(), F.col(item))
    return points.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def borda_ranking(points: DataFrame, query: str, item: str) -> DataFrame:
    """Every candidate with its place in its query, from 1."""
    placed = value_positions(points.withColumn("n", F.lit(1).cast("bigint")), [query], [F.col("points").desc(), F.col(item)])
    return placed.select(query, item, "points", (F.col("before") + 1).cast("bigint").alias("place"))
