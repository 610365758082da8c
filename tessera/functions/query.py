"""Understanding of a query text: task, intent and the search recipe that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import intent

# Weights and limits of the search recipes by task.
RECIPES = [
    # task, bm25, dense, second dense, rerank pool, graph depth
    ("general", 0.2, 0.6, 0.2, 10, 0),
    ("definition", 0.5, 0.2, 0.3, 20, 1),
    ("bug", 0.4, 0.2, 0.4, 20, 1),
    ("test_debug", 0.4, 0.2, 0.4, 20, 1),
    ("semantic", 0.1, 0.7, 0.2, 0, 0),
]


def task_type(query: Column) -> Column:
    """See tessera.functions.intent."""
    return intent.task_type(query)


def relation(query: Column) -> Column:
    return intent.relation(query)


def recipes(spark: SparkSession) -> DataFrame:
    """Five rows."""
    return spark.createDataFrame(RECIPES, "task string, w_bm25 double, w_dense double, w_second double, pool int, graph_depth int")


def with_recipe(queries: DataFrame, text: str) -> DataFrame:
    return queries.withColumn("task", task_type(F.col(text))).join(F.broadcast(recipes(queries.sparkSession)), "task")
