"""Score arithmetic of the search pipeline as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import identifiers

# Penalties of the ranking.
TEST_FACTOR, COARSE_FACTOR = 0.05, 0.75


def sigmoid(logit: Column) -> Column:
    """The logistic of a score; infinities give 1 and 0."""
    return F.when(logit >= 0, 1 / (1 + F.exp(-logit))).otherwise(F.exp(logit) / (1 + F.exp(logit)))


def fusion_weights(bm25: Column, dense: Column, hybrid: float) -> tuple[Column, Column]:
    """Weights at least 0 that sum to 1; the hybrid weight where both are 0."""
    b, d = F.greatest(bm25, F.lit(0.0)), F.greatest(dense, F.lit(0.0))
    total = b + d
    return F.when(total > 0, b / total).otherwise(hybrid), F.when(total > 0, d / total).otherwise(1 - hybrid)


def type_boost(kind: Column) -> Column:
    return identifiers.type_boost(kind)


def task_factor(task: Column, is_test: Column, coarse: Column) -> Column:
    """Multiplier after reranking: tests and documents hardly count for a bug, whole files less for test debugging."""
    return F.when((task == "bug") & is_test, TEST_FACTOR).when((task == "test_debug") & coarse, COARSE_FACTOR).otherwise(1.0)


def token_budget(limit: int, share: float = 0.2, least: int = 256) -> int:
    """Tokens of a batch once a reserve is kept."""
    return max(1, limit - max(least, -int(-limit * share // 1)))


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Closed line ranges that share a line."""
    return (start_a <= end_b) & (end_a >= start_b)


def path_fits(actual: Column, expected: Column) -> Column:
    """Equal, or one the end of the other from a slash on."""
    return (actual == expected) | actual.endswith(F.concat(F.lit("/"), expected)) | expected.endswith(F.concat(F.lit("/"), actual))


def node_size(degree: Column, most: Column) -> Column:
    return F.when(most > 0, F.ln(degree + 1) / F.ln(most + 1)).otherwise(0.0)


def coupling(calls: Column, most: Column, source_dir: Column, target_dir: Column) -> Column:
    """Class of an edge between files: hot from 65 percent of the most calls on, then by directories."""
    top = lambda d: F.split(d, "/")[0]
    return F.when(calls >= most * 0.65, "hot").when(source_dir == target_dir, "same-directory").when(top(source_dir) != top(target_dir), "cross-top-level").otherwise("other")
