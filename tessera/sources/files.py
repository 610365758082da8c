"""Sources and sinks: repository scans, snapshot stores, evaluation sets and configuration."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.content import repository_path
from tessera.functions.text import glob_regex, language_of

# Files whose presence marks a project's root.
MARKERS = (".git", "package.json", "Cargo.toml", "go.mod", "pyproject.toml", "setup.py", "requirements.txt", "Gemfile", "composer.json", "pom.xml", "build.gradle", "CMakeLists.txt", "Makefile", ".opencode")
GOLDEN = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("queries", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("query", T.StringType()), T.StructField("queryType", T.StringType()), T.StructField("expected", T.StructType([T.StructField("filePath", T.StringType()), T.StructField("acceptableFiles", T.ArrayType(T.StringType())), T.StructField("symbol", T.StringType()), T.StructField("startLine", T.IntegerType()), T.StructField("endLine", T.IntegerType())]))]))),
    ]
)


def matches(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern fits: ``dir/`` is that directory from the root and all in it, others are globs."""
    out = F.lit(False)
    for p in patterns:
        out = out | ((path == p[:-1]) | path.startswith(p) if p.endswith("/") else path.rlike(glob_regex(p)))
    return out


def scan(spark: SparkSession, root: str, include: list[str], exclude: list[str], ignore: list[str], max_bytes: int) -> DataFrame:
    """Files under root with the reason why each is left out (null: kept): ignored, excluded, too-large or not-included, in
    that order. Contents are read for kept files only, as the plan's columns demand."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^" + re.escape("file:" + os.path.abspath(root)) + "/?", "")
    reason = F.when(matches(path, ignore), "ignored").when(matches(path, exclude), "excluded").when(F.col("length") > max_bytes, "too-large").when(~matches(path, include), "not-included")
    return files.select(path.alias("file_path"), language_of(path).alias("language"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), reason.alias("reason"), F.md5("content").alias("hash"), F.col("content").cast("string").alias("content"))


def has_marker(root: str) -> bool:
    return any(os.path.exists(os.path.join(root, m)) for m in MARKERS)


def save_snapshot(nodes: DataFrame, path: str) -> None:
    """Replaces the branches that nodes holds and no others."""
    nodes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("branch").parquet(path)


def load_snapshot(spark: SparkSession, path: str, branch: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("branch") == branch)


def _drop(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def delete_snapshot(spark: SparkSession, path: str, branch: str) -> None:
    _drop(spark, f"{path}/branch={branch}")


def clear_snapshots(spark: SparkSession, path: str) -> None:
    _drop(spark, path)


def scan_path(spark: SparkSession, root: str, changed: str, include: list[str], exclude: list[str], ignore: list[str], max_bytes: int) -> DataFrame:
    """The scan of one path: a row if it is there and kept, else none."""
    rows = scan(spark, root, include, exclude, ignore, max_bytes)
    wanted = spark.range(1).select(repository_path(F.lit(changed), os.path.abspath(root)).alias("p")).first()["p"]
    return rows.where((F.col("file_path") == wanted) & F.col("reason").isNull()) if wanted else rows.limit(0)


# Thresholds of an evaluation budget, and the other name two of them may have.
THRESHOLDS = ("hitAt1MaxDrop", "hitAt5MaxDrop", "mrrAt10MaxDrop", "combinedRecallAt10MaxDrop", "expansionHitRateMaxDrop", "p95LatencyMaxMultiplier", "p95LatencyMaxAbsoluteMs", "minHitAt1", "minHitAt5", "minMrrAt10")
OTHER_NAMES = {"combinedRecallAt10MaxDrop": "combinedRecallAt10", "expansionHitRateMaxDrop": "expansionHitRate"}


def load_budget(path: str) -> dict[str, float]:
    """The thresholds a budget file gives; one that isn't a number of at least 0 raises with its place."""
    with open(path) as f:
        given = json.load(f).get("thresholds", {})
    out = {}
    for name in THRESHOLDS:
        value = given.get(name, given.get(OTHER_NAMES.get(name, "")))
        if value is not None:
            if isinstance(value, bool) or not isinstance(value, (int, float)) or value < 0:
                raise ValueError(f"{path}: thresholds.{name} is not a number of at least 0")
            out[name] = float(value)
    return out


def migrated(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Older tables under a newer schema: missing columns are null, others are cast."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def golden_queries(spark: SparkSession, path: str) -> DataFrame:
    """The queries of an evaluation file; raises on malformed files and repeated ids."""
    df = spark.read.schema(GOLDEN).option("multiLine", True).option("mode", "FAILFAST").json(path)
    out = df.select(F.explode("queries").alias("q")).select("q.*")
    double = out.groupBy("id").count().where("count > 1 OR id IS NULL").limit(1).collect()
    if double:
        raise ValueError(f"repeated or missing query id: {double[0]['id']}")
    return out


def substituted(value: object, env: dict[str, str] | None = None, key: str = "$root") -> object:
    """Strings that are {env:NAME} or $NAME as a whole, replaced; an unset name, or such a reference inside a longer
    string, raises with its place."""
    env = dict(os.environ) if env is None else env
    if isinstance(value, dict):
        return {k: substituted(v, env, f"{key}.{k}") for k, v in value.items()}
    if isinstance(value, list):
        return [substituted(v, env, f"{key}[{i}]") for i, v in enumerate(value)]
    if isinstance(value, str):
        m = re.fullmatch(r"\{env:([A-Z_][A-Z0-9_]*)\}|\$([A-Z_][A-Z0-9_]*)", value)
        if m:
            name = m[1] or m[2]
            if name not in env:
                raise KeyError(f"{key}: environment variable {name} is not set")
            return env[name]
        if re.search(r"\{env:[^}]+\}", value):
            raise ValueError(f"{key}: a reference to an environment variable must be the whole string")
    return value


@dataclass
class Config:
    """Search and index settings, clamped to sensible ranges."""

    include: list[str] = field(default_factory=lambda: ["**/*"])
    exclude: list[str] = field(default_factory=list)
    max_file_bytes: int = 1_048_576
    max_results: int = 20
    min_score: float = 0.1
    hybrid_weight: float = 0.5
    rrf_k: int = 60
    chunks_per_file: int = 100

    def __post_init__(self) -> None:
        self.min_score = min(1.0, max(0.0, float(self.min_score)))
        self.hybrid_weight = min(1.0, max(0.0, float(self.hybrid_weight)))
        self.max_results = max(1, int(self.max_results))
        self.rrf_k = max(1, int(self.rrf_k))

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path) as f:
            raw = substituted(json.load(f))
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in raw.items() if k in known})
