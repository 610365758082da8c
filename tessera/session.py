"""Session defaults and the few helpers that every operator shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\r\n\f\v"
DAY = "INTERVAL '1' DAY"


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session, wherever the driver imported it from."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    package = Path(__file__).parent
    archive = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera-package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    context.addPyFile(archive)
    context._tessera_shipped = True


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the cluster's shared folder (spark.checkpoint.dir, else the checkpoint folder
    already set). Where neither is named a local session takes a temporary one; a cluster raises, for its executors share no disk.
    The folder goes with the application."""
    context = spark.sparkContext
    if not hasattr(context, "_tessera_dir"):
        current = context._jsc.sc().getCheckpointDir()
        named = spark.conf.get("spark.checkpoint.dir", None) or (current.get() if current.isDefined() else None)
        if not named:
            if not context.master.startswith("local"):
                raise RuntimeError("name a folder all executors share in spark.checkpoint.dir")
            named = f"{tempfile.gettempdir()}/tessera-{os.getuid()}/checkpoints"
        if current.isEmpty():
            context.setCheckpointDir(named)
        context._tessera_dir = f"{named.rstrip('/')}/tessera-{context.applicationId}"
        folder = context._jvm.org.apache.hadoop.fs.Path(context._tessera_dir)
        files = folder.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    return context._tessera_dir


def release(spark: SparkSession) -> None:
    """Deletes everything ``cut`` has written in this application; results not yet read are lost with it."""
    context = spark.sparkContext
    if hasattr(context, "_tessera_dir"):
        folder = context._jvm.org.apache.hadoop.fs.Path(context._tessera_dir)
        files = folder.getFileSystem(context._jsc.hadoopConfiguration())
        files.delete(folder, True)
        context.__dict__.pop("_tessera_indexes", None)
        files.mkdirs(folder)


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Write df to the shared folder and read it back: later plans start from files that
    outlive any executor. by: columns whose values get folders of their own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files ``cut`` wrote for these tables, which nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)


def clean_key(column: str | Column) -> Column:
    """Lower case, no surrounding white space; an empty key is null."""
    text = F.lower(F.btrim(F.col(column) if isinstance(column, str) else column, F.lit(BLANKS)))
    return F.when(text != "", text)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has at most so many rows (counted), else left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
