"""What changed between consecutive full snapshots, as one signed aggregation.

Every record of a snapshot becomes cells (key, field, value): +1 in its own snapshot and -1 in the
next one that is present, beside a presence cell without a value. Cells that sum to zero didn't
change; the others classify the key and name its changed fields. Both signs of a key share its hash
partition, so one exchange on the key serves repeated deliveries, cells and classes alike.

Defined cases: of repeated deliveries the latest counts (ties: the greatest values); rows without
a key or snapshot number are ignored; a null value is no value, so null against anything is no
change; the first snapshot of a series has no rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Series index rows up to which the index of snapshots is broadcast; beyond it, it is joined by shuffle.
INDEX_BROADCAST_ROWS = 500_000


def latest(rows: DataFrame, key: list[str], version: str, values: list[str]) -> DataFrame:
    """One row per key: that of the greatest version, then of the greatest values."""
    pick = F.max(F.struct(F.col(version), *[F.col(v) for v in values])).alias("_row")
    return rows.groupBy(*key).agg(pick).select(*key, *[F.col(f"_row.{v}").alias(v) for v in values])


def next_snapshots(rows: DataFrame, series: list[str], number: str) -> DataFrame:
    """(series, number, following, opens): each snapshot, the next higher one present (null at the
    end), and whether it is the first of its series."""
    order = Window.partitionBy(*series).orderBy(number)
    index = rows.select(*series, number).distinct().withColumn("following", F.lead(number).over(order)).withColumn("opens", F.row_number().over(order) == 1)
    return F.broadcast(index) if index.count() <= INDEX_BROADCAST_ROWS else index


def snapshot_changes(rows: DataFrame, series: list[str], number: str, key: str, fields: list[str], index: DataFrame) -> DataFrame:
    """(series, number, key, change_kind, changed_fields) of every added, removed or changed key.

    rows must hold one row per series, number and key."""
    signed = rows.select(*series, number, key, *fields).join(index, [*series, number], "inner")
    here = F.when(~F.col("opens"), F.struct(F.lit(1).alias("sign"), F.col(number).alias("at")))
    then = F.when(F.col("following").isNotNull(), F.struct(F.lit(-1).alias("sign"), F.col("following").alias("at")))
    cells = [F.struct(F.lit("").alias("field"), F.lit("").alias("value"))]
    cells += [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    signed = signed.select(*series, key, F.array(*cells).alias("_cells"), F.explode(F.array_compact(F.array(here, then))).alias("_s"))
    signed = signed.select(*series, F.col("_s.at").alias(number), key, F.col("_s.sign").alias("_sign"), F.explode("_cells").alias("_c"))
    signed = signed.select(*series, number, key, "_sign", F.col("_c.field").alias("_field"), F.col("_c.value").alias("_value")).where("_value IS NOT NULL")
    group = [*series, number, key]
    sums = signed.groupBy(*group, "_field", "_value").agg(F.sum("_sign").alias("_sum")).where("_sum <> 0")
    by_field = sums.groupBy(*group, "_field").agg(F.max("_sum").alias("_new"), F.min("_sum").alias("_old"))
    both = (F.col("_field") != "") & (F.col("_new") > 0) & (F.col("_old") < 0)
    presence = F.max(F.when(F.col("_field") == "", F.col("_new")))
    keyed = by_field.groupBy(*group).agg(presence.alias("_presence"), F.sort_array(F.collect_list(F.when(both, F.col("_field")))).alias("changed_fields"))
    kind = F.when(F.col("_presence") > 0, "added").when(F.col("_presence") < 0, "removed").when(F.size("changed_fields") > 0, "changed")
    return keyed.withColumn("change_kind", kind).where("change_kind IS NOT NULL").drop("_presence")


def tree_nodes(nodes: DataFrame) -> DataFrame:
    """Tree deliveries with paths and hashes in one spelling: forward slashes, no leading ./ or /,
    no doubled or closing slash, hashes in lower case."""
    path = F.regexp_replace(F.btrim(F.col("path"), F.lit(" \t\r\n")), r"\\", "/")
    path = F.regexp_replace(F.regexp_replace(path, r"/(\./)*/*", "/"), r"^(\./|/)+", "")
    path = F.regexp_replace(path, r"/$", "")
    digest = F.lower(F.btrim(F.col("hash"), F.lit(" \t\r\n")))
    return nodes.select("repo", "branch", "snapshot_no", path.alias("path"), F.when(digest != "", digest).alias("hash"), "kind", "delivered_at").where("path IS NOT NULL AND path <> '' AND snapshot_no IS NOT NULL")


def tree_changes(nodes: DataFrame) -> DataFrame:
    """Files added, removed or changed in each snapshot of a repository branch."""
    rows = tree_nodes(nodes)
    series = ["repo", "branch"]
    index = next_snapshots(nodes.where("snapshot_no IS NOT NULL"), series, "snapshot_no")
    parted = rows.repartition("repo", "branch", "path")
    files = latest(parted, [*series, "snapshot_no", "path"], "delivered_at", ["kind", "hash"]).where("kind = 'file'")
    return snapshot_changes(files, series, "snapshot_no", "path", ["hash"], index)
