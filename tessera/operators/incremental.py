"""Snapshots, upserts, deletions: all by key, rewritten as anti-join and union."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, status (new, changed, deleted): one full outer join."""
    a, b = old.select(key, F.col(value).alias("_a"), F.lit(1).alias("_o")), new.select(key, F.col(value).alias("_b"), F.lit(1).alias("_n"))
    d = a.join(b, key, "full")
    status = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "deleted").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return d.select(key, status.alias("status")).where("status is not null")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def replace_by(old: DataFrame, new: DataFrame, owner: str, owners: DataFrame | None = None) -> DataFrame:
    """Rows of the owners processed are replaced, also where an owner has no new rows."""
    return old.join((owners if owners is not None else new).select(owner).distinct(), owner, "left_anti").unionByName(new)


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def last_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The n last rows by the given columns: top-k in each task, no full sort."""
    return df.orderBy(*(F.desc(c) for c in order)).limit(n)
