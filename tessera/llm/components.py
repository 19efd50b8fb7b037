"""Connected components of a link table, by alternating neighbour and label steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rows of two numbers that one file of a step holds at least, so that a small table of links is not dealt to all tasks.
ROWS = 100_000


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long) -> (id, component): the smallest id reachable, for every id that has a link.

    Large-star and small-star steps in turn (Kiveris and others, 2014) until nothing changes. Each step is a grouped
    minimum, combined before the shuffle, and a join with one row a group, whose skewed side can be split; the star of a
    hot id is never gathered in one place. Every step is written to the shared folder, one number comes to the driver.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before, n = None, edges.count()
    while True:
        step = lambda df, name, parts=max(1, -(-2 * n // ROWS)): materialize(df.coalesce(parts), name)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
        large = both.where("b > a").join(low, both["a"] == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = step(large.where("a <> b").distinct(), "large")
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(low, large["a"] == F.col("u"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = step(small.where("a <> b").distinct(), "links")
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        before, n = state, state.n
