"""Usage accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values: (model prefix, price of 1000 tokens), in declaration order.
PRICES = [("model1", 0.03), ("model", 0.01)]


def by_provider(calls: DataFrame) -> DataFrame:
    """provider, requests, tokens, cost, avg_all (the mean over all providers), avg_own."""
    g = calls.groupBy("provider").agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("c"), F.avg("cost").alias("a"))
    w = Window.partitionBy()  # a row a provider
    return g.select("provider", "requests", "tokens", F.round("c", 4).alias("cost"), F.round(F.sum("c").over(w) / F.sum("requests").over(w), 4).alias("avg_all"), F.round("a", 4).alias("avg_own"))


def price(model: Column, prices: Sequence[tuple[str, float]] = PRICES) -> Column:
    """The first price whose key the model contains; longest keys first."""
    out = None
    for key, p in sorted(prices, key=lambda x: -len(x[0])):
        out = F.when(model.contains(key), p) if out is None else out.when(model.contains(key), p)
    return out.otherwise(0.0)
