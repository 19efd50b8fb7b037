"""Aggregates that are maintained: a change costs what it changes, not what the table holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Conflict, Store

#: Batches after which the log of deltas is summed up.
FOLD = 16
LONG = "long"
CELL = ("kind", "key", "measure", "value")


class Rollup:
    """Counts, sums, minima, maxima, numbers of different values and histograms of a table of facts, for the whole and by each of
    some columns, kept up to date by signed deltas.

    Two tables of a store: the facts by owner, and cells: (kind, key, measure, value) with a count and sums. A fact adds one to
    its group's cell without a measure, and for each counted column one to the cell of its value. A batch subtracts the cells
    of the old facts of its owners and adds those of the new ones, summed before they are shuffled; cells at zero go. Minima
    and maxima are the least and largest value with a count, so that a deletion uncovers the next one. Only buckets of owners in
    the batch are read.

    A batch has a number, larger than that of the one before. Its deltas are one commit, then its facts another: a batch that
    is run again adds no deltas that are there, and puts the same facts again, so that each batch counts once wherever it was
    cut off. It must give the same rows each time, and one writer at a time applies batches. Sums are of whole numbers, so
    that they don't drift; nulls add nothing to sums and have no value to count. A null in a grouping column is a group.
    """

    def __init__(self, store: Store, name: str, owner: str, by: Sequence[str] = (), sums: Sequence[str] = (), counted: Sequence[str] = ()):
        self.store, self.owner, self.by, self.sums, self.counted = store, owner, tuple(by), tuple(sums), tuple(counted)
        self.facts, self.cells = f"{name}_facts", f"{name}_cells"
        self.columns = list(dict.fromkeys([owner, *by, *sums, *counted]))

    # --- changes

    def apply(self, rows: DataFrame, batch: int, owners: DataFrame | None = None) -> None:
        """Put rows in the place of the facts of their owners, or of those in `owners` (an owner without rows has none then)."""
        rows, touched = rows.select(*self.columns), (rows if owners is None else owners).select(self.owner)
        if batch > self.last_batch():
            delta = self._signed(rows, 1)
            if self.store.exists(self.facts):
                delta = delta.unionByName(self._signed(self.store.lookup(self.facts, touched), -1))
            self.store.add(self.cells, self._summed(delta).withColumn("batch", F.lit(batch).cast(LONG)), "key")
        self.store.replace_files(self.facts, rows, self.owner, touched)
        if batch % FOLD == 0:
            self.fold()

    def delete(self, owners: DataFrame, batch: int) -> None:
        """Take out all facts of some owners."""
        self.apply(self.store.load(self.facts).limit(0), batch, owners)

    def last_batch(self) -> int:
        """The number of the last batch whose deltas are in; -1 before the first."""
        if not self.store.exists(self.cells):
            return -1
        last = self.store.load(self.cells).agg(F.max("batch")).first()[0]
        return -1 if last is None else last

    def fold(self) -> None:
        """Sum up the deltas of all batches so far; a commit of another writer meanwhile leaves them as they are."""
        n, last = self.store.version(self.cells), self.last_batch()
        whole = self._summed(self.store.load(self.cells).drop("batch")).withColumn("batch", F.lit(last).cast(LONG))
        try:
            self.store.save(self.cells, whole, "key", expect=n)
        except Conflict:
            return

    def _signed(self, rows: DataFrame, sign: int) -> DataFrame:
        """The cells of each fact, with a sign."""
        no = F.lit(None).cast("string")
        groups = F.array(F.struct(F.lit("all").alias("kind"), no.alias("key")), *(F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("key")) for c in self.by))
        measures = F.array(F.struct(no.alias("measure"), F.lit(None).cast(LONG).alias("value")), *(F.struct(F.lit(c).alias("measure"), F.col(c).cast(LONG).alias("value")) for c in self.counted))
        g = rows.select(F.explode(groups).alias("g"), measures.alias("ms"), *self.sums)
        m = g.select("g.*", F.explode("ms").alias("m"), *self.sums).where("m.measure is null or m.value is not null")
        total = lambda c: F.when(F.col("m.measure").isNull(), F.coalesce(F.col(c).cast(LONG), F.lit(0))).otherwise(0)
        return m.select("kind", "key", "m.measure", "m.value", F.lit(sign).cast(LONG).alias("n"), *((total(c) * sign).cast(LONG).alias(f"sum_{c}") for c in self.sums))

    def _summed(self, cells: DataFrame) -> DataFrame:
        names = ["n", *(f"sum_{c}" for c in self.sums)]
        some = F.lit(False)
        for c in names:
            some = some | (F.col(c) != 0)
        return cells.groupBy(*CELL).agg(*(F.sum(c).alias(c) for c in names)).where(some)

    # --- results

    def read(self) -> DataFrame:
        """kind (all, or a column), key, n, sum_*, and for each counted column min_*, max_*, different_*."""
        cells = self._summed(self.store.load(self.cells))
        whole = F.col("measure").isNull()
        of = lambda c, x: F.when(F.col("measure") == c, x)
        out: list[Column] = [F.sum(F.when(whole, F.col("n"))).alias("n"), *(F.sum(F.when(whole, F.col(f"sum_{c}"))).alias(f"sum_{c}") for c in self.sums)]
        for c in self.counted:
            out += [F.min(of(c, F.col("value"))).alias(f"min_{c}"), F.max(of(c, F.col("value"))).alias(f"max_{c}"), F.count(of(c, F.col("value"))).alias(f"different_{c}")]
        return cells.groupBy("kind", "key").agg(*out).where("n > 0")

    def values(self, column: str) -> DataFrame:
        """kind, key, value, n: how often each group has each value of a counted column."""
        cells = self._summed(self.store.load(self.cells))
        return cells.where(F.col("measure") == column).select("kind", "key", "value", "n")
