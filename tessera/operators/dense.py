"""Exact nearest neighbours by squared distance, and the pluggable embedder."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EMBEDDERS: dict[str, Callable[[list[str]], list]] = {}


def distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


#: Queries that are sent out at a time, and numbers that one step of a comparison holds.
BLOCK, STEP = 10_000, 4_000_000


def knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", where: Column | None = None, skip_self: bool = True) -> DataFrame:
    """query_id, id, distance, rank: the exact k nearest of all rows for each query; ties go to the smaller id. queries: query_id, q.

    A stated set of queries against all rows, in blocks of BLOCK. Each task keeps its k best a query, so that a query's
    shuffle is k rows a task, however many rows there are.
    """
    v = (vectors if where is None else vectors.where(where)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("v is not null")
    out, held = None, []

    def add(block: list) -> DataFrame:
        ids, q = np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], np.float64)
        sent = vectors.sparkSession.sparkContext.broadcast((ids, q))
        return v.mapInArrow(lambda batches: nearest(batches, *sent.value, k, skip_self), "query_id long, id long, distance double")

    for row in queries.select("query_id", F.col("q").cast("array<double>")).where("q is not null").toLocalIterator():
        held.append(row)
        if len(held) == BLOCK:
            out, held = add(held) if out is None else out.unionByName(add(held)), []
    if held:
        out = add(held) if out is None else out.unionByName(add(held))
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id long, id long, distance double")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")).cast("long"))
    return out.where(F.col("rank") <= k)


def nearest(batches: Iterator[pa.RecordBatch], query_ids: np.ndarray, q: np.ndarray, k: int, skip_self: bool) -> Iterator[pa.RecordBatch]:
    """The k best rows of a task for each query."""
    best_d, best_i = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, v = np.asarray(batch.column(0)), np.stack(batch.column(1).to_numpy(zero_copy_only=False))
        step = max(1, STEP // max(1, q.size))
        for a in range(0, len(ids), step):
            d = np.round(((q[:, None, :] - v[None, a : a + step]) ** 2).sum(axis=2), 6)
            if skip_self:
                d[query_ids[:, None] == ids[None, a : a + step]] = np.inf
            d = np.concatenate([best_d, d], axis=1)
            i = np.concatenate([best_i, np.broadcast_to(ids[a : a + step], (len(q), len(ids[a : a + step])))], axis=1)
            order = np.lexsort((i, d), axis=1)[:, :k]
            best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
    ok = np.isfinite(best_d)
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, k).reshape(-1, k)[ok]), pa.array(best_i[ok]), pa.array(best_d[ok])], ["query_id", "id", "distance"])


#: Vectors that the centres of cells are fitted to (those with the smallest hashes of their ids), steps of the fit, most cells,
#: and what one task holds of a cell and of its queries.
SAMPLE, FITS, CELLS, HELD = 10_000, 8, 1024, 20_000
#: Distances are rounded to six places; bounds give way by more than rounding and the order of summation can make.
SLACK = 1e-5


def fitted(sample: np.ndarray, k: int) -> np.ndarray:
    """k centres of a sample by Lloyd's algorithm, from its k first vectors."""
    centres = sample[:k].copy()
    for _ in range(FITS):
        near = squares(sample, centres).argmin(1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all of a to all of b, to some twelve places."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def rows_matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, size)


class Cells:
    """Vectors dealt to the cells of some centres, as tables below a folder; nearest neighbours that read few cells.

    A row keeps its distance to its centre. For a query at distance d from a centre no row of the cell at distance r is nearer
    than |d - r| (triangle inequality). The cells that are nearest to a query and hold enough rows give a k-th distance; then
    only cells, and in them only rows, whose bound does not pass it are compared. Results are exact. With `probes`, only so many
    nearest cells are looked at: fewer rows, and a recall below one.

    Cells are cut into slices, and queries into blocks, of about HELD, so that neither a full cell nor one that all queries
    look at meets in one task.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", keep: tuple[str, ...] = (), cells: int | None = None) -> Cells:
        """Index all vectors of finite components that have the length of the sample's first; others can't be compared with them.
        keep: further columns, for filters."""
        v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), *keep)
        v = v.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
        sample = [r.v for r in v.orderBy(F.xxhash64("id"), "id").select("v").limit(SAMPLE).collect()]  # bounded by SAMPLE
        size = len(sample[0]) if sample else 0
        v = v.where(F.size("v") == size)
        n = v.count()
        k = max(1, min(CELLS, cells or int(n**0.5), len(sample)))
        centres = fitted(np.array([x for x in sample if len(x) == size], np.float64).reshape(-1, size), k) if n else np.zeros((0, 0))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in v.schema.fields)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    d = squares(rows_matrix(b.column(1), size), centres)
                    cell = d.argmin(1)
                    r = np.sqrt(d[np.arange(len(cell)), cell])
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r), pa.array(cell, pa.int32())], [*b.schema.names, "r", "cell"])

        dealt = v.mapInArrow(deal, f"{schema}, r double, cell int")
        dealt.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.root}/rows")
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
        self.spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/centres")
        self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.root}/empty")
        return self

    def _rows(self, where: Column | str | None) -> DataFrame:
        fields = self.spark.read.parquet(f"{self.root}/empty").schema
        d = self.spark.read.schema(fields.add("r", "double").add("cell", "integer")).parquet(f"{self.root}/rows")
        return d if where is None else d.where(where)

    def knn(self, queries: DataFrame, k: int, where: Column | str | None = None, skip_self: bool = True, probes: int | None = None) -> DataFrame:
        """query_id, id, distance, rank of the k nearest rows of each query (query_id, q) that `where` keeps; ties go to the
        smaller id."""
        pairs = self._pairs(queries, k, where, skip_self, probes)
        out = self._compared(pairs, k, where, skip_self)
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")).cast("long"))
        return out.where(F.col("rank") <= k)

    def visits(self, queries: DataFrame, k: int, where: Column | str | None = None, skip_self: bool = True) -> DataFrame:
        """query_id, cells, rows: what an exact search looks at for each query."""
        n = self._rows(where).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        return self._pairs(queries, k, where, skip_self, None).join(F.broadcast(n), "cell").groupBy("query_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("rows"))  # at most CELLS rows

    def _pairs(self, queries: DataFrame, k: int, where: Column | str | None, skip_self: bool, probes: int | None) -> DataFrame:
        """query_id, q, cell, d (to the centre), reach: the cells that each query has to look at."""
        centres = {r.cell: r.centre for r in self.spark.read.parquet(f"{self.root}/centres").collect()}  # at most CELLS rows
        full = self._rows(where).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("least"), F.max("r").alias("most")).orderBy("cell").collect()
        q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q"), F.lit(float("inf")).alias("reach"))
        size = len(centres[0]) if centres and centres[0] else 0
        q = q.where(F.col("q").isNotNull() & (F.size("q") == size) & (F.size("q") > 0))
        if not full:
            return q.select("query_id", "q", F.lit(0).alias("cell"), F.lit(0.0).alias("d"), "reach").limit(0)
        cell = np.array([r["cell"] for r in full], np.int32)
        c = np.array([centres[r["cell"]] for r in full])
        n, least, most = (np.array([r[x] for r in full]) for x in ("n", "least", "most"))
        enough = k + int(skip_self)

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                d, reach = np.sqrt(squares(rows_matrix(b.column(1), size), c)), np.asarray(b.column(2))
                order = np.argsort(d, axis=1, kind="stable")
                first = np.zeros(d.shape, bool)
                before = np.cumsum(n[order], axis=1) - n[order]
                take = before < enough if probes is None else np.broadcast_to(np.arange(d.shape[1]) < probes, d.shape)
                np.put_along_axis(first, order, take, 1)
                bound = np.maximum(0, np.maximum(d - most, least - d))
                i, j = np.nonzero(np.where(np.isinf(reach)[:, None], first, bound <= reach[:, None] + SLACK))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), b.column(1).take(pa.array(i)), pa.array(cell[j]), pa.array(d[i, j]), pa.array(reach[i])], ["query_id", "q", "cell", "d", "reach"])

        chosen = q.mapInArrow(choose, "query_id long, q array<double>, cell int, d double, reach double")
        if probes is not None:
            return chosen
        best = self._compared(chosen, k, where, skip_self)
        w = Window.partitionBy("query_id").orderBy("distance", "id")
        best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).where(F.col("rank") == k).select("query_id", F.sqrt("distance").alias("reach"))
        path = f"{self.root}/searches/{uuid.uuid4().hex}"
        best.write.parquet(path)
        best = self.spark.read.schema("query_id long, reach double").parquet(path)
        # without k rows in the nearest cells (there are not so many rows, then) all cells are looked at
        return q.drop("reach").join(best, "query_id", "left").select("query_id", "q", F.coalesce("reach", F.lit(1e300)).alias("reach")).mapInArrow(choose, chosen.schema)

    def _compared(self, pairs: DataFrame, k: int, where: Column | str | None, skip_self: bool) -> DataFrame:
        """query_id, id, distance: the k best rows of each slice of a cell for each query that looks at it."""
        rows = self._rows(where).select("cell", "id", "v", "r")
        slices = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / HELD).cast("int").alias("slices"))  # at most CELLS rows
        blocks = max(1, -(-pairs.select("query_id").distinct().count() // HELD))
        q = pairs.join(F.broadcast(slices), "cell").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        v = rows.join(F.broadcast(slices), "cell").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
        v = v.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        key = ["cell", "slice", "block"]

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            return within(left, right, k, skip_self)

        q, v = q.select(*key, "query_id", "q", "d", "reach"), v.select(*key, "id", "v", "r")
        return q.groupBy(*key).cogroup(v.groupBy(*key)).applyInArrow(compare, "query_id long, id long, distance double")


def within(queries: pa.Table, rows: pa.Table, k: int, skip_self: bool) -> pa.Table:
    """The k best rows of a slice for each query that looks at it, of those that the triangle inequality leaves."""
    out: list[list] = [[], [], []]
    if queries.num_rows and rows.num_rows:
        q_ids, ids = queries.column("query_id").to_numpy(), rows.column("id").to_numpy()
        size = len(queries.column("q")[0])
        q, v = (np.asarray(t.column(c).combine_chunks().flatten(), np.float64).reshape(-1, size) for t, c in ((queries, "q"), (rows, "v")))
        d, reach, r = queries.column("d").to_numpy(), queries.column("reach").to_numpy(), rows.column("r").to_numpy()
        step = max(1, STEP // max(1, v.size))
        for a in range(0, len(q), step):
            rough = squares(q[a : a + step], v)
            for i in range(len(rough)):
                ok = np.abs(d[a + i] - r) <= reach[a + i] + SLACK
                if skip_self:
                    ok &= ids != q_ids[a + i]
                at = np.flatnonzero(ok)
                if len(at) > k:
                    cut = np.partition(rough[i, at], k - 1)[k - 1] + SLACK
                    at = at[rough[i, at] <= cut]
                exact = np.round(((q[a + i] - v[at]) ** 2).sum(1), 6)
                best = np.lexsort((ids[at], exact))[:k]
                out[0].append(np.full(len(best), q_ids[a + i]))
                out[1].append(ids[at][best])
                out[2].append(exact[best])
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return pa.table({"query_id": cat(out[0], np.int64), "id": cat(out[1], np.int64), "distance": cat(out[2], np.float64)})


def hash_embedding(texts: list[str], size: int = 8) -> list[list[float]]:
    """Deterministic vectors of texts: bytes of SHA-256 on [-1, 1]."""
    digests = np.frombuffer(b"".join(hashlib.sha256(t.encode()).digest() for t in texts), np.uint8).reshape(len(texts), 32)
    return list(digests[:, np.arange(size) % 32] / 127.5 - 1)


EMBEDDERS["hash"] = hash_embedding


def embed(df: DataFrame, text_col: str, name: str = "hash", out: str = "embedding") -> DataFrame:
    """df with the vectors of a registered embedder, which gets a batch of texts at a time (null as empty); an unknown name
    raises ValueError."""
    if name not in EMBEDDERS:
        raise ValueError(f"no embedder {name!r}; there are {sorted(EMBEDDERS)}")
    f = EMBEDDERS[name]

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(f(s.fillna("").tolist()) if len(s) else [], dtype=object)

    return df.withColumn(out, run(F.col(text_col)))
