"""Centroid clustering: Lloyd's algorithm in integers, by what changes from round to round (delta Lloyd).

Vectors are made integers (floor of `SCALE` times a component), so that sums, centroids and distances are exact and no order
of summation can show. The state of a round is a table: vector, owner (cluster), distance to it, the owner before. A round
compares a vector whose owner stood still with the centroids that moved only, since its distance to all others is as it was
and was not below the one kept; a vector whose owner moved is compared with all. Vectors that change hands give their
components to the new owner and take them from the old one; these signed transfers are summed inside each task, then by
(cluster, component), and added to the global sums. Only those come to the driver: clusters x (components + 1) integers,
whatever the number of vectors. Each state is written to the shared folder and the one before it is deleted.

Defined cases: a vector is kept if it has exactly `size` components, none null or not finite, and none beyond 2**27 after
scaling, where distances fit 64 bits (others give no row); of kept vectors with equal hashes of their ids the one with the
smaller components is a seed first; a null id never seeds before one that is not null; with fewer vectors than clusters
each is a seed; repeated rows are vectors of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_dir

SCALE, LARGEST = 256, 1 << 27
#: Products of components up to this, 64 of them, are exact in doubles.
EXACT = 1 << 22
STATE = "vec_id long, v array<int>, cluster int, distance long, was int"
ADDED = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integers(vectors: DataFrame, id_col: str, vec_col: str, size: int) -> DataFrame:
    """vec_id, v (array<int>) of the vectors that are kept."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double") * float(SCALE))
    fits = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= float(LARGEST)))
    got = vectors.where((F.size(vec_col) == size) & fits)
    return got.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c).cast("int")).alias("v"))


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all of v to all of c, as integers."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= EXACT and v.shape[1] <= 64:
        x, y = v.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)).astype(np.int64)
    return np.stack([((v - one) ** 2).sum(1) for one in c], axis=1)


def assigned(v: np.ndarray, was: np.ndarray, held: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, distance) of vectors whose owners were `was`, at the distances `held`; moved: which centroids changed."""
    cluster, distance = was.copy(), held.copy()
    lost = (was < 0) | moved[was]
    if lost.any():
        d = distances(v[lost], centroids)
        cluster[lost] = d.argmin(1)  # the first of equals
        distance[lost] = d.min(1)
    rest = np.flatnonzero(~lost)
    if len(rest) and moved.any():
        those = np.flatnonzero(moved)
        d = distances(v[rest], centroids[those])
        best, at = d.min(1), those[d.argmin(1)]
        take = (best < held[rest]) | ((best == held[rest]) & (at < was[rest]))
        cluster[rest[take]], distance[rest[take]] = at[take], best[take]
    return cluster, distance


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, size).astype(np.int64)


def next_state(state: DataFrame, centroids: list[list[int]], moved: list[bool]) -> DataFrame:
    """The state after one comparison."""
    size = len(centroids[0])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, m = np.array(centroids, np.int64), np.array(moved, bool)
        for b in batches:
            if not b.num_rows:
                continue
            was, held = np.asarray(b.column(2)), np.asarray(b.column(3))
            cluster, distance = assigned(matrix(b.column(1), size), was, held, c, m)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(was, pa.int32())], ["vec_id", "v", "cluster", "distance", "was"])

    return state.select("vec_id", "v", "cluster", "distance").mapInArrow(step, STATE)


def transfers(state: DataFrame, k: int, size: int) -> DataFrame:
    """cluster, at, x: what each cluster gains of component `at` (at = size: of vectors). At most k x (size + 1) rows a task."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.zeros((k, size + 1), np.int64)
        for b in batches:
            if b.num_rows:
                v = np.column_stack([matrix(b.column(0), size), np.ones(b.num_rows, np.int64)])
                to, was = np.asarray(b.column(1)), np.asarray(b.column(2))
                np.add.at(gain, to, v)
                np.subtract.at(gain, was[was >= 0], v[was >= 0])
        c, at = np.nonzero(gain)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(at, pa.int32()), pa.array(gain[c, at])], ["cluster", "at", "x"])

    part = state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(step, "cluster int, at int, x long")
    return part.groupBy("cluster", "at").agg(F.sum("x").alias("x"))


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", size: int = 64, k: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector.

    Centroids start as the k vectors with the smallest SHA-256 of "seed:id". After `rounds` rounds of assigning and averaging
    (floor of sum by count) vectors are assigned once more.
    """
    spark = vectors.sparkSession
    home = f"{scratch_dir(spark)}/lloyd-{uuid.uuid4().hex}"
    own = integers(vectors, id_col, vec_col, size)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centroids = [list(r.v) for r in own.orderBy(order.asc_nulls_last(), "v").limit(k).collect()]  # k rows
    if not centroids:
        return spark.createDataFrame([], ADDED)
    sums, moved = [[0] * (size + 1) for _ in centroids], [True] * len(centroids)
    state = own.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    jvm, conf, before = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), None
    for turn in range(rounds + 1):
        now = f"{home}/{turn}"
        next_state(state, centroids, moved).write.parquet(now)
        state = spark.read.schema(STATE).parquet(now)
        if before:
            path = jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(conf).delete(path, True)
        before = now
        if turn == rounds:
            break
        for r in transfers(state, len(centroids), size).collect():  # at most k x (size + 1) rows
            sums[r["cluster"]][r["at"]] += r["x"]
        fresh = [[x // s[size] for x in s[:size]] if s[size] else c for s, c in zip(sums, centroids, strict=True)]
        moved = [a != b for a, b in zip(fresh, centroids, strict=True)]
        centroids = fresh
        if not any(moved):  # nothing can change hands any more
            break
    shas = [(i, ",".join(map(str, c))) for i, c in enumerate(centroids)]
    named = spark.createDataFrame(shas, "cluster int, text string").select("cluster", F.sha2("text", 256).alias("centroid_sha256"))
    each = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(named, "cluster")  # at most k rows
    every = state.agg(F.sum("distance").alias("inertia"))  # one row
    out = state.join(F.broadcast(each), "cluster").join(F.broadcast(every))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
