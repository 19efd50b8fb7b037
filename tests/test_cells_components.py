"""Cells of vectors against a scan, and strongly connected components against a search from every file."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import dense, graph


def vectors(spark, n=600, groups=15, size=16, seed=1):
    r = np.random.default_rng(seed)
    mid = r.normal(size=(groups, size))
    data = [(i, [float(x) for x in mid[i % groups] + 0.2 * r.normal(size=size)], i % 4) for i in range(n)]
    data += [(n + i, data[i][1], 0) for i in range(5)] + [(n + 9, None, 0), (n + 10, [1.0], 0), (n + 11, [float("nan")] * size, 0), (n + 12, [None] * size, 0)]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(3)


def answer(df):
    return sorted((tuple(r) for r in df.select("query_id", "id", "distance", "rank").collect()), key=repr)


def good(v):
    return v.where((F.size("embedding") == 16) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)))


@pytest.mark.parametrize("held", [20_000, 40])
def test_cells_give_what_a_scan_gives(spark, tmp_path, monkeypatch, held):
    monkeypatch.setattr(dense, "HELD", held)
    v = vectors(spark)
    index = dense.Cells(spark, str(tmp_path)).build(v, keep=("label",))
    q = good(v).where("vec_id % 10 = 0 or vec_id >= 600").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    assert answer(index.knn(q, 7)) == answer(dense.knn(good(v), q, 7))
    where = F.col("label") == 3
    assert answer(index.knn(q, 3, where=where, skip_self=False)) == answer(dense.knn(good(v), q, 3, where=where, skip_self=False))
    many = index.knn(q.limit(2), 10_000)
    assert many.groupBy("query_id").count().select("count").distinct().collect()[0][0] == 604


def test_cells_are_pruned_and_recall_is_measured(spark, tmp_path):
    v = good(vectors(spark, 2000, 40))
    index = dense.Cells(spark, str(tmp_path)).build(v)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    seen = index.visits(q, 5).agg(F.avg("cells").alias("cells"), F.avg("rows").alias("rows"), F.count(F.lit(1)).alias("n")).first()
    assert seen.n == 101 and seen.cells < 22 and seen.rows < 1000  # of 44 cells and 2005 rows
    exact, some = ({(r.query_id, r.id) for r in index.knn(q, 5, probes=p).collect()} for p in (None, 3))
    assert len(exact & some) >= 0.9 * len(exact) and len(exact) == 505


def test_cells_of_nothing_and_of_equal_vectors(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "query_id long, q array<double>")
    assert dense.Cells(spark, f"{tmp_path}/a").build(none).knn(q, 3).count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(20)], "vec_id long, embedding array<double>")
    got = dense.Cells(spark, f"{tmp_path}/b").build(same).knn(q, 3)
    assert answer(got) == [(1, 0, 1.0, 1), (1, 2, 1.0, 2), (1, 3, 1.0, 3)]


def plain_components(edges):
    out, back = {}, {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        back.setdefault(b, set()).add(a)

    def reach(x, of):
        seen, todo = {x}, [x]
        while todo:
            for y in of.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    return sorted((x, min(reach(x, out) & reach(x, back))) for x in {y for e in edges for y in e})


def components(spark, tmp_path, edges):
    def written(df, name):
        path = f"{tmp_path}/{name}-{uuid.uuid4().hex}"
        df.coalesce(1).write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return sorted(map(tuple, graph.components(spark.createDataFrame(edges, "src long, dst long"), written).collect()))


def test_components_against_a_search_from_every_file(spark, tmp_path):
    r = random.Random(6)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(75)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(200 + i, 201 + i) for i in range(5)]
    edges += [(i, j) for i in range(300, 304) for j in range(300, 304)] + [(303, 100), (108, 200), (7, 7), edges[0]]
    edges = [e for e in edges if e[0] != e[1]] + [(7, 7)]
    want = plain_components([e for e in edges if e[0] != e[1]])
    assert components(spark, tmp_path, edges) == want and len({c for _, c in want}) < len(want)


def test_components_of_nothing_and_of_a_chain(spark, tmp_path):
    assert components(spark, tmp_path, []) == []
    assert components(spark, tmp_path, [(1, 2), (2, 3)]) == [(1, 1), (2, 2), (3, 3)]


def test_components_of_long_circles_and_ways(spark, tmp_path):
    """Rounds grow with the logarithm of a circle or way, not with its length."""
    edges = [(i, (i + 1) % 500) for i in range(500)] + [(1000 + i, 1000 + (i + 1) % 300) for i in range(300)] + [(2000 + i, 2001 + i) for i in range(200)]
    edges += [(2200, 0), (7, 1005), (1005, 1100), (3000, 2000), (3001, 3000), (3001, 2100), (2050, 3001), (4000, 4001), (4001, 4000), (4000, 5)]
    written = []

    def keep(df, name):
        written.append(name)
        path = f"{tmp_path}/{name}-{uuid.uuid4().hex}"
        df.coalesce(1).write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    got = sorted(map(tuple, graph.components(spark.createDataFrame(edges, "src long, dst long"), keep).collect()))
    assert got == plain_components(edges) and len(written) < 100


def test_components_of_random_sparse_graphs(spark, tmp_path):
    for seed in range(4):
        r = random.Random(seed)
        edges = list({(r.randrange(80), r.randrange(80)) for _ in range(70 + 20 * seed)} | {(100 + i, 100 + r.randrange(60)) for i in range(60)} | {(100 + r.randrange(60), r.randrange(80)) for _ in range(3)})
        edges = [e for e in edges if e[0] != e[1]]
        assert components(spark, f"{tmp_path}/{seed}", edges) == plain_components(edges)
