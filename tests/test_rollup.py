"""Maintained aggregates against recomputing them: random feeds, failures between commits, streams, nulls."""

import random

import pytest

from tessera.sources import rollup as rollups
from tessera.sources.rollup import Rollup
from tessera.sources.store import Store
from tessera.streaming.changes import apply_facts

SCHEMA = "file_id string, lang string, size long, rank int"


def facts(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def made(spark, path, buckets=4):
    return Rollup(Store(spark, str(path), buckets), "t", "file_id", ["lang"], ["size"], ["rank"])


def recomputed(rows):
    """What the aggregates of (file_id, lang, size, rank) must be."""
    out = {}
    for kind, key in {("all", None), *(("lang", r[1]) for r in rows)}:
        of = [r for r in rows if kind == "all" or r[1] == key]
        ranks = [r[3] for r in of if r[3] is not None]
        if of:
            out[kind, key] = (len(of), sum(r[2] or 0 for r in of), min(ranks, default=None), max(ranks, default=None), len(set(ranks)))
    return out


def read(r):
    return {(x.kind, x.key): tuple(x)[2:] for x in r.read().collect()}


def test_random_feed_equals_recomputing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rollups, "FOLD", 3)
    rnd, r, have = random.Random(11), made(spark, tmp_path), {}
    for batch in range(1, 8):
        keys = rnd.sample(range(15), 5)
        new = {f"f{k}": [(f"f{k}", rnd.choice(["a", "b", None]), rnd.choice([None, 5, -3, 10**12]), rnd.choice([None, 1, 2, 9])) for _ in range(rnd.randrange(3))] for k in keys}
        r.apply(facts(spark, [x for v in new.values() for x in v]), batch, facts(spark, [(k, None, 0, 0) for k in new]))
        have |= new
        if batch in (2, 3, 7):
            assert read(r) == recomputed([x for v in have.values() for x in v])
    cells = r.store.load(r.cells)
    assert cells.where("n = 0 and sum_size = 0").count() == 0 and cells.select("batch").distinct().count() == 2  # folded at 6
    r.delete(facts(spark, [(k, None, 0, 0) for k in have]), 8)
    assert read(r) == {} and r.store.load(r.facts).count() == 0


def test_a_deletion_uncovers_the_next_extreme(spark, tmp_path):
    r = made(spark, tmp_path)
    r.apply(facts(spark, [("x", "a", 1, 1), ("y", "a", 1, 5), ("z", "a", 1, 5), ("w", "a", 1, 9)]), 1)
    r.delete(facts(spark, [("w", None, 0, 0), ("y", None, 0, 0)]), 2)
    assert read(r)["lang", "a"] == (2, 2, 1, 5, 2)
    r.delete(facts(spark, [("z", None, 0, 0), ("none", None, 0, 0)]), 3)
    assert read(r)["all", None] == (1, 1, 1, 1, 1)
    assert [tuple(x) for x in r.values("rank").where("kind = 'all'").collect()] == [("all", None, 1, 1)]


@pytest.mark.parametrize("where", ["before the cells", "before the facts"])
def test_a_batch_cut_off_counts_once(spark, tmp_path, where):
    r = made(spark, tmp_path)
    r.apply(facts(spark, [("x", "a", 1, 1), ("y", "b", 2, 2)]), 1)
    rows = facts(spark, [("x", "b", 7, 3), ("v", "b", 1, None)])
    step = "add" if where == "before the cells" else "replace_files"

    def fail(*_):
        raise OSError("lost")

    setattr(r.store, step, fail)
    with pytest.raises(OSError):
        r.apply(rows, 2)
    again = made(spark, tmp_path)
    for _ in range(2):
        again.apply(rows, 2)
    assert read(again) == recomputed([("x", "b", 7, 3), ("y", "b", 2, 2), ("v", "b", 1, None)])


def test_only_the_buckets_of_a_batch_are_read(spark, tmp_path):
    s = Store(spark, str(tmp_path), 8)
    s.save("t", facts(spark, [(f"f{i}", "a", i, i) for i in range(60)]))
    got = s.lookup("t", facts(spark, [("f7", None, 0, 0), ("none", None, 0, 0), ("f7", None, 0, 0)]))
    assert [r["size"] for r in got.collect()] == [7]
    buckets = {f.split("_bucket=")[1].split("/")[0] for f in got.inputFiles() if "_bucket=" in f}
    assert 1 <= len(buckets) <= 2
    with pytest.raises(ValueError, match="kept by"):
        s.lookup("t", spark.createDataFrame([(1,)], "n int"))


def test_stream_of_facts(spark, tmp_path):
    feed, schema = str(tmp_path / "feed"), SCHEMA + ", seq long, deleted boolean"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
    put([("x", "a", 1, 1, 1, False), ("x", "a", 4, 4, 2, False), ("y", "b", 2, 2, 1, False)])
    r = made(spark, tmp_path / "store")
    run = lambda: apply_facts(spark.readStream.schema(schema).parquet(feed), r, str(tmp_path / "check")).awaitTermination()
    run()
    assert read(r) == recomputed([("x", "a", 4, 4), ("y", "b", 2, 2)])
    put([("x", None, None, None, 3, True), ("z", None, None, 7, 3, False)])
    run()
    run()
    assert read(r) == recomputed([("y", "b", 2, 2), ("z", None, None, 7)])
