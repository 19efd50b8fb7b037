"""The keyed log store: what a change touches, two writers, compaction, tables of the old format."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import store as stores
from tessera.sources.store import Conflict, Store


def table(spark, rows):
    return spark.createDataFrame(rows, "file_id string, n long")


def rows_of(s, name="t"):
    return sorted((tuple(r) for r in s.load(name).collect()), key=repr)


def folders(s, name="t"):
    """Which buckets each folder of files has."""
    return {x: sorted(k for k in s._names(f"{s.root}/{name}/data/{x}") if k.startswith("_bucket=")) for x in s._names(f"{s.root}/{name}/data")}


def test_a_change_touches_its_own_buckets(spark, tmp_path):
    s = Store(spark, str(tmp_path), buckets=8)
    s.save("t", table(spark, [("f%d" % i, i) for i in range(100)]))
    before = folders(s)
    assert len(before) == 1 and len(next(iter(before.values()))) == 8
    s.replace_files("t", table(spark, [("f3", 300), ("f3", 301)]))
    new = {x: k for x, k in folders(s).items() if x not in before}
    assert len(new) == 2 and all(len(k) == 1 for k in new.values()) and {x: folders(s)[x] for x in before} == before
    s.delete_files("t", table(spark, [("f4", 0), ("none", 0)]))
    want = [("f%d" % i, i) for i in range(100) if i not in (3, 4)] + [("f3", 300), ("f3", 301)]
    assert rows_of(s) == sorted(want, key=repr)
    plan = s.load("t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and 1 <= plan.count("LeftAnti") <= 2  # buckets with nothing gone stand beside the join


def test_two_writers_lose_nothing(spark, tmp_path):
    a, b = Store(spark, str(tmp_path), 4), Store(spark, str(tmp_path), 4)
    a.save("t", table(spark, [("x", 1), ("y", 2)]))
    old = a.manifest("t")
    b.replace_files("t", table(spark, [("x", 10)]))
    assert not a._commit("t", old)  # made from a manifest that is no longer the last
    commit, raced = a._commit, []

    def late(name, m):
        if not raced:
            raced.append(b.replace_files("t", table(spark, [("z", 3)])))
        return commit(name, m)

    a._commit = late
    a.replace_files("t", table(spark, [("y", 20), ("z", 4)]))
    assert rows_of(b) == [("x", 10), ("y", 20), ("z", 4)]
    raced.clear()
    a.append("t", table(spark, [("z", 9), ("w", 5)]), "file_id")
    assert rows_of(b) == [("w", 5), ("x", 10), ("y", 20), ("z", 3)]
    with pytest.raises(Conflict):
        b.save("t", table(spark, []), expect=old["version"])


def test_compaction_keeps_what_others_commit_meanwhile(spark, tmp_path):
    s, other = Store(spark, str(tmp_path), 2), Store(spark, str(tmp_path), 2)
    s.save("t", table(spark, [("f%d" % i, i) for i in range(10)]))
    for k in range(3):
        s.replace_files("t", table(spark, [("f1", k), ("f%d" % (k + 5), -k)]))
    want = rows_of(s)
    commit, raced = s._commit, []

    def late(name, m):
        if not raced:
            raced.append(other.replace_files("t", table(spark, [("f2", 77)])))
        return commit(name, m)

    s._commit = late
    assert s.compact("t") == [0, 1]
    want = [x for x in want if x[0] != "f2"] + [("f2", 77)]
    assert rows_of(s) == sorted(want, key=repr) and len(s.manifest("t")["entries"]) == 2
    s._commit = commit
    assert s.compact("t") and s.compact("t") == [] and not any(e["gone"] for e in s.manifest("t")["entries"])
    s.clean("t")
    assert rows_of(s) == sorted(want, key=repr) and len(folders(s)) == len(s.manifest("t")["entries"]) and len(s._names(f"{s.root}/t/manifests")) == 1


def test_random_changes_against_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "MOST", 3)
    r, s, have = random.Random(3), Store(spark, str(tmp_path), 4), {"f%d" % i: [i] for i in range(20)}
    s.save("t", table(spark, [(k, x) for k, v in have.items() for x in v] + [(None, 1)]))
    for step in range(8):
        keys = ["f%d" % r.randrange(30) for _ in range(4)]
        if step % 4 == 3:
            s.delete_files("t", table(spark, [(k, 0) for k in keys]))
            have = {k: v for k, v in have.items() if k not in keys}
        else:
            rows = [(k, r.randrange(1000)) for k in keys[:3]]
            s.replace_files("t", table(spark, rows), owners=table(spark, [(k, 0) for k in keys]))
            have = {k: v for k, v in have.items() if k not in keys} | {k: [x for y, x in rows if y == k] for k, _ in rows}
    assert rows_of(s) == sorted([(k, x) for k, v in have.items() for x in v] + [(None, 1)], key=repr)
    assert max(sum(k in e["at"] for e in s.manifest("t")["entries"]) for k in range(4)) <= 4


def test_a_table_of_the_old_format_opens_and_moves_on(spark, tmp_path):
    d = table(spark, [("a", 1), ("b", 2), (None, 3)])
    d.write.parquet(f"{tmp_path}/t/old")
    (tmp_path / "t" / "current").write_text(f"{tmp_path}/t/old")
    s = Store(spark, str(tmp_path), 4)
    assert s.version("t") == 0 and s.manifest("t")["format"] == stores.FORMAT and rows_of(s) == [("a", 1), ("b", 2), (None, 3)]
    s.replace_files("t", table(spark, [("a", 10)]))
    assert rows_of(s) == [("a", 10), ("b", 2), (None, 3)] and s.manifest("t")["owner"] == "file_id"
    s.clear("t")
    assert s.load("t").count() == 0 and s.load("t").columns == ["file_id", "n"]
    monkey = {**s.manifest("t"), "format": stores.FORMAT + 1}
    assert s._commit("t", monkey)
    with pytest.raises(ValueError, match="newer"):
        s.load("t")
    with pytest.raises(FileNotFoundError):
        s.load("none")
    assert s.load_or_empty("none", "a long").count() == 0 and F is not None
