"""The file tree as a data source: the same files as a walk, filters that reach the listing, skew, defined odd cases."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import listing, tree


def made(root, paths):
    for p in paths:
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(p)


def walked(root, skipped=()):
    out = []
    for at, down, names in os.walk(root):
        down[:] = [d for d in down if d not in skipped and not os.path.islink(f"{at}/{d}")]
        out += [os.path.relpath(f"{at}/{n}", root) for n in names]
    return sorted(out)


def paths_of(df):
    return sorted(r.path for r in df.select("path").collect())


def test_same_files_as_a_walk(spark, tmp_path):
    r = random.Random(5)
    names = ["a", "b", "build", "_c", ".d", "e f", "é"]
    made(tmp_path, {"/".join([*(r.choice(names) for _ in range(r.randrange(6))), f"x{i}.{r.choice(['py', 'JS', 'md'])}"]) for i in range(200)})
    made(tmp_path, ["pkg/__init__.py", ".github/ci.yml", "build/no.py"])
    (tmp_path / "empty.py").write_text("")
    os.symlink(tmp_path, tmp_path / "loop")
    for root in (str(tmp_path), f"{tmp_path}/", f"file://{tmp_path}"):
        assert paths_of(listing.listing(spark, root, ["build"])) == walked(tmp_path, ["build"])
    got = {r.path: r for r in tree.scan(spark, str(tmp_path), skipped=["build"]).collect()}
    assert sorted(got) == walked(tmp_path, ["build"]) and {"pkg/__init__.py", ".github/ci.yml", "empty.py"} <= set(got)
    assert all(r.text == ("" if p == "empty.py" else p) and r.size_bytes == len(r.text.encode()) for p, r in got.items())
    assert paths_of(tree.scan(spark, str(tmp_path), [".js"], include_dirs=["a", "_c/"])) == [p for p in walked(tmp_path, tree.SKIPPED) if p.startswith(("a/", "_c/")) and p.endswith(".JS")]


def test_the_driver_lists_a_bounded_number_of_directories(tmp_path, monkeypatch):
    made(tmp_path, [f"d{i}/e{j}/f.py" for i in range(30) for j in range(5)])
    looked, real = [], listing.TreeReader._listed
    monkeypatch.setattr(listing.TreeReader, "_listed", lambda self, s, b, d: looked.append(d) or real(self, s, b, d))
    reader = listing.TreeReader({"path": str(tmp_path), "spread": "8"})
    parts = reader.partitions()
    assert len(looked) == 1 and len(parts) == 8
    rows = [p for x in parts for b in reader.read(x) for p in b.column("path").to_pylist()]
    assert sorted(rows) == walked(tmp_path)
    chain = "/".join(["c"] * 40)
    made(tmp_path / "deep", [f"{chain}/f.py"])
    looked.clear()
    deep = listing.TreeReader({"path": str(tmp_path / "deep"), "spread": "8"})
    parts = deep.partitions()
    assert len(looked) == 8 and [p for x in parts for b in deep.read(x) for p in b.column("path").to_pylist()] == [f"{chain}/f.py"]


def test_filters_reach_the_listing(spark, tmp_path):
    made(tmp_path, ["a/x.py", "a/b/y.py", "a/b/z.js", "c/x.py", "ab/x.py"])
    d = listing.listing(spark, str(tmp_path))
    for cond, want in ((F.col("path").startswith("a/"), ["a/b/y.py", "a/b/z.js", "a/x.py"]), (F.col("path") == "c/x.py", ["c/x.py"]), (F.col("path").isin("c/x.py", "a/x.py", "no"), ["a/x.py", "c/x.py"]), (F.col("suffix") == "js", ["a/b/z.js"]), (F.col("suffix").isin("js", "py") & F.col("path").startswith("a"), ["a/b/y.py", "a/b/z.js", "a/x.py", "ab/x.py"]), (F.col("path").startswith("a/") & (F.col("path") == "c/x.py"), [])):
        assert paths_of(d.where(cond)) == want
    reader = listing.TreeReader({"path": str(tmp_path)})
    prefix, suffix = listing.StringStartsWith(("path",), "a/b"), listing.EqualTo(("suffix",), "py")
    assert list(reader.pushFilters([prefix, suffix])) == [prefix]  # the suffix is answered by the listing
    assert [reader._may_hold(x) for x in ("a/", "a/b/", "a/b/c/", "ab/", "c/")] == [True, True, True, False, False]
    plan = d.where("suffix = 'py'")._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(suffix" in plan and "= py" not in plan


def test_odd_cases(spark, tmp_path, monkeypatch):
    with pytest.raises(FileNotFoundError):
        listing.listing(spark, str(tmp_path / "none"))
    assert listing.listing(spark, str(tmp_path)).count() == 0 and tree.scan(spark, str(tmp_path)).count() == 0
    made(tmp_path, ["one.py"])
    (tmp_path / "bad.txt").write_bytes(b"a\xff\xfeb\n")
    assert [(r.path, r.text, r.line_count) for r in tree.scan(spark, str(tmp_path / "one.py")).collect()] == [("one.py", "one.py", 1)]
    assert [r.text for r in tree.scan(spark, str(tmp_path), ["txt"]).collect()] == ["ab\n"]
    gone = spark.createDataFrame([("one.py",), ("gone.py",)], "path string")
    assert [(r.path, r.text) for r in listing.with_texts(gone, str(tmp_path), 2).collect()] == [("one.py", "one.py")]
    assert [listing.ending(x) for x in ("a.PY", "Makefile", ".gitignore", "a.tar.gz", "a.")] == ["py", "", "", "gz", ""]
