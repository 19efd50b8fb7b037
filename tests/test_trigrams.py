"""Pattern search over trigrams against a scan of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import trigrams


@pytest.mark.parametrize("pattern,runs", [
    ("token", ["tok", "oke", "ken"]), ("(?i)ToKen", ["tok", "oke", "ken"]), ("abc.def", ["abc", "def"]), ("ab?cd", []), ("abc|def", []), ("(abc)+d", ["abc"]), ("x(abc)y", ["xab", "abc", "bcy"]),
    ("^abc$", ["abc"]), ("a{3}", []), ("[ab]cde", ["cde"]), (r"\bword\b", ["wor", "ord"]), (r"\p{L}abc", []), ("(unclosed", []), ("", []), ("(?i)éab", []), ("éab", ["éab"]), ("(?:abc)*", []), (r"a\.bc", ["a.b", ".bc"]), ("abc(?=def)", ["abc"]), ("(?i:abc)d", ["abc", "bcd"]),
])
def test_required_trigrams(pattern, runs):
    number = lambda x: (ord(x[0]) << 42) | (ord(x[1]) << 21) | ord(x[2])
    got = trigrams.required(pattern)
    assert set(got) <= set(map(number, runs)) and (bool(got) == bool(runs))


def test_search_gives_what_a_scan_gives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigrams, "SEGMENT", 50)
    r = random.Random(5)
    words = ["token", "Secret", "éclair", "abc", "ABC", "x=1", "def foo(a):", "ǅ", "İx", "a" * 30, "\U0001f600ok"]
    data = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 6)))) for i in range(300)] + [(900, None), (901, ""), (902, "ab"), (903, "token " * 50_000 + "needle"), (3, "token again"), (None, "token")]
    rows = spark.createDataFrame(data, "id long, text string").repartition(4)
    index = trigrams.Trigrams(spark, str(tmp_path)).build(rows, "id", "text")
    for pattern in ("token", "(?i)secret", "needle$", r"foo\(\w\)", "éclair", "a{20}", "[Aa]bc", "nowhere", "\U0001f600ok", "İx", "token.*Secret", "ab", "(?i)ABC ", r"\p{Lt}"):
        want = sorted((x.id, x.text) for x in rows.where("id is not null").where(F.col("text").rlike(pattern)).collect())
        assert sorted((x.id, x.text) for x in index.search(rows.where("id is not null"), pattern, "id", "text").collect()) == want
    assert index.candidates("needle").count() == 1 and index.candidates("x=1 token").count() < 100 and index.candidates("ab?") is None


def test_building_shuffles_no_postings(spark, tmp_path, monkeypatch):
    """Segments are made where the rows are: each has its ids once, and blocks of numbers of rows."""
    monkeypatch.setattr(trigrams, "SEGMENT", 40)
    rows = spark.createDataFrame([(i, f"token number {i}") for i in range(200)], "id long, text string").repartition(2)
    index = trigrams.Trigrams(spark, str(tmp_path)).build(rows, "id", "text")
    table = spark.read.parquet(f"{index.root}/grams")
    ids = table.where("bucket = -1")
    assert ids.count() == 6 and ids.agg(F.sum(F.size("ids"))).first()[0] == 200 and ids.agg(F.max(F.size("ids"))).first()[0] <= 40
    assert table.where("bucket >= 0 and (ids is not null or n <> size(rows))").count() == 0
    assert sorted(r.id for r in index.search(rows, "number 17", "id", "text").collect()) == [17, *range(170, 180)]
