"""The block-max index against a scan of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import lexical


def corpus(spark, n, segment=None):
    r = random.Random(n)
    words = ["w%d" % i for i in range(200)]
    row = lambda: " ".join(words[min(int(r.expovariate(0.05)), 199)] for _ in range(r.choice((0, 1, 5, 30, 200))))
    data = [("d%d" % i, row()) for i in range(n)] + [("null", None), ("empty", ""), ("accents", "Été W3 w3"), (None, "w1 w2")]
    return spark.createDataFrame(data, "id string, text string").repartition(4)


QUERIES = [(0, "w3"), (1, "w1 w2"), (2, "w0 w1 w2 w3 w4"), (3, "w199 w0"), (4, "nowhere"), (5, "w1 nowhere"), (6, ""), (7, None), (8, "ete W3"), (9, "w1 W1 w1"), (None, "w5 w7")]


@pytest.mark.parametrize("every", [True, False])
@pytest.mark.parametrize("n", [1, 20])
def test_index_gives_what_a_scan_gives(spark, tmp_path, monkeypatch, every, n):
    monkeypatch.setattr(lexical, "SEGMENT", 100)
    monkeypatch.setattr(lexical, "SHORT", 0)
    rows, queries = corpus(spark, 700), spark.createDataFrame(QUERIES, "query_id long, text string")
    for only in (None, queries):
        index = lexical.Index(spark, f"{tmp_path}/{only is None}").build(rows, "id", "text", only)
        got = sorted((tuple(r) for r in index.search(queries.where("query_id is not null"), n, every).collect()), key=repr)
        want = sorted((tuple(r) for r in lexical.search(rows, queries.where("query_id is not null"), "id", "text", n, every).collect()), key=repr)
        assert got == want and len(got) > 4 * n
    again = lexical.Index(spark, index.root)  # opened, not built
    assert sorted((tuple(r) for r in again.search(queries.where("query_id is not null"), n, every).collect()), key=repr) == want
    index.clean()


def test_search_reads_a_part_of_the_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT", 200)
    monkeypatch.setattr(lexical, "SHORT", 0)
    rows = corpus(spark, 2000)
    index = lexical.Index(spark, str(tmp_path)).build(rows, "id", "text")
    assert index._whole().first().segs == 11
    q = spark.createDataFrame([(0, "w0 w1"), (1, "w2 w150"), (2, "w0")], "query_id long, text string")
    for every in (True, False):
        r = index.reads(q, 5, every).agg(F.sum("held").alias("held"), F.sum("kept").alias("kept")).first()
        assert r.held > 1500 and r.kept < 0.3 * r.held


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id long, text string")
    index = lexical.Index(spark, str(tmp_path)).build(none, "id", "text")
    q = spark.createDataFrame([(0, "a b")], "query_id long, text string")
    assert index.search(q).count() == 0 and index.reads(q).count() == 0
    assert index.search(q.limit(0), every=False).count() == 0


def test_phrases_against_a_scan_of_all_rows(spark, tmp_path):
    rows = corpus(spark, 300)
    index = lexical.Index(spark, str(tmp_path)).build(rows, "id", "text", places=True)
    asked = {0: "w1 w2", 1: "w0 w0", 2: "W3", 3: "w2 w1 w0", 4: "w1 nowhere", 5: "w2 w1 w2", 6: "ete w3 W3"}
    got = {}
    for r in index.phrases(spark.createDataFrame(list(asked.items()), "query_id long, text string"), 7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    for i, phrase in asked.items():
        want = [(k + 1, r.id, r.score) for k, r in enumerate(lexical.bm25_phrase(rows, phrase, "id", "text", 7).collect())]
        assert sorted(got.get(i, [])) == want
    assert len(got) == 6 and index.phrases(spark.createDataFrame([(0, ""), (1, None)], "query_id long, text string")).count() == 0


def test_phrases_shuffle_their_places_once(spark, tmp_path):
    """Counted and scored in one plan, which deals the blocks of a segment once."""
    rows = spark.createDataFrame([(i, "a b c" if i % 3 else "b c a b") for i in range(90)], "id long, text string")
    index = lexical.Index(spark, str(tmp_path)).build(rows, "id", "text", places=True)
    asked = {0: "b c", 1: "a b", 2: "c b"}
    d = index.phrases(spark.createDataFrame(list(asked.items()), "query_id long, text string"), 4)
    got = sorted(map(tuple, d.collect()), key=lambda r: (r[0], r[3]))
    assert got == [(q, r.id, r.score, k + 1) for q in (0, 1) for k, r in enumerate(lexical.bm25_phrase(rows, asked[q], "id", "text", 4).collect())]
    assert "ReusedExchange" in d._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("every", [True, False])
@pytest.mark.parametrize("n,pairs", [(1, 500_000), (20, 7)])
def test_many_queries_meet_each_segment_once(spark, tmp_path, monkeypatch, every, n, pairs):
    """Scored inside the segments; rows that repeat an id count as one, as in a scan that groups by id."""
    monkeypatch.setattr(lexical, "SEGMENT", 100)
    monkeypatch.setattr(lexical, "FEW", 0)
    monkeypatch.setattr(lexical, "PAIRS", pairs)
    monkeypatch.setattr(lexical, "VECTORS", 3)
    rows = corpus(spark, 700).unionByName(spark.createDataFrame([("d3", "w1 w2 w3"), ("d3", "w3 w5")], "id string, text string"))
    many = [(100 + i, f"w{i} w{i // 3} w{2 * i} w0 w1 w2") for i in range(40)]
    queries = spark.createDataFrame(QUERIES + many, "query_id long, text string").where("query_id is not null")
    index = lexical.Index(spark, str(tmp_path)).build(rows, "id", "text", queries)
    got = sorted((tuple(r) for r in index.search(queries, n, every).collect()), key=repr)
    want = sorted((tuple(r) for r in lexical.search(rows, queries, "id", "text", n, every).collect()), key=repr)
    assert got == want and len(got) > (20 if every else 40)
    assert index.reads(queries, n, every).where("held <> kept").count() == 0


def test_any_word_of_many_queries_goes_in_passes(spark, tmp_path, monkeypatch):
    """Segments are kept once, however many rows of queries meet them, and later passes give only rows that reach the least score."""
    monkeypatch.setattr(lexical, "SEGMENT", 20)
    monkeypatch.setattr(lexical, "FEW", 0)
    monkeypatch.setattr(lexical, "PAIRS", 50)
    rows = corpus(spark, 800)
    queries = spark.createDataFrame([(i, f"w{i} w{i // 3} w{2 * i} w0 w1 w2 w{i} w150") for i in range(40)], "query_id long, text string")
    index = lexical.Index(spark, str(tmp_path)).build(rows, "id", "text", queries)
    got = sorted(map(tuple, index.search(queries, 5, every=False).collect()))
    assert got == sorted(map(tuple, lexical.search(rows, queries, "id", "text", 5, every=False).collect())) and len(got) == 200
    segs = index._whole().first().segs
    assert segs == 41 and spark.read.parquet(f"{tmp_path}/searches/segments-*").count() <= segs
    assert spark.read.parquet(f"{tmp_path}/searches/hits-*").count() < 40 * 5 * segs / 2


def test_many_queries_of_frequent_words_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "FEW", 0)
    rows = spark.createDataFrame([(i, "a b" if i % 2 else "a a c") for i in range(300)], "id long, text string")
    queries = spark.createDataFrame([(0, "a"), (1, "a b"), (2, "c a")], "query_id long, text string")
    index = lexical.Index(spark, str(tmp_path)).build(rows, "id", "text")
    for every in (True, False):
        got = sorted(tuple(r) for r in index.search(queries, 5, every).collect())
        assert got == sorted(tuple(r) for r in lexical.search(rows, queries, "id", "text", 5, every).collect()) and len(got) == 15


def test_postings_shuffle_no_words(spark):
    rows = corpus(spark, 60).unionByName(spark.createDataFrame([("d3", "w1 w2 w1"), ("d3", "w1 w2 w2"), (None, "w5")], "id string, text string"))
    d = lexical.postings(rows, "id", "text")
    t = rows.select("id", lexical.tokens(F.col("text")).alias("t")).select("id", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term"))
    want = t.groupBy("id", "dl", "term").count()
    assert sorted(map(tuple, d.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
