"""Functions for SQL against the operators that they stand for."""

import pytest
from pyspark.sql import functions as F

from tessera import sql
from tessera.engine import Engine
from tessera.functions import text
from tessera.operators import chunking, parsing

SOURCES = [
    ("helpers.py", "python", "def load_all():\n    return 'the public helper'\n\n\nclass Tool:\n    def run(self):\n        pass\n"),
    ("app.py", "python", "import helpers\n\nclass App:\n    pass\n"), ("cli.py", "python", "import app\n# public\n"), ("a'b.js", "javascript", "function go() { return '}'; }\n"),
    ("empty.py", "python", ""), ("null.py", "python", None),
]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("sql") / "store"))
    e.ingest(spark.createDataFrame([x for x in SOURCES if x[2] is not None], "file_id string, language string, text string"))
    assert {"q_search_chunks", "q_impact_of", "q_parse_source"} <= set(e.register_functions("q_"))
    spark.createDataFrame(SOURCES, "file_id string, language string, text string").createOrReplaceTempView("q_sources")
    return e


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_scalars(spark, engine):
    odd = ["Ünïcode Straße, ÉTÉ x1_y2", "", "\n", "a\n", "a\n\n", "a\nb", "it's \\ \"q\"", None]
    d = spark.createDataFrame([(x,) for x in odd], "x string")
    got = d.select("x", F.expr("q_terms_of(x)"), F.expr("q_lines_of(x)"), F.expr("q_tokens_in(x)"))
    assert rows(got) == rows(d.select("x", text.tokens(F.col("x")), text.lines(F.col("x")), text.tokens_div4(F.col("x"))))


@pytest.mark.parametrize("size, overlap", [(3, 1), (2, 0), (100, 20)])
def test_chunks(spark, engine, size, overlap):
    got = spark.sql(f"SELECT s.file_id, c.* FROM q_sources s, LATERAL q_sliding_chunks(s.text, {size}, {overlap}) c")
    want = chunking.sliding(spark.table("q_sources").where("text is not null"), size, overlap).select("file_id", "start_line", "end_line", "content")
    assert rows(got) == rows(want)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_parse(spark, engine):
    got = spark.sql("SELECT s.file_id, p.* FROM q_sources s, LATERAL q_parse_source(s.text, s.language) p")
    assert rows(got) == rows(parsing.parse(spark.table("q_sources")).where("kind <> 'module'").select("file_id", "kind", "name", "start_line", "end_line", "parents", "content"))


def test_search(spark, engine):
    for question in ("public", "the public helper", "public import", "nothing of this", "", "it's"):
        want = [(r.id, r.score, r.rank) for r in engine.retrieve(question, 5).orderBy("rank").collect()]
        got = spark.sql("SELECT * FROM q_search_chunks(:q, 5) ORDER BY rank", {"q": question})
        assert [tuple(r) for r in got.collect()] == want
    assert spark.sql("SELECT * FROM q_search_chunks(NULL)").count() == 0


def test_graph_and_symbols_in_one_statement(spark, engine):
    got = spark.sql("SELECT d.file_id, i.file_id AS hit, i.steps FROM q_definitions_of('load_all') d, LATERAL q_impact_of(d.file_id) i")
    assert rows(got) == [("helpers.py", "app.py", 1), ("helpers.py", "cli.py", 2)]
    assert rows(spark.sql("SELECT file_id FROM q_references_to('load_all')")) == [("app.py",)] and spark.sql("SELECT * FROM q_definitions_of(NULL)").count() == 0
    named = spark.sql("SELECT s.name, r.file_id FROM q_symbols s, LATERAL q_references_to(s.name) r")
    assert rows(named) == [("App", "cli.py"), ("Tool", "app.py"), ("load_all", "app.py"), ("run", "app.py")]
    both = spark.sql("SELECT f.file_id, i.* FROM q_files f, LATERAL q_impact_of(f.file_id) i")
    want = engine.impact(engine.files().select(F.col("file_id").alias("file")))
    assert {tuple(r)[:2] for r in both.collect()} == {tuple(r) for r in want.collect()}
    spark.sql("CREATE OR REPLACE TEMP VIEW q_kinds AS SELECT p.kind, count(*) AS n FROM q_sources s, LATERAL q_parse_source(s.text, s.language) p GROUP BY p.kind")
    assert dict(rows(spark.table("q_kinds")))["class"] == 2


def test_without_views_only_what_needs_none(spark):
    made = sql.register(spark, prefix="bare_")
    assert "bare_sliding_chunks" in made and "bare_search_chunks" not in made and "bare_impact_of" not in made
