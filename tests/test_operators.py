"""Operators that SQL does not check: patterns, parsing, sources, folds, streams."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import paths, text
from tessera.operators import chunking, context, dense, docs, fusion, incremental, metadata, parsing
from tessera.plans import analysis, registry
from tessera.sources import ingest, store, tree
from tessera.streaming import changes

from .conftest import SF


def col(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("path,patterns,out", [
    ("a/b.py", ["*.py"], True), ("a/b.py", ["*.py", "!a/*.py"], False), ("build/x.c", ["build/"], True), ("a/build", ["build/"], False),
    ("src/deep/x.c", ["src/**/x.c"], True), ("src/x.c", ["src/*.c"], True), ("src/d/x.c", ["src/*.c"], False), ("a1.c", ["a[0-9].c"], True), ("x", ["# x", ""], False),
])
def test_ignored(spark, path, patterns, out):
    assert col(spark, path, lambda x: paths.ignored(x, patterns)) is out


@pytest.mark.parametrize("path,out", [("./a//b/../c", "a/c"), ("/r/./x/..", "/r"), ("a\\b", "a/b"), ("../a", "../a")])
def test_normalize(spark, path, out):
    assert col(spark, path, paths.normalize) == out


@pytest.mark.parametrize("q,out", [("(foo OR bar)", "foo or bar"), ("a*b", "a b"), ("???", "")])
def test_sanitize(spark, q, out):
    assert col(spark, q, text.sanitize_query) == out


def test_markdown_links(spark):
    assert col(spark, "[a](b.md) [c](http://x) [d](#e)", text.markdown_links) == ["b.md"]


def test_parse_python(spark):
    d = spark.createDataFrame([("a.py", "python", "import os\nclass A:\n    def f(self):\n        pass\n"), ("b.ts", "typescript", "function g() {}\n"), ("c.txt", "text", "x")], "file_id string, language string, text string")
    got = {(r.file_id, r.kind, r.name, r.start_line, tuple(r.parents)) for r in parsing.parse(d).collect()}
    assert {("a.py", "import", "import os", 1, ()), ("a.py", "class", "A", 2, ()), ("a.py", "method", "f", 3, ("A",)), ("b.ts", "function", "g", 1, ())} <= got
    assert ("c.txt", "module", "c.txt", 1, ()) in got


def test_imports(spark):
    m = spark.createDataFrame([("pkg", "pkg/__init__.py"), ("pkg.a", "pkg/a.py"), ("pkg.b", "pkg/b.py")], "module string, file_id string")
    i = spark.createDataFrame([("c.py", "from pkg import a, b"), ("c.py", "import pkg.a as x, pkg.b"), ("c.py", "from pkg import z"), ("c.py", "import os")], "source string, raw_text string")
    got = {}
    for r in docs.resolve_imports(i, m).collect():
        got.setdefault(r.raw_text, set()).add(r.target)
    assert got == {"from pkg import a, b": {"pkg/a.py", "pkg/b.py"}, "import pkg.a as x, pkg.b": {"pkg/a.py", "pkg/b.py"}, "from pkg import z": {"pkg/__init__.py"}, "import os": {None}}


def test_sliding_stops_at_the_last_line(spark):
    d = spark.createDataFrame([("f", "\n".join(map(str, range(25))))], "file_id string, text string")
    got = [(r.start_line, r.end_line) for r in chunking.sliding(d, 10, 2).orderBy("start_line").collect()]
    assert got == [(1, 10), (9, 18), (17, 25)]


def test_symbol_takes_the_next_chunk_once_its_first_is_given(spark):
    c = spark.createDataFrame([("f", "c1", 1, 10), ("f", "c2", 2, 5)], "file_id string, chunk_id string, start_line long, end_line long")
    h = spark.createDataFrame([("f", "s1", 3, 1), ("f", "s2", 4, 2), ("f", "s3", 4, 3)], "file_id string, symbol_id string, line long, rank long")
    assert {(r.symbol_id, r.chunk_id) for r in fusion.symbols_to_chunks_once(h, c).collect()} == {("s1", "c1"), ("s2", "c2")}


def test_pack_priority(spark):
    i = spark.createDataFrame([("g", 1, 1, "x" * 400), ("g", 2, 2, "x" * 4000), ("g", 3, 3, "x" * 40)], "g string, id long, rank long, text string")
    r = context.pack_priority(i, 300, "g").first()
    assert (r.taken, r.cut) == ("1,2", 200)


def test_embedders(spark):
    d = spark.createDataFrame([("a",), (None,)], "t string")
    assert [len(r.embedding) for r in dense.embed(d, "t").collect()] == [8, 8]
    with pytest.raises(ValueError):
        dense.embed(d, "t", "none")


def test_tree(spark, tmp_path):
    for p, s in {"src/app.py": "x = 1\n", "node_modules/m.js": "x", "src/skip.py": "y", "a.md": "# t\n"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(s)
    got = tree.scan(spark, str(tmp_path), ignore=["skip.py"]).collect()
    assert {(r.path, r.language, r.line_count) for r in got} == {("src/app.py", "python", 1), ("a.md", "markdown", 1)}
    assert [r.path for r in tree.scan(spark, str(tmp_path), ["py"], include_dirs=["src"]).orderBy("path").collect()] == ["src/app.py", "src/skip.py"]
    assert [r.page for r in store.list_pages(spark, str(tmp_path)).collect()] == ["a.md"]
    assert store.page(spark, str(tmp_path), "a.md") == "# t\n"
    with pytest.raises(ValueError):
        store.page(spark, str(tmp_path), "../x")


def test_store_and_stream(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    with pytest.raises(FileNotFoundError):
        s.load("files")
    s.save("files", spark.createDataFrame([("a", 1), ("b", 1)], "file_id string, v long"))
    feed = tmp_path / "feed"
    spark.createDataFrame([("a", 1, False, 2), ("a", 2, False, 3), ("b", 1, True, 0), ("c", 1, False, 9)], "file_id string, seq long, deleted boolean, v long").write.parquet(str(feed))
    stream = spark.readStream.schema("file_id string, seq long, deleted boolean, v long").parquet(str(feed))
    changes.apply_changes(stream, s, "files", str(tmp_path / "cp")).awaitTermination(60)
    assert {(r.file_id, r.v) for r in s.load("files").collect()} == {("a", 3), ("c", 9)}
    s.export_json("files", str(tmp_path / "out"))
    assert s.import_json("files", str(tmp_path / "out"), "file_id") == 2


def test_diff(spark):
    a, b = (spark.createDataFrame(x, "k long, v string") for x in ([(1, "a"), (2, "b"), (3, None)], [(2, "c"), (3, None), (4, "d")]))
    assert {(r.k, r.status) for r in incremental.snapshot_diff(a, b, "k", "v").collect()} == {(1, "deleted"), (2, "changed"), (4, "new")}


def test_embedder_gets_batches(spark):
    seen = spark.sparkContext.accumulator(0)
    dense.EMBEDDERS["length"] = lambda texts: (seen.add(1), [[float(len(t))] for t in texts])[1]
    d = spark.createDataFrame([("ab",), ("",), ("abc",)], "t string").coalesce(1)
    assert [r.embedding for r in dense.embed(d, "t", "length").collect()] == [[2.0], [0.0], [3.0]] and seen.value == 1


def test_knn_in_blocks(spark, monkeypatch):
    d = spark.createDataFrame([(i, [float(i % 7), float(i // 7)]) for i in range(60)] + [(99, None)], "vec_id long, embedding array<float>").repartition(3)
    q = d.where("vec_id % 10 = 0").selectExpr("vec_id as query_id", "embedding as q")
    whole = sorted(map(tuple, dense.knn(d, q, 4).collect()))
    monkeypatch.setattr(dense, "BLOCK", 2)
    assert sorted(map(tuple, dense.knn(d, q, 4).collect())) == whole and len(whole) == 24
    assert dense.knn(d, q.limit(0), 4).count() == 0


def brute_semantic(body, most, least):
    all_lines = body.split("\n")
    n = len(all_lines) - (len(all_lines) > 1 and all_lines[-1] == "")
    if n <= most:
        return [(1, n)]
    marks, before = [], None
    for i, s in enumerate(all_lines):
        if not s.strip(" "):
            continue
        indent, x = len(s) - len(s.lstrip(" ")), s.lstrip(" ")
        if x.startswith(("def ", "class ", "async def ", "if __name__")) or (x.startswith("#") and len(s.strip(" ")) > 2) or (indent == 0 and before):
            marks.append(i + 1)
        before = indent
    cuts = [1]
    if len(marks) <= 1:
        cuts = list(range(1, n + 1, most))
    else:
        for x in marks:
            if x - cuts[-1] >= least:
                cuts.append(x)
    return [(a, b - 1) for a, b in zip(cuts, [*cuts[1:], n + 1], strict=True)]


def test_semantic_chunks_against_a_loop(spark):
    import random

    r = random.Random(4)
    line = lambda: r.choice(["def f():", "    x = 1", "# a comment", "class A:", "  y", "", "plain words", "#", "if __name__:"])
    data = [(str(i), "\n".join(line() for _ in range(r.randint(1, 70))) + r.choice(["", "\n"])) for i in range(40)]
    d = spark.createDataFrame(data, "file_id string, text string")
    for most, least in ((20, 10), (5, 3), (100, 10)):
        got = {}
        for x in chunking.semantic(d, most, least).orderBy("file_id", "start_line").collect():
            got.setdefault(x.file_id, []).append((x.start_line, x.end_line))
        assert got == {f: brute_semantic(s, most, least) for f, s in data}


def test_symbols_to_chunks_once_against_a_loop(spark):
    import random

    r = random.Random(6)
    c = [("f%d" % f, "c%d.%d" % (f, k), a, a + r.randint(0, 20)) for f in range(6) for k in range(8) for a in [r.randint(1, 60)]]
    h = [("f%d" % f, "s%d.%d" % (f, k), r.randint(1, 80), k) for f in range(6) for k in range(12)]
    want = set()
    for f in sorted({x[0] for x in h}):
        taken = set()
        for _, s, line, _ in sorted((x for x in h if x[0] == f), key=lambda x: x[3]):
            free = [x for x in sorted((a, b, i) for g, i, a, b in c if g == f) if x[0] <= line <= x[1] and x[2] not in taken]
            if free:
                taken.add(free[0][2])
                want.add((f, free[0][2], s))
    got = fusion.symbols_to_chunks_once(spark.createDataFrame(h, "file_id string, symbol_id string, line long, rank long"), spark.createDataFrame(c, "file_id string, chunk_id string, start_line long, end_line long"))
    assert {tuple(x) for x in got.collect()} == want


def test_pack_priority_against_a_loop(spark):
    import random

    r = random.Random(8)
    items = [("g%d" % g, k, k, "x" * (4 * r.randint(1, 200))) for g in range(8) for k in range(12)]
    want = {}
    for g in {x[0] for x in items}:
        left, taken, cut = 500, [], 0
        for _, i, _, s in sorted((x for x in items if x[0] == g), key=lambda x: x[2]):
            n = len(s) // 4
            if left > 50 and n <= left:
                taken, left = [*taken, i], left - n
            elif left > 100 and n > left:
                taken, cut, left = [*taken, i], left, 0
        want[g] = (",".join(map(str, taken)), cut)
    got = context.pack_priority(spark.createDataFrame(items, "g string, id long, rank long, text string"), 500, "g")
    assert {x.g: (x.taken, x.cut) for x in got.collect()} == want


def test_ordered_distinct_reads_whole_texts(spark):
    from tessera.plans import QUERIES

    from .conftest import SF

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.words for r in QUERIES["ordered_distinct"](spark, SF).collect()}
    assert got == {i: " ".join(dict.fromkeys(s.split(" "))) for i, s in texts.items()}


def test_answer_context(spark):
    from tessera.plans import QUERIES

    from .conftest import SF

    rows = QUERIES["rag_context"](spark, SF).collect()
    room, order = {}, {}
    for r in rows:
        room[r.query_id, r.section] = room.get((r.query_id, r.section), 0) + r.tokens
        order.setdefault((r.query_id, r.section), []).append(r["rank"])
    shares = {k: {**v, "chunks": 1 - sum(v.values())} for k, v in context.SHARES.items()}
    intent = {r.query_id: r.intent for r in rows}
    assert rows and all(n <= round(2000 * shares[intent[q]][s]) for (q, s), n in room.items())
    assert {r.section for r in rows} >= {"overview", "symbols", "chunks", "modules"} and len(set(intent.values())) >= 4


def test_answer_context_fetches_what_fits(spark):
    """Contents are joined to the chunks that fit; chunks that share an id all come, each as often as it is there."""
    q = spark.createDataFrame([("q", "tell me more")], "query_id string, text string")
    files = spark.createDataFrame([("f", "en", 1, 1)], "file_id string, language string, line_count long, doc_id long")
    symbols = spark.createDataFrame([], "symbol_id string, file_id string, name string, kind string, line long")
    edges = spark.createDataFrame([], "src long, dst long")
    chunks = spark.createDataFrame([("a", "x" * 8), ("a", "y" * 8), ("a", "y" * 8), ("b", "z" * 4000), ("c", "u")], "chunk_id string, content string")
    best = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, id string, rank long")
    d = context.answer_context(q, files, chunks, symbols, edges, budget=1000, best=best)
    got = sorted((r.section, r["rank"], r.id, r.tokens, r.content) for r in d.collect())
    whole = "Files: 1; languages: en"
    assert got == [("chunks", 1, "a", 2, "x" * 8), ("chunks", 1, "a", 2, "y" * 8), ("chunks", 1, "a", 2, "y" * 8), ("overview", 1, "overview", len(whole) // 4, whole)]
    branch = d._jdf.queryExecution().optimizedPlan().toString().split("\n+- ")[-1]
    assert branch.index("Join") < branch.index("Window")  # the contents are joined to what the budget leaves


def test_fusion_by_language_gives_that_language_only(spark):
    """Every list is filtered, by vectors, texts and symbols; vectors are searched behind the filter, not cut before it."""
    from collections import Counter

    from tessera.plans import QUERIES
    from tessera.plans.analysis import ranked_lists
    from tessera.plans.registry import Tables

    from .conftest import SF

    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["rrf_lang"](spark, SF).collect()
    assert rows and {lang.get(r.id) for r in rows} == {"en"}
    vectors = [r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()]
    dense, _, named = (x.collect() for x in ranked_lists(Tables(spark, SF), "lang = 'en'"))
    of = [v for v in vectors if lang.get(v) == "en"]
    assert Counter(r.query_id for r in dense) == {v: min(40, len(of) - (v in of)) for v in vectors if v % 100 == 0}
    for q in {r.query_id for r in named}:
        mine = sorted(r["rank"] for r in named if r.query_id == q)
        assert mine == list(range(1, len(mine) + 1))


def test_git_changes_and_file_lists(spark, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@x.org", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a").write_text("1")
    (tmp_path / "b").write_text("1")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "a").write_text("2")
    (tmp_path / "b").unlink()
    (tmp_path / "c").write_text("1")
    git("add", "-A")
    git("commit", "-qm", "two")
    assert {tuple(r) for r in tree.git_changes(spark, str(tmp_path)).collect()} == {("a", "changed"), ("b", "deleted"), ("c", "new")}
    with pytest.raises(RuntimeError):
        tree.git_changes(spark, str(tmp_path), "no-such-commit")
    assert {tuple(r) for r in tree.split_by_existence(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()} == {(str(tmp_path / "a"), "changed"), (str(tmp_path / "b"), "deleted")}


def test_directory_into_a_store(spark, tmp_path):
    from tessera.sources import ingest

    for p, s in {"pkg/__init__.py": "", "pkg/a.py": "class A:\n    pass\n", "main.py": "from pkg import a\nimport pkg.b, os\n\ndef run():\n    pass\n", "pkg/b.py": "x = 1\n", "dist/z.py": "def no(): pass\n"}.items():
        (tmp_path / "repo" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / p).write_text(s)
    s = store.Store(spark, str(tmp_path / "store"))
    ingest.ingest_directory(spark, str(tmp_path / "repo"), s, ["py"])
    assert {tuple(r) for r in s.load("edges").collect()} == {("main.py", "pkg/a.py"), ("main.py", "pkg/b.py")}
    assert {(r.file_id, r.name) for r in s.load("symbols").collect()} == {("pkg/a.py", "A"), ("main.py", "run")}
    assert {r.file_id for r in s.load("files").collect()} == {"pkg/__init__.py", "pkg/a.py", "main.py", "pkg/b.py"}


def test_usage_by_window_as_a_stream(spark, tmp_path):
    feed = tmp_path / "events"
    spark.createDataFrame([("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:50:00", 2.0), ("b", "2024-01-01 01:10:00", 4.0), ("b", "2024-01-02 00:00:00", 8.0)], "provider string, ts string, cost double").selectExpr("provider", "cast(ts as timestamp) as ts", "cost").write.parquet(str(feed))
    stream = spark.readStream.schema("provider string, ts timestamp, cost double").parquet(str(feed))
    out = changes.usage_by_window(stream).writeStream.format("memory").queryName("usage_seen").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    out.awaitTermination(60)
    assert {(r.provider, r.n, r.cost) for r in spark.table("usage_seen").collect()} == {("a", 2, 3.0), ("b", 1, 4.0), ("b", 1, 8.0)}


@pytest.mark.parametrize("language,body,want", [
    ("go", "import \"fmt\"\n\ntype A struct {\n  x int\n}\n\nfunc (a A) Run() {\n  return\n}\n", {("import", 1, 1), ("class", 3, 5), ("function", 7, 9)}),
    ("rust", "use std::io;\nimpl A {\n  fn f() {\n  }\n}\n", {("import", 1, 1), ("class", 2, 5), ("method", 3, 4)}),
    ("c", "#include <a.h>\nint f(int x) {\n  return x;\n}\n", {("import", 1, 1), ("function", 2, 4)}),
    ("ruby", "require 'x'\nclass A\n  def f\n  end\nend\n", {("import", 1, 1), ("class", 2, 5), ("method", 3, 4)}),
    ("csharp", "using System;\nclass A {\n  public int F() {\n  }\n}\n", {("import", 1, 1), ("class", 2, 5), ("method", 3, 4)}),
    ("php", "use A;\nfunction f() {\n}\n", {("import", 1, 1), ("function", 2, 3)}),
])
def test_parse_other_languages(language, body, want):
    assert {(r[0], r[2], r[3]) for r in parsing.parse_patterns(body, language)} == want


def test_templates(spark):
    from tessera.operators import pages

    with pytest.raises(ValueError):
        pages.render("no such", x=F.lit(1))
    with pytest.raises(ValueError):
        pages.render("answer_question", question=F.lit("x"))


def test_a_context_by_scan_and_by_index(spark, tmp_path):
    from tessera.engine import Engine

    e = Engine(spark, str(tmp_path / "store"))
    e.ingest(spark.createDataFrame([(f"m{i}.py", "python", f"import m{i + 1}\n\ndef load_{i}():\n    return 'the public helper {i % 3}'\n") for i in range(8)], "file_id string, language string, text string"))
    asked = spark.createDataFrame([("a", "how is load_1 implemented, public helper 2"), ("b", "what is the architecture of load_2 and load_3"), ("c", ""), ("d", None)], "query_id string, text string")
    f = e.table("files").select("*", F.col("file_id").alias("doc_id"))
    scanned = context.answer_context(asked, f, e.table("chunks"), e.table("symbols"), e.table("edges"), 2000)
    got, want = ({tuple(r) for r in d.collect()} for d in (e.context(asked), scanned))
    assert got == want and {"chunks", "symbols"} <= {r[2] for r in got if r[0] == "a"} and "dependencies" in {r[2] for r in got if r[0] == "b"}


def test_engine(spark, tmp_path):
    from tessera.engine import Engine

    e = Engine(spark, str(tmp_path / "store"))
    e.ingest(spark.createDataFrame([("helpers.py", "python", "def load_all():\n    return 'the public helper'\n"), ("app.py", "python", "import helpers\n\nclass App:\n    pass\n"), ("cli.py", "python", "import app\n")], "file_id string, language string, text string"))
    assert [r.file_id for r in e.lookup_symbol("load_all").collect()] == ["helpers.py"] and e.lookup_symbol("none").count() == 0
    assert {r.file for r in e.who_references("load_all").collect()} == {"app.py"}
    assert {r.hit for r in e.impact(spark.createDataFrame([("helpers.py",)], "file string")).collect()} == {"app.py", "cli.py"}
    assert [(r.n_symbols, r.n_out, r.n_in) for r in e.file_summary("app.py").collect()] == [(1, 1, 1)]
    assert [r.id for r in e.retrieve("public helper", no_such_filter=1).collect()] == ["helpers.py#L1-L2"] and e.retrieve("public", language="go").count() == 0
    got = [(r.source, r.id) for r in e.search("App", 5).orderBy("rank").collect()]
    assert got[0][0] == 0 and (1, "app.py::class::App::L3") in got
    near = spark.createDataFrame([("0", "cli.py#L1-L1", 1)], "query_id string, id string, rank long")
    assert "cli.py#L1-L1" in {r.id for r in e.search("App", 5, near).collect()}
    assert {r.section for r in e.context("what is defined in load_all() of helpers.py?").collect()} >= {"overview", "symbols"} - {"symbols"}
    assert e.analyze("how do I use load_all() and getUser?").first().symbols == ["I", "getUser", "load_all"]
    assert set(e.register_views("t_")) >= {"t_files", "t_chunks"} and spark.sql("select count(*) n from t_files").first().n == 3


def test_watched_folder_into_the_store(spark, tmp_path):
    from tessera.streaming import files

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text("x = 1\n")
    s = store.Store(spark, str(tmp_path / "store"))
    for k in range(2):
        changes.apply_changes(files.watch(spark, str(tmp_path / "in")), s, "files", str(tmp_path / "cp")).awaitTermination(60)
        assert {(r.file_id, r.language) for r in s.load("files").collect()} == ({("a.py", "python")} if not k else {("a.py", "python"), ("x/a.py", "python"), ("b.md", "markdown")})
        (tmp_path / "in" / "b.md").write_text("# b\n")
        (tmp_path / "in" / "x").mkdir(exist_ok=True)
        (tmp_path / "in" / "x" / "a.py").write_text("y = 1\n")


def test_subword_counts(spark, tmp_path):
    import base64

    from tessera.functions.tokenizers import subword_count

    pieces = [bytes([i]) for i in range(256)] + [b"ab", b"abc"]
    (tmp_path / "ranks").write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % i for i, p in enumerate(pieces)))
    d = spark.createDataFrame([("abc abc",), ("",), (None,), ("xyz",)], "t string")
    assert [r.n for r in d.select(subword_count(F.col("t"), str(tmp_path / "ranks"), r"\S+|\s+").alias("n")).collect()] == [3, 0, None, 3]


def test_first_named_meets_queries_with_the_first_rows_of_a_term(spark):
    """Against a loop; queries are joined to the first rows of each term, not to all that have it."""
    r, n = random.Random(3), 4
    named = [(f"t{r.randrange(6)}", None if i % 97 == 0 else r.randrange(40), r.randrange(9)) for i in range(400)] + [(None, 1, 1)]
    asked = [(q, f"t{t}") for q in range(20) for t in {q % 7, q % 3}] + [(99, None)]
    want = []
    for q in {q for q, _ in asked}:
        first = {}
        for t, i, line in named:
            if t is not None and (q, t) in asked:
                first[i] = min(first.get(i, line), line)
        order = sorted(first, key=lambda i: (first[i], i is not None, i or 0))
        want += [(q, i, k + 1) for k, i in enumerate(order[:n])]
    got = fusion.first_named(spark.createDataFrame(named, "term string, id long, line long"), spark.createDataFrame(asked, "query_id long, term string"), n)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and len(want) == 20 * n
    plan = analysis.named(registry.Tables(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit [term" in plan


def test_ingest_parses_texts_once(spark, tmp_path):
    """What the parser gave is written and read by all tables; the texts give the same twice."""
    texts = [("a.py", "python", '"""Doc."""\nimport b\nclass A:\n    def f(self):\n        pass\n'), ("b.py", "python", "def g(:\n"), ("b.js", "javascript", "/** M */\nfunction g() {}\n"), ("c.go", "go", "func h() {}\n"), ("d.txt", "text", "x"), ("e.py", "python", None), ("f", None, "class")]
    src = spark.createDataFrame(texts, "file_id string, language string, text string")
    once = metadata.read(ingest.sized(src))
    rows = lambda d, *c: sorted(map(tuple, d.select(*c).collect()), key=repr)
    assert rows(once, "file_id", *metadata.FIELDS) == rows(metadata.extract(src), "file_id", *metadata.FIELDS)
    found = ["file_id", "kind", "name", "start_line", "end_line", "parents"]
    assert rows(once.select("file_id", F.inline("found")), *found) == rows(parsing.parse(src).where("kind <> 'module'"), *found)
    kept = store.Store(spark, str(tmp_path))
    ingest.ingest(src, kept)
    for name, df in ingest.tables(src).items():
        assert rows(kept.load(name), *df.columns) == rows(df, *df.columns)
    assert kept._names(f"{tmp_path}/_read") == []
    assert "MapInPandas" not in ingest.tables(src, read=once)["symbols"]._jdf.queryExecution().optimizedPlan().toString()
