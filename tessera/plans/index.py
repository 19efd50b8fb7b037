"""Queries over sources and their metadata, the tables of a store, sessions and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sql
from ..functions import paths
from ..operators import chunking, dense, docs, metadata, pages, parsing, usage
from ..operators.incremental import snapshot_diff
from ..sources import ingest, tree
from ..sources.chat import Sessions
from ..sources.store import Store
from .analytics import BM, DIFF, calls, edges, new, old
from .documents import chunks, files, symbols
from .registry import query

# --- sources of a code base, made from the documents: every fourth one Python, JavaScript, Java or text

BODY = {
    "python": 'import os\nfrom @S import doc_@N\n\nclass A@I(Base):\n    """Doc @I."""\n    def f@I(self):\n        return "class No: { @T"\n\ndef g@I():\n    return 2  # def no():\n',
    "javascript": "import x from './x'\nconst y = require('./y')\n\n/** Module @I. */\nclass A@I {\n  run() { return \"} @T\"; } // class No {\n}\n\nfunction g@I() {\n  return '}' + `}${\"{\"} function no() {`;\n}\nconst h@I = (a) => {\n  return a;\n}\n",
    "java": "import java.util.List;\n\n/** Class @I. */\npublic class A@I {\n  public int f@I(int a) {\n    return a; /* } class No { @T */\n  }\n}\ninterface B@I {}\n",
    "text": "Notes @I\nof @S\n@T\n",
}
ENDS = {"python": "py", "javascript": "js", "java": "java", "text": "txt"}


def sources(t) -> DataFrame:
    """doc_id, file_id, language, text: sources that quote the beginning of their document in strings and comments."""
    kind = F.element_at(F.array(*map(F.lit, BODY)), (F.col("doc_id") % 4 + 1).cast("int"))
    body = F.element_at(F.array(*map(F.lit, BODY.values())), (F.col("doc_id") % 4 + 1).cast("int"))
    i = F.col("doc_id").cast("string")
    said = F.regexp_replace(F.left("text", F.lit(200)), "[^A-Za-z ]", "")
    body = F.replace(F.replace(F.replace(F.replace(body, F.lit("@I"), i), F.lit("@S"), F.col("source")), F.lit("@N"), (F.col("doc_id") + 20).cast("string")), F.lit("@T"), said)
    path = F.concat("source", F.lit("/doc_"), i, F.lit("."), F.element_at(F.array(*map(F.lit, ENDS.values())), (F.col("doc_id") % 4 + 1).cast("int")))
    return t.documents.select("doc_id", path.alias("file_id"), kind.alias("language"), body.alias("text"))


def sql_string(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


SRC = "src AS (SELECT doc_id, source, regexp_replace(left(text, 200), '[^A-Za-z ]', '', 'g') AS said, source || '/doc_' || doc_id || '.' || (['" + "','".join(ENDS.values()) + "'])[doc_id % 4 + 1] AS file_id, (['" + "','".join(BODY) + "'])[doc_id % 4 + 1] AS language, replace(replace(replace(replace(([" + ", ".join(sql_string(x) for x in BODY.values()) + "])[doc_id % 4 + 1], '@I', CAST(doc_id AS VARCHAR)), '@S', source), '@N', CAST(doc_id + 20 AS VARCHAR)), '@T', regexp_replace(left(text, 200), '[^A-Za-z ]', '', 'g')) AS text FROM documents)"


#: What each line of a source declares: imports, class, function.
LINE = {
    "imports": "CASE WHEN language = 'text' THEN NULL WHEN starts_with(x, 'import ') OR starts_with(x, 'from ') OR contains(x, ' = require(') THEN rtrim(x, ';') END",
    "classes": "nullif(CASE WHEN language <> 'text' AND starts_with(x, 'class ') THEN split_part(split_part(split_part(x, ' ', 2), '(', 1), ' ', 1) WHEN language = 'java' AND starts_with(x, 'public class ') THEN split_part(x, ' ', 3) WHEN language = 'java' AND starts_with(x, 'interface ') THEN split_part(x, ' ', 2) END, '')",
    "functions": "CASE WHEN language = 'python' AND starts_with(ltrim(x), 'def ') THEN split_part(split_part(ltrim(x), ' ', 2), '(', 1) WHEN language = 'javascript' AND (starts_with(x, 'function ') OR contains(x, ' = (')) THEN split_part(split_part(x, ' ', 2), '(', 1) WHEN language = 'java' AND starts_with(x, '  public int ') THEN split_part(split_part(x, 'int ', 2), '(', 1) END",
    "docstring": "CASE WHEN contains(x, '\"\"\"') THEN split_part(x, '\"\"\"', 2) WHEN starts_with(x, '/** ') THEN split_part(split_part(x, '/** ', 2), ' */', 1) END",
}


@query("source_metadata", "WITH " + SRC + ", ln AS (SELECT file_id, language, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM src) SELECT file_id, " + ", ".join(f"coalesce(string_agg({LINE[n]}, '|' ORDER BY i), '') AS {n}" for n in ("imports", "classes", "functions")) + f", min({LINE['docstring']}) AS docstring FROM ln GROUP BY file_id")
def source_metadata(t):
    d = metadata.extract(sources(t))
    return d.select("file_id", *(F.array_join(c, "|").alias(c) for c in ("imports", "classes", "functions")), "docstring")


#: Language, kind, name, first and last line, parent: what the bodies define.
DEFINED = [
    ("python", "import", "import os", 1, 1, ""), ("python", "import", "from @S import doc_@N", 2, 2, ""), ("python", "class", "A@I", 4, 7, ""), ("python", "method", "f@I", 6, 7, "A@I"), ("python", "function", "g@I", 9, 10, ""),
    ("javascript", "import", "import x from './x'", 1, 1, ""), ("javascript", "import", "const y = require('./y')", 2, 2, ""), ("javascript", "class", "A@I", 5, 7, ""), ("javascript", "function", "g@I", 9, 11, ""), ("javascript", "function", "h@I", 12, 14, ""),
    ("java", "import", "import java.util.List;", 1, 1, ""), ("java", "class", "A@I", 4, 8, ""), ("java", "method", "f@I", 5, 7, "A@I"), ("java", "class", "B@I", 9, 9, ""), ("text", "module", "@F", 1, 4, ""),
]
_PUT = "replace(replace(replace(replace({}, '@I', CAST(doc_id AS VARCHAR)), '@S', source), '@N', CAST(doc_id + 20 AS VARCHAR)), '@F', file_id)"
PARSED = SRC + ", df(language, kind, name, a, b, parent) AS (VALUES " + ", ".join("(" + ", ".join(sql_string(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in DEFINED) + "), ps AS (SELECT file_id, language, kind, " + _PUT.format("name") + " AS name, CAST(a AS BIGINT) AS start_line, CAST(b AS BIGINT) AS end_line, " + _PUT.format("parent") + " AS parent, doc_id, source FROM src JOIN df USING (language))"


@query("parse_sources", "WITH " + PARSED + " SELECT file_id, kind, name, start_line, end_line, parent FROM ps")
def parse_sources(t):
    return parsing.parse(sources(t)).select("file_id", "kind", "name", "start_line", "end_line", F.array_join("parents", ",").alias("parent"))


@query("symbol_table", "WITH " + PARSED + " SELECT file_id, name, CAST(start_line AS VARCHAR) AS lines FROM ps WHERE kind IN ('class', 'function', 'method')")
def symbol_table(t):
    d = parsing.symbol_table(parsing.parse(sources(t)))
    return d.select("file_id", "name", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


@query("nodes_of_type", "WITH " + PARSED + " SELECT file_id, name, row_number() OVER (PARTITION BY file_id ORDER BY start_line) AS rank FROM ps WHERE kind IN ('class', 'method')")
def nodes_of_type(t):
    return parsing.nodes_of(parsing.parse(sources(t)), "class", "method").select("file_id", "name", "rank")


@query("import_edges", "SELECT f.file_id AS source, 'from ' || f.source || ' import doc_' || (f.doc_id + 20) || ', missing' AS raw_text, g.file_id AS target FROM {files} f LEFT JOIN files g ON g.source = f.source AND g.doc_id = f.doc_id + 20")
def import_edges(t):
    modules = files(t).select(F.concat_ws(".", "source", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))).alias("module"), "file_id")
    imports = files(t).select(F.col("file_id").alias("source"), F.concat(F.lit("from "), F.col("source"), F.lit(" import doc_"), (F.col("doc_id") + 20).cast("string"), F.lit(", missing")).alias("raw_text"))
    return docs.resolve_imports(imports, modules)


@query("chunk_strategies", "SELECT file_id, language, start_line, end_line, 'sliding' AS chunk_type FROM {chunks} WHERE language = 'en' UNION ALL SELECT file_id, language, 1, line_count, 'whole' FROM {files} WHERE language <> 'en'")
def chunk_strategies(t):
    cut = chunking.pipeline(files(t), {"en": ("sliding", {"size": 10, "overlap": 2})})
    return cut.select("file_id", "language", "start_line", "end_line", "chunk_type")


@query("chunk_embeddings", "SELECT chunk_id, array_to_string(list_transform(range(0, 8), lambda i: CAST(round((CAST(('0x' || substr(sha256(content), 2 * i + 1, 2)) AS INT) / 127.5::DOUBLE - 1) * 1000) AS INT)), ',') AS vector FROM {chunks}")
def chunk_embeddings(t):
    v = dense.embed(chunks(t).select("chunk_id", "content"), "content")
    return v.select("chunk_id", F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("int").cast("string")), ",").alias("vector"))


# --- the tables of a store, written to the shared folder and read back

EDGES = "SELECT a.file_id AS src, b.file_id AS dst FROM src a JOIN src b ON b.doc_id = a.doc_id + 20 AND b.source = a.source WHERE a.language = 'python'"


@query("ingest_counts", "WITH " + PARSED + " SELECT 'files' AS name, count(*) AS n FROM src UNION ALL SELECT 'chunks', count(*) FROM src UNION ALL SELECT 'embeddings', count(*) FROM src UNION ALL SELECT 'symbols', count(*) FROM ps WHERE kind IN ('class', 'method', 'function') UNION ALL SELECT 'imports', count(*) FROM ps WHERE kind = 'import' UNION ALL SELECT 'edges', count(*) FROM (" + EDGES + ")")
def ingest_counts(t):
    store = Store(t.spark, t.scratch())
    ingest.ingest(sources(t), store)
    out = None
    for name in ("files", "chunks", "embeddings", "symbols", "imports", "edges"):
        n = store.load(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("ingest_edges", "WITH " + SRC + " " + EDGES)
def ingest_edges(t):
    return ingest.tables(sources(t))["edges"]


@query("ingest_update", "WITH " + PARSED + " SELECT file_id, name, kind FROM ps WHERE kind IN ('class', 'method', 'function') AND doc_id % 8 <> 0 UNION ALL SELECT file_id, 'only' || doc_id, 'function' FROM src WHERE doc_id % 8 = 0")
def ingest_update(t):
    """All sources, and then new texts of every eighth file in the place of the old."""
    store, s = Store(t.spark, t.scratch()), sources(t)
    ingest.ingest(s, store)
    changed = s.where("doc_id % 8 = 0").withColumn("text", F.concat(F.lit("def only"), F.col("doc_id").cast("string"), F.lit("():\n    pass\n")))
    ingest.ingest(changed, store, replace=False)
    return store.load("symbols").select("file_id", "name", "kind")


@query("store_versions", "SELECT doc_id, CASE WHEN doc_id % 10 = 2 THEN text || 'x' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 3")
def store_versions(t):
    """Append the documents twice (the second adds none), put some in the place of others, delete some, drop old versions."""
    store, d = Store(t.spark, t.scratch()), t.documents.select("doc_id", "text")
    for _ in range(2):
        store.append("docs", d, "doc_id")
    store.replace_files("docs", d.where("doc_id % 10 = 2").withColumn("text", F.concat("text", F.lit("x"))), "doc_id")
    store.delete_files("docs", d.where("doc_id % 10 = 3"), "doc_id")
    store.clean("docs")
    return store.load("docs")


@query("store_cleared", "SELECT source, count(*) AS held, CAST(0 AS BIGINT) AS n FROM documents GROUP BY source")
def store_cleared(t):
    """Rows of each source before and after the tables are cleared; the columns stay."""
    store, count = Store(t.spark, t.scratch()), F.count(F.lit(1))
    store.save("docs", t.documents.select("doc_id", "source", "text"))
    held = t.written(store.load("docs").groupBy("source").agg(count.alias("held")), "held")
    store.clear()
    return held.join(store.load("docs").groupBy("source").agg(count.alias("n")), "source", "left").fillna(0, ["n"])


@query("overrides_exchange", "SELECT doc_id, quality, toxic FROM labels WHERE doc_id IS NOT NULL")
def overrides_exchange(t):
    """Exported as JSON and imported by another store."""
    a, b = Store(t.spark, t.scratch()), Store(t.spark, t.scratch())
    a.save("overrides", t.labels.select("doc_id", "quality", "toxic"))
    a.export_json("overrides", f"{a.root}/out")
    b.save("overrides", t.labels.select("doc_id", "quality", "toxic").limit(0))
    b.import_json("overrides", f"{a.root}/out", "doc_id")
    return b.load("overrides")


@query("snapshot_saved", DIFF)
def snapshot_saved(t):
    """The hashes of a run are kept; the next run differs from what it reads. A first run has none to read."""
    store, hashed = Store(t.spark, t.scratch()), lambda d: d.select("doc_id", F.sha2("text", 256).alias("hash"))
    store.save("hashes", store.load_or_empty("hashes", "doc_id long, hash string").unionByName(hashed(old(t))))
    return snapshot_diff(store.load("hashes"), hashed(new(t)), "doc_id", "hash")


@query("last_run", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def last_run(t):
    """The record of the last generation among those kept."""
    store = Store(t.spark, t.scratch())
    store.append("runs", t.events.select("event_id", "ts"), "event_id")
    return store.load("runs").orderBy(F.desc("ts"), F.desc("event_id")).limit(1)


@query("dependencies_saved", "SELECT src, string_agg(dst, ',' ORDER BY dst) AS sources FROM {edges} GROUP BY src")
def dependencies_saved(t):
    store = Store(t.spark, t.scratch())
    store.save("docs", edges(t).groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("sources")))  # at most two a document
    return store.load("docs").select("src", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))


@query("usage_saved", "WITH g AS (SELECT provider, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens, sum(cost) AS c, avg(cost) AS a FROM {usage} GROUP BY provider) SELECT provider, requests, tokens, round(c, 4) AS cost, round(sum(c) OVER () / sum(requests) OVER (), 4) AS avg_all, round(a, 4) AS avg_own FROM g")
def usage_saved(t):
    store = Store(t.spark, t.scratch())
    store.append("usage", calls(t), "event_id")
    return usage.by_provider(store.load("usage"))


@query("chat_sessions", "SELECT conv_id AS session_id, CASE WHEN conv_id % 2 = 0 THEN 'talk ' || conv_id ELSE 'Chat Session - 2024-01-01 00:00:00' END AS name, CAST(count(*) AS BIGINT) AS n FROM conversations WHERE role IN ('user', 'assistant', 'system') GROUP BY conv_id ORDER BY max(turn) DESC, conv_id LIMIT 10")
def chat_sessions(t):
    """Sessions and messages are added (twice: the second adds none; other roles and unknown sessions are left out)."""
    chat, c = Sessions(Store(t.spark, t.scratch())), t.conversations
    s = c.select("conv_id").distinct().select(F.col("conv_id").alias("session_id"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("talk "), F.col("conv_id").cast("string"))).alias("name"), F.lit("here").alias("codebase"), F.lit("2024-01-01").cast("timestamp").alias("started"))
    m = c.select(F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.col("conv_id").alias("session_id"), "role", F.col("text").alias("content"), F.lit(None).cast("string").alias("metadata"), F.col("turn").alias("at"))
    bad = m.where("at = 0").select(F.concat("message_id", F.lit("?")).alias("message_id"), "session_id", F.lit("tool").alias("role"), "content", "metadata", "at")
    for _ in range(2):
        chat.start(s)
        chat.add(m.unionByName(bad).unionByName(m.withColumn("session_id", F.col("session_id") + 1_000_000).withColumn("message_id", F.concat("message_id", F.lit("!")))))
    return chat.recent(10).select("session_id", "name", "n")


@query("file_tree", "SELECT 'source=' || source || '/lang=' || lang AS dir, 'text' AS language, CAST(sum(strlen(text) + 1) AS BIGINT) AS size_bytes FROM documents WHERE source NOT IN ('src3') GROUP BY ALL")
def file_tree(t):
    """The documents written as text files by source and language, and scanned; the directory of one source is skipped."""
    root = t.scratch()
    t.documents.select("source", "lang", "text").write.partitionBy("source", "lang").text(root)
    d = tree.scan(t.spark, root, ["txt"], skipped=(*tree.SKIPPED, "source=src3"))
    return d.groupBy(paths.directory(F.col("path")).alias("dir"), "language").agg(F.sum("size_bytes").alias("size_bytes"))


# --- the same from SQL alone, by functions that the session has


def session(t) -> None:
    """Registers the functions and the views that they read."""
    e = edges(t).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    sql.register(t.spark, {"files": files(t), "chunks": chunks(t), "symbols": symbols(t), "edges": e, "sources": sources(t)}, "tessera_")


@query("sql_search", BM + "SELECT id AS chunk_id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM r ORDER BY score DESC, id LIMIT 10")
def sql_search(t):
    session(t)
    return t.spark.sql("SELECT chunk_id, score, rank FROM tessera_search_chunks('Public license', 10)")


@query("sql_chunks", "SELECT file_id, start_line, end_line, content FROM {chunks}")
def sql_chunks(t):
    session(t)
    return t.spark.sql("SELECT f.file_id, c.start_line, c.end_line, c.content FROM tessera_files f, LATERAL tessera_sliding_chunks(f.text, 10, 2) c")


@query("sql_parse", "WITH " + PARSED + " SELECT language, kind, count(*) AS n, count(DISTINCT name) AS names FROM ps WHERE kind <> 'module' GROUP BY ALL")
def sql_parse(t):
    session(t)
    return t.spark.sql("SELECT s.language, p.kind, count(*) AS n, count(DISTINCT p.name) AS names FROM tessera_sources s, LATERAL tessera_parse_source(s.text, s.language) p GROUP BY s.language, p.kind")


@query("sql_impact", "WITH h AS (SELECT dst AS changed, src AS hit, 1 AS steps FROM {edges} UNION ALL SELECT a.dst, b.src, 2 FROM edges a JOIN edges b ON b.dst = a.src) SELECT CAST(changed AS VARCHAR) AS changed, f.source, CAST(hit AS VARCHAR) AS hit, min(steps) AS steps FROM h JOIN documents f ON f.doc_id = changed WHERE hit <> changed GROUP BY ALL")
def sql_impact(t):
    session(t)
    return t.spark.sql("SELECT f.changed, f.source, i.file_id AS hit, i.steps FROM (SELECT CAST(doc_id AS STRING) AS changed, source FROM tessera_files) f, LATERAL tessera_impact_of(f.changed) i")


# --- pages

NAMES = ["index.md", "guides/getting-started.md", "api/index.md"]
PAGES = "pg AS (SELECT 'api/' || file_id || '.md' AS page, '# Doc ' || doc_id || chr(10) || 'body' AS text FROM {files} UNION ALL SELECT DISTINCT 'modules/' || source || '_x/index.md', 'no heading' FROM files UNION ALL SELECT unnest(['index.md', 'guides/getting-started.md', 'api/index.md', 'other/x.md']), chr(10) || '# Top' || chr(10)), sc AS (SELECT *, CASE WHEN page = 'index.md' THEN 0 WHEN starts_with(page, 'guides/') THEN 1 WHEN starts_with(page, 'modules/') THEN 2 WHEN page = 'api/index.md' THEN 3 WHEN starts_with(page, 'api/') THEN 4 END AS place FROM pg)"
TITLE = "CASE WHEN starts_with(text, '# Doc') THEN substr(string_split(text, chr(10))[1], 3) WHEN text = 'no heading' THEN 'index' ELSE 'Top' END"


def made_pages(t) -> DataFrame:
    f = files(t)
    out = f.select(F.concat(F.lit("api/"), "file_id", F.lit(".md")).alias("page"), F.concat(F.lit("# Doc "), F.col("doc_id").cast("string"), F.lit("\nbody")).alias("text"))
    out = out.unionByName(f.select("source").distinct().select(F.concat(F.lit("modules/"), "source", F.lit("_x/index.md")).alias("page"), F.lit("no heading").alias("text")))
    return out.unionByName(t.spark.createDataFrame([(x, "\n# Top\n") for x in [*NAMES, "other/x.md"]], "page string, text string"))


@query("llms_index", "WITH " + PAGES + " SELECT -1 AS place, '' AS page, '# Site' || chr(10) || chr(10) || '> About' || chr(10) AS line UNION ALL SELECT DISTINCT place, '', chr(10) || '## ' || (['Overview', 'Guides', 'Modules', 'API Reference', 'Files'])[place + 1] || chr(10) FROM sc WHERE place IS NOT NULL UNION ALL SELECT place, page, '- [' || " + TITLE + " || '](' || page || ')' FROM sc WHERE place IS NOT NULL")
def llms_index(t):
    return pages.index_lines(made_pages(t), "Site", "About")


@query("llms_full", "WITH " + PAGES + " SELECT place, page, chr(10) || '---' || chr(10) || chr(10) || '<!-- ' || page || ' -->' || chr(10) || chr(10) || text AS text FROM sc WHERE place IS NOT NULL")
def llms_full(t):
    return pages.full_text(made_pages(t))


@query("site_navigation", "WITH " + PAGES + " SELECT 0 AS place, 'Home' AS section, 'Home' AS title, 'index.md' AS page UNION ALL SELECT 1, 'Guides', 'Getting Started', page FROM pg WHERE starts_with(page, 'guides/') UNION ALL SELECT 2, 'Modules', upper(substr(page, 9, 1)) || replace(substr(string_split(page, '/')[2], 2), '_x', ' X'), page FROM pg WHERE starts_with(page, 'modules/') UNION ALL SELECT 3, 'API Reference', 'API Reference', 'api/index.md' FROM (SELECT 1)")
def site_navigation(t):
    return pages.navigation(made_pages(t))


@query("explorer_html", "WITH c AS (SELECT language AS place, count(*) AS n, list_sort(list(file_id))[1:5] AS a FROM {files} GROUP BY language) SELECT '' AS place, '<h2>Repository Statistics</h2><p>Total Files: ' || count(*) || '</p><p>Total Lines: ' || CAST(sum(line_count) AS BIGINT) || '</p><p>Languages: ' || count(DISTINCT language) || '</p>' AS html FROM files UNION ALL SELECT place, '<h3>' || upper(place[1]) || place[2:] || '</h3><p>Files: ' || n || '</p><ul>' || array_to_string(list_transform(a, lambda x: '<li>' || string_split(x, '/')[-1] || '</li>'), '') || CASE WHEN n > 5 THEN '<li><em>... and ' || (n - 5) || ' more files</em></li>' ELSE '' END || '</ul>' FROM c")
def explorer_html(t):
    return pages.explorer(files(t), F.col("language"))


@query("answer_links", "SELECT doc_id, 'see [a/doc_' || doc_id || '.py:3-4](u' || doc_id || ') and none.py, [doc_' || doc_id || '.py](u' || doc_id || ').' AS answer FROM documents")
def answer_links(t):
    i = F.col("doc_id").cast("string")
    said = F.concat(F.lit("see a/doc_"), i, F.lit(".py:3-4 and none.py, doc_"), i, F.lit(".py."))
    names, urls = F.array(F.lit("z.py"), F.concat(F.lit("src/a/doc_"), i, F.lit(".py"))), F.array(F.lit("z"), F.concat(F.lit("u"), i))
    return t.documents.select("doc_id", pages.linked(said, names, urls).alias("answer"))


@query("prompt_templates", "SELECT doc_id, 'Question: about ' || source || chr(10) || chr(10) || 'Context:' || chr(10) || lang AS answer, 'costs $5 in ' || lang AS own FROM documents")
def prompt_templates(t):
    pages.add_template("own", "costs $$5 in ${where}")
    about = F.concat(F.lit("about "), F.col("source"))
    return t.documents.select("doc_id", pages.render("answer_question", question=about, context=F.col("lang")).alias("answer"), pages.render("own", where=F.col("lang")).alias("own"))


def writer(prompt: str) -> str:
    """Stands for a model: the prompt in capitals; none for an empty one."""
    if not prompt:
        raise ValueError("nothing to write about")
    return prompt.upper()


@query("generated_pages", "SELECT 'api/' || file_id || '.md' AS page, CASE WHEN doc_id % 10 = 0 THEN 'nothing to write about' ELSE upper('about ' || doc_id) END AS text, doc_id % 10 = 0 AS failed FROM {files}")
def generated_pages(t):
    """A page for each planned file; an empty prompt makes its page fail, not the run."""
    f = files(t)
    prompts = f.select(F.concat(F.lit("api/"), "file_id", F.lit(".md")).alias("page"), F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.concat(F.lit("about "), F.col("doc_id").cast("string"))).alias("prompt"))
    return pages.generate(docs.page_plan(f).where("kind = 'file'"), prompts, writer)
