"""Queries over languages, frameworks, questions, ranked retrieval and its evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import context, dense, detect, fusion, graph, lexical, metrics
from .analytics import complexity, edges
from .documents import chunks, files, symbols
from .registry import query

LONG = "long"


def quoted(values) -> str:
    """A list of SQL strings."""
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def picked(values: list[str], by: str = "doc_id") -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))


def picked_sql(values: list[str], by: str = "doc_id") -> str:
    return f"([{quoted(values)}])[{by} % {len(values)} + 1]"


# --- paths: file names with every extension and marker there is, dealt to the documents

ENDS = [*paths.LANGUAGES, "PY", "jsx", "zz", "tar.gz"]
MARKERS = sorted({x.replace("*", "app") for names in detect.FRAMEWORKS.values() for x in names}) + [f"x.{e}" for ends in detect.EXTENSIONS.values() for e in ends]


def marker_files(t) -> DataFrame:
    """repo, path, text: a file of a code base for each document, named by MARKERS; manifests have content."""
    json = F.when(F.col("doc_id") % 2 == 0, '{"dependencies": {"react": "1", "next": "2"}}').otherwise('{"devDependencies": {"jest": "1", "vite": "2"}}')
    toml = F.when(F.col("doc_id") % 2 == 0, "[tool.poetry]\n[tool.black]").otherwise('build-backend = "uv_build"\n[tool.pytest.x]\n[tool.pytest]')
    name = picked(MARKERS)
    return t.documents.select((F.col("doc_id") % 23).alias("repo"), F.concat(F.lit("a/"), name).alias("path"), F.when(name == "package.json", json).when(name == "pyproject.toml", toml).otherwise("").alias("text"))


MARKED = "mf AS (SELECT doc_id % 23 AS repo, doc_id, string_split(" + picked_sql(MARKERS) + ", '/')[-1] AS name FROM documents), ex(language, e) AS (VALUES " + ", ".join(f"('{k}', '{e}')" for k, v in detect.EXTENSIONS.items() for e in v) + "), fr(framework, pat) AS (VALUES " + ", ".join(f"('{k}', '{x}')" for k, v in detect.FRAMEWORKS.items() for x in v) + ")"
COUNTED = MARKED + ", lc AS (SELECT repo, language, count(*) AS n FROM mf JOIN ex ON lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) = e GROUP BY ALL)"
FOUND_BY_FILE = "SELECT DISTINCT repo, framework FROM mf JOIN fr ON (contains(pat, '*') AND name LIKE replace(pat, '*', '%')) OR name = pat"
FOUND_BY_CONTENT = "SELECT DISTINCT repo, unnest(CASE WHEN name = 'package.json' THEN CASE WHEN doc_id % 2 = 0 THEN ['react', 'next'] ELSE ['jest', 'vite'] END ELSE CASE WHEN doc_id % 2 = 0 THEN ['poetry', 'black'] ELSE ['uv', 'pytest'] END END) AS framework FROM mf WHERE name IN ('package.json', 'pyproject.toml')"


@query("lang_of_ext", "SELECT doc_id, 'a/b.' || x AS path, CASE " + " ".join(f"WHEN lower(regexp_extract('a/b.' || x, '\\.([A-Za-z0-9]+)$', 1)) = '{e}' THEN '{v}'" for e, v in paths.LANGUAGES.items()) + " END AS detected FROM (SELECT doc_id, " + picked_sql(ENDS) + " AS x FROM documents)")
def lang_of_ext(t):
    d = t.documents.select("doc_id", F.concat(F.lit("a/b."), picked(ENDS)).alias("path"))
    return d.select("doc_id", "path", paths.language_of(F.col("path")).alias("detected"))


@query("detected_languages", "WITH " + COUNTED + " SELECT repo, language, n FROM lc")
def detected_languages(t):
    return detect.language_counts(marker_files(t), "repo")


@query("frameworks_by_file", "WITH " + MARKED + " " + FOUND_BY_FILE)
def frameworks_by_file(t):
    return detect.by_file(marker_files(t), "repo")


@query("frameworks_by_content", "WITH " + MARKED + " " + FOUND_BY_CONTENT)
def frameworks_by_content(t):
    return detect.by_content(marker_files(t), "repo")


HAS = "list_has_any(frameworks, [{}])"
KIND = "CASE WHEN primary_language IS NULL THEN 'unknown' WHEN " + HAS.format(quoted(detect.FRONTEND)) + " THEN 'web_frontend' WHEN list_contains(frameworks, 'nodejs') OR primary_language IN (" + quoted(detect.SCRIPTS) + ") THEN 'web_backend' WHEN " + HAS.format(quoted(detect.MOBILE)) + " THEN 'mobile' WHEN primary_language = 'python' AND " + HAS.format(quoted(detect.NOTEBOOKS)) + " THEN 'data_science' WHEN primary_language IN (" + quoted(detect.DESKTOP) + ") THEN 'desktop' WHEN primary_language IN (" + quoted(detect.SYSTEM) + ") THEN 'system' WHEN " + HAS.format(quoted(detect.PACKAGES)) + " THEN 'library' ELSE primary_language END"


@query("codebase_type", "WITH " + COUNTED + ", pl AS (SELECT repo, min_by(language, (-n, language)) AS primary_language FROM lc GROUP BY repo), fw AS (SELECT repo, list_sort(list(DISTINCT framework)) AS frameworks FROM (" + FOUND_BY_FILE + " UNION " + FOUND_BY_CONTENT + ") GROUP BY repo), r AS (SELECT repo, primary_language, coalesce(frameworks, []) AS frameworks FROM (SELECT DISTINCT repo FROM mf) LEFT JOIN pl USING (repo) LEFT JOIN fw USING (repo)) SELECT repo, primary_language, array_to_string(frameworks, ',') AS frameworks, " + KIND + " AS kind FROM r")
def codebase_type(t):
    s = detect.summary(marker_files(t), "repo")
    return s.select("repo", F.col("primary").alias("primary_language"), F.array_join("frameworks", ",").alias("frameworks"), "kind")


#: A code base of each kind: a frontend, a backend by framework and by language, and so on; dealt to the documents.
KINDS = [("python", "react"), ("go", "nodejs"), ("typescript", ""), ("dart", "flutter"), ("python", "conda"), ("java", "maven"), ("rust", "cargo"), ("ruby", "composer"), ("ruby", "docker"), ("", "docker")]
DEALT = "kd AS (SELECT source, nullif(" + picked_sql([k for k, _ in KINDS]) + ", '') AS primary_language, [" + picked_sql([f for _, f in KINDS]) + "] AS frameworks FROM documents)"


@query("codebase_kinds", "WITH " + DEALT + " SELECT source, primary_language, array_to_string(frameworks, ',') AS frameworks, " + KIND + " AS kind, count(*) AS n FROM kd GROUP BY ALL")
def codebase_kinds(t):
    d = t.documents.select("source", F.nullif(picked([k for k, _ in KINDS]), F.lit("")).alias("primary_language"), F.array(picked([f for _, f in KINDS])).alias("frameworks"))
    kind = detect.codebase_type(F.col("primary_language"), F.col("frameworks")).alias("kind")
    return d.groupBy("source", "primary_language", F.array_join("frameworks", ",").alias("frameworks"), kind).agg(F.count(F.lit(1)).alias("n"))


NAMES = ["core/x", "api/x", "models/x", "services/x", "utils/x", "tests/x", "config/x", "docs/x", "a/x_spec.y", "a/b.yaml", "a/c.json", "a/d.rst", "a/e.txt", "a/b", "a/Main.c"]


@query("module_category", "SELECT doc_id, p AS path, CASE " + " ".join(f"WHEN regexp_matches(lower(p), '{'|'.join(v)}') THEN '{k}'" for k, v in paths.CATEGORIES.items()) + " " + " ".join(f"WHEN regexp_matches(lower(p), '{v}') THEN '{k}'" for k, v in paths.NAMED.items()) + " ELSE 'other' END AS category FROM (SELECT doc_id, " + picked_sql(NAMES) + " AS p FROM documents)")
def module_category(t):
    d = t.documents.select("doc_id", picked(NAMES).alias("path"))
    return d.select("doc_id", "path", paths.category(F.col("path")).alias("category"))


@query("parent_dir", "SELECT file_id, string_split(file_id, '/')[-2] AS parent FROM {files} UNION ALL SELECT DISTINCT 'top.txt', 'root'")
def parent_dir(t):
    f = files(t).select("file_id").unionByName(t.spark.createDataFrame([("top.txt",)], "file_id string"))
    return f.select("file_id", paths.parent(F.col("file_id")).alias("parent"))


@query("top_exts", "SELECT e AS ext, count(*) AS n FROM (SELECT lower(regexp_extract('a.' || " + picked_sql(ENDS) + ", '\\.([A-Za-z0-9]+)$', 1)) AS e FROM documents) GROUP BY e ORDER BY n DESC, e LIMIT 5")
def top_exts(t):
    d = t.documents.select(paths.suffix(F.concat(F.lit("a."), picked(ENDS))).alias("ext"))
    return d.groupBy("ext").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ext").limit(5)


PROBLEMS = ["node_modules", "dist", "build", "__pycache__", ".mypy_cache", ".ruff_cache", ".pytest_cache", ".git", "venv", ".venv", "env"]
PLACES = [*PROBLEMS, ".github", "src", "a/env/b"]


@query("scan_alerts", "WITH p AS (SELECT x AS dir FROM (SELECT " + picked_sql(PLACES) + " AS x FROM documents) UNION ALL SELECT 'big' FROM documents, range(3)), d AS (SELECT dir, count(*) AS n FROM p GROUP BY dir), a AS (SELECT count(*) AS n FROM p) SELECT 'few files' AS alert, '' AS what, n FROM a WHERE n BETWEEN 1 AND 4 UNION ALL SELECT 'many files', '', n FROM a WHERE n > 5000 UNION ALL SELECT 'large directory', dir, n FROM d WHERE n > 500 UNION ALL SELECT 'should be excluded', part, CAST(sum(n) AS BIGINT) FROM (SELECT unnest(list_distinct(string_split(dir, '/'))) AS part, n FROM d) WHERE part IN (" + quoted(PROBLEMS) + ") GROUP BY part")
def scan_alerts(t):
    p = t.documents.select(picked(PLACES).alias("dir")).unionByName(t.documents.select(F.explode(F.array_repeat(F.lit("big"), 3)).alias("dir")))
    return metrics.scan_alerts(p, PROBLEMS)


COST = "WITH cy AS (SELECT count(*) AS n FROM (SELECT array_to_string(path, '>') FROM p JOIN edges ON src = l AND dst = s)), a AS (SELECT count(*) FILTER (complexity > 10) AS high, count(*) FILTER (n_out > 1) AS coupled, avg(CASE WHEN complexity > 10 THEN 1.0 ELSE 0.0 END) AS hr, avg(n_out) AS d FROM {cx})"
CYCLES = "WITH RECURSIVE p(s, l, path, n) AS (SELECT src, dst, [src, dst], 2 FROM {edges} WHERE src < dst UNION ALL SELECT s, dst, list_append(path, dst), n + 1 FROM p JOIN edges ON src = l WHERE n < 5 AND dst > s AND NOT list_contains(path, dst)), " + COST[len("WITH ") :]


def rated(t) -> DataFrame:
    """One row: n_cycles, high, coupled, hr, d."""
    n = graph.cycles(edges(t)).agg(F.count(F.lit(1)).alias("n_cycles"))
    a = complexity(t).agg(F.count_if(F.col("complexity") > 10).alias("high"), F.count_if(F.col("n_out") > 1).alias("coupled"), F.avg((F.col("complexity") > 10).cast("double")).alias("hr"), F.avg("n_out").alias("d"))
    return a.join(F.broadcast(n))  # one row


@query("quality_score", CYCLES + " SELECT round(greatest(0.0, 100 - 30 * hr - least(10.0 * cy.n, 30.0) - CASE WHEN d > 5 THEN least(5 * (d - 5), 20.0) ELSE 0 END), 6) AS score FROM a, cy")
def quality_score(t):
    return rated(t).select(F.round(metrics.quality_score(F.col("hr"), F.col("n_cycles"), F.col("d")), 6).alias("score"))


RULES = "unnest(list_filter([CASE WHEN high > 0 THEN 'Consider refactoring ' || high || ' high-complexity files' END, CASE WHEN n > 0 THEN 'Break ' || n || ' dependency cycles to improve maintainability' END, CASE WHEN coupled > 0 THEN 'Reduce coupling in ' || coupled || ' highly coupled files' END], lambda x: x IS NOT NULL))"


@query("recommendations", CYCLES + " SELECT " + RULES + " AS text FROM a, cy")
def recommendations(t):
    return rated(t).select(F.explode(metrics.recommendations(F.col("high"), F.col("n_cycles"), F.col("coupled"))).alias("text"))


@query("recommendations_none", "SELECT file_id, CASE WHEN complexity > 10 THEN 'Consider refactoring 1 high-complexity files' ELSE 'Code quality metrics look good! Keep up the good work.' END AS text FROM {cx}")
def recommendations_none(t):
    """Each file by itself: most have nothing to mend."""
    high = (F.col("complexity") > 10).cast("int")
    return complexity(t).select("file_id", F.explode(metrics.recommendations(high, F.lit(0), F.lit(0))).alias("text"))


# --- tokens

SPACES = r"[\t-\r\x1c-\x20\x85\p{Z}]"
GENERIC = "WITH k AS (SELECT file_id, text, CAST(len(regexp_extract_all(text, '[{}()\\[\\];,.:=+\\-*/]')) AS DOUBLE) AS c, CAST(len(regexp_extract_all(text, '" + SPACES + "')) AS DOUBLE) AS w FROM {files}) SELECT file_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(floor(c / 2.5::DOUBLE + (length(text) - c - w) / 4.2::DOUBLE + w / 1.5::DOUBLE) AS BIGINT)) END AS n FROM k"


@query("tokens_generic", GENERIC)
def tokens_generic(t):
    return files(t).select("file_id", text.tokens_generic(F.col("text")).alias("n"))


@query("truncate_budget", "SELECT file_id, CASE WHEN length(text) // 4 <= 20 THEN text ELSE substr(text, 1, 83) || chr(10) || '[truncated]...' END AS head, CASE WHEN length(text) // 4 <= 20 THEN text ELSE '...[truncated]' || chr(10) || right(text, 83) END AS tail FROM {files}")
def truncate_budget(t):
    return files(t).select("file_id", text.truncate_to(F.col("text"), 20).alias("head"), text.truncate_to(F.col("text"), 20, keep_end=True).alias("tail"))


# --- questions

ASKED = ["how does the login flow work", "fix the crash, why is it not stable?", "an example of get_user() in src/app.ts", "implement parseHtml for html_parser.py and HTMLNode", "tell me more", "what is defined in main.py?", "Which method calls load_all() and save_all()? see a/b.rs, x.tar.gz", "the public interface of é_x and xÉy", "how to call it\nand use it", "troubleshoot", ""]
QUESTIONS = "qs AS (SELECT conv_id, turn, text || ' ' || " + picked_sql(ASKED, "(conv_id + turn)") + " AS q FROM conversations)"
_W = text.WORD
INTENT = "CASE " + " ".join(f"WHEN regexp_matches(lower(q), '(?:^|[^{_W}])(?:{'|'.join(p)})(?:$|[^{_W}])') THEN '{k}'" for k, p in text.INTENTS.items()) + " ELSE 'general' END"
SYMS = f"list_sort(list_distinct(list_concat(list_filter(regexp_extract_all(q, '[{_W}]+'), lambda x: regexp_matches(x, '{text.SYMBOL}')), list_filter(regexp_extract_all(q, '([{_W}]+)\\(\\)', 1), lambda x: regexp_matches(x, '{text.CALL}')))))"
REFS = f"list_sort(list_distinct(list_concat(list_filter(list_transform(regexp_extract_all(q, '[{_W}][{_W}/.\\-]*'), lambda x: regexp_extract(x, '^.+\\.({text.SOURCES})(?:$|[^{_W}])', 1)), lambda x: x <> ''), regexp_extract_all(q, '[{_W}][{_W}.\\-]*\\.[{_W}]+'))))"


def questions(t) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.concat("text", F.lit(" "), F.element_at(F.array(*map(F.lit, ASKED)), ((F.col("conv_id") + F.col("turn")) % len(ASKED) + 1).cast("int"))).alias("q"))


@query("query_intent", "WITH " + QUESTIONS + " SELECT conv_id, turn, " + INTENT + " AS intent FROM qs")
def query_intent(t):
    return questions(t).select("conv_id", "turn", text.intent(F.col("q")).alias("intent"))


@query("query_symbols", "WITH " + QUESTIONS + " SELECT conv_id, turn, array_to_string(" + SYMS + ", ',') AS symbols FROM qs")
def query_symbols(t):
    return questions(t).select("conv_id", "turn", F.array_join(text.query_symbols(F.col("q")), ",").alias("symbols"))


@query("query_files", "WITH " + QUESTIONS + " SELECT conv_id, turn, array_to_string(" + REFS + ", ',') AS files FROM qs")
def query_files(t):
    return questions(t).select("conv_id", "turn", F.array_join(text.query_files(F.col("q")), ",").alias("files"))


@query("query_complexity", "WITH " + QUESTIONS + ", c AS (SELECT conv_id, turn, len(regexp_extract_all(q, '" + SPACES.replace("[", "[^", 1) + "+')) AS n, len(" + SYMS + ") AS s FROM qs) SELECT conv_id, turn, CASE WHEN n > 20 OR s > 4 THEN 'high' WHEN n > 10 OR s > 2 THEN 'medium' ELSE 'low' END AS complexity FROM c")
def query_complexity(t):
    return questions(t).select("conv_id", "turn", text.complexity(F.col("q"), text.query_symbols(F.col("q"))).alias("complexity"))


# --- ranked retrieval: a table of queries against all rows


def lexical_sql(queries: str, rows: str, n: int, prefix: str = "") -> str:
    """CTEs that end in {prefix}ranks: q, id, score, rank. queries: q, text; rows: id, text."""
    tok = "regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')"
    p = prefix
    return f"""{p}bt AS (SELECT q, unnest(list_distinct({tok})) AS term FROM ({queries})), {p}dt AS (SELECT id, {tok} AS t FROM ({rows})),
{p}s AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM {p}dt), {p}p AS (SELECT id, len(t) AS dl, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM {p}dt) GROUP BY ALL),
{p}df AS (SELECT term, count(*)::DOUBLE AS k FROM {p}p GROUP BY term), {p}nt AS (SELECT q, count(*) AS c FROM {p}bt GROUP BY q),
{p}sc AS (SELECT q, id, round(sum(greatest(ln((n - k + 0.5) / (k + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score, count(*) AS c FROM {p}bt JOIN {p}p USING (term) JOIN {p}df USING (term), {p}s GROUP BY q, id),
{p}ranks AS (SELECT * FROM (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM {p}sc JOIN {p}nt USING (q, c)) WHERE rank <= {n})"""


DOCS = "SELECT doc_id AS id, text FROM documents"
#: Questions for the fused searches: two words of the document that has the id of a query vector.
ASKS = "SELECT doc_id AS q, array_to_string((regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+'))[3:4], ' ') AS text FROM documents WHERE doc_id % 100 = 0"


def asks(t) -> DataFrame:
    words = F.array_join(F.slice(text.tokens(F.col("text")), 3, 2), " ")
    return t.documents.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), words.alias("text"))


def found(t, rows: DataFrame, queries: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The best rows of each query, from an index of the queries' words in the shared folder."""
    return lexical.Index(t.spark, f"{t.scratch()}/lexical").build(rows, id_col, text_col, only=queries).search(queries, n)


@query("bm25_batch", "WITH " + lexical_sql(ASKS, DOCS, 20) + " SELECT q AS query_id, id, score, rank FROM ranks")
def bm25_batch(t):
    return found(t, t.documents, asks(t), 20)


@query("bm25_index", "WITH " + lexical_sql(ASKS, "SELECT chunk_id AS id, content AS text FROM {chunks}", 20) + " SELECT q AS query_id, id, score, rank FROM ranks")
def bm25_index(t):
    """Postings written once to the shared folder, then searched."""
    return lexical.Index(t.spark, f"{t.scratch()}/lexical").build(chunks(t), "chunk_id", "content").search(asks(t), 20)


@query("bm25_any", "WITH " + lexical_sql(ASKS, DOCS, 20).replace("JOIN nt USING (q, c)", "") + " SELECT q AS query_id, id, score, rank FROM ranks")
def bm25_any(t):
    """Rows with any of a question's words, the largest tops of a segment first."""
    return lexical.Index(t.spark, f"{t.scratch()}/lexical").build(t.documents, "doc_id", "text", only=asks(t)).search(asks(t), 20, every=False)


@query("phrase_index", "WITH d AS (SELECT doc_id AS id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS t FROM documents), s AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM d), w AS (SELECT id, len(t) AS dl, unnest(t[1:len(t) - 1]) AS a, unnest(t[2:]) AS b FROM d), q AS (SELECT id AS query_id, t[3] AS a, t[4] AS b FROM d WHERE id % 100 = 0 AND len(t) >= 4), h AS (SELECT query_id, id, dl, count(*) AS tf FROM q JOIN w USING (a, b) GROUP BY ALL), k AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS k FROM h), r AS (SELECT query_id, id, round(greatest(ln((n - k + 0.5) / (k + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM k, s) SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r) WHERE rank <= 20")
def phrase_index(t):
    """Two neighbouring words of every hundredth document, as phrases over the places of an index."""
    q = asks(t).where(F.size(text.tokens(F.col("text"))) == 2)
    return lexical.Index(t.spark, f"{t.scratch()}/lexical").build(t.documents, "doc_id", "text", only=q, places=True).phrases(q, 20)


@query("bm25_held", "WITH " + lexical_sql(ASKS, DOCS, 20) + ", h AS (SELECT q, sum(k) AS held, count(*) AS c FROM bt JOIN df USING (term) GROUP BY q) SELECT q AS query_id, CAST(held AS BIGINT) AS held FROM h JOIN nt USING (q, c)")
def bm25_held(t):
    """The postings that each question's words have (a search looks at fewer)."""
    index = lexical.Index(t.spark, f"{t.scratch()}/lexical").build(t.documents, "doc_id", "text", only=asks(t))
    return index.reads(asks(t), 20).select("query_id", "held")


KNN = "SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: (v.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) * (v.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE))), 6) AS distance FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id"
BEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM ({})) WHERE rank <= {}"


def query_vectors(t) -> DataFrame:
    """The stated set of queries: every vector whose id is divisible by 100."""
    return t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query("knn_l2", BEST.format(KNN, 10))
def knn_l2(t):
    return dense.knn(t.embeddings, query_vectors(t), 10)


def cells(t, queries: DataFrame, k: int, **options) -> DataFrame:
    return dense.Cells(t.spark, f"{t.scratch()}/cells").build(t.embeddings, keep=("label",)).knn(queries, k, **options)


@query("knn_cells", BEST.format(KNN, 10))
def knn_cells(t):
    """As knn_l2, by cells and the triangle inequality."""
    return cells(t, query_vectors(t), 10)


@query("knn_cells_filtered", BEST.format(KNN + " AND v.label = 3", 5))
def knn_cells_filtered(t):
    return cells(t, query_vectors(t), 5, where=F.col("label") == 3)


@query("knn_filtered", BEST.format(KNN + " AND v.label = 3", 5))
def knn_filtered(t):
    return dense.knn(t.embeddings, query_vectors(t), 5, where=F.col("label") == 3)


@query("similar_files", "SELECT query_id, id, rank FROM (" + BEST.format(KNN, 3) + ")")
def similar_files(t):
    return dense.knn(t.embeddings, query_vectors(t), 3).select("query_id", "id", "rank")


#: Symbols named as a word of a question, as the documents that hold them, by line.
NAMED = "nm AS (SELECT b.q, s.doc_id AS id, row_number() OVER (PARTITION BY b.q ORDER BY min(s.line), s.doc_id) AS rank FROM bt b JOIN {symbols} s ON strip_accents(lower(s.name)) = b.term GROUP BY b.q, s.doc_id)"


def fused_sql(where: str | None = None) -> str:
    of = f"(SELECT doc_id FROM documents WHERE {where})"
    knn, first = (KNN, "SELECT q, id, rank, 2 FROM nm WHERE rank <= 25") if where is None else (f"{KNN} AND v.vec_id IN {of}", f"SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY rank), 2 FROM nm WHERE rank <= 25 AND id IN {of}")
    return "WITH " + lexical_sql(ASKS, DOCS if where is None else f"{DOCS} WHERE {where}", 50) + ", " + NAMED + ", dn AS (" + BEST.format(knn, 40) + "), u AS (SELECT query_id, id, rank, 0 AS src FROM dn UNION ALL SELECT q, id, rank, 1 FROM ranks UNION ALL " + first + "), f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, CAST(min(src) AS BIGINT) AS source FROM u GROUP BY ALL) SELECT query_id, id, score, source FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM f) WHERE r <= 20"


def named(t) -> DataFrame:
    """query_id, id, rank: documents with a symbol that a question names, by its first line."""
    q = asks(t).select("query_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term"))
    s = symbols(t).select(F.regexp_extract("file_id", r"doc_(\d+)\.txt$", 1).cast(LONG).alias("id"), F.translate(F.lower("name"), text.ACCENTED, text.PLAIN).alias("term"), "line")
    return fusion.first_named(s, q, 25)


def ranked_lists(t, where: str | None = None) -> list[DataFrame]:
    """Nearest vectors, best texts and named symbols of each question. A filter of documents holds for all three: vectors and
    texts are searched behind it, the first named documents pass it afterwards and are ranked anew, as the method does."""
    if where is None:
        return [dense.knn(t.embeddings, query_vectors(t), 40), found(t, t.documents, asks(t), 50), named(t)]
    docs = t.documents.where(where)
    of = docs.select(F.col("doc_id").alias("id"))
    vectors = t.embeddings.join(of.withColumnRenamed("id", "vec_id"), "vec_id", "left_semi")
    return [dense.knn(vectors, query_vectors(t), 40), found(t, docs, asks(t), 50), fusion.first_ranks(named(t).join(of, "id", "left_semi"), "rank", 25)]


@query("rrf_fusion", fused_sql())
def rrf_fusion(t):
    return fusion.rrf(ranked_lists(t), n=20)


@query("rrf_lang", fused_sql("lang = 'en'"))
def rrf_lang(t):
    return fusion.rrf(ranked_lists(t, "lang = 'en'"), n=20)


@query("lexical_fallback", "WITH " + lexical_sql(ASKS, DOCS, 10) + ", " + NAMED + ", u AS (SELECT q, id, rank, 0 AS source FROM ranks UNION ALL SELECT q, id, rank, 1 FROM nm WHERE rank <= 25) SELECT q AS query_id, id, CAST(source AS BIGINT) AS source, rank FROM (SELECT q, id, source, row_number() OVER (PARTITION BY q ORDER BY source, rank) AS rank FROM u) WHERE rank <= 10")
def lexical_fallback(t):
    return fusion.hybrid(None, found(t, t.documents, asks(t), 10), named(t), 10)


@query("hybrid_search", fused_sql().replace("SELECT query_id, id, score, source FROM", "SELECT query_id, id, source, r AS rank FROM").replace("r <= 20", "r <= 10"))
def hybrid_search(t):
    return fusion.hybrid(*ranked_lists(t), 10)


# --- context for a question

TERMS = "(VALUES ('the'), ('license'), ('Der')) y(s)"


@query("prioritize", "SELECT chunk_id, CAST(sum(CASE WHEN contains(lower(content), lower(s)) THEN 2 ELSE 0 END) + 1 AS INT) AS score FROM {chunks}, " + TERMS + " GROUP BY chunk_id ORDER BY score DESC, chunk_id LIMIT 50")
def prioritize(t):
    c = chunks(t).select("chunk_id", "content", F.lit("window").alias("chunk_type"), F.array().cast("array<string>").alias("symbols"))
    return context.prioritize(c, ["the", "license", "Der"]).select("chunk_id", "score").orderBy(F.desc("score"), "chunk_id").limit(50)


@query("relevant_modules", "SELECT DISTINCT f.file_id FROM {files} f JOIN {symbols} s ON s.file_id = f.file_id WHERE s.name IN ('The', 'And') ORDER BY 1 LIMIT 3")
def relevant_modules(t):
    return context.modules_of(files(t), symbols(t), ["The", "And"], 3).select("file_id")


@query("symbol_category", "SELECT name, CASE WHEN contains(min(file_id), 'src') THEN 'core' ELSE 'docs' END AS category FROM {symbols} WHERE name IN ('The', 'And') GROUP BY name")
def symbol_category(t):
    return context.symbol_categories(symbols(t), ["The", "And"])


@query("code_samples", "WITH k AS (SELECT chunk_id, content, len(regexp_extract_all(content, chr(10))) + 1 AS n FROM {chunks} WHERE contains(lower(content), 'license')), r AS (SELECT chunk_id, substr(content, 1, 500) AS sample, row_number() OVER (ORDER BY CASE WHEN n BETWEEN 5 AND 50 THEN 0.5 ELSE 0 END DESC, chunk_id) AS rank FROM k) SELECT chunk_id, sample FROM r WHERE rank <= 3")
def code_samples(t):
    return context.code_samples(chunks(t).withColumn("kind", F.lit("window")), "License", 3, 500).select("chunk_id", "sample")


#: Tokens of a section of a context of 2000, by intent.
ROOM = "(VALUES ('architectural', 'overview', 600), ('architectural', 'modules', 600), ('architectural', 'dependencies', 600), ('architectural', 'chunks', 200), ('implementation', 'symbols', 1200), ('implementation', 'chunks', 800), ('usage', 'symbols', 800), ('usage', 'chunks', 1200), ('debugging', 'symbols', 600), ('debugging', 'chunks', 1400), ('general', 'overview', 400), ('general', 'chunks', 1600)) rm(intent, section, room)"
CONTEXT = f"""WITH {QUESTIONS}, qq AS (SELECT conv_id || '-' || turn AS query_id, {INTENT} AS intent, {SYMS} AS names, q FROM qs),
{lexical_sql("SELECT query_id AS q, q AS text FROM qq", "SELECT chunk_id AS id, content AS text FROM {chunks}", 20).replace("JOIN nt USING (q, c)", "")},
nq AS (SELECT query_id, unnest(names) AS name FROM qq),
hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY file_id, line, symbol_id) AS rank FROM {{symbols}} JOIN nq USING (name)) WHERE rank <= 20),
md AS (SELECT query_id, file_id, min(rank) AS rank FROM hit GROUP BY ALL),
parts AS (SELECT query_id, 'overview' AS section, 1 AS rank, 'overview' AS id, content FROM qq, (SELECT 'Files: ' || count(*) || '; languages: ' || string_agg(DISTINCT language, ', ' ORDER BY language) AS content FROM {{files}})
UNION ALL SELECT query_id, 'modules', rank, file_id, file_id || ' ' || language || ' ' || line_count || ' lines' FROM md JOIN files USING (file_id)
UNION ALL SELECT query_id, 'dependencies', min(rank), file_id, 'depends on ' || string_agg('doc_' || dst, ', ' ORDER BY dst) FROM md JOIN files USING (file_id) JOIN {{edges}} ON src = doc_id GROUP BY query_id, file_id
UNION ALL SELECT query_id, 'symbols', rank, symbol_id, kind || ' ' || name || ' in ' || file_id FROM hit
UNION ALL SELECT q, 'chunks', rank, id, content FROM ranks JOIN chunks ON chunk_id = id)
SELECT query_id, intent, section, rank, id, tokens, content FROM (SELECT query_id, intent, section, rank, id, length(content) // 4 AS tokens, content, room, sum(length(content) // 4) OVER (PARTITION BY query_id, section ORDER BY rank, id ROWS UNBOUNDED PRECEDING) AS used FROM parts JOIN qq USING (query_id) JOIN {ROOM} USING (intent, section)) WHERE used <= room"""


@query("rag_context", CONTEXT)
def rag_context(t):
    """The context of each question of all sessions, packed into its budget by the strategy of its intent."""
    q = questions(t).select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("q").alias("text"))
    best = lexical.Index(t.spark, f"{t.scratch()}/lexical").build(chunks(t), "chunk_id", "content", only=q).search(q, 20, every=False)
    return context.answer_context(q, files(t), chunks(t), symbols(t), edges(t), budget=2000, best=best)


# --- evaluation

EVAL = "WITH " + lexical_sql("SELECT item_id AS q, text FROM benchmark", DOCS, 100) + ", ex AS (SELECT r.q, r.id FROM ranks r JOIN benchmark b ON b.item_id = r.q JOIN documents d ON d.doc_id = r.id WHERE contains(d.text, b.text)), fm AS (SELECT b.item_id AS q, min(r.rank) AS rank FROM benchmark b LEFT JOIN (SELECT * FROM ranks JOIN ex USING (q, id)) r ON r.q = b.item_id GROUP BY 1)"


def matches(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ranked, expected, cases: the benchmark's passages as questions; expected are the documents that hold them verbatim."""
    b = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    ranked = found(t, t.documents, b, 100).select(F.col("query_id").alias("case"), F.col("id").alias("file"), "rank")
    hit = ranked.join(lexical.small_side(b.select(F.col("query_id").alias("case"), F.col("text").alias("q"))), "case")
    hit = hit.join(t.documents.select(F.col("doc_id").alias("file"), "text"), "file").where(F.contains("text", "q"))
    return ranked, hit.select("case", "file"), b.select(F.col("query_id").alias("case"))


@query("first_match", EVAL + " SELECT q AS \"case\", rank FROM fm")
def first_match(t):
    return context.first_match(*matches(t))


@query("recall_at_k", EVAL + " SELECT count(*) AS total, count(rank) AS passed, round(coalesce(count(rank) / count(*)::DOUBLE, 0), 6) AS recall FROM fm")
def recall_at_k(t):
    return context.recall(context.first_match(*matches(t)))


@query("distinct_topk", EVAL + ", g AS (SELECT q, id % 7 AS file, min(rank) AS first FROM ranks GROUP BY ALL), o AS (SELECT q AS \"case\", file, row_number() OVER (PARTITION BY q ORDER BY first) AS rank FROM g) SELECT * FROM o WHERE rank <= 3")
def distinct_topk(t):
    return context.distinct_files(matches(t)[0].withColumn("file", F.col("file") % 7), 3)


@query("ordered_distinct", "WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS x, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents), f AS (SELECT doc_id, x, min(i) AS i FROM w GROUP BY ALL) SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS words FROM f GROUP BY doc_id")
def ordered_distinct(t):
    return t.documents.select("doc_id", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))


@query("external_links", "WITH l AS (SELECT page_id, target FROM {hrefs} UNION ALL SELECT page_id, url FROM pages UNION ALL SELECT page_id, 'mailto:' || page_id || '@x.org' FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'tel:1' FROM pages WHERE page_id % 5 = 0) SELECT page_id, count(*) AS n FROM l WHERE contains(target, '://') OR starts_with(target, 'mailto:') OR starts_with(target, 'tel:') GROUP BY page_id")
def external_links(t):
    """The external ones of a page's links, its own address and some mail and telephone links."""
    more = F.array_compact(F.array(F.col("url"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("mailto:"), F.col("page_id").cast("string"), F.lit("@x.org"))), F.when(F.col("page_id") % 5 == 0, F.lit("tel:1"))))
    d = t.pages.select("page_id", F.explode(F.concat(text.hrefs(F.col("html")), more)).alias("target"))
    return d.where(text.is_external(F.col("target"))).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query("json_probe", "SELECT event_id, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events WHERE CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT) > 50")
def json_probe(t):
    k = F.get_json_object("props", "$.k").cast(LONG)
    return t.events.select("event_id", k.alias("k")).where("k > 50")
