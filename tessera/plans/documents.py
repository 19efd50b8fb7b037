"""Queries over files, chunks, symbols and text: scans, filters, chunking, scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import chunking, trigrams
from .registry import Tables, query

LONG = "long"


def files(t: Tables) -> DataFrame:
    return chunking.files(t.documents)


def chunks(t: Tables) -> DataFrame:
    return chunking.sliding(files(t).select("doc_id", "file_id", "language", "text"), 10, 2)


def symbols(t: Tables) -> DataFrame:
    return chunking.line_symbols(files(t))


@query("file_scan", "SELECT file_id FROM {files}")
def file_scan(t):
    return files(t).select("file_id")


@query("doc_metadata", "SELECT file_id, language, size_bytes, line_count FROM {files}")
def doc_metadata(t):
    return files(t).select("file_id", "language", "size_bytes", "line_count")


@query("doc_lookup", "SELECT file_id, language, text FROM {files} WHERE file_id = 'src7/fr/doc_87.txt' OR doc_id = 7")
def doc_lookup(t):
    return files(t).where((F.col("file_id") == "src7/fr/doc_87.txt") | (F.col("doc_id") == 7)).select("file_id", "language", "text")


@query("chunk_lookup", "SELECT chunk_id, start_line, end_line, content FROM {chunks} WHERE doc_id = 3 AND start_line = 1")
def chunk_lookup(t):
    return chunks(t).where("doc_id = 3 and start_line = 1").select("chunk_id", "start_line", "end_line", "content")


@query("chunks_for_doc", "SELECT chunk_id, content FROM {chunks} WHERE doc_id = 5")
def chunks_for_doc(t):
    return chunks(t).where("doc_id = 5").select("chunk_id", "content")


@query("doc_hashes", "SELECT file_id, sha256(text) AS hash FROM {files}")
def doc_hashes(t):
    return files(t).select("file_id", F.sha2("text", 256).alias("hash"))


@query("session_messages", "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 3 ORDER BY turn")
def session_messages(t):
    return t.conversations.where("conv_id = 3").select("conv_id", "turn", "role", "text").orderBy("turn")


@query("delete_session", "SELECT conv_id, turn FROM conversations WHERE conv_id <> 3")
def delete_session(t):
    return t.conversations.join(F.broadcast(t.spark.createDataFrame([(3,)], "conv_id long")), "conv_id", "left_anti").select("conv_id", "turn")


@query("filter_ext", "SELECT url FROM pages WHERE lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) IN ('html', 'txt', 'com') OR url LIKE '%/fr/%'")
def filter_ext(t):
    return t.pages.where(paths.suffix(F.col("url")).isin("html", "txt", "com") | F.col("url").contains("/fr/")).select("url")


@query("filter_dirs", "SELECT file_id FROM {files} WHERE (file_id LIKE 'src1/%' OR file_id LIKE 'src2/%') AND NOT file_id LIKE 'src2/fr/%'")
def filter_dirs(t):
    f, d = files(t), paths.directory(F.col("file_id"))
    inc = d.startswith("src1/") | d.startswith("src2/") | d.isin("src1", "src2")
    return f.where(inc & ~(d == "src2/fr")).select("file_id")


PATTERNS = ["src1*/", "*.txt", "!src1/en/*.txt", "# note", "src[23]/de/"]


@query("gitignore_match", r"SELECT file_id, CASE WHEN regexp_matches(file_id, '^src[23]/de/') THEN true WHEN regexp_matches(file_id, '^src1/en/[^/]*\.txt$') THEN false ELSE true END AS ignored FROM {files}")
def gitignore_match(t):
    return files(t).select("file_id", paths.ignored(F.col("file_id"), PATTERNS).alias("ignored"))


@query("filter_patterns", "SELECT file_id FROM {files} WHERE file_id LIKE 'src3/%' AND language <> 'de'")
def filter_patterns(t):
    return files(t).where(F.col("file_id").startswith("src3/") & ~paths.ignored(F.col("file_id"), ["de/"])).select("file_id")


@query("exclude_parts", "SELECT file_id FROM {files} WHERE source NOT IN ('src4', 'src5')")
def exclude_parts(t):
    return files(t).where(~F.arrays_overlap(F.split("file_id", "/"), F.array(F.lit("src4"), F.lit("src5")))).select("file_id")


@query("documentable", "SELECT file_id FROM {files} WHERE NOT contains(file_id, '/es/') AND NOT contains(file_id, 'doc_1')")
def documentable(t):
    p = F.col("file_id")
    return files(t).where((paths.suffix(p) == "txt") & ~p.contains("/es/") & ~p.contains("doc_1")).select("file_id")


@query("by_language", "SELECT file_id FROM {files} WHERE language = 'de'")
def by_language(t):
    return files(t).where("language = 'de'").select("file_id")


@query("symbol_lookup", "SELECT symbol_id, file_id, line FROM {symbols} WHERE name = 'The' AND kind = 'class'")
def symbol_lookup(t):
    return symbols(t).where("name = 'The' and kind = 'class'").select("symbol_id", "file_id", "line")


@query("import_search", "WITH e AS (SELECT file_id FROM {files} WHERE source = 'src1'), c AS (SELECT file_id FROM {files} WHERE contains(source, 'src1')) SELECT file_id FROM e UNION ALL SELECT file_id FROM c WHERE NOT EXISTS (SELECT 1 FROM e)")
def import_search(t):
    f = files(t).where(F.col("source").contains("src1")).select("file_id", (F.col("source") == "src1").alias("exact"))
    best = F.broadcast(f.agg(F.coalesce(F.bool_or("exact"), F.lit(False)).alias("any")))  # one row
    return f.join(best).where(F.col("exact") | ~F.col("any")).select("file_id")


@query("grep_lines", "SELECT file_id, CAST(i AS BIGINT) AS line_number, trim(string_split(text, chr(10))[i], ' ') AS line FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM {files}) WHERE contains(lower(string_split(text, chr(10))[i]), 'public license')")
def grep_lines(t):
    return grep(files(t), F.lower("s").contains("public license"))


GREP_SQL = "SELECT file_id, CAST(i AS BIGINT) AS line_number, trim(string_split(text, chr(10))[i], ' ') AS line FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM {files}) WHERE regexp_matches(string_split(text, chr(10))[i], 'token = \"[0-9a-f]{8}')"


@query("grep_regex", GREP_SQL)
def grep_regex(t):
    return grep(files(t), F.col("s").rlike('token = "[0-9a-f]{8}'))


@query("grep_index", GREP_SQL)
def grep_index(t):
    """As grep_regex, over an index of trigrams; only lines of files that can match are looked at."""
    f, pattern = files(t).select("file_id", "text"), 'token = "[0-9a-f]{8}'
    found = trigrams.Trigrams(t.spark, f"{t.scratch()}/trigrams").build(f, "file_id", "text").search(f, pattern, "file_id", "text")
    return trigrams.lines(found, "text", F.col("s").rlike(pattern))


def grep(f: DataFrame, where: Column) -> DataFrame:
    d = f.select("file_id", F.posexplode(F.split("text", "\n")).alias("i", "s")).where(where)
    return d.select("file_id", (F.col("i") + 1).cast(LONG).alias("line_number"), F.trim("s").alias("line"))


@query("path_match", "SELECT file_id FROM {files} WHERE file_id = 'en/doc_1.txt' OR file_id LIKE '%/en/doc_1.txt'")
def path_match(t):
    return files(t).where((F.col("file_id") == "en/doc_1.txt") | F.col("file_id").endswith("/en/doc_1.txt")).select("file_id")


@query("glob_match", "SELECT file_id FROM {files} WHERE regexp_matches(file_id, '^src1[0-9]/.*/doc_.*5\\.txt$')")
def glob_match(t):
    return files(t).where(paths.fnmatch(F.col("file_id"), "src1[0-9]/*/doc_*5.txt")).select("file_id")


@query("extract_links", "SELECT page_id, target FROM {hrefs} WHERE NOT (contains(target, '://') OR starts_with(target, 'mailto:') OR starts_with(target, 'tel:') OR starts_with(target, '#'))")
def extract_links(t):
    links = F.filter(text.hrefs(F.col("html")), lambda x: ~(text.is_external(x) | x.startswith("#")))
    return t.pages.select("page_id", F.explode(links).alias("target"))


@query("dead_links", "WITH p AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages) SELECT page_id, target FROM {hrefs} h WHERE starts_with(target, '/') AND NOT EXISTS (SELECT 1 FROM p WHERE p.path = h.target)")
def dead_links(t):
    h = t.pages.select("page_id", F.explode(text.hrefs(F.col("html"))).alias("target")).where(F.col("target").startswith("/"))
    have = t.pages.select(F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("target"))
    return h.join(have, "target", "left_anti").select("page_id", "target")


@query("tree_flat", "WITH p AS (SELECT array_to_string(string_split(file_id, '/')[1:2], '/') AS dir FROM {files}) SELECT dir, count(*) AS children_count FROM p GROUP BY dir")
def tree_flat(t):
    return files(t).groupBy(F.array_join(F.slice(F.split("file_id", "/"), 1, 2), "/").alias("dir")).agg(F.count(F.lit(1)).alias("children_count"))


@query("ancestors", "SELECT DISTINCT unnest([source, source || '/' || language]) AS dir FROM {files}")
def ancestors(t):
    return files(t).select(F.explode(paths.ancestors(F.col("file_id"))).alias("dir")).distinct()


@query("line_slice", "SELECT file_id, array_to_string(l[2:4], chr(10)) AS lines FROM {lined}")
def line_slice(t):
    return files(t).select("file_id", F.array_join(F.slice(text.lines(F.col("text")), 2, 3), "\n").alias("lines"))


@query("chunk_whole", "SELECT file_id, CAST(1 AS BIGINT) AS start_line, line_count AS end_line, 'module' AS chunk_type FROM {files}")
def chunk_whole(t):
    return chunking.whole(files(t)).select("file_id", "start_line", "end_line", "chunk_type")


@query("chunk_sliding", "SELECT chunk_id, file_id, start_line, end_line, content FROM {chunks}")
def chunk_sliding(t):
    return chunks(t).select("chunk_id", "file_id", "start_line", "end_line", "content")


@query("chunks_ordered", "SELECT file_id, string_agg(start_line || '-' || end_line, ',' ORDER BY start_line) AS ranges FROM {chunks} GROUP BY file_id")
def chunks_ordered(t):
    c = chunks(t).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line"))).alias("c"))
    return c.select("file_id", F.array_join(F.transform("c", lambda x: F.concat_ws("-", x["start_line"], x["end_line"])), ",").alias("ranges"))


BOUND = r"""
WITH l AS (SELECT file_id, i - 1 AS line, string_split(text, chr(10))[i] AS s FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM {files})),
k AS (SELECT *, length(s) - length(ltrim(s, ' ')) AS indent FROM l WHERE trim(s, ' ') <> ''), p AS (SELECT *, lag(indent) OVER (PARTITION BY file_id ORDER BY line) AS before FROM k),
b AS (SELECT file_id, CAST(line AS BIGINT) AS line FROM p WHERE regexp_matches(ltrim(s, ' '), '^(def |class |async def |if __name__)') OR (starts_with(ltrim(s, ' '), '#') AND length(trim(s, ' ')) > 2) OR (indent = 0 AND before > 0))
"""


def semantic_sql(most: int, least: int, columns: str) -> str:
    """Cuts of files longer than `most`: hops from each cut to the first boundary at least so many lines on."""
    return BOUND.replace("WITH l AS", "WITH RECURSIVE l AS") + f""", nb AS (SELECT file_id, line + 1 AS p FROM b), f AS (SELECT file_id, n, l, coalesce(k, 0) AS k FROM {{lined}} LEFT JOIN (SELECT file_id, count(*) AS k FROM nb GROUP BY file_id) USING (file_id)),
hop AS (SELECT a.file_id, a.p, min(z.p) AS nxt FROM (SELECT file_id, CAST(1 AS BIGINT) AS p FROM f UNION SELECT file_id, p FROM nb) a JOIN nb z ON z.file_id = a.file_id AND z.p >= a.p + {least} GROUP BY ALL),
g(file_id, p) AS (SELECT file_id, CAST(1 AS BIGINT) FROM f WHERE n > {most} AND k > 1 UNION ALL SELECT g.file_id, hop.nxt FROM g JOIN hop ON hop.file_id = g.file_id AND hop.p = g.p),
s AS (SELECT file_id, CAST(1 AS BIGINT) AS p FROM f WHERE n <= {most} UNION ALL SELECT file_id, unnest(range(1, n + 1, {most})) FROM f WHERE n > {most} AND k <= 1 UNION ALL SELECT file_id, p FROM g),
e AS (SELECT file_id, p AS start_line, CAST(coalesce(lead(p) OVER (PARTITION BY file_id ORDER BY p) - 1, n) AS BIGINT) AS end_line, l FROM s JOIN f USING (file_id)) SELECT {columns} FROM e"""


@query("chunk_semantic", semantic_sql(20, 10, "file_id, start_line, end_line, array_to_string(l[start_line:end_line], chr(10)) AS content"))
def chunk_semantic(t):
    return chunking.semantic(files(t).select("file_id", "text"), 20)


@query("greedy_cuts", semantic_sql(5, 3, "file_id, start_line, end_line").replace("WITH RECURSIVE l AS", "WITH RECURSIVE x AS (SELECT file_id, replace(text, 'The ', 'def ') AS text FROM {files}), l AS").replace("FROM {files})),", "FROM x)),"))
def greedy_cuts(t):
    """Over texts in which a frequent word is a definition, so that there is something to cut at."""
    return chunking.semantic(files(t).select("file_id", F.replace("text", F.lit("The "), F.lit("def ")).alias("text")), 5, 3).select("file_id", "start_line", "end_line")


@query("semantic_boundaries", BOUND.replace("WITH l AS", "WITH x AS (SELECT file_id, replace(text, 'The ', 'def ') AS text FROM {files}), l AS").replace("FROM {files}))", "FROM x))") + "SELECT * FROM b")
def semantic_boundaries(t):
    return chunking.boundaries(files(t).select("file_id", F.replace("text", F.lit("The "), F.lit("def ")).alias("text")))


@query("segments", BOUND.replace("WITH l AS", "WITH x AS (SELECT file_id, replace(text, 'The ', 'def ') AS text FROM {files}), l AS").replace("FROM {files}))", "FROM x))") + ", c AS (SELECT file_id, line + 1 AS start_line, lead(line) OVER (PARTITION BY file_id ORDER BY line) AS nxt, count(*) OVER (PARTITION BY file_id) AS n FROM b) SELECT file_id, start_line, CAST(coalesce(nxt, m) AS BIGINT) AS end_line FROM c JOIN (SELECT file_id, len(string_split(text, chr(10))) AS m FROM x) USING (file_id) WHERE n <= 2 OR coalesce(nxt, m) - start_line + 1 >= 5")
def segments(t):
    return chunking.segments(files(t).select("file_id", F.replace("text", F.lit("The "), F.lit("def ")).alias("text")))


@query("symbols_in_range", "SELECT c.chunk_id, string_agg(DISTINCT s.name, ',' ORDER BY s.name) AS symbols FROM {chunks} c JOIN {symbols} s ON s.file_id = c.file_id AND s.line BETWEEN c.start_line AND c.end_line GROUP BY c.chunk_id")
def symbols_in_range(t):
    return chunking.symbols_in_range(chunks(t), symbols(t))


@query("regex_extract", r"SELECT file_id, array_to_string(regexp_extract_all(text, 'token = \"([0-9a-f]+)\"', 1), ',') AS found FROM {files} WHERE regexp_matches(text, 'token = \"([0-9a-f]+)\"')")
def regex_extract(t):
    found = F.regexp_extract_all(F.col("text"), F.lit('token = "([0-9a-f]+)"'), F.lit(1))
    return files(t).where(F.col("text").rlike('token = "([0-9a-f]+)"')).select("file_id", F.array_join(found, ",").alias("found"))


@query("index_counts", "SELECT (SELECT count(*) FROM {files}) AS n_files, (SELECT count(*) FROM {chunks}) AS n_chunks, (SELECT count(*) FROM {symbols}) AS n_symbols, (SELECT count(*) FROM {edges}) AS n_edges")
def index_counts(t):
    from ..operators.graph import synthetic_edges

    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = n(files(t), "n_files")
    for df, name in ((chunks(t), "n_chunks"), (symbols(t), "n_symbols"), (synthetic_edges(t.documents), "n_edges")):
        out = out.join(F.broadcast(n(df, name)))  # one row each
    return out


@query("tokenize", "SELECT file_id, CAST(len(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')) AS BIGINT) AS n_tokens FROM {files}")
def tokenize(t):
    return files(t).select("file_id", F.size(text.tokens(F.col("text"))).cast(LONG).alias("n_tokens"))


@query("normalize_path", "SELECT file_id, regexp_replace(file_id, '^([^/]+)/[^/]+/', '\\1/') AS path FROM {files}")
def normalize_path(t):
    messy = F.concat(F.lit("./"), F.regexp_replace("file_id", "^([^/]+)/([^/]+)/", "$1//$2/.././"))
    return files(t).select("file_id", paths.normalize(messy).alias("path"))


@query("make_ids", "SELECT file_id || '#L1-L' || line_count AS chunk_id, file_id || '::file::' || doc_id || '::L1' AS symbol_id FROM {files}")
def make_ids(t):
    p = F.col("file_id")
    return files(t).select(paths.chunk_id(p, F.lit(1), F.col("line_count")).alias("chunk_id"), paths.symbol_id(p, F.lit("file"), F.col("doc_id").cast("string"), F.lit(1)).alias("symbol_id"))


@query("flatten_meta", "SELECT file_id, CASE WHEN len(regexp_extract_all(text, 'CC BY[A-Z0-9. -]*')) = 0 THEN '[]' ELSE array_to_string(regexp_extract_all(text, 'CC BY[A-Z0-9. -]*'), ', ') END AS licences FROM {files}")
def flatten_meta(t):
    a = F.regexp_extract_all(F.col("text"), F.lit("CC BY[A-Z0-9. -]*"), F.lit(0))
    return files(t).select("file_id", F.when(F.size(a) == 0, "[]").otherwise(F.array_join(a, ", ")).alias("licences"))


@query("tokens_div4", "SELECT file_id, CAST(length(text) // 4 AS BIGINT) AS n FROM {files}")
def tokens_div4(t):
    return files(t).select("file_id", text.tokens_div4(F.col("text")).alias("n"))


@query("budget_table", "SELECT file_id, mode, CAST(8 * size_bytes * tenths // 100 AS BIGINT) AS budget FROM {files}, (VALUES ('low', 3), ('medium', 6), ('high', 9)) s(mode, tenths)")
def budget_table(t):
    """What a mode may take of a context window, for windows as large as each file."""
    shares = F.create_map(*(F.lit(x) for kv in (("low", 3), ("medium", 6), ("high", 9)) for x in kv))
    m = files(t).select("file_id", "size_bytes", F.explode(shares).alias("mode", "tenths"))
    return m.select("file_id", "mode", F.floor(8 * F.col("size_bytes") * F.col("tenths") / 100).cast(LONG).alias("budget"))


@query("fits_budget", "SELECT file_id FROM {files} WHERE length(text) // 4 <= 100")
def fits_budget(t):
    return files(t).where(text.tokens_div4(F.col("text")) <= 100).select("file_id")


@query("model_context", "SELECT user_id, CASE WHEN 'model' || (user_id % 4) = 'model0' THEN 8192 WHEN contains('model' || (user_id % 4), 'model') THEN 32768 END AS ctx FROM (SELECT DISTINCT user_id FROM events)")
def model_context(t):
    m = F.concat(F.lit("model"), (F.col("user_id") % 4).cast("string"))
    return t.events.select("user_id").distinct().select("user_id", F.when(m == "model0", 8192).when(m.contains("model"), 32768).alias("ctx"))


@query("section_entries", "WITH l AS (SELECT file_id, i, l[i] AS s FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM {lined})), h AS (SELECT *, max(CASE WHEN i % 4 = 1 THEN i END) OVER (PARTITION BY file_id ORDER BY i) AS head FROM l) SELECT file_id, CAST(head AS BIGINT) AS head, CAST(count(*) AS BIGINT) AS n FROM h WHERE i <> head GROUP BY ALL")
def section_entries(t):
    d = files(t).select("file_id", F.posexplode(text.lines(F.col("text"))).alias("i", "s")).withColumn("i", F.col("i") + 1)
    w = Window.partitionBy("file_id").orderBy("i")
    d = d.withColumn("head", F.last(F.when(F.col("i") % 4 == 1, F.col("i")), True).over(w))
    return d.where("i <> head").groupBy("file_id", F.col("head").cast(LONG).alias("head")).agg(F.count(F.lit(1)).alias("n"))


@query("page_paths", "SELECT 'docs/api/' || file_id || '.md' AS page, 'docs/modules/' || lower(replace(source, ' ', '_')) || '.md' AS module FROM {files}")
def page_paths(t):
    return files(t).select(F.concat(F.lit("docs/api/"), F.col("file_id"), F.lit(".md")).alias("page"), F.concat(F.lit("docs/modules/"), F.lower(F.replace("source", F.lit(" "), F.lit("_"))), F.lit(".md")).alias("module"))


@query("doc_plan", "SELECT 'overview' AS kind, 'index.md' AS page UNION ALL SELECT DISTINCT 'module', 'modules/' || source || '.md' FROM {files} UNION ALL SELECT 'file', 'api/' || file_id || '.md' FROM {files} UNION ALL SELECT 'guide', unnest(['guides/start.md', 'guides/use.md', 'guides/develop.md', 'guides/deploy.md']) UNION ALL SELECT 'api', 'api/index.md'")
def doc_plan(t):
    from ..operators.docs import page_plan

    return page_plan(files(t))


@query("strip_blocks", "SELECT page_id, ltrim(regexp_replace(html, '(?s)<style>.*?</style>\\s*', '', 'g'), ' ') AS html FROM pages")
def strip_blocks(t):
    return t.pages.select("page_id", text.strip_blocks(F.col("html"), "style").alias("html"))


@query("list_and_more", "WITH g AS (SELECT source, list(file_id ORDER BY file_id) AS a FROM {files} GROUP BY source) SELECT source, array_to_string(list_transform(a[1:10], lambda x: '- ' || x), chr(10)) || CASE WHEN len(a) > 10 THEN chr(10) || '- ... and ' || (len(a) - 10) || ' more' ELSE '' END AS listing FROM g")
def list_and_more(t):
    f = files(t).select("source", "file_id")
    first = f.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("file_id"))).where("r <= 10")  # before they are gathered
    g = first.groupBy("source").agg(F.sort_array(F.collect_list("file_id")).alias("a")).join(f.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source")
    return g.select("source", text.list_and_more(F.col("a"), F.col("n")).alias("listing"))


@query("prompt_context", "SELECT file_id, string_agg('--- ' || file_id || ' (lines ' || start_line || '-' || end_line || ') ---' || chr(10) || content, chr(10) ORDER BY chunk_id) AS prompt FROM {chunks} GROUP BY file_id")
def prompt_context(t):
    """The context of a prompt on each file: its chunks, each behind its place."""
    c = chunks(t)
    one = F.concat(F.lit("--- "), F.col("file_id"), F.lit(" (lines "), F.col("start_line"), F.lit("-"), F.col("end_line"), F.lit(") ---\n"), F.col("content"))
    c = c.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", one.alias("x")))).alias("a"))
    return c.select("file_id", F.array_join("a.x", "\n").alias("prompt"))


@query("format_hit", "SELECT chunk_id, 'File: ' || file_id || ' | Lines: ' || start_line || '-' || end_line AS head FROM {chunks}")
def format_hit(t):
    parts = [F.concat(F.lit("File: "), F.col("file_id")), F.concat(F.lit("Lines: "), F.col("start_line"), F.lit("-"), F.col("end_line")), F.lit(None).cast("string")]
    return chunks(t).select("chunk_id", text.header(parts).alias("head"))


@query("xref_markdown", "SELECT src, '## Cross-references' || chr(10) || string_agg('- [doc_' || dst || '](doc_' || dst || '.md)', chr(10) ORDER BY dst) AS md FROM {edges} GROUP BY src")
def xref_markdown(t):
    from ..operators.graph import synthetic_edges

    e = synthetic_edges(t.documents).groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("d"))
    line = F.transform("d", lambda x: F.concat(F.lit("- [doc_"), x.cast("string"), F.lit("](doc_"), x.cast("string"), F.lit(".md)")))
    return e.select("src", F.concat(F.lit("## Cross-references\n"), F.array_join(line, "\n")).alias("md"))


@query("gen_context", "SELECT file_id, to_json({{'language': language, 'lines': line_count}}) AS ctx FROM {files}".replace("{{", "struct_pack(").replace("}}", ")").replace("'language': language, 'lines': line_count", "language := language, lines := line_count"))
def gen_context(t):
    return files(t).select("file_id", F.to_json(F.struct("language", F.col("line_count").alias("lines"))).alias("ctx"))


@query("first_candidate", "SELECT file_id, CASE WHEN doc_id % 3 = 0 THEN '.js' WHEN doc_id % 2 = 0 THEN '.ts' ELSE '/index.js' END AS suffix FROM {files}")
def first_candidate(t):
    from ..operators.docs import first_existing

    f = files(t).select("file_id", "doc_id")
    have = f.select(F.explode(F.array(F.when(F.col("doc_id") % 3 == 0, F.concat("file_id", F.lit(".js"))), F.when(F.col("doc_id") % 2 == 0, F.concat("file_id", F.lit(".ts"))), F.concat("file_id", F.lit("/index.js")))).alias("file")).where("file is not null")
    return first_existing(f.select("file_id"), have)


@query("module_map", "SELECT replace(regexp_replace(file_id, '\\.txt$', ''), '/', '.') AS module, file_id FROM {files}")
def module_map(t):
    return files(t).select(F.replace(F.regexp_replace("file_id", r"\.txt$", ""), F.lit("/"), F.lit(".")).alias("module"), "file_id")
