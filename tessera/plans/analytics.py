"""Queries over the graph, statistics, ranking, increments and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import context, fusion, graph, incremental, lexical, metrics, usage
from ..operators.sizes import small_side
from ..sources.rollup import Rollup
from ..sources.store import Store
from .documents import chunks, files, symbols
from .registry import query

LONG = "long"


def edges(t) -> DataFrame:
    return graph.synthetic_edges(t.documents)


def complexity(t) -> DataFrame:
    return metrics.file_complexity(files(t), edges(t), symbols(t))


def calls(t) -> DataFrame:
    return t.events.select("event_id", "ts", F.col("event_type").alias("provider"), F.concat(F.lit("model"), (F.col("user_id") % 4).cast("string")).alias("model"), F.get_json_object("props", "$.k").cast(LONG).alias("tokens"), F.col("value").alias("cost"))


def one(t, *values, schema: str) -> DataFrame:
    return F.broadcast(t.spark.createDataFrame([*values], schema))  # a few literals


# --- joins and the graph


@query("out_edges", "SELECT DISTINCT dst FROM {edges} WHERE src = 10")
def out_edges(t):
    return edges(t).where("src = 10").select("dst").distinct()


@query("in_edges", "SELECT DISTINCT src FROM {edges} WHERE dst = 10")
def in_edges(t):
    return edges(t).where("dst = 10").select("src").distinct()


@query("cross_refs", "SELECT file, CAST(sum(o) AS BIGINT) AS imports, CAST(sum(i) AS BIGINT) AS imported_by FROM (SELECT src AS file, 1 AS o, 0 AS i FROM {edges} UNION ALL SELECT dst, 0, 1 FROM {edges}) GROUP BY file")
def cross_refs(t):
    return graph.degrees(edges(t)).select("file", F.col("n_out").alias("imports"), F.col("n_in").alias("imported_by"))


RELATED = "SELECT other AS doc_id FROM {near} WHERE file = 10 UNION SELECT b.doc_id FROM documents a JOIN documents b ON a.source = b.source WHERE a.doc_id = 10 AND b.doc_id <> 10 UNION SELECT b.doc_id FROM {symbols} a JOIN {symbols} b ON a.name = b.name AND b.doc_id <> 10 WHERE a.doc_id = 10"


@query("related_files", RELATED)
def related_files(t):
    near = graph.neighbours(edges(t)).where("file = 10").select(F.col("other").alias("doc_id"))
    d = t.documents.select("doc_id", "source")
    mates = d.join(F.broadcast(d.where("doc_id = 10").select("source")), "source", "left_semi").select("doc_id")
    f = files(t).select("file_id", "doc_id")
    s = symbols(t).join(f, "file_id").select("doc_id", "name")
    named = s.join(s.where("doc_id = 10").select("name").distinct(), "name", "left_semi").select("doc_id")
    return near.unionByName(mates).unionByName(named).where("doc_id <> 10").distinct()


@query("typed_refs", "SELECT dst AS doc_id, 'import' AS type FROM {edges} WHERE src = 10 UNION SELECT src, 'imported_by' FROM {edges} WHERE dst = 10 UNION SELECT b.doc_id, 'related' FROM documents a JOIN documents b ON a.source = b.source WHERE a.doc_id = 10 AND b.doc_id <> 10 AND b.doc_id NOT IN (SELECT other FROM {near} WHERE file = 10)")
def typed_refs(t):
    e = edges(t)
    direct = e.where("src = 10").select(F.col("dst").alias("doc_id"), F.lit("import").alias("type")).unionByName(e.where("dst = 10").select(F.col("src").alias("doc_id"), F.lit("imported_by").alias("type")))
    d = t.documents.select("doc_id", "source")
    mates = d.join(F.broadcast(d.where("doc_id = 10").select("source")), "source", "left_semi").where("doc_id <> 10").join(direct.select("doc_id"), "doc_id", "left_anti")
    return direct.unionByName(mates.select("doc_id", F.lit("related").alias("type"))).distinct()


CHANGED = "(VALUES (5), (17), (40)) c(file)"


@query("impact_1hop", "SELECT file AS doc_id FROM " + CHANGED + " UNION SELECT b.other FROM {near} b JOIN " + CHANGED + " ON b.file = c.file")
def impact_1hop(t):
    return graph.impact(one(t, (5,), (17,), (40,), schema="file long"), edges(t)).select(F.col("file").alias("doc_id"))


@query("impact_2hop", "WITH h AS (SELECT c.file, e.src AS hit FROM " + CHANGED + " JOIN {edges} e ON e.dst = c.file), k AS (SELECT * FROM h UNION SELECT h.file, e.src FROM h JOIN edges e ON e.dst = h.hit) SELECT file, hit FROM k WHERE file <> hit")
def impact_2hop(t):
    return graph.dependents_within_two(one(t, (5,), (17,), (40,), schema="file long"), edges(t))


@query("cycles", "WITH RECURSIVE p(s, l, path, n) AS (SELECT src, dst, [src, dst], 2 FROM {edges} WHERE src < dst UNION ALL SELECT s, dst, list_append(path, dst), n + 1 FROM p JOIN edges ON src = l WHERE n < 5 AND dst > s AND NOT list_contains(path, dst)) SELECT array_to_string(path, '>') AS cycle, CAST(n AS BIGINT) AS length FROM p JOIN edges ON src = l AND dst = s")
def cycles(t):
    return graph.cycles(edges(t))


@query("strong_components", "WITH RECURSIVE r(a, b) AS (SELECT src, dst FROM {edges} UNION SELECT r.a, e.dst FROM r JOIN edges e ON r.b = e.src), m AS (SELECT x.a, min(x.b) AS b FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a) SELECT file, coalesce(least(m.b, file), file) AS component FROM (SELECT src AS file FROM edges UNION SELECT dst FROM edges) LEFT JOIN m ON m.a = file")
def strong_components(t):
    return graph.components(edges(t), t.written)


@query("centrality", "SELECT file, n_out + n_in AS centrality, n_in > 3 AS core, n_out = 0 AS leaf FROM {deg}")
def centrality(t):
    return graph.degrees(edges(t)).select("file", (F.col("n_out") + F.col("n_in")).alias("centrality"), (F.col("n_in") > 3).alias("core"), (F.col("n_out") == 0).alias("leaf"))


COUPLING = "WITH ce AS (SELECT src AS file, count(*) AS ce FROM {edges} GROUP BY 1), ca AS (SELECT dst AS file, count(*) AS ca FROM edges GROUP BY 1), k AS (SELECT file, coalesce(ca, 0) AS ca, ce, round(ce / (ce + coalesce(ca, 0))::DOUBLE, 6) AS instability FROM ce LEFT JOIN ca USING (file))"


@query("coupling", COUPLING + " SELECT * FROM k")
def coupling(t):
    return graph.coupling(edges(t))


@query("most_stable", COUPLING + " SELECT file, instability FROM k ORDER BY instability, file LIMIT 10")
def most_stable(t):
    return graph.coupling(edges(t)).select("file", "instability").orderBy("instability", "file").limit(10)


@query("dot_edges", "SELECT '  \"doc_' || src || '\" -> \"doc_' || dst || '\";' AS line FROM {edges}")
def dot_edges(t):
    return edges(t).select(F.concat(F.lit('  "doc_'), F.col("src").cast("string"), F.lit('" -> "doc_'), F.col("dst").cast("string"), F.lit('";')).alias("line"))


@query("dep_stats", "WITH d AS (SELECT src, count(*) AS n FROM {edges} GROUP BY src) SELECT CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS mean FROM d")
def dep_stats(t):
    d = edges(t).groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return d.agg(F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean"))


@query("highly_coupled", "SELECT file, n_out + n_in AS n FROM {deg} WHERE n_out + n_in > 2 ORDER BY n DESC, file LIMIT 10")
def highly_coupled(t):
    return graph.degrees(edges(t)).select("file", (F.col("n_out") + F.col("n_in")).alias("n")).where("n > 2").orderBy(F.desc("n"), "file").limit(10)


# --- statistics


@query("repo_stats", "SELECT CASE WHEN grouping(language) = 1 AND grouping(category) = 1 THEN 'all' WHEN grouping(language) = 0 THEN 'language' ELSE 'category' END AS kind, coalesce(language, category, '') AS key, count(*) AS n, CAST(sum(line_count) AS BIGINT) AS n_lines FROM (SELECT *, 'core' AS category FROM {files}) GROUP BY GROUPING SETS ((), (language), (category))")
def repo_stats(t):
    return metrics.statistics(files(t), paths.category(F.col("file_id")))


@query("file_complexity", "SELECT file_id, complexity FROM {cx}")
def file_complexity(t):
    return complexity(t).select("file_id", "complexity")


@query("file_summary", "SELECT c.file_id, coalesce(k.classes, 0) AS n_classes, coalesce(k.functions, 0) AS n_functions, c.n_out AS n_deps, c.complexity FROM {cx} c LEFT JOIN (SELECT file_id, CAST(count(*) FILTER (kind = 'class') AS BIGINT) AS classes, CAST(count(*) FILTER (kind = 'function') AS BIGINT) AS functions FROM symbols GROUP BY file_id) k USING (file_id)")
def file_summary(t):
    s = symbols(t).groupBy("file_id").agg(F.count_if(F.col("kind") == "class").alias("n_classes"), F.count_if(F.col("kind") == "function").alias("n_functions"))
    return complexity(t).join(s, "file_id", "left").fillna(0, ["n_classes", "n_functions"]).select("file_id", "n_classes", "n_functions", F.col("n_out").alias("n_deps"), "complexity")


@query("module_overview", "SELECT source AS category, file_id, count(*) OVER (PARTITION BY source) AS n_files FROM {files}")
def module_overview(t):
    """A row a file, with the number of files of its module: no module's files are gathered in one place."""
    f = files(t).select(F.col("source").alias("category"), "file_id")
    return f.join(small_side(f.groupBy("category").agg(F.count(F.lit(1)).alias("n_files"))), "category")


@query("complexity_agg", "SELECT count(*) AS n, round(avg(complexity), 6) AS mean, max(complexity) AS most, min(complexity) AS least, CAST(count(*) FILTER (complexity > 10) AS BIGINT) AS high FROM {cx}")
def complexity_agg(t):
    return metrics.complexity_summary(complexity(t))


@query("complexity_hist", "WITH b AS (SELECT unnest(['low (1-5)', 'medium (6-10)', 'high (11-20)', 'very high (>20)']) AS bin), c AS (SELECT CASE WHEN complexity <= 5 THEN 'low (1-5)' WHEN complexity <= 10 THEN 'medium (6-10)' WHEN complexity <= 20 THEN 'high (11-20)' ELSE 'very high (>20)' END AS bin, count(*) AS n FROM {cx} GROUP BY 1) SELECT bin, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bin)")
def complexity_hist(t):
    return metrics.histogram(complexity(t))


@query("complexity_heatmap", "SELECT file_id, complexity, repeat('#', CAST(least(complexity // 2, 20) AS INT)) AS bar FROM {cx} ORDER BY complexity DESC, file_id LIMIT 20")
def complexity_heatmap(t):
    return complexity(t).select("file_id", "complexity", F.repeat(F.lit("#"), F.least(F.floor(F.col("complexity") / 2), F.lit(20)).cast("int")).alias("bar")).orderBy(F.desc("complexity"), "file_id").limit(20)


@query("module_top3", "SELECT source, file_id, complexity, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY complexity DESC, file_id) AS r FROM {cx}) WHERE r <= 3")
def module_top3(t):
    w = Window.partitionBy("source").orderBy(F.desc("complexity"), "file_id")
    return complexity(t).withColumn("rank", F.row_number().over(w).cast(LONG)).where("rank <= 3").select("source", "file_id", "complexity", "rank")


@query("module_breakdown", "SELECT source, count(*) AS n, count(DISTINCT language) AS n_languages, CAST(sum(complexity) AS BIGINT) AS total, round(avg(complexity), 6) AS mean FROM {cx} GROUP BY source")
def module_breakdown(t):
    return complexity(t).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("language").alias("n_languages"), F.sum("complexity").alias("total"), F.round(F.avg("complexity"), 6).alias("mean"))


@query("repo_overview", "SELECT count(*) AS n_files, count(DISTINCT source) AS n_modules, round(avg(complexity), 6) AS mean_complexity, CAST(sum(n_out) AS BIGINT) AS n_deps FROM {cx}")
def repo_overview(t):
    return complexity(t).agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct("source").alias("n_modules"), F.round(F.avg("complexity"), 6).alias("mean_complexity"), F.sum("n_out").alias("n_deps"))


@query("lang_counts", "SELECT language, count(*) AS n FROM {files} GROUP BY language")
def lang_counts(t):
    return files(t).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query("significant_langs", "SELECT language, count(*) AS n FROM {files} GROUP BY language HAVING count(*) >= greatest(3, 0.05 * (SELECT count(*) FROM documents))")
def significant_langs(t):
    g = files(t).groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("total", F.sum("n").over(Window.partitionBy())).where(F.col("n") >= F.greatest(F.lit(3.0), 0.05 * F.col("total"))).select("language", "n")  # a row a language


@query("primary_lang", "SELECT language, n FROM (SELECT language, count(*) AS n FROM {files} GROUP BY language) ORDER BY n DESC, language LIMIT 1")
def primary_lang(t):
    return files(t).groupBy("language").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language").limit(1)


@query("top_dirs", "SELECT regexp_replace(file_id, '/[^/]*$', '') AS dir, count(*) AS n FROM {files} GROUP BY 1 ORDER BY n DESC, dir LIMIT 10")
def top_dirs(t):
    return files(t).groupBy(paths.directory(F.col("file_id")).alias("dir")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dir").limit(10)


@query("dir_counts", "SELECT dir, n FROM (SELECT regexp_replace(file_id, '/[^/]*$', '') AS dir, count(*) AS n FROM {files} GROUP BY 1) WHERE n > 1 ORDER BY dir LIMIT 10")
def dir_counts(t):
    return files(t).groupBy(paths.directory(F.col("file_id")).alias("dir")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("dir").limit(10)


@query("cost_estimate", "SELECT count(*) AS n_files, round(count(*) * 800 * 0.0001 / 1000, 6) AS cost FROM {files}")
def cost_estimate(t):
    return files(t).agg(F.count(F.lit(1)).alias("n_files"), F.round(F.count(F.lit(1)) * 800 * 0.0001 / 1000, 6).alias("cost"))


@query("overview_text", "SELECT 'Files: ' || count(*) || '; languages: ' || string_agg(DISTINCT language, ', ' ORDER BY language) AS text FROM {files}")
def overview_text(t):
    return files(t).agg(F.concat(F.lit("Files: "), F.count(F.lit(1)).cast("string"), F.lit("; languages: "), F.array_join(F.sort_array(F.collect_set("language")), ", ")).alias("text"))


@query("analyze_groups", "SELECT source, count(*) AS n, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM {files} GROUP BY source")
def analyze_groups(t):
    return files(t).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"))


@query("module_context", "WITH s AS (SELECT DISTINCT split_part(file_id, '/', 1) AS source, name FROM {symbols} WHERE kind = 'class'), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY name) AS r FROM s) SELECT source, string_agg(name, ',' ORDER BY name) AS classes FROM r WHERE r <= 10 GROUP BY source")
def module_context(t):
    s = symbols(t).where("kind = 'class'").select(F.split("file_id", "/")[0].alias("source"), "name").distinct()
    s = s.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("name"))).where("r <= 10")  # before they are gathered
    return s.groupBy("source").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("classes"))


@query("api_surface", "SELECT file_id, count(*) FILTER (kind = 'class') AS n_classes, count(*) FILTER (kind = 'function') AS n_functions FROM {symbols} WHERE NOT starts_with(name, 'A') GROUP BY file_id HAVING count(*) FILTER (kind = 'class') > 0 OR count(*) FILTER (kind = 'function') > 3")
def api_surface(t):
    s = symbols(t).where(~F.col("name").startswith("A")).groupBy("file_id").agg(F.count_if(F.col("kind") == "class").alias("n_classes"), F.count_if(F.col("kind") == "function").alias("n_functions"))
    return s.where("n_classes > 0 or n_functions > 3")


# --- ranking

BM = """
WITH d AS (SELECT chunk_id AS id, language, t, len(t) AS dl, len(list_filter(t, lambda x: x = 'public')) AS a, len(list_filter(t, lambda x: x = 'license')) AS b FROM {toks}),
s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, count(*) FILTER (a > 0) AS na, count(*) FILTER (b > 0) AS nb FROM d),
r AS (SELECT id, language, round(greatest(ln((n - na + 0.5) / (na + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl)) + greatest(ln((n - nb + 0.5) / (nb + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM d, s WHERE a > 0 AND b > 0)
"""


@query("bm25_chunks", BM + "SELECT id, score FROM r ORDER BY score DESC, id LIMIT 10")
def bm25_chunks(t):
    return lexical.bm25(chunks(t), "Public license", "chunk_id", "content", 10)


@query("bm25_filtered", BM + "SELECT id, score FROM r WHERE language = 'en' ORDER BY score DESC, id LIMIT 10")
def bm25_filtered(t):
    return lexical.bm25(chunks(t), "public_license"[:6] + " license", "chunk_id", "content", 10, F.col("language") == "en")


@query("bm25_phrase", """
WITH d AS (SELECT chunk_id AS id, len(t) AS dl, len(list_filter(range(1, len(t)), lambda i: t[i] = 'public' AND t[i + 1] = 'license')) AS tf FROM {toks}), s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, count(*) FILTER (tf > 0) AS k FROM d)
SELECT id, round(greatest(ln((n - k + 0.5) / (k + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM d, s WHERE tf > 0 ORDER BY score DESC, id LIMIT 10""")
def bm25_phrase(t):
    return lexical.bm25_phrase(chunks(t), "public_license", "chunk_id", "content", 10)


@query("bm25_symbols", """
WITH d AS (SELECT symbol_id AS id, lower(name) = 'the' AS hit, len(regexp_extract_all(strip_accents(lower(name)), '[\\p{L}\\p{N}]+')) AS dl FROM {symbols}), s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, count(*) FILTER (hit) AS k FROM d)
SELECT id, round(greatest(ln((n - k + 0.5) / (k + 0.5)), 1e-6) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM d, s WHERE hit ORDER BY score DESC, id LIMIT 25""")
def bm25_symbols(t):
    return lexical.bm25(symbols(t), "The", "symbol_id", "name", 25)


@query("postings", "SELECT chunk_id AS id, CAST(len(t) AS BIGINT) AS dl, term, count(*) AS tf FROM (SELECT *, unnest(t) AS term FROM {toks}) GROUP BY ALL")
def postings(t):
    return lexical.postings(chunks(t), "chunk_id", "content")


@query("symbol_to_chunk", "SELECT s.symbol_id, min_by(c.chunk_id, c.start_line) AS chunk_id FROM {symbols} s JOIN {chunks} c ON c.file_id = s.file_id AND s.line BETWEEN c.start_line AND c.end_line GROUP BY s.symbol_id")
def symbol_to_chunk(t):
    return fusion.symbols_to_chunks(symbols(t), chunks(t))


@query("symbol_to_chunk_once")
def symbol_to_chunk_once(t):
    return fusion.symbols_to_chunks_once(symbols(t).withColumn("rank", F.col("line")), chunks(t))


@query("example_score", "SELECT chunk_id, (CASE WHEN start_line % 3 = 0 THEN 1.0 ELSE 0 END + CASE WHEN len(string_split(content, chr(10))) BETWEEN 5 AND 50 THEN 0.5 ELSE 0 END + CASE WHEN len(list_filter(string_split(content, ' '), lambda x: length(x) > 3)) > 0 THEN 0.3 ELSE 0 END)::DOUBLE AS score FROM {chunks}")
def example_score(t):
    kind = F.when(F.col("start_line") % 3 == 0, "function").otherwise("module")
    return chunks(t).select("chunk_id", fusion.example_score(kind, F.col("content"), F.split("content", " ")).alias("score"))


@query("symbol_line", "SELECT symbol_id, line FROM {symbols}")
def symbol_line(t):
    return symbols(t).select("symbol_id", F.expr(r"try_cast(regexp_extract(symbol_id, '::L(-?\\d+)$', 1) as bigint)").alias("line"))


@query("budget_pack", "SELECT chunk_id FROM (SELECT chunk_id, sum(length(content) // 4) OVER (PARTITION BY file_id ORDER BY start_line ROWS UNBOUNDED PRECEDING) AS s FROM {chunks}) WHERE s <= 200")
def budget_pack(t):
    return context.pack(chunks(t), text.tokens_div4(F.col("content")), 200, "file_id", "start_line").select("chunk_id")


@query("pack_priority", """
WITH RECURSIVE o AS (SELECT source, doc_id, length(text) // 4 AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents), s AS (SELECT DISTINCT source, CAST(0 AS BIGINT) AS r, CAST(2000 AS BIGINT) AS room, '' AS taken, CAST(0 AS BIGINT) AS cut FROM documents
UNION ALL SELECT s.source, o.r, CASE WHEN room > 50 AND t <= room THEN room - t WHEN room > 100 AND t > room THEN 0 ELSE room END,
  CASE WHEN (room > 50 AND t <= room) OR (room > 100 AND t > room) THEN taken || CASE WHEN taken = '' THEN '' ELSE ',' END || doc_id ELSE taken END, CASE WHEN room > 100 AND t > room THEN room ELSE cut END FROM s JOIN o ON o.source = s.source AND o.r = s.r + 1)
SELECT source, arg_max(taken, r) AS taken, arg_max(cut, r) AS cut FROM s GROUP BY source""")
def pack_priority(t):
    items = t.documents.select("source", F.col("doc_id").alias("id"), F.col("doc_id").alias("rank"), "text")
    return context.pack_priority(items, 2000, "source")


@query("doc_with_chunks", "SELECT file_id, count(*) AS n_chunks, string_agg(chunk_id, ',' ORDER BY start_line) AS chunk_ids FROM {chunks} GROUP BY file_id")
def doc_with_chunks(t):
    c = chunks(t).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start_line", "chunk_id"))).alias("c"))
    return files(t).select("file_id").join(c, "file_id").select("file_id", F.size("c").cast(LONG).alias("n_chunks"), F.array_join("c.chunk_id", ",").alias("chunk_ids"))


# --- increments


def old(t) -> DataFrame:
    return t.documents.where("doc_id % 10 <> 0").select("doc_id", "text")


def new(t) -> DataFrame:
    return t.documents.where("doc_id % 10 <> 1").select("doc_id", F.when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"))


DIFF = "SELECT doc_id, CASE WHEN o.text IS NULL THEN 'new' WHEN n.text IS NULL THEN 'deleted' ELSE 'changed' END AS status FROM {old} o FULL JOIN {new} n USING (doc_id) WHERE o.text IS DISTINCT FROM n.text"


def diff(t) -> DataFrame:
    hashed = lambda d: d.select("doc_id", F.sha2("text", 256).alias("hash"))
    return incremental.snapshot_diff(hashed(old(t)), hashed(new(t)), "doc_id", "hash")


@query("snapshot_diff", DIFF)
def snapshot_diff(t):
    return diff(t)


@query("upsert_files", "SELECT doc_id, sha256(text) AS hash FROM {new} UNION ALL SELECT doc_id, sha256(text) FROM {old} WHERE doc_id NOT IN (SELECT doc_id FROM new)")
def upsert_files(t):
    return incremental.upsert(old(t), new(t), "doc_id").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("upsert_chunks", "SELECT chunk_id, CASE WHEN doc_id % 10 = 2 THEN 'new' ELSE content END AS content FROM {chunks}")
def upsert_chunks(t):
    c = chunks(t)
    return incremental.upsert(c.select("chunk_id", "content"), c.where("doc_id % 10 = 2").select("chunk_id", F.lit("new").alias("content")), "chunk_id")


@query("merge_latest", "SELECT doc_id, max_by(text, v) AS text FROM (SELECT *, 1 AS v FROM {old} UNION ALL SELECT *, 2 FROM {new}) GROUP BY doc_id")
def merge_latest(t):
    u = old(t).withColumn("v", F.lit(1)).unionByName(new(t).withColumn("v", F.lit(2)))
    return u.groupBy("doc_id").agg(F.max_by("text", "v").alias("text"))


@query("dedup_first", "SELECT name, min_by(symbol_id, (file_id, line)) AS symbol_id FROM {symbols} GROUP BY name")
def dedup_first(t):
    return symbols(t).groupBy("name").agg(F.min_by("symbol_id", F.struct("file_id", "line")).alias("symbol_id"))


@query("replace_symbols", "SELECT symbol_id FROM {symbols} WHERE doc_id % 10 <> 2 UNION ALL SELECT symbol_id || '!' FROM {symbols} WHERE doc_id % 20 = 2")
def replace_symbols(t):
    f = files(t).select("file_id", "doc_id")
    s = symbols(t).join(f, "file_id").select("file_id", "doc_id", "symbol_id")
    fresh = s.where("doc_id % 20 = 2").withColumn("symbol_id", F.concat("symbol_id", F.lit("!")))
    return incremental.replace_by(s, fresh, "file_id", f.where("doc_id % 10 = 2")).select("symbol_id")


@query("delete_file", "SELECT chunk_id FROM {chunks} WHERE doc_id NOT IN (3, 4)")
def delete_file(t):
    return chunks(t).join(one(t, (3,), (4,), schema="doc_id long"), "doc_id", "left_anti").select("chunk_id")


@query("stale_cleanup", "SELECT count(*) FILTER (doc_id % 10 <> 1) AS kept, count(*) FILTER (doc_id % 10 = 1) AS removed FROM documents")
def stale_cleanup(t):
    d, valid = t.documents.select("doc_id"), new(t).select("doc_id")
    k = d.join(valid, "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("kept"))
    return k.join(F.broadcast(d.join(valid, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("removed"))))  # one row each


@query("incremental_impact", "WITH f AS (" + DIFF + ") SELECT doc_id FROM f WHERE status <> 'deleted' UNION SELECT other FROM {near} JOIN f ON file = doc_id EXCEPT SELECT doc_id FROM f WHERE status = 'deleted'")
def incremental_impact(t):
    d = diff(t)
    hit = graph.impact(d.select(F.col("doc_id").alias("file")), edges(t)).select(F.col("file").alias("doc_id"))
    return hit.join(d.where("status = 'deleted'"), "doc_id", "left_anti")


# Facts of the files, put in wrong for one tenth, then put right (twice: the second counts for nothing), one tenth then deleted

HELD = "hf AS (SELECT f.language, c.source, f.line_count, c.complexity FROM {cx} c JOIN {files} f USING (doc_id) WHERE doc_id % 10 <> 3)"


def held(t) -> Rollup:
    r = Rollup(Store(t.spark, t.scratch()), "files", "file_id", ["language", "source"], ["line_count", "complexity"], ["complexity"])
    f = t.written(complexity(t).select("doc_id", *r.columns), "facts")
    off = F.when(F.col("doc_id") % 10 == 2, 1000).otherwise(0)
    r.apply(f.withColumn("complexity", F.col("complexity") + off).withColumn("line_count", F.col("line_count") + off), 1)
    for _ in range(2):
        r.apply(f.where("doc_id % 10 = 2"), 2)
    r.delete(f.where("doc_id % 10 = 3"), 3)
    return r


@query("rollup_files", "WITH " + HELD + ", u AS (SELECT 'all' AS kind, NULL AS key, * FROM hf UNION ALL SELECT 'language', language, * FROM hf UNION ALL SELECT 'source', source, * FROM hf) SELECT kind, key, count(*) AS n, CAST(sum(line_count) AS BIGINT) AS sum_line_count, CAST(sum(complexity) AS BIGINT) AS sum_complexity, min(complexity) AS min_complexity, max(complexity) AS max_complexity, count(DISTINCT complexity) AS different_complexity FROM u GROUP BY kind, key")
def rollup_files(t):
    return held(t).read()


@query("rollup_bins", "WITH " + HELD + " SELECT source, CASE WHEN complexity <= 5 THEN 'low (1-5)' WHEN complexity <= 10 THEN 'medium (6-10)' WHEN complexity <= 20 THEN 'high (11-20)' ELSE 'very high (>20)' END AS bin, count(*) AS n FROM hf GROUP BY ALL")
def rollup_bins(t):
    """Complexity of each source's files in bins, from the counts of values."""
    v = held(t).values("complexity").where("kind = 'source'")
    return v.groupBy(F.col("key").alias("source"), metrics.complexity_bin(F.col("value")).alias("bin")).agg(F.sum("n").alias("n"))


@query("rollup_degrees", "WITH e AS (SELECT src, CASE WHEN src % 10 = 2 THEN src + 1 ELSE dst END AS dst FROM {edges} WHERE src % 10 <> 3) SELECT file, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT src AS file, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY file")
def rollup_degrees(t):
    """Dependencies out and in of each file, after some files have other ones and some have none."""
    r = Rollup(Store(t.spark, t.scratch()), "edges", "src", ["src", "dst"])
    e = t.written(edges(t), "edges")
    r.apply(e, 1)
    r.apply(e.where("src % 10 = 2").withColumn("dst", F.col("src") + 1), 2)
    r.delete(e.where("src % 10 = 3"), 3)
    n = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias({"src": "n_out", "dst": "n_in"}[kind])
    return r.read().where("kind <> 'all'").groupBy(F.col("key").cast(LONG).alias("file")).agg(n("src"), n("dst"))


@query("impacted_docs", "SELECT DISTINCT b.doc_id FROM documents a JOIN documents b ON a.source = b.source WHERE a.doc_id IN (5, 17, 40)")
def impacted_docs(t):
    d = t.documents.select("doc_id", "source")
    return d.join(d.where(F.col("doc_id").isin(5, 17, 40)).select("source").distinct(), "source", "left_semi").select("doc_id")


@query("impacted_pages", "SELECT 'api/' || file_id || '.md' AS page FROM {files} WHERE source IN (SELECT source FROM documents WHERE doc_id IN (5, 17))")
def impacted_pages(t):
    f = files(t).select("file_id", "source", "doc_id")
    return f.join(f.where(F.col("doc_id").isin(5, 17)).select("source"), "source", "left_semi").select(F.concat(F.lit("api/"), F.col("file_id"), F.lit(".md")).alias("page"))


@query("shared_sources", "SELECT source, count(*) AS n_docs, min(doc_id) AS first FROM documents GROUP BY source HAVING count(*) > 1")
def shared_sources(t):
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first")).where("n_docs > 1")


@query("page_sources", "SELECT file, string_agg(other, ',' ORDER BY other) AS sources FROM {near} GROUP BY file")
def page_sources(t):
    return graph.neighbours(edges(t)).groupBy("file").agg(F.array_join(F.sort_array(F.collect_set("other")), ",").alias("sources"))


@query("dep_hash", "SELECT source, sha256(string_agg(doc_id || ':' || n_chars, '|' ORDER BY doc_id || ':' || n_chars)) AS hash FROM documents GROUP BY source")
def dep_hash(t):
    x = F.concat_ws(":", F.col("doc_id"), F.col("n_chars"))
    return t.documents.groupBy("source").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(x)), "|"), 256).alias("hash"))


@query("dep_tracker_stats", "SELECT count(DISTINCT src) AS n_docs, count(DISTINCT dst) AS n_sources, round(count(*) / count(DISTINCT src)::DOUBLE, 6) AS mean FROM {edges}")
def dep_tracker_stats(t):
    e = edges(t)
    return e.agg(F.count_distinct("src").alias("n_docs"), F.count_distinct("dst").alias("n_sources"), F.round(F.count(F.lit(1)) / F.count_distinct("src"), 6).alias("mean"))


@query("override_stats", "SELECT coalesce(kind, 'all') AS kind, n FROM (SELECT CASE WHEN toxic = 1 THEN 'skip' WHEN quality = 0 THEN 'template' ELSE 'none' END AS kind, count(*) AS n FROM labels GROUP BY ROLLUP (1))")
def override_stats(t):
    kind = F.when(F.col("toxic") == 1, "skip").when(F.col("quality") == 0, "template").otherwise("none")
    return t.labels.select(kind.alias("kind")).rollup("kind").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("kind", F.lit("all")).alias("kind"), "n")


@query("overrides_list", "SELECT doc_id FROM labels WHERE toxic = 1 ORDER BY doc_id DESC")
def overrides_list(t):
    return t.labels.where("toxic = 1").select("doc_id").orderBy(F.desc("doc_id"))


@query("overrides_upsert", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE toxic END AS toxic FROM labels")
def overrides_upsert(t):
    old_rows = t.labels.select("doc_id", "toxic")
    return incremental.upsert(old_rows, old_rows.where("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("toxic")), "doc_id")


@query("skip_anti", "SELECT file_id FROM {files} WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def skip_anti(t):
    return files(t).join(t.labels.where("toxic = 1"), "doc_id", "left_anti").select("file_id")


@query("status_report", "WITH f AS (" + DIFF + ") SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(*) FROM f WHERE status = 'new') AS n_new, (SELECT count(*) FROM f WHERE status = 'changed') AS n_changed, (SELECT count(*) FROM f WHERE status = 'deleted') AS n_deleted")
def status_report(t):
    d = diff(t).agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("new", "changed", "deleted")))
    return t.documents.agg(F.count(F.lit(1)).alias("n_docs")).join(F.broadcast(d))  # one row each


@query("file_relationships", "SELECT file AS doc_id, n_out, n_in, n_out + n_in AS centrality FROM {deg} WHERE file IN (1, 2, 3)")
def file_relationships(t):
    return graph.degrees(edges(t)).where(F.col("file").isin(1, 2, 3)).select(F.col("file").alias("doc_id"), "n_out", "n_in", (F.col("n_out") + F.col("n_in")).alias("centrality"))


# --- usage and conversations


@query("usage_by_provider", "WITH g AS (SELECT provider, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens, sum(cost) AS c, avg(cost) AS a FROM {usage} GROUP BY provider) SELECT provider, requests, tokens, round(c, 4) AS cost, round(sum(c) OVER () / sum(requests) OVER (), 4) AS avg_all, round(a, 4) AS avg_own FROM g")
def usage_by_provider(t):
    return usage.by_provider(calls(t))


@query("usage_window", "SELECT CASE WHEN grouping(provider) = 0 THEN 'provider' WHEN grouping(model) = 0 THEN 'model' ELSE 'all' END AS kind, coalesce(provider, model, '') AS key, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM {usage} WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY GROUPING SETS ((), (provider), (model))")
def usage_window(t):
    c = calls(t)
    c = c.join(F.broadcast(c.agg(F.max("ts").alias("last")))).where(F.col("ts") >= F.col("last") - F.expr("interval 7 days"))  # one row
    g = c.groupingSets([[], ["provider"], ["model"]], "provider", "model").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), F.grouping_id("provider", "model").alias("g"))
    kind = F.when(F.col("g") == 1, "provider").when(F.col("g") == 2, "model").otherwise("all")
    return g.select(kind.alias("kind"), F.coalesce("provider", "model", F.lit("")).alias("key"), "n", "tokens")


@query("usage_totals", "SELECT count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 4) AS cost FROM {usage}")
def usage_totals(t):
    return calls(t).agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"))


@query("embed_usage", "SELECT CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens) / greatest(1, count(*))::DOUBLE, 6) AS per_request FROM {usage}")
def embed_usage(t):
    return calls(t).agg(F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / F.greatest(F.lit(1), F.count(F.lit(1))), 6).alias("per_request"))


COST = "round(tokens * CASE WHEN model = 'model1' THEN 0.03::DOUBLE ELSE 0.01::DOUBLE END / 1000, 6)"


@query("call_cost", "SELECT event_id, " + COST + " AS cost FROM {usage}")
def call_cost(t):
    return calls(t).select("event_id", F.round(F.col("tokens") * usage.price(F.col("model")) / 1000, 6).alias("cost"))


@query("embed_cost", "SELECT model, round(sum(tokens) * CASE WHEN model = 'model1' THEN 0.03::DOUBLE ELSE 0.01::DOUBLE END / 1000, 6) AS cost FROM {usage} GROUP BY model")
def embed_cost(t):
    return calls(t).groupBy("model").agg(F.sum("tokens").alias("n")).select("model", F.round(F.col("n") * usage.price(F.col("model")) / 1000, 6).alias("cost"))


@query("ring_buffer_50", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def ring_buffer_50(t):
    return incremental.last_rows(t.events, 50, "ts", "event_id").select("event_id")


@query("last_n", "SELECT event_id, ts FROM (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 10) ORDER BY ts, event_id")
def last_n(t):
    return incremental.last_rows(t.events, 10, "ts", "event_id").select("event_id", "ts").orderBy("ts", "event_id")


@query("recent_sessions", "SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, conv_id LIMIT 10")
def recent_sessions(t):
    return t.conversations.groupBy("conv_id").agg(F.max("turn").alias("last_turn")).orderBy(F.desc("last_turn"), "conv_id").limit(10)


@query("trim_history", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text) // 4) OVER w AS s, row_number() OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)) WHERE s <= 100 OR r = 1")
def trim_history(t):
    return context.trim_history(t.conversations, text.tokens_div4(F.col("text")), 100).select("conv_id", "turn")


@query("conv_tokens", "SELECT conv_id, CAST(sum(length(role) // 4 + length(text) // 4 + 4) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def conv_tokens(t):
    return t.conversations.groupBy("conv_id").agg(F.sum(text.tokens_div4(F.col("role")) + text.tokens_div4(F.col("text")) + 4).alias("tokens"))


@query("followups", "SELECT conv_id, turn FROM conversations WHERE turn > 0 AND regexp_matches(lower(text), 'what about|and also|more about|the|tell me')")
def followups(t):
    return t.conversations.where((F.col("turn") > 0) & F.lower("text").rlike("what about|and also|more about|the|tell me")).select("conv_id", "turn")


@query("usage_percent", "SELECT conv_id, round(100.0 * sum(length(text) // 4) / 8192::DOUBLE, 4) AS percent FROM conversations GROUP BY conv_id")
def usage_percent(t):
    return t.conversations.groupBy("conv_id").agg(F.round(100.0 * F.sum(text.tokens_div4(F.col("text"))) / 8192, 4).alias("percent"))
