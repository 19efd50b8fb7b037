"""Functions for users' SQL: terms, lines, chunks, parsing, search, definitions, references and impact.

All but the parser are SQL functions that Catalyst inlines into the query that calls them: their joins, filters and columns are
planned with it, and no Python runs. A table function may stand behind LATERAL, over all rows of a table; only search_chunks
may not, it takes one constant question (a table of questions goes to Engine.retrieve).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from .functions.text import ACCENTED, PLAIN, TOKEN
from .operators import parsing
from .operators.lexical import FLOOR, K1, B

#: Views that the functions over an index read, with the columns that they need.
VIEWS = {"chunks": "chunk_id string, content string", "symbols": "symbol_id string, file_id string, name string, kind string, line bigint", "edges": "src string, dst string"}

#: Name, arguments, result, body; @ stands for the prefix of functions and views. A null argument gives null or no rows.
FUNCTIONS = [
    ("terms_of", "x STRING", "ARRAY<STRING>", f"regexp_extract_all(translate(lower(x), '{ACCENTED}', '{PLAIN}'), r'{TOKEN}', 0)"),
    ("lines_of", "x STRING", "ARRAY<STRING>", "if(endswith(x, '\\n'), slice(split(x, '\\n'), 1, size(split(x, '\\n')) - 1), split(x, '\\n'))"),
    ("tokens_in", "x STRING", "BIGINT", "CAST(floor(length(x) / 4) AS BIGINT)"),
    (
        "sliding_chunks", "x STRING, width INT DEFAULT 100, overlap INT DEFAULT 20", "TABLE(start_line BIGINT, end_line BIGINT, content STRING)",
        """SELECT s, least(s + w - 1, n), array_join(slice(l, CAST(s AS INT), w), '\\n')
        FROM (SELECT l, w, n, explode(transform(sequence(0, CAST(greatest(0, ceil((n - w) / step)) AS INT)), k -> CAST(k AS BIGINT) * step + 1)) AS s
            FROM (SELECT l, w, step, size(l) AS n FROM (SELECT @lines_of(x) AS l, width AS w, width - overlap AS step)) WHERE l IS NOT NULL)""",
    ),
    (
        "search_chunks", "question STRING, most INT DEFAULT 10", "TABLE(chunk_id STRING, score DOUBLE, rank BIGINT)",
        f"""WITH w AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(regexp_count(translate(lower(content), '{ACCENTED}', '{PLAIN}'), r'{TOKEN}')) AS mean FROM @chunks),
        t AS (SELECT chunk_id, @terms_of(content) AS t, q FROM (SELECT chunk_id, content, @terms_of(question) AS q FROM @chunks) WHERE exists(q, y -> contains(translate(lower(content), '{ACCENTED}', '{PLAIN}'), y))),
        p AS (SELECT chunk_id, dl, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT chunk_id, size(t) AS dl, explode(filter(t, y -> array_contains(q, y))) AS term FROM t) GROUP BY ALL),
        h AS (SELECT term, CAST(count(*) AS DOUBLE) AS held FROM p GROUP BY term),
        r AS (SELECT p.chunk_id, round(sum(greatest(ln((n - held + 0.5D) / (held + 0.5D)), {FLOOR}D) * tf * {K1 + 1}D / (tf + {K1}D * ({1 - B}D + {B}D * dl / mean))), 6) AS score, count(*) AS have
            FROM p JOIN h ON p.term = h.term CROSS JOIN w GROUP BY p.chunk_id),
        o AS (SELECT chunk_id, score FROM r WHERE have = size(array_distinct(@terms_of(question))))
        SELECT chunk_id, score, rank FROM (SELECT chunk_id, score, CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS BIGINT) AS rank FROM o) WHERE rank <= most""",
    ),
    ("definitions_of", "wanted STRING", "TABLE(symbol_id STRING, file_id STRING, kind STRING, line BIGINT)", "SELECT symbol_id, file_id, kind, line FROM @symbols WHERE name = wanted"),
    ("references_to", "wanted STRING", "TABLE(symbol_id STRING, file_id STRING)", "SELECT DISTINCT s.symbol_id, e.src FROM @symbols s JOIN @edges e ON e.dst = s.file_id WHERE s.name = wanted"),
    (
        "impact_of", "changed STRING", "TABLE(file_id STRING, steps INT)",
        """SELECT src, min(n) FROM (SELECT src, 1 AS n FROM @edges WHERE dst = changed
        UNION ALL SELECT b.src, 2 FROM @edges a JOIN @edges b ON b.dst = a.src WHERE a.dst = changed) WHERE src <> changed GROUP BY src""",
    ),
]


class Parse:
    """A row for each import, class, function and method of a source."""

    def eval(self, text: str | None, language: str | None) -> Iterator[tuple]:
        for kind, name, start, end, parents, content in parsing.rows_of(text or "", language or ""):
            yield kind, name, start, end, list(parents), content


def register(spark: SparkSession, views: Mapping[str, DataFrame] | None = None, prefix: str = "") -> list[str]:
    """Register the functions, and views (see VIEWS) that those over an index read, under names with a prefix; gives the names of
    the functions. Functions whose views are not there are left out. What had these names in the session is replaced."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(prefix + name)
    have = {x.name for x in spark.catalog.listTables() if x.isTemporary}
    made = []
    for name, arguments, result, body in FUNCTIONS:
        if all(prefix + v in have for v in VIEWS if f"@{v}" in body):
            body = body.replace("@", prefix)
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS {result} RETURN {body}")
            made.append(prefix + name)
    spark.udtf.register(f"{prefix}parse_source", udtf(Parse, returnType="kind string, name string, start_line bigint, end_line bigint, parents array<string>, content string"))
    return [*made, f"{prefix}parse_source"]
