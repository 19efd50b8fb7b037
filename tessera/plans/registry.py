"""Where queries register, and the views that they and their SQL share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The tables of a directory, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def scratch(self) -> str:
        """A new folder in the shared one that the cluster names; only a local session may have none."""
        folder = self.spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not self.spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return f"{(folder or '/tmp/checkpoints/tessera').rstrip('/')}/plans-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """df, written to the shared folder and read back."""
        path = f"{self.scratch()}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register f(tables) -> DataFrame, and the SQL that gives its rows ({VIEW} names below stand for their definitions)."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return f

    return put


LINES = "CASE WHEN len(string_split(text, chr(10))) > 1 AND string_split(text, chr(10))[-1] = '' THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END"
VIEWS = {
    "files": f"SELECT doc_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS file_id, lang AS language, n_chars AS size_bytes, CAST(len({LINES}) AS BIGINT) AS line_count, source, text FROM documents",
    "lined": f"SELECT doc_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS file_id, lang AS language, {LINES} AS l, len({LINES}) AS n FROM documents",
    "chunks": "SELECT file_id || '#L' || s || '-L' || least(s + 9, n) AS chunk_id, doc_id, file_id, language, CAST(s AS BIGINT) AS start_line, CAST(least(s + 9, n) AS BIGINT) AS end_line, array_to_string(l[s:s + 9], chr(10)) AS content FROM (SELECT *, unnest(list_transform(range(0, CAST(greatest(0, ceil((n - 10) / 8.0)) AS BIGINT) + 1), lambda k: k * 8 + 1)) AS s FROM lined)",
    "symbols": "SELECT file_id || '::' || kind || '::' || name || '::L' || line AS symbol_id, file_id, doc_id, name, kind, line FROM (SELECT *, CASE WHEN line % 2 = 0 THEN 'class' ELSE 'function' END AS kind FROM (SELECT doc_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS file_id, CAST(i AS BIGINT) AS line, regexp_extract(string_split(text, chr(10))[i], '(\\p{Lu}\\p{L}+)', 1) AS name FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)) WHERE name <> '')",
    "edges": "SELECT DISTINCT src, dst FROM (SELECT doc_id AS src, (7 * doc_id + 3) % (SELECT count(*) FROM documents) AS dst FROM documents UNION ALL SELECT doc_id, doc_id // 2 FROM documents WHERE doc_id % 5 = 0) WHERE src <> dst",
    "near": "SELECT src AS file, dst AS other FROM edges UNION SELECT dst, src FROM edges",
    "hrefs": "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages",
    "deg": "SELECT file, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT src AS file, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY file",
    "syms": "SELECT file_id, doc_id, count(*) AS n_symbols FROM symbols GROUP BY ALL",
    "cx": "SELECT f.doc_id, f.file_id, f.language, f.source, coalesce(d.n_out, 0) + coalesce(s.n_symbols, 0) AS complexity, coalesce(d.n_out, 0) AS n_out FROM files f LEFT JOIN deg d ON d.file = f.doc_id LEFT JOIN syms s ON s.doc_id = f.doc_id",
    "old": "SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 0",
    "new": "SELECT doc_id, CASE WHEN doc_id % 10 = 2 THEN text || 'x' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 1",
    "usage": "SELECT event_id, ts, event_type AS provider, 'model' || (user_id % 4) AS model, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT) AS tokens, value AS cost FROM events",
    "toks": "SELECT chunk_id, file_id, language, regexp_extract_all(strip_accents(lower(content)), '[\\p{L}\\p{N}]+') AS t FROM chunks",
}
NEEDS = {"chunks": ["lined"], "near": ["edges"], "deg": ["edges"], "syms": ["symbols"], "cx": ["files", "deg", "syms"], "toks": ["chunks"]}


def with_views(sql: str) -> str:
    """sql with the definitions of the views that it names in braces, in front."""
    import re

    order: list[str] = []

    def need(name: str) -> None:
        for x in NEEDS.get(name, []):
            need(x)
        if name not in order:
            order.append(name)

    for name in re.findall(r"\{([a-z]+)\}", sql):
        need(name)
    body = re.sub(r"\{([a-z]+)\}", r"\1", sql).strip()
    views = ", ".join(f"{v} AS ({VIEWS[v]})" for v in order)
    if not views:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views}, {body[len('WITH RECURSIVE') :]}"
    return f"WITH {views}, {body[4:]}" if body.upper().startswith("WITH ") else f"WITH {views} {body}"
