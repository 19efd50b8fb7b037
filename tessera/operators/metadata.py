"""What a file declares, in the order of its text, as columns of the file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import parsing

FIELDS = ["imports", "classes", "functions", "docstring"]
SCHEMA = "imports array<string>, classes array<string>, functions array<string>, docstring string"
FOUND = ["kind", "name", "start_line", "end_line", "parents"]
#: Languages whose comments that open with two stars document what follows.
STARRED = ("javascript", "typescript", "java")


def documentation(text: str, language: str) -> str | None:
    """The first string in three double quotes (Python), or the first starred comment, without white space around it."""
    if language != "python" and language not in STARRED:
        return None
    s = parsing.scan(text, language)
    spans, mark = (s.strings, '"""') if language == "python" else (s.comments, "/**")
    for a, b in spans:
        if text.startswith(mark, a) and b - a >= len(mark) + len(mark[1:]):
            return text[a + len(mark) : b - (3 if language == "python" else 2)].strip()
    return None


def described(text: str, language: str, rows: list[tuple] | None = None) -> tuple[list[str], list[str], list[str], str | None]:
    """imports (statements), classes, functions (methods too) and the documentation of one text; rows: what the parser gave for it."""
    lists: dict[str, list[str]] = {"import": [], "class": [], "function": []}
    known = language == "python" or language in STARRED
    for kind, name, *_ in (parsing.rows_of(text, language) if rows is None else rows) if known else []:
        lists["function" if kind == "method" else kind].append(name.rstrip(";"))
    return *lists.values(), documentation(text, language)


def read(files: DataFrame) -> DataFrame:
    """files without their text, with FIELDS and found: the parser's rows (kind, name, start_line, end_line, parents). One pass over
    the texts, for those who need both."""
    kept = [c for c in files.columns if c != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*kept).schema.fields)
    found = pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("start_line", pa.int64()), ("end_line", pa.int64()), ("parents", pa.list_(pa.string()))]))
    types = [pa.list_(pa.string())] * 3 + [pa.string(), found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for language, text in zip(b.column("language").to_pylist(), b.column("text").to_pylist(), strict=True):
                rows = parsing.rows_of(text or "", language)
                out.append((*described(text or "", language, rows), [dict(zip(FOUND, r, strict=False)) for r in rows]))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *columns], [*kept, *FIELDS, "found"])

    return files.select(*kept, "text").mapInArrow(run, f"{kinds}, {SCHEMA}, found array<struct<kind:string,name:string,start_line:bigint,end_line:bigint,parents:array<string>>>")


def extract(files: DataFrame) -> DataFrame:
    """files (language, text) with FIELDS; other languages have empty lists and no docstring. A null text is an empty one."""

    @F.pandas_udf(SCHEMA)
    def run(language: pd.Series, text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([described(t or "", x) for x, t in zip(language, text, strict=True)], columns=FIELDS)

    d = files.select("*", run("language", "text").alias("_described"))
    return d.select(*files.columns, *(F.col("_described")[n].alias(n) for n in FIELDS))
