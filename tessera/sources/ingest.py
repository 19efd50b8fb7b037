"""A directory, or a table of sources, into the tables of a store."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import chunk_id, symbol_id
from ..functions.text import lines
from ..operators import chunking, dense, docs, metadata, parsing
from . import tree
from .store import Store


def python_modules(files: DataFrame) -> DataFrame:
    """module, file_id of the Python files (file_id): dotted path, a package by its __init__."""
    p = files.where(F.col("file_id").endswith(".py"))
    name = F.regexp_replace(F.regexp_replace("file_id", r"\.py$", ""), "/__init__$", "")
    return p.select(F.replace(name, F.lit("/"), F.lit(".")).alias("module"), "file_id")


def sized(sources: DataFrame) -> DataFrame:
    """file_id, language, text, size_bytes, line_count, hash."""
    return sources.select("file_id", "language", "text", F.octet_length("text").cast("long").alias("size_bytes"), F.size(lines(F.col("text"))).cast("long").alias("line_count"), F.sha2("text", 256).alias("hash"))


def tables(sources: DataFrame, size: int = 100, overlap: int = 20, embedder: str = "hash", read: DataFrame | None = None) -> dict[str, DataFrame]:
    """files, chunks, symbols, imports, edges, embeddings of sources (file_id, language, text); read: metadata.read(sized(sources)),
    where it is written already."""
    described = metadata.extract(sized(sources)) if read is None else read
    parsed = parsing.parse(sources) if read is None else read.select("file_id", F.inline("found"))
    named = parsed.where(F.col("kind").isin("class", "function", "method"))
    imports = parsed.where("kind = 'import'").select(F.col("file_id").alias("source"), F.col("name").alias("raw_text"), F.col("start_line").alias("line")).distinct()
    edges = docs.resolve_imports(imports.select("source", "raw_text").distinct(), python_modules(sources if read is None else read)).where("target is not null and target <> source")
    chunks = chunking.sliding(sources, size, overlap)
    return {
        "files": described.select("file_id", "language", "size_bytes", "line_count", *metadata.FIELDS, "hash"),
        "chunks": chunks.select("chunk_id", "file_id", "language", "start_line", "end_line", "content"),
        "symbols": named.select(symbol_id(F.col("file_id"), F.col("kind"), F.col("name"), F.col("start_line")).alias("symbol_id"), "file_id", "name", "kind", F.col("start_line").alias("line"), "end_line", "parents", chunk_id(F.col("file_id"), F.col("start_line"), F.col("end_line")).alias("chunk_id")),
        "imports": imports,
        "edges": edges.select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct(),
        "embeddings": dense.embed(chunks.select("chunk_id", "file_id", "content"), "content", embedder).drop("content"),
    }


def ingest(sources: DataFrame, store: Store, replace: bool = True, **options) -> None:
    """Write the tables of all sources, or (replace=False) put them in the place of what the store has of these files. The texts
    are parsed once, into a table that goes when the others are there."""
    path, once = f"{store.root}/_read/{uuid.uuid4().hex}", metadata.read(sized(sources))
    try:
        once.write.parquet(path)
        read = store.spark.read.schema(once.schema).parquet(path)
        for name, df in tables(sources, **options, read=read).items():
            owner = {"imports": "source", "edges": "src"}.get(name, "file_id")
            if replace or not store.exists(name):
                store.save(name, df, owner)
            else:
                store.replace_files(name, df, owner, read.select(F.col("file_id").alias(owner)))
    finally:
        at, fs = store._fs(path)
        fs.delete(at, True)


def ingest_directory(spark: SparkSession, root: str, store: Store, extensions: Sequence[str] | None = None, **options) -> None:
    ingest(tree.scan(spark, root, extensions).select(F.col("path").alias("file_id"), "language", "text"), store, **options)
