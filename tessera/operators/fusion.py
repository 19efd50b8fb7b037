"""Reciprocal rank fusion and rescoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizes import small_side


def rrf(lists: Sequence[DataFrame], k: int = 60, n: int | None = None) -> DataFrame:
    """query_id, id, score, source. Each list: query_id, id, rank (from 1); their order is their priority. The n best a query."""
    every = None
    for i, x in enumerate(lists):
        x = x.select("query_id", "id", "rank", F.lit(i).alias("src"))
        every = x if every is None else every.unionByName(x)
    out = every.groupBy("query_id", "id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 6).alias("score"), F.min("src").cast("long").alias("source"))
    if n is None:
        return out
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def first_ranks(hits: DataFrame, order: str, n: int) -> DataFrame:
    """query_id, id, rank of the n first hits (query_id, id) of each query."""
    w = Window.partitionBy("query_id").orderBy(order, "id")
    return hits.select("query_id", "id", F.row_number().over(w).cast("long").alias("rank")).where(F.col("rank") <= n)


def first_named(named: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """query_id, id, rank of the n first rows that a query (query_id, term) names, by line. named: term, id, line.

    Each term keeps its n first rows before the queries are joined, so that a query meets n rows a term, however many rows have
    it: a row that is among a query's first is so among those of the term that gives its line.
    """
    asked = small_side(asked)
    rows = named.join(small_side(asked.select("term").distinct()), "term", "left_semi").groupBy("term", "id").agg(F.min("line").alias("line"))
    of_term = Window.partitionBy("term").orderBy("line", "id")
    rows = rows.withColumn("_r", F.row_number().over(of_term)).where(F.col("_r") <= n).drop("_r")
    return first_ranks(rows.join(asked, "term").groupBy("query_id", "id").agg(F.min("line").alias("line")), "line", n)


def hybrid(dense: DataFrame | None, texts: DataFrame, symbols: DataFrame, n: int) -> DataFrame:
    """query_id, id, source, rank: the fused lists where there are vectors, else the texts and then the symbols."""
    if dense is None:
        return in_order([texts, symbols], n)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rrf([dense, texts, symbols], n=n).select("query_id", "id", "source", F.row_number().over(w).cast("long").alias("rank"))


def in_order(lists: Sequence[DataFrame], n: int) -> DataFrame:
    """query_id, id, source, rank: the lists one behind the other, cut to n a query (lexical search without vectors)."""
    every = None
    for i, x in enumerate(lists):
        x = x.select("query_id", "id", F.col("rank").alias("r"), F.lit(i).cast("long").alias("source"))
        every = x if every is None else every.unionByName(x)
    w = Window.partitionBy("query_id").orderBy("source", "r")
    return every.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n).drop("r")


def example_score(kind: Column, content: Column, symbols: Column) -> Column:
    """+1 for a function or method, +0.5 for 5 to 50 lines, +0.3 for a symbol of more than three letters."""
    n = F.regexp_count(content, F.lit("\n")) + 1
    return F.when(kind.isin("function", "method"), 1.0).otherwise(0.0) + F.when(n.between(5, 50), 0.5).otherwise(0.0) + F.when(F.exists(symbols, lambda s: F.length(s) > 3), 0.3).otherwise(0.0)


def symbols_to_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """symbol_id, chunk_id: the first chunk by start that covers the symbol's line. A range join inside an equi-join by file."""
    c = chunks.select("file_id", "chunk_id", "start_line", "end_line")
    cover = hits.join(c, "file_id").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    return cover.groupBy("symbol_id").agg(F.min(F.struct("start_line", "chunk_id")).alias("m")).select("symbol_id", F.col("m.chunk_id").alias("chunk_id"))


def symbols_to_chunks_once(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """file_id, chunk_id, symbol_id: as above, but a chunk that was given to an earlier symbol is passed over. hits has rank.

    Sequential inside a file only: a fold over its hits, carrying the chunks that are taken.
    """
    c = chunks.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("start_line", "end_line", "chunk_id"))).alias("c"))
    h = hits.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("rank", "symbol_id", "line"))).alias("h")).join(c, "file_id")

    def give(acc: Column, x: Column) -> Column:
        free = F.filter(F.col("c"), lambda k: x["line"].between(k["start_line"], k["end_line"]) & ~F.exists(acc, lambda a: a["chunk_id"] == k["chunk_id"]))
        one = F.struct(F.get(free, F.lit(0))["chunk_id"].alias("chunk_id"), x["symbol_id"].alias("symbol_id"))
        return F.when(F.size(free) > 0, F.concat(acc, F.array(one))).otherwise(acc)

    got = h.select("file_id", F.explode(F.aggregate("h", F.array().cast("array<struct<chunk_id:string,symbol_id:string>>"), give)).alias("x"))
    return got.select("file_id", "x.chunk_id", "x.symbol_id")
