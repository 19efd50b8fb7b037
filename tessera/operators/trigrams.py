"""Search by pattern over an index of trigrams: rows that can't match are never read."""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of an index, rows and postings of a segment (at most, or one row), and how many of a pattern's rarest trigrams are
#: asked for.
BUCKETS, SEGMENT, POSTS, ASKED = 16, 8192, 8_000_000, 4
BITS = 21  # of a code point


def folded(c: int) -> int:
    """A-Z as a-z; an index looks at no other cases."""
    return c + 32 if 65 <= c <= 90 else c


def runs(tree, any_case: bool) -> list[list[int]]:
    """Sequences of characters that every match of a parsed pattern holds."""
    out: list[list[int]] = [[]]
    for op, arg in tree:
        if op is C.LITERAL and (arg < 128 or not any_case):
            out[-1].append(folded(arg))
        elif op is C.SUBPATTERN:
            inner = runs(arg[3], any_case or bool(arg[1] & re.IGNORECASE))
            plain = all(x is C.LITERAL for x, _ in arg[3]) and len(inner) == 1
            out = [*out[:-1], out[-1] + inner[0]] if plain else [*out, *inner, []]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
            out += [*runs(arg[2], any_case), []]
        elif op is not C.AT:  # an anchor parts nothing
            out.append([])
    return out


def required(pattern: str) -> list[int]:
    """Trigrams that every text that matches holds, as numbers; none for a pattern that this parser does not know, or that
    need not hold three known characters in a row."""
    try:
        tree = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return []
    found = runs(tree, bool(tree.state.flags & re.IGNORECASE))
    return sorted({(a << 2 * BITS) | (b << BITS) | c for x in found for a, b, c in zip(x, x[1:], x[2:], strict=False)})


def grams(text: str) -> np.ndarray:
    """The different trigrams of a text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.where((c >= 65) & (c <= 90), c + 32, c)
    return np.unique((c[:-2] << 2 * BITS) | (c[1:-1] << BITS) | c[2:]) if len(c) > 2 else np.zeros(0, np.int64)


def segment(number: int, ids: list[pa.Array], held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """gram, seg, n, rows, ids: the blocks of a task's segment, by trigram, and its ids (no trigram)."""
    seg = (TaskContext.get().partitionId() << 32) + number
    gram, row = np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for x in held])
    order = np.argsort(gram, kind="stable")
    gram, row = gram[order], row[order]
    own = pa.concat_arrays(ids)
    names, lists = ["gram", "seg", "n", "rows", "ids"], pa.list_(own.type)
    whole = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([seg]), pa.array([len(own)]), pa.nulls(1, pa.list_(pa.int32())), whole], names)
    begin = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
    ends = np.append(begin[1:], len(gram))[: len(begin)]
    for i in range(0, len(begin), 20_000):
        a, z = begin[i : i + 20_000], ends[i : i + 20_000]
        offsets = pa.array((np.append(a, z[-1]) - a[0]).astype(np.int32))
        body = pa.ListArray.from_arrays(offsets, pa.array(row[a[0] : z[-1]]))
        yield pa.RecordBatch.from_arrays([pa.array(gram[a]), pa.array(np.full(len(a), seg)), pa.array(z - a), body, pa.nulls(len(a), lists)], names)


class Trigrams:
    """Postings of trigrams as a table below a folder, in blocks of one trigram and segment, so that none is too frequent for
    one task. A segment is a run of rows of one task, which numbers them and puts their postings in order, so nothing is
    shuffled; ids are kept once a row. A search reads the blocks of a few rare trigrams of its pattern, and of the rows those
    that have them all."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, rows: DataFrame, id_col: str, text_col: str) -> Trigrams:
        """Index the texts; a null one has no trigrams. Each text is read whole, by itself."""
        kind = rows.schema[id_col].dataType.simpleString()
        most_rows, most_posts = SEGMENT, POSTS

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made, ids, held, posts = 0, [], [], 0
            for b in batches:
                for k, text in enumerate(b.column(1)):
                    ids.append(b.column(0).slice(k, 1))
                    held.append(grams(text.as_py() or ""))
                    posts += len(held[-1])
                    if len(ids) >= most_rows or posts >= most_posts:
                        yield from segment(made, ids, held)
                        made, ids, held, posts = made + 1, [], [], 0
            if ids:
                yield from segment(made, ids, held)

        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "1000")  # for this write; texts can be long
        try:
            d = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            d = d.mapInArrow(split, f"gram long, seg long, n long, rows array<int>, ids array<{kind}>")
            bucket = F.when(F.col("gram").isNull(), -1).otherwise(F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int"))
            d.withColumn("bucket", bucket).sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/grams")
        finally:
            self.spark.conf.set(key, before)
        self.spark.createDataFrame([], f"gram long, seg long, n long, rows array<int>, ids array<{kind}>, bucket int").write.mode("overwrite").parquet(f"{self.root}/schema")
        return self

    def candidates(self, pattern: str) -> DataFrame | None:
        """id of the rows with all of some rare trigrams that a match must hold; None if the pattern requires none."""
        need = required(pattern)
        if not need:
            return None
        table = self.spark.read.schema(self.spark.read.parquet(f"{self.root}/schema").schema).parquet(f"{self.root}/grams")
        mine = table.where(F.col("gram").isin(need))  # the pattern's own trigrams, pushed to the scan
        counts = {r.gram: r.n for r in mine.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row a trigram of the pattern
        rare = sorted(need, key=lambda g: (counts.get(g, 0), g))[:ASKED]
        hit = table.where(F.col("gram").isin(rare)).select("seg", F.explode("rows").alias("row"))
        hit = hit.groupBy("seg", "row").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rare))
        hit = hit.groupBy("seg").agg(F.collect_list("row").alias("hits"))  # at most a segment's rows
        ids = table.where("bucket = -1").select("seg", "ids").join(hit, "seg")
        return ids.select(F.explode(F.transform("hits", lambda k: F.get("ids", k))).alias("id")).distinct()

    def search(self, rows: DataFrame, pattern: str, id_col: str, text_col: str) -> DataFrame:
        """The rows (those that were indexed) whose text the pattern, a Java regular expression, is found in."""
        some = self.candidates(pattern)
        near = rows if some is None else rows.join(some.withColumnRenamed("id", "_id"), F.col(id_col) == F.col("_id"), "left_semi")
        return near.where(F.col(text_col).rlike(pattern))


def lines(rows: DataFrame, text_col: str, where: Column) -> DataFrame:
    """rows without the text, with line_number (from 1) and line of the lines for which `where`, over the column s, holds."""
    kept = [c for c in rows.columns if c != text_col]
    d = rows.select(*kept, F.posexplode(F.split(F.col(text_col), "\n")).alias("i", "s")).where(where)
    return d.select(*kept, (F.col("i") + 1).cast("long").alias("line_number"), F.trim("s").alias("line"))
