"""Line dedup by pairwise alignment.

A line is the hash of its trimmed characters; lines without a word are left alone. A run is the shortest sequence of
consecutive lines from a line on, or up to a line, that has `BLOCK` words or more. Each line of a block of `BLOCK` words or
more that two documents share is in a run inside the block, so runs find every block, of short or frequent lines too. For
each run that several documents hold, every later document is paired with the run's first holder (smallest id): one pair
for a document and run, however many documents share it and however frequent it is, so a group of copies is a star. Each
pair is aligned by patience diff: lines that either text holds once are matched in their longest increasing order, the gaps
between matches likewise, and matches grow over equal neighbours. A block of aligned lines with `BLOCK` words or more is
deleted from the later document. An alignment leaves out a block that stands in another order in the other text, overlaps an
aligned one or has only repeated lines; the runs of such blocks that the two texts share are matched on their own and go too.
So what goes from a document are all blocks of `BLOCK` words or more that any earlier document holds: a block's runs all have
a first holder, which is no later than that document.

Hash sequences travel, not texts; the text is joined once, to what is deleted from it.

Defined cases: a null or wordless text has no lines and stays as it is; null ids come last and are not compared with one
another, nor are rows that repeat an id; rows that repeat id and text get the same result; a text of any length is read
whole; an empty table gives an empty result. Columns of the input named like a result column are replaced, any other names
do no harm.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, materialize, mix, powers, restored, row_hash, shielded

BLOCK = 10


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions (i, j) of a and b, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        ones, others = Counter(a[i:m]), Counter(b[j:n])
        place = {x: k for k, x in enumerate(b[j:n], j) if others[x] == 1}
        pairs = [(k, place[x]) for k, x in enumerate(a[i:m], i) if ones[x] == 1 and x in place]
        tails: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for k, (_, y) in enumerate(pairs):  # longest increasing run of y
            at = bisect_left(tails, y)
            tails[at:at + 1], ends[at:at + 1] = [y], [k]
            back.append(ends[at - 1] if at else -1)
        k, run = (ends[-1] if ends else -1), []
        while k >= 0:
            run.append(pairs[k])
            k = back[k]
        if not run:
            continue
        left = (i, j)
        for x, y in [*reversed(run), (m, n)]:
            todo.append((left[0], x, left[1], y))
            if x < m:
                out.append((x, y))
            left = (x + 1, y + 1)
    return sorted(out)


def blocks(a: list[int], words: list[int], b: list[int], b_words: list[int], least: int = BLOCK) -> list[int]:
    """Positions of a in blocks that b holds too and that have at least so many words: those that align, and those left out."""
    if a == b:
        return list(range(len(a))) if sum(words) >= least else []
    gone, held = set(aligned(a, words, b, least)), set(b)
    left = [i for i, x in enumerate(a) if i not in gone and x in held]
    if left:
        lines, counts = np.array(a + b, np.int64), np.array(words + b_words, np.int64)
        doc, first, last, key = shortest_runs(lines, counts, np.array([len(a), len(b)]), least)
        own = doc == 0
        shared = np.isin(key[own], key[~own])
        for i, j in zip(first[own][shared].tolist(), last[own][shared].tolist(), strict=True):
            gone.update(range(i, j + 1))
    return sorted(gone)


def aligned(a: list[int], words: list[int], b: list[int], least: int = BLOCK) -> list[int]:
    """Positions of a in blocks that align with b and have at least so many words."""
    out: list[int] = []
    block: list[int] = []
    before = (-2, -2)
    for x, y in [*patience(a, b), (-9, -9)]:
        if (x, y) != (before[0] + 1, before[1] + 1):
            if sum(words[i] for i in block) >= least:
                out += block
            block = []
        block.append(x)
        before = (x, y)
    return out


def line_tables(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, h, at (line numbers), line (hashes), words: arrays over the lines with a word."""
    trimmed = F.transform(F.split(F.col(text_col), "\n"), lambda x, i: F.struct(i.alias("i"), F.trim(x, F.lit(" \t\r\f\x0b")).alias("x")))
    lines = F.transform(F.filter(trimmed, lambda s: s["x"] != ""), lambda s: F.struct(s["i"].alias("i"), F.xxhash64(s["x"]).alias("x"), F.regexp_count(s["x"], F.lit(WORDS)).alias("n")))
    last = F.lit((1 << 63) - 1)
    got = docs.select(F.coalesce(F.col(id_col).cast("long"), last).alias("id"), row_hash(docs, text_col).alias("h"), lines.alias("l")).where(F.size("l") > 0)
    return got.select("id", "h", F.col("l.i").alias("at"), F.col("l.x").alias("line"), F.col("l.n").alias("words"))


def shortest_runs(line: np.ndarray, words: np.ndarray, size: np.ndarray, least: int = BLOCK) -> tuple[np.ndarray, ...]:
    """doc, first, last, key of each run; line and words of all documents in a row, size: lines of each document."""
    n, end = len(line), np.cumsum(size)
    doc, total, i = np.repeat(np.arange(len(size)), size), np.concatenate([[0], np.cumsum(words, dtype=np.int64)]), np.arange(n)
    to = np.searchsorted(total, total[:-1] + least, "left") - 1
    since = np.searchsorted(total, total[1:] - least, "right") - 1
    down, up = to < end[doc], since >= (end - size)[doc]
    both = np.unique(np.concatenate([i[down] * (n + 1) + to[down], since[up] * (n + 1) + i[up]]))
    first, last = both // (n + 1), both % (n + 1)
    pw, inv = powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(line.view(np.uint64)) * pw[:n], dtype=np.uint64)])
    key = mix((sums[last + 1] - sums[first]) * inv[first] + (last - first + 1).astype(np.uint64))
    return doc[first], first, last, key.view(np.int64)


def run_table(lines: DataFrame, least: int) -> DataFrame:
    """id, h, run (a hash) of each run of the documents."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            size = np.asarray(pa.compute.list_value_length(batch.column(2))).astype(np.int64)
            line, words = (np.asarray(batch.column(k).flatten()) for k in (2, 3))
            doc, _, _, key = shortest_runs(line, words, size, least)
            yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(hs[doc]), pa.array(key)], ["id", "h", "run"])

    return lines.select("id", "h", "line", "words").mapInArrow(find, "id long, h long, run long")


def deleted_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """id, h, removed (sorted line numbers): the lines that go."""
    lines = materialize(line_tables(docs, id_col, text_col), "lines")
    each = run_table(lines, block)
    held = each.groupBy("run").agg(F.min("id").alias("first"), F.max("id").alias("_last")).where(F.col("first") < F.col("_last"))
    held = materialize(held.select("run", "first"), "lines-held")
    shared = each.join(held, "run").where(F.col("id") > F.col("first"))
    pairs = materialize(shared.select("id", "h", "first").distinct(), "line-pairs")
    ours = lines.select("id", "h", "at", "line", "words")
    theirs = lines.select(F.col("id").alias("first"), F.col("line").alias("other"), F.col("words").alias("other_words"))
    both = pairs.join(theirs, "first").join(ours, ["id", "h"]).select("id", "h", "at", "line", "words", "other", "other_words")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs, at = [], [], []
            for i, h, place, line, words, other, other_words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                gone = blocks(line, words, other, other_words, block)
                ids += [i] * len(gone)
                hs += [h] * len(gone)
                at += [place[k] for k in gone]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), pa.array(at, pa.int32())], ["id", "h", "at"])

    gone = both.mapInArrow(align, "id long, h long, at int")
    return materialize(gone.groupBy("id", "h").agg(F.sort_array(F.collect_set("at")).alias("removed")), "lines-removed")


ADDED = ["n_lines", "n_removed", "removed_lines", "kept_text"]


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """docs with n_lines (lines with a word), n_removed, removed_lines (numbers from 0) and kept_text.

    The texts are shuffled once, to the lines that go, at every size: how many documents have such lines has no bound.
    """
    own, (i, t) = shielded(docs, id_col, text_col)
    gone = deleted_lines(own, i, t, block).select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("removed").alias("removed_lines"))
    keyed = own.withColumn("_i", F.coalesce(F.col(i).cast("long"), F.lit((1 << 63) - 1))).withColumn("_k", row_hash(own, t))
    out = keyed.join(gone.hint("merge"), (F.col("_i") == F.col("_id")) & (F.col("_k") == F.col("_h")), "left")
    kept = F.array_join(F.filter(F.split(F.col(t), "\n"), lambda x, k: ~F.array_contains(F.col("removed_lines"), k)), "\n")
    n_lines = F.coalesce(F.size(F.filter(F.split(F.col(t), "\n"), lambda x: F.trim(x, F.lit(" \t\r\f\x0b")) != "")).cast("long"), F.lit(0).cast("long"))
    out = out.withColumn("n_lines", F.when(F.col(t).isNull(), F.lit(0).cast("long")).otherwise(n_lines))
    out = out.withColumn("kept_text", F.when(F.col("removed_lines").isNull(), F.col(t)).otherwise(kept))
    out = out.withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<int>"))).withColumn("n_removed", F.size("removed_lines").cast("long"))
    return restored(out, docs, ADDED)
