"""Substring dedup by hashes of all windows of `span` words, filed under minimizers.

This takes the place of a suffix tree split by variable-length prefixes: no suffix is sorted and no tree is built. What the
result needs of the tree is which suffixes agree in their first `span` words, and equal windows of `span` words are just
these. Each window is filed under its anchor, the smallest-hashed `anchor`-gram anywhere inside it (a minimizer), so that
equal windows meet under equal anchors while consecutive windows share one row. A group is read in document order from
Spark's external sort, so its first window is the earliest and only the distinct windows of one anchor are held in memory,
however many documents share them. Before the shuffle each task drops the windows that it has seen in an earlier document,
so a passage shared by a third of all documents leaves one row for each step of a task.

A pass before counts the windows of each anchor. Those of an anchor with more than `group` are filed each under its own
hash, so that they spread over all tasks and their groups have one window each. To keep the count small a step reports
only anchors with `STEP_LEAST` windows or more in it: an anchor that stays whole has at most `group` in such steps, and
fewer than `STEP_LEAST` in each of the others.

Words are 64-bit hashes, anchors 64 bits, windows 64 bits beside their anchor: equality is by 128 bits of hash, never by texts.

Order: documents by id (null ids last), then by a hash of the text. Rows that repeat both are one document, each of them
gets the same result. A null text has no words, a text with fewer words than `span` loses nothing, a text of any length is
read whole, an empty table gives an empty result. Columns of the input named like a result column are replaced, any other
names do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, limit_arrow_rows, materialize, mix, restored, rolling, row_hash, shielded, steps

LAST_ID = (1 << 63) - 1
BYTES = 8  # of a window's hash, beside its anchor's 8
RUNS = T.StructType([T.StructField(n, t) for n, t in (("anchor", T.LongType()), ("id", T.LongType()), ("h", T.LongType()), ("start", T.IntegerType()), ("n", T.IntegerType()), ("windows", T.BinaryType()))])
GROUP = 1 << 18  # distinct windows that a task holds in memory for one anchor
STEP_LEAST = 8
COVERED = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("h", T.LongType()), ("start", T.IntegerType()), ("n", T.IntegerType()))])


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """For each i, the leftmost position of the smallest of x[i:i+width]."""
    have, size = np.arange(len(x)), 1

    def best(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(x[b] < x[a], b, a)

    while size * 2 <= width:
        have = best(have[: len(have) - size], have[size:])
        size *= 2
    rest = width - size
    return best(have[: len(have) - rest], have[rest:]) if rest else have


def window_runs(texts: list[bytes], span: int, anchor: int) -> dict[str, np.ndarray]:
    """Each window: doc (index of its text), start (word of the text), anchor, code."""
    w = Words(texts)
    whole = rolling(w.hash, span)
    none = np.zeros(0, np.int64)
    if not len(whole):
        return {"doc": none, "start": none, "anchor": none.astype(np.uint64), "at": none, "code": none.astype(np.uint64)}
    doc = w.doc()
    ok = np.flatnonzero(doc[: len(whole)] == doc[span - 1 :])
    grams = mix(rolling(w.hash, anchor))
    at = sliding_argmin(grams, span - anchor + 1)[ok]
    doc = doc[ok]
    return {"doc": doc, "start": ok - w.first[doc], "anchor": grams[at], "at": at, "code": whole[ok] & np.uint64((1 << 8 * BYTES) - 1)}


def breaks(*columns: np.ndarray) -> np.ndarray:
    """Where runs of rows that agree in all columns (the last one counting up) start."""
    new = np.ones(len(columns[0]), bool)
    *same, count = columns
    new[1:] = count[1:] != count[:-1] + 1
    for c in same:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def binary(codes: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """BYTES of each code, joined for each run."""
    data = np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 8)[:, :BYTES])
    offsets = np.append(cuts, len(codes)).astype(np.int32) * BYTES
    return pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def frequent_anchors(texts: list[bytes], span: int, anchor: int, least: int) -> pa.RecordBatch:
    """anchor, n: the anchors with at least so many different windows in some texts."""
    x = window_runs(texts, span, anchor)
    order = np.lexsort((x["code"], x["anchor"]))
    a, c = x["anchor"][order], x["code"][order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    keys, n = np.unique(a[new], return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(keys[n >= least].view(np.int64)), pa.array(n[n >= least])], ["anchor", "n"])


def runs_of(ids: np.ndarray, hs: np.ndarray, texts: list[bytes], span: int, anchor: int, split: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of RUNS for some texts: windows that may be the first of their kind, and runs that are not (windows null).

    split: sorted anchors whose windows are filed each under its own hash.
    """
    x = window_runs(texts, span, anchor)
    n = len(x["doc"])
    if not n:
        return
    if split is not None and len(split):
        own = split[np.minimum(np.searchsorted(split, x["anchor"]), len(split) - 1)] == x["anchor"]
        x["anchor"] = np.where(own, mix(x["anchor"] ^ mix(x["code"])), x["anchor"])
        x["at"] = np.where(own, -1 - np.arange(n), x["at"])  # a row each
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((hs, ids))] = np.arange(len(ids))
    if len(ids) > 1:  # rows that repeat id and text share a rank
        order = np.lexsort((hs, ids))
        step = np.concatenate([[0], np.cumsum((ids[order][1:] != ids[order][:-1]) | (hs[order][1:] != hs[order][:-1]))])
        rank[order] = step
    place = (rank[x["doc"]].astype(np.uint64) << np.uint64(36)) + x["start"].astype(np.uint64)
    order = np.lexsort((place, x["code"], x["anchor"]))
    a, c, p = x["anchor"][order], x["code"][order], place[order]
    head = np.ones(n, bool)
    head[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    seen = np.empty(n, bool)
    seen[order] = p > p[np.maximum.accumulate(np.where(head, np.arange(n), 0))]
    for some in (~seen, seen):
        doc, start, key, at, code = (x[k][some] for k in ("doc", "start", "anchor", "at", "code"))
        if not len(doc):
            continue
        cuts = breaks(doc, at, start) if some is not seen else breaks(doc, start)
        size = np.diff(np.append(cuts, len(doc)))
        windows = binary(code, cuts) if some is not seen else pa.nulls(len(cuts), pa.binary())
        d = doc[cuts]
        yield pa.RecordBatch.from_arrays([pa.array(key[cuts].view(np.int64)), pa.array(ids[d]), pa.array(hs[d]), pa.array(start[cuts].astype(np.int32)), pa.array(size.astype(np.int32)), windows], RUNS.names)


def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of RUNS, sorted by anchor, id, h and start -> rows of COVERED for the windows that are not the first of their kind."""
    state: dict[int, tuple] = {}
    last = None
    for batch in batches:
        names = batch.schema.names
        anchor, ids, hs, start, n = (np.asarray(batch.column(names.index(k))) for k in ("anchor", "id", "h", "start", "n"))
        windows = batch.column(names.index("windows"))
        known = np.asarray(pa.compute.is_null(windows))
        if known.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[known]), pa.array(hs[known]), pa.array(start[known]), pa.array(n[known])], COVERED.names)
        rows = np.flatnonzero(~known)
        if not len(rows):
            continue
        size = n[rows].astype(np.int64)
        flat = np.frombuffer(b"".join(x for x in windows.to_pylist() if x is not None), np.uint8).reshape(-1, BYTES)
        code = np.zeros((len(flat), 8), np.uint8)
        code[:, :BYTES] = flat
        code = code.view(np.uint64).ravel()
        row = np.repeat(rows, size)
        begin = start[row] + (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size))
        key = anchor[row]
        order = np.lexsort((code, key))  # stable: within a window the earliest comes first
        k, c, r, b = key[order], code[order], row[order], begin[order]
        head = np.ones(len(k), bool)
        head[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        lead = np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))
        again = (ids[r] != ids[r[lead]]) | (hs[r] != hs[r[lead]]) | (b != b[lead])
        if last is not None and k[0] <= last:  # the group of the batch before goes on
            for i in np.flatnonzero(head & (k == last)):
                if (was := state.get(int(c[i]))) is not None:
                    j = slice(i, i + int(np.argmax(np.append(head[i + 1 :], True))) + 1)
                    again[j] = (ids[r[j]] != was[0]) | (hs[r[j]] != was[1]) | (b[j] != was[2])
        end = anchor[rows[-1]]
        if last is None or end != last:
            state, last = {}, end
        for i in np.flatnonzero(head & (k == end)):
            state.setdefault(int(c[i]), (ids[r[i]], hs[r[i]], b[i]))
        hit = np.empty(len(again), bool)
        hit[order] = again
        at, begin = row[hit], begin[hit]
        if len(at):
            cuts = breaks(at, begin)
            d = at[cuts]
            yield pa.RecordBatch.from_arrays([pa.array(ids[d]), pa.array(hs[d]), pa.array(begin[cuts].astype(np.int32)), pa.array(np.diff(np.append(cuts, len(at))).astype(np.int32))], COVERED.names)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 20, anchor: int = 8, group: int = GROUP) -> DataFrame:
    """id, h, runs: for each document with windows that start earlier elsewhere, the runs (start, n) of such windows."""

    least = min(STEP_LEAST, group)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in steps(batch, "text"):
                yield frequent_anchors(texts, span, anchor, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for rows, texts in steps(batch, "text"):
                yield from runs_of(ids[rows], hs[rows], texts, span, anchor, split)

    keyed = docs.select(F.coalesce(F.col(id_col), F.lit(LAST_ID)).cast("long").alias("id"), row_hash(docs, text_col).alias("h"), F.col(text_col).alias("text"))
    frequent = keyed.select("text").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > group)
    split = np.sort(np.array([r.anchor for r in frequent.select("anchor").toLocalIterator()], np.int64).view(np.uint64))  # fewer than windows / group
    runs = keyed.mapInArrow(run, RUNS)
    met = runs.repartition(F.col("anchor")).sortWithinPartitions("anchor", "id", "h", "start").mapInArrow(later, COVERED)
    return materialize(met.groupBy("id", "h").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("runs")), "substring-runs")


ADDED = ["n_words", "n_removed", "kept_text", "kept_sha256"]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 20, anchor: int = 8, group: int = GROUP) -> DataFrame:
    """docs with n_words, n_removed, kept_text (words joined by a space) and kept_sha256."""
    limit_arrow_rows(docs.sparkSession)
    own, (i, t) = shielded(docs, id_col, text_col)
    found = repeats(own, i, t, span, anchor, group).select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("runs.start").alias("_starts"), F.col("runs.n").alias("_ns"))
    keyed = own.withColumn("_i", F.coalesce(F.col(i), F.lit(LAST_ID)).cast("long")).withColumn("_k", row_hash(own, t))
    joined = keyed.join(found.hint("merge"), (F.col("_i") == F.col("_id")) & (F.col("_k") == F.col("_h")), "left").select(*own.columns, "_starts", "_ns")
    new = T.StructType([T.StructField(c, t) for c, t in zip(ADDED, (T.LongType(), T.LongType(), T.StringType(), T.StringType()), strict=True)])
    schema = T.StructType([*own.schema.fields, *new.fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for rows, texts in steps(batch, t):
                part = batch.slice(rows.start, rows.stop - rows.start)
                starts, ns = (part.column(names.index(c)).to_pylist() for c in ("_starts", "_ns"))
                n_words, n_removed, kept, sha = [], [], [], []
                for text, s, n in zip(texts, starts, ns, strict=True):
                    words = text.split()
                    total = len(words)
                    if s:
                        edge = np.zeros(total + 1, np.int64)
                        np.add.at(edge, np.asarray(s), 1)
                        np.add.at(edge, np.asarray(s) + np.asarray(n) + span - 1, -1)
                        live = np.cumsum(edge[:-1]) == 0
                        words = [words[i] for i in np.flatnonzero(live)]
                    left = b" ".join(words)
                    n_words.append(total)
                    n_removed.append(total - len(words))
                    kept.append(left)
                    sha.append(hashlib.sha256(left).hexdigest())
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sha)], schema.names)

    return restored(joined.mapInArrow(cut, schema), docs, ADDED)
