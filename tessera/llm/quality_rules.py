"""Quality rules with host verdicts.

Each text gets counts and two kinds of rules: the base rules (too few words, too much of it in repeated windows) and soft
rules (word length, symbols, repeated lines). Failures are summed by host, each host's failure rate is shrunk towards the
rate of all hosts by a beta prior whose two parameters are fitted to the hosts (method of moments), and the verdict on the
host comes back to its documents: a document goes if it fails a base rule, or two soft rules, or one soft rule on a host
whose shrunk rate is above `host_limit`.

The texts are read twice and never shuffled: the first pass leaves one row of sums for each host and task, the second
joins the table of hosts (broadcast only if it has at most BROADCAST_ROWS rows).

Defined cases: a null or wordless text has no words and fails the base rule; null hosts are one host; rows that repeat
are judged each on its own; a text of any length is read whole; an empty table gives an empty result. Columns of the input
named like a result column are replaced, any other names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _WS, Words, limit_arrow_rows, materialize, mix, restored, rolling, segments_hash, shielded, small_side, steps

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
_SYM = np.zeros(256, bool)
_SYM[list(SYMBOLS)] = True


def count_texts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The COUNTS of some texts."""
    w = Words(texts)
    buf, n = w.buf, len(texts)
    ends = w.at + w.size

    def within(flags: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return c[ends] - c[w.at]

    live = ~_WS[buf] if len(buf) else np.zeros(0, bool)
    out = {"n_words": w.count(), "word_chars": within(live & ((buf & 0xC0) != 0x80)), "n_symbols": within(_SYM[buf] if len(buf) else live)}
    # lines: the texts are joined by newlines, so that every newline ends a line
    newline = buf == 10
    line_end = np.append(np.flatnonzero(newline), len(buf))
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    words_before = np.concatenate([[0], np.cumsum(live, dtype=np.int64)])
    worded = words_before[line_end] > words_before[line_start]
    line_start, line_end = line_start[worded], line_end[worded]
    if len(line_start):
        doc = np.searchsorted(w.at, line_start, "right") - 1
        # an empty text starts where no line with a word can; the last text that starts at or before is the line's
        h = segments_hash(buf, line_start, line_end) ^ mix((doc + 1).astype(np.uint64))
        order = np.lexsort((h, doc))
        same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        out["n_dup_lines"] = np.bincount(doc[order][1:][same], minlength=n)
        out["n_lines"] = np.bincount(doc, minlength=n)
    else:
        out["n_dup_lines"] = out["n_lines"] = np.zeros(n, np.int64)
    # words in windows that a text holds twice or more
    r, doc = rolling(w.hash, WINDOW), w.doc()
    out["n_repeat_words"] = np.zeros(n, np.int64)
    if len(r):
        ok = doc[: len(r)] == doc[WINDOW - 1 :]
        key = np.where(ok, mix(r ^ mix((doc[: len(r)] + 1).astype(np.uint64))), 0)
        at = np.sort(key[ok])
        twice = np.unique(at[1:][at[1:] == at[:-1]])
        if len(twice):
            hit = ok & (twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key)
            c = np.zeros(len(w.hash) + 1, np.int64)
            c[:-WINDOW] += hit
            c[WINDOW:] -= hit
            out["n_repeat_words"] = np.bincount(doc[np.cumsum(c[:-1]) > 0], minlength=n)
    return out


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs (no column named like a count) with COUNTS (long), computed over Arrow batches without a shuffle."""
    limit_arrow_rows(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in steps(batch, text_col):
                got = count_texts(texts)
                part = batch.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(got[c], pa.int64()) for c in COUNTS)], [*part.schema.names, *COUNTS])

    return docs.mapInArrow(run, schema)


def base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def soft_failures(longest_word: float = 12.0, symbols: float = 0.3, dup_lines: float = 0.3):
    """How many soft rules fail (0 to 3)."""
    n = F.col("n_words")
    rules = [
        (F.col("word_chars") > longest_word * n) | (F.col("word_chars") < 2 * n),
        F.col("n_symbols") > symbols * n,
        F.col("n_dup_lines") > dup_lines * F.col("n_lines"),
    ]
    return sum((r.cast("int") for r in rules), F.lit(0))


def host_rates(counted: DataFrame, host_col: str = "source") -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk by the fitted beta prior)."""
    failed = base_failed() | (soft_failures() > 0)
    hosts = counted.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(failed.cast("long")).alias("n_failed"))
    hosts = materialize(hosts, "quality-hosts")  # else each use of the table reads all texts again
    n, f = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    s = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(n * n).alias("nn"), F.sum(f * f / n).alias("ff")).first()
    a, b = beta_prior(s["k"] or 0, s["n"] or 0.0, s["f"] or 0.0, s["nn"] or 0.0, s["ff"] or 0.0)
    return hosts.withColumn("rate", (f + F.lit(a)) / (n + F.lit(a + b)))


def beta_prior(k: int, n: float, f: float, nn: float, ff: float) -> tuple[float, float]:
    """(alpha, beta) by the method of moments; k hosts with n documents, f failures, sums of n*n and of f*f/n."""
    if not n:
        return 1.0, 1.0
    p = min(max(f / n, 1e-6), 1 - 1e-6)
    spread = ff - f * f / n  # sum of n * (rate - p) ** 2
    room = n - nn / n
    between = (spread - (k - 1) * p * (1 - p)) / room if room > 0 else 0.0
    between = min(max(between, p * (1 - p) / 1e4), p * (1 - p) / 2)  # the prior weighs 1 to 9999 documents
    m = p * (1 - p) / between - 1
    return p * m, (1 - p) * m


ADDED = [*COUNTS, "base_failed", "soft_failed", "host_rate", "kept"]


def quality_rules(docs: DataFrame, host_col: str = "source", text_col: str = "text", host_limit: float = 0.25) -> DataFrame:
    """docs with COUNTS, base_failed, soft_failed, host_rate and kept."""
    own, (host, text) = shielded(docs, host_col, text_col)
    hosts = host_rates(with_counts(own.select(host, text), text), host)
    hosts = small_side(hosts.select(F.col("host").alias("_host"), F.col("rate").alias("host_rate")))
    out = with_counts(own, text).withColumn("base_failed", base_failed()).withColumn("soft_failed", soft_failures())
    out = out.join(hosts, F.col(host).eqNullSafe(F.col("_host")), "left")
    bad = F.coalesce(F.col("host_rate") > host_limit, F.lit(False))
    return restored(out.withColumn("kept", ~F.col("base_failed") & (F.col("soft_failed") < F.when(bad, 1).otherwise(2))), docs, ADDED)
