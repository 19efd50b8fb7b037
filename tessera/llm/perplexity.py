"""Quality classifier: an interpolated modified Kneser-Ney model over characters.

The model is trained on trusted texts, one for each language. An n-gram of up to five characters is one long (12 bits a
character, code points above are folded), so that context and suffix are shifts. Counts are summed in the tasks, then by
Spark; lower orders count distinct left neighbours; the discounts D1, D2, D3+ come from each order's counts of counts.

Scoring joins the counts to what the documents hold. The different n-grams of all documents are gathered (each task sends an
n-gram once) and joined, order by order, to the model's rows for the n-gram and for its context, sharded by hashes of those:
the probability of an n-gram is its own share and its context's remaining weight times the probability of the n-gram without
its first character. The result, a number for each n-gram that occurs, stands by itself, so it is cut by a hash of the n-gram
into shards of about `SHARD_ROWS`, however frequent a character or context is; one shard at a time is sent out and adds its
part of a document's log-probability in one pass over the text.

A document is kept if its perplexity is at most `slack` times
the `quantile` of trusted documents of its language that the model was not trained on (every tenth). Mean log-probabilities
are first shrunk towards the language's by the weight of `PRIOR` characters, since a few characters say little.

Defined cases: null and empty texts have no characters, no perplexity, and are kept; a null language is a language of its
own; languages without held-out trusted texts have no threshold and keep everything; labels that repeat count once, rows
that repeat are each scored and trained on; orders without an n-gram that occurs once or twice take fixed discounts; texts of
any length are read whole; an empty table gives an empty result. Columns of the input named like a result column are
replaced, any other names do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import limit_arrow_rows, materialize, restored, shielded, small_side, steps

ORDER = 5
BITS = 12
MASK = (1 << BITS) - 1
SHARD_ROWS = 4_000_000
#: A prime by which n-grams are dealt to shards, so that neither the first nor the last character decides.
DEAL = 1_000_003
PRIOR = 50
COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])


def packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(gram of each character with the four before it, index of its text). A text begins after four zeros."""
    n = np.fromiter((len(t.decode("utf-8", "replace")) for t in texts), np.int64, len(texts))
    chars = np.frombuffer("".join(t.decode("utf-8", "replace") for t in texts).encode("utf-32-le", "replace"), np.uint32).astype(np.int64) & MASK
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(chars)) - np.repeat(np.cumsum(n) - n, n)
    gram = chars.copy()
    for k in range(1, ORDER):
        gram[k:] |= np.where(at[k:] >= k, chars[:-k] << (BITS * k), 0) if len(chars) > k else 0
    return gram, doc


def counted(trusted: DataFrame) -> DataFrame:
    """lang, gram, n of the highest order. trusted: lang, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for rows, texts in steps(batch, "text"):
                mine = langs[rows]
                for lang in sorted(set(mine), key=str):
                    gram, n = np.unique(packed([t for t, x in zip(texts, mine, strict=True) if x == lang])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n)], COUNTS.names)

    return trusted.mapInArrow(run, COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def model(trusted: DataFrame) -> DataFrame:
    """lang, k (order), gram, a (discounted share of the gram), g (weight left to the order below, after gram as context).

    A gram has a row with a, a context one with g; both may be the same row.
    """
    level = materialize(counted(trusted), "kn-counts")
    out = None
    for k in range(ORDER, 0, -1):
        ctx = F.shiftright("gram", BITS)
        of = level.groupBy("lang").agg(*(F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)))
        y = F.coalesce(F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0)), F.lit(0.5))
        fit = lambda i: F.greatest(F.lit(0.1), F.least(F.lit(float(i)) * 0.95, F.coalesce(F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0)), F.lit(0.5 * i))))
        of = F.broadcast(of.select(F.col("lang").alias("_l"), *(fit(i).alias(f"d{i}") for i in (1, 2, 3))))  # a row a language
        rows = level.join(of, F.col("lang").eqNullSafe(F.col("_l")))
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.select("lang", ctx.alias("ctx"), "gram", "n", d.alias("d"))
        total = rows.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
        total = materialize(total, "kn-contexts")
        have = rows.join(total.withColumnRenamed("lang", "_l").withColumnRenamed("ctx", "_c"), F.col("lang").eqNullSafe(F.col("_l")) & (F.col("ctx") == F.col("_c")))
        a = have.select("lang", F.lit(k).alias("k"), "gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("a"), F.lit(None).cast("double").alias("g"))
        g = total.select("lang", F.lit(k).alias("k"), F.col("ctx").alias("gram"), F.lit(None).cast("double").alias("a"), (F.col("left") / F.col("total")).alias("g"))
        out = a.unionByName(g) if out is None else out.unionByName(a).unionByName(g)
        if k > 1:
            level = level.groupBy("lang", F.col("gram").bitwiseAND((1 << BITS * (k - 1)) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
            level = materialize(level, "kn-level")
    return materialize(out, "kn-model")


def grams(docs: DataFrame) -> DataFrame:
    """l, gram: the different n-grams of the highest order in texts (lang, text), by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for rows, texts in steps(batch, "text"):
                mine = langs[rows]
                for lang in sorted(set(mine), key=str):
                    gram = np.unique(packed([t for t, x in zip(texts, mine, strict=True) if x == lang])[0])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram)], ["lang", "gram"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long").select(named("lang").alias("l"), "gram").distinct()


def named(lang):
    """A text for a language, null among them."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def probabilities(kn: DataFrame, found: DataFrame) -> DataFrame:
    """l, gram, p of the n-grams `found` (l, gram), under a model(). At most 2 ** BITS rows share a context or a suffix."""
    rows = kn.withColumn("l", named(F.col("lang")))
    levels = [found]
    for k in range(ORDER - 1, 0, -1):
        levels.append(materialize(levels[-1].select("l", F.col("gram").bitwiseAND((1 << BITS * k) - 1).alias("gram")).distinct(), "kn-grams"))
    below = None
    for k, level in zip(range(1, ORDER + 1), reversed(levels), strict=True):
        a = rows.where((F.col("k") == k) & F.col("a").isNotNull()).select("l", "gram", "a")
        g = rows.where((F.col("k") == k) & F.col("g").isNotNull()).select("l", F.col("gram").alias("ctx"), "g")
        d = level.withColumn("ctx", F.shiftright("gram", BITS)).join(a, ["l", "gram"], "left").join(g, ["l", "ctx"], "left")
        if below is None:
            d = d.withColumn("low", F.lit(1.0 / (1 << BITS)))
        else:
            suffix = F.col("gram").bitwiseAND((1 << BITS * (k - 1)) - 1)
            d = d.withColumn("suffix", suffix).join(below.select("l", F.col("gram").alias("suffix"), F.col("p").alias("low")), ["l", "suffix"])
        p = F.coalesce("a", F.lit(0.0)) + F.coalesce("g", F.lit(1.0)) * F.col("low")
        below = materialize(d.select("l", "gram", p.alias("p")), "kn-probabilities")
    return below


class Shard:
    """A shard of the logarithms in sorted arrays, by language."""

    def __init__(self, rows: pa.Table, number: int, of: int):
        self.number, self.of = number, of
        names = rows.column("l").combine_chunks().dictionary_encode()
        codes, gram, p = np.asarray(names.indices), rows.column("gram").to_numpy(), rows.column("log").to_numpy()
        self.parts: dict = {}
        for code, name in enumerate(names.dictionary.to_pylist()):
            mine = np.flatnonzero(codes == code)
            order = mine[np.argsort(gram[mine])]
            self.parts[name] = (gram[order], p[order])

    def mine(self, gram: np.ndarray) -> np.ndarray:
        return (gram % DEAL) % self.of == self.number

    def scores(self, lang: str | None, gram: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of n-grams that are all in the shard."""
        keys, logs = self.parts["" if lang is None else "=" + lang]
        return logs[np.searchsorted(keys, gram)].astype(np.float64)


def add_scores(docs: DataFrame, shard, text_col: str, lang_col: str) -> DataFrame:
    """docs, whose last columns are _nll and _n, with this shard's part added. shard: a broadcast Shard."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shard.value
        seen: dict = {}
        for batch in batches:
            langs = batch.column(batch.schema.get_field_index(lang_col)).to_pylist()
            for rows, texts in steps(batch, text_col):
                nll, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
                mine = langs[rows]
                for lang in set(mine):
                    at = np.array([i for i, x in enumerate(mine) if x == lang])
                    gram, doc = packed([texts[i] for i in at])
                    if own.of > 1:
                        ok = own.mine(gram)
                        gram, doc = gram[ok], doc[ok]
                    if not len(gram):
                        continue
                    if lang not in seen:  # values of frequent grams, by slot
                        seen[lang] = (np.full(1 << 18, -1, np.int64), np.zeros(1 << 18))
                    keys, values = seen[lang]
                    slot = ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)
                    miss = keys[slot] != gram
                    logs = values[slot]
                    if miss.any():
                        new, back = np.unique(gram[miss], return_inverse=True)
                        got = own.scores(lang, new)
                        logs[miss] = got[back]
                        put = ((new.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)
                        keys[put], values[put] = new, got
                        odd = keys[put] != new  # two in one slot: the value must be the key's
                        for s in put[odd]:
                            values[s] = got[new == keys[s]][0]
                    nll[at] = np.bincount(doc, -logs, len(at))
                    n[at] = np.bincount(doc, minlength=len(at))
                part = batch.slice(rows.start, len(texts))
                names = part.schema.names
                sums = [pa.array(np.asarray(part.column(names.index("_nll"))) + nll), pa.array(np.asarray(part.column(names.index("_n"))) + n)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *sums], names)

    return docs.mapInArrow(run, schema)


def shards_of(kn: DataFrame, docs: DataFrame, shard_rows: int = SHARD_ROWS) -> list:
    """What scoring texts (lang, text) needs of a model(), as broadcast variables of about shard_rows n-grams."""
    p = probabilities(kn, materialize(grams(docs), "kn-found"))
    n = max(1, math.ceil(p.count() / shard_rows))
    out = []
    for i in range(n):
        rows = p.where((F.col("gram") % DEAL) % n == i).select("l", "gram", F.ln("p").cast("float").alias("log"))
        out.append(kn.sparkSession.sparkContext.broadcast(Shard(rows.toArrow(), i, n)))  # bounded by shard_rows
    return out


def score(docs: DataFrame, shards: list, text_col: str, lang_col: str) -> DataFrame:
    """docs with _nll and _n: the sum of negative log-probabilities, and the characters."""
    out = docs.withColumn("_nll", F.lit(0.0)).withColumn("_n", F.lit(0).cast("long"))
    for shard in shards:
        out = add_scores(out, shard, text_col, lang_col)
    return out


ADDED = ["n_scored", "perplexity", "threshold", "kept"]


def classify(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.99, slack: float = 1.25, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """docs with n_scored (characters), perplexity, threshold and kept. trusted_ids: a column named as id_col."""
    limit_arrow_rows(docs.sparkSession)
    own, (i, text, lang) = shielded(docs, id_col, text_col, lang_col)
    trusted = materialize(trusted_ids.select(F.col(id_col).alias("_t")).where("_t is not null").distinct(), "kn-trusted")
    held_out = F.pmod(F.xxhash64("_t"), F.lit(10)) == 0
    narrow = own.select(F.col(i).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    train = narrow.join(small_side(trusted.where(~held_out)), F.col("id") == F.col("_t"), "left_semi").select("lang", "text")
    kn = shards_of(model(train), narrow.select("lang", "text"), shard_rows)
    probe = narrow.join(small_side(trusted.where(held_out)), F.col("id") == F.col("_t"), "left_semi")
    probe = materialize(score(probe, kn, "text", "lang").where("_n > 0").select("lang", "_nll", "_n"), "kn-held-out")
    mean = probe.groupBy("lang").agg((F.sum("_nll") / F.sum("_n")).alias("_mean"))
    shrunk = (F.col("_nll") + PRIOR * F.col("_mean")) / (F.col("_n") + PRIOR)
    limits = probe.join(F.broadcast(mean.withColumnRenamed("lang", "_l")), F.col("lang").eqNullSafe(F.col("_l")))  # a row a language
    limits = limits.groupBy("lang").agg(F.first("_mean").alias("_mean"), (F.exp(F.percentile_approx(shrunk, quantile, 10_000)) * slack).alias("threshold"))
    limits = small_side(materialize(limits, "kn-limits").withColumnRenamed("lang", "_l"))
    out = score(own, kn, text, lang).join(limits, F.col(lang).eqNullSafe(F.col("_l")), "left")
    nll = F.coalesce(shrunk, F.col("_nll") / F.col("_n"))
    out = out.withColumn("n_scored", F.col("_n")).withColumn("perplexity", F.when(F.col("_n") > 0, F.exp(nll)))
    return restored(out.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))), docs, ADDED)
