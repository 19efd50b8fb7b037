"""Mixing sources to target weights by weighted fair queueing.

Every document of a source is placed in a shuffled order (a hash of the document and a seed); the virtual finish time of its
words is the source's cumulative size up to them, divided by the source's target. A second pass over the source queues
behind the first. All words are ordered by virtual finish time and cut off at the total budget.

The targets add up to the budget, and up to virtual time t a source has t times its target, so this order reaches the budget
at time 1, in every source at once: what is taken of a source is the part of its queue with a finish time of at most 1. So
the global order needs no sort, and the document on a source's cut is taken in part, which leaves no source short by a
long document. (A test sorts all words and cuts them off.)

Within a source the cumulative size comes from sums of about sqrt(n) hash ranges and a window inside the one range that
holds the cut. What a source contributes is one row (the key on the cut, and the words that it gives), and the texts are
not shuffled at all.

Defined cases: a null text has size 0 and takes 0 words; null sources are one source that sorts last; rows that repeat id,
source and text have equal keys and take as much each, so that a cut inside them may leave less than one word for each row;
texts of any length are read whole; an empty table gives an empty result. Columns of the input named like a result column
are replaced, any other names do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS, materialize, restored, scratch, shielded, small_side

ADDED = ["size", "source_size", "target", "taken"]


def text_size(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)).cast("long"), F.lit(0).cast("long"))


#: Bits of a key of the shuffled order.
KEY_BITS = 60


def shuffle_key(seed: int, doc: Column, source: Column, text: Column) -> Column:
    """The place of a document in the shuffled order of its source: the first 60 bits of an MD5 sum."""
    whole = F.concat_ws("|", F.lit(str(seed)), doc.cast("string"), source.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.left(F.md5(whole), F.lit(KEY_BITS // 4)), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size) with sid (rank by code point, null last) and target.

    Targets are in proportion to the weights, which repeat along the rank, but at most `most` times the source's size;
    what is above goes to the others by weight. Ordered by size / weight the capped sources come first, so one
    running sum finds the level. The table has one row a source.
    """
    everything = Window.orderBy("sid")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", w)
    t = t.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    total = F.sum("source_size").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", "sid").rowsBetween(0, Window.unboundedFollowing)
    level = (share * total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    # the level, if this source and all with a larger ratio were not capped; the right one is the first not above its ratio
    t = t.withColumn("level", level)
    t = t.withColumn("level", F.coalesce(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["level"], F.col("ratio")))
    return t.select("source", "sid", "source_size", F.least(F.col("cap"), F.col("w") * F.col("level")).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 20240) -> DataFrame:
    """docs with size, source_size, target (their source's) and taken: the words that the mix takes, repeats counted."""
    own, (i, source, text) = shielded(docs, id_col, source_col, text_col)
    key = shuffle_key(seed, F.col(i), F.col(source), F.col(text))
    units = own.select(F.col(source).alias("source"), key.alias("key"), text_size(text).alias("size"))
    with scratch(docs.sparkSession) as keep:
        cut = small_side(keep(decide(materialize(units, "mix-units"), weights, share, most), "mix-cut"))
    out = own.withColumn("size", text_size(text)).withColumn("_key", key)
    out = out.join(cut.withColumnRenamed("source", "_source"), F.col(source).eqNullSafe(F.col("_source")), "left")
    more = F.when(F.col("_key") < F.col("edge"), F.col("size")).when(F.col("_key") == F.col("edge"), F.least("size", "part"))
    return restored(out.withColumn("taken", F.coalesce(F.col("size") * F.col("whole") + F.coalesce(more, F.lit(0)), F.lit(0)).cast("long")), docs, ADDED)


def decide(units: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """units (source, key, size) -> source, source_size, target, whole (passes taken in full), and of the pass on the cut
    edge (the key on it, null if the target is a number of whole passes) and part (the words that each row of it gives)."""
    bits = max(4, math.ceil(math.log2(units.count() + 1) / 2))
    units = units.withColumn("range", F.shiftright("key", KEY_BITS - bits))
    ranges = materialize(units.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "mix-ranges")
    sizes = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    words = F.floor(F.col("target") + 1e-6)
    t = targets(sizes, weights, share, most).withColumn("whole", F.coalesce(F.floor(words / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)))
    t = materialize(t.withColumn("rest", words - F.col("whole") * F.col("source_size")).drop("sid"), "mix-targets")
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    some = small_side(t.where("rest > 0").select(F.col("source").alias("_t"), "rest"))
    at = ranges.join(some, F.col("source").eqNullSafe(F.col("_t"))).where("offset < rest and rest <= offset + range_size")
    at = small_side(materialize(at.select("_t", F.col("range").alias("_r"), (F.col("rest") - F.col("offset")).alias("left")), "mix-cuts"))
    near = units.join(at, F.col("source").eqNullSafe(F.col("_t")) & (F.col("range") == F.col("_r")))
    keys = near.groupBy("source", "left", "key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    edge = keys.withColumn("upto", upto).where("upto >= left and upto - size < left")
    edge = edge.select(F.col("source").alias("_e"), F.col("key").alias("edge"), F.floor((F.col("left") - F.col("upto") + F.col("size")) / F.col("n")).alias("part"))
    return t.join(edge, F.col("source").eqNullSafe(F.col("_e")), "left").select("source", "source_size", "target", "whole", "edge", "part")
