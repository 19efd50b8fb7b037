"""Repository statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import degrees


def file_complexity(files: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """files with n_out (dependencies), n_symbols and complexity (their sum)."""
    d = degrees(edges).select(F.col("file").alias("doc_id"), "n_out", "n_in")
    s = symbols.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_symbols"))
    out = files.join(d, "doc_id", "left").join(s, "file_id", "left").fillna(0, ["n_out", "n_in", "n_symbols"])
    return out.withColumn("complexity", F.col("n_out") + F.col("n_symbols"))


def statistics(files: DataFrame, category: Column) -> DataFrame:
    """kind, key, n, n_lines for the whole, each language and each category: one pass over grouping sets."""
    f = files.withColumn("category", category)
    g = f.groupingSets([[], ["language"], ["category"]], "language", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("line_count").alias("n_lines"), F.grouping_id("language", "category").alias("g"))
    kind = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "language").otherwise("category")
    return g.select(kind.alias("kind"), F.coalesce("language", "category", F.lit("")).alias("key"), "n", "n_lines")


def complexity_summary(c: DataFrame) -> DataFrame:
    return c.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("complexity"), 6).alias("mean"), F.max("complexity").alias("most"), F.min("complexity").alias("least"), F.count_if(F.col("complexity") > 10).alias("high"))


def complexity_bin(x: Column) -> Column:
    return F.when(x <= 5, "low (1-5)").when(x <= 10, "medium (6-10)").when(x <= 20, "high (11-20)").otherwise("very high (>20)")


def histogram(c: DataFrame) -> DataFrame:
    """bin, n: all four bins, also empty ones."""
    bins = c.sparkSession.createDataFrame([(b,) for b in ("low (1-5)", "medium (6-10)", "high (11-20)", "very high (>20)")], "bin string")
    n = c.groupBy(complexity_bin(F.col("complexity")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.join(n, "bin", "left").fillna(0, ["n"])


def quality_score(high_ratio: Column, n_cycles: Column, mean_deps: Column) -> Column:
    much = F.when(mean_deps > 5, F.least(5 * (mean_deps - 5), F.lit(20.0))).otherwise(0.0)
    return F.greatest(F.lit(0.0), 100 - 30 * high_ratio - F.least(10.0 * n_cycles, F.lit(30.0)) - much)


def recommendations(high: Column, n_cycles: Column, coupled: Column) -> Column:
    """Texts of the rules that fire: complex files, cycles, coupled files; one text where none does."""
    n = lambda x: x.cast("string")
    rules = F.array_compact(F.array(
        F.when(high > 0, F.concat(F.lit("Consider refactoring "), n(high), F.lit(" high-complexity files"))),
        F.when(n_cycles > 0, F.concat(F.lit("Break "), n(n_cycles), F.lit(" dependency cycles to improve maintainability"))),
        F.when(coupled > 0, F.concat(F.lit("Reduce coupling in "), n(coupled), F.lit(" highly coupled files"))),
    ))
    return F.when(F.size(rules) > 0, rules).otherwise(F.array(F.lit("Code quality metrics look good! Keep up the good work.")))


def scan_alerts(files: DataFrame, problems: Sequence[str], few: int = 5, many: int = 5000, large: int = 500) -> DataFrame:
    """alert, what, n of a listing (dir: each file's directory): too few or many files, large directories, and directories
    with a part that should have been excluded."""
    d = files.groupBy("dir").agg(F.count(F.lit(1)).alias("n"))
    a = files.agg(F.count(F.lit(1)).alias("n"))
    alert = lambda df, name, what: df.select(F.lit(name).alias("alert"), what.alias("what"), "n")
    out = alert(a.where((F.col("n") > 0) & (F.col("n") < few)), "few files", F.lit("")).unionByName(alert(a.where(F.col("n") > many), "many files", F.lit("")))
    out = out.unionByName(alert(d.where(F.col("n") > large), "large directory", F.col("dir")))
    parts = d.select(F.explode(F.array_distinct(F.split("dir", "/"))).alias("part"), "n").where(F.col("part").isin(*problems))
    return out.unionByName(alert(parts.groupBy("part").agg(F.sum("n").alias("n")), "should be excluded", F.col("part")))
