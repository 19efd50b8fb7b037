"""Page plans and the lookups behind them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GUIDES = ["start", "use", "develop", "deploy"]
JS_SUFFIXES = ["", ".js", ".jsx", ".ts", ".tsx", "/index.js", "/index.ts"]


def page_plan(files: DataFrame, guides: bool = True, api: bool = True) -> DataFrame:
    """kind, page: overview, a page a module and a file, guides, the index of the pages."""
    spark = files.sparkSession
    fixed = [("overview", "index.md"), *((("guide", f"guides/{g}.md") for g in GUIDES) if guides else ()), *([("api", "api/index.md")] if api else ())]
    out = spark.createDataFrame(fixed, "kind string, page string")
    out = out.unionByName(files.select("source").distinct().select(F.lit("module").alias("kind"), F.concat(F.lit("modules/"), F.col("source"), F.lit(".md")).alias("page")))
    return out.unionByName(files.select(F.lit("file").alias("kind"), F.concat(F.lit("api/"), F.col("file_id"), F.lit(".md")).alias("page")))


def first_existing(bases: DataFrame, have: DataFrame, suffixes: Sequence[str] = JS_SUFFIXES) -> DataFrame:
    """file_id, suffix: the first of the suffixes with which the path exists. have: file."""
    c = bases.select("file_id", F.posexplode(F.array(*map(F.lit, suffixes))).alias("i", "suffix")).withColumn("file", F.concat("file_id", "suffix"))
    got = c.join(have.select("file").distinct(), "file").groupBy("file_id").agg(F.min(F.struct("i", "suffix")).alias("m"))
    return got.select("file_id", F.col("m.suffix").alias("suffix"))


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """source, raw_text -> source, raw_text, target (null where unresolved). modules: module, file_id.

    `import a, b as c` gives a and b; `from m import x, y` gives m.x and m.y where they exist, else m.
    """
    raw = F.trim(F.regexp_replace("raw_text", r"[\n()]", " "))
    frm, names = F.regexp_extract(raw, r"^from\s+([\w.]+)\s+import\s+", 1), F.regexp_replace(raw, r"^(?:from\s+[\w.]+\s+)?import\s+", "")
    one = F.transform(F.filter(F.split(names, ","), lambda x: F.trim(x) != ""), lambda x: F.regexp_extract(F.trim(x), r"^([\w.]+)", 1))
    wide = F.transform(one, lambda x: F.struct(F.lit(1).alias("level"), F.when(frm == "", x).otherwise(F.concat(frm, F.lit("."), x)).alias("module")))
    both = F.when(frm == "", wide).otherwise(F.concat(wide, F.array(F.struct(F.lit(0).alias("level"), frm.alias("module")))))
    c = imports.select("source", "raw_text", F.explode(both).alias("c")).select("source", "raw_text", "c.level", "c.module")
    hit = c.join(modules, "module").select("source", "raw_text", "level", F.col("file_id").alias("target"))
    best = hit.groupBy("source", "raw_text").agg(F.max("level").alias("level"))
    hit = hit.join(best, ["source", "raw_text", "level"]).select("source", "raw_text", "target").distinct()
    return imports.join(hit, ["source", "raw_text"], "left")
