"""Documents -> chunks, symbols and boundaries."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import chunk_id, symbol_id
from ..functions.text import lines

CHUNKERS: dict[str, Callable[..., DataFrame]] = {}


def chunker(name: str):
    """Register a strategy: DataFrame(file_id, text, ...) -> chunk rows."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        CHUNKERS[name] = f
        return f

    return put


def files(documents: DataFrame) -> DataFrame:
    """documents as files: file_id (a path), language, size_bytes, line_count."""
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return documents.select("doc_id", path.alias("file_id"), F.col("lang").alias("language"), F.col("n_chars").alias("size_bytes"), F.size(lines(F.col("text"))).cast("long").alias("line_count"), "source", "text")


@chunker("whole")
def whole(docs: DataFrame) -> DataFrame:
    return docs.select("file_id", F.lit(1).cast("long").alias("start_line"), F.size(lines(F.col("text"))).cast("long").alias("end_line"), F.lit("module").alias("chunk_type"), F.col("text").alias("content"))


@chunker("sliding")
def sliding(docs: DataFrame, size: int = 100, overlap: int = 20) -> DataFrame:
    """Windows of `size` lines that overlap; the last is the first that reaches the last line."""
    step = size - overlap
    d = docs.withColumn("_l", lines(F.col("text"))).withColumn("_n", F.size("_l"))
    last = F.greatest(F.lit(0), F.ceil((F.col("_n") - size) / step)).cast("int")
    d = d.withColumn("_s", F.explode(F.transform(F.sequence(F.lit(0), last), lambda k: k * step + 1)))
    end = F.least(F.col("_s") + size - 1, F.col("_n"))
    d = d.withColumn("content", F.array_join(F.slice("_l", F.col("_s"), size), "\n")).withColumn("start_line", F.col("_s").cast("long")).withColumn("end_line", end.cast("long"))
    return d.withColumn("chunk_id", chunk_id(F.col("file_id"), F.col("start_line"), F.col("end_line"))).drop("_l", "_n", "_s", "text")


def boundaries(docs: DataFrame) -> DataFrame:
    """file_id, line (from 0): definitions, comments of more than two characters, and dedents to column 0."""
    d = docs.select("file_id", F.posexplode(F.split("text", "\n")).alias("line", "s")).where(F.trim("s") != "")
    indent = F.length("s") - F.length(F.ltrim("s"))
    w = Window.partitionBy("file_id").orderBy("line")
    d = d.withColumn("indent", indent).withColumn("before", F.lag("indent").over(w))
    t = F.ltrim("s")
    start = t.rlike(r"^(def |class |async def |if __name__)") | (t.startswith("#") & (F.length(F.trim("s")) > 2))
    return d.where(start | ((F.col("indent") == 0) & (F.col("before") > 0))).select("file_id", F.col("line").cast("long").alias("line"))


def segments(docs: DataFrame, least: int = 5) -> DataFrame:
    """file_id, start_line, end_line between neighbouring boundaries; short ones go where a file has more than two."""
    b = boundaries(docs)
    w = Window.partitionBy("file_id")
    b = b.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("next", F.lead("line").over(w.orderBy("line")))
    n = docs.select("file_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    s = b.join(n, "file_id").select("file_id", (F.col("line") + 1).alias("start_line"), F.coalesce("next", "n_lines").alias("end_line"), "n")
    return s.where((F.col("n") <= 2) | (F.col("end_line") - F.col("start_line") + 1 >= least)).drop("n")


@chunker("semantic")
def semantic(docs: DataFrame, most: int = 100, least: int = 10) -> DataFrame:
    """Greedy cuts at boundaries at least `least` lines apart; files of up to `most` lines stay whole; the fold is per file."""
    n = F.size(lines(F.col("text")))
    b = boundaries(docs).groupBy("file_id").agg(F.sort_array(F.collect_list((F.col("line") + 1).cast("int"))).alias("b"))
    d = docs.join(b, "file_id", "left").withColumn("n", n)

    def cut(acc, x):
        far = x - acc["last"] >= least
        return F.struct(F.when(far, x).otherwise(acc["last"]).alias("last"), F.when(far, F.concat(acc["cuts"], F.array(x))).otherwise(acc["cuts"]).alias("cuts"))

    greedy = F.aggregate("b", F.struct(F.lit(1).alias("last"), F.array(F.lit(1)).alias("cuts")), cut)["cuts"]
    fixed = F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1)), F.lit(most))
    starts = F.when(F.col("n") <= most, F.array(F.lit(1))).when(F.size(F.coalesce("b", F.array().cast("array<int>"))) <= 1, fixed).otherwise(greedy)
    d = d.withColumn("starts", starts).select("*", F.posexplode("starts").alias("i", "s"))
    end = F.coalesce(F.get("starts", F.col("i") + 1) - 1, F.col("n"))
    return d.select("file_id", F.col("s").cast("long").alias("start_line"), end.cast("long").alias("end_line"), F.array_join(F.slice(lines(F.col("text")), F.col("s"), end - F.col("s") + 1), "\n").alias("content"))


def pipeline(docs: DataFrame, by: Mapping[str, tuple[str, dict]], other: tuple[str, dict] = ("whole", {})) -> DataFrame:
    """file_id, language, start_line, end_line, content, chunk_type: each language's files cut by its registered strategy, (name,
    options); the files of other languages by `other`. An unknown strategy raises ValueError."""
    out = None
    for languages, (name, options) in [*(([k], v) for k, v in by.items()), (None, other)]:
        if name not in CHUNKERS:
            raise ValueError(f"no strategy {name!r}; there are {sorted(CHUNKERS)}")
        mine = docs.where(F.col("language").isin(languages) if languages else ~F.coalesce(F.col("language"), F.lit("")).isin(*by))
        cut = CHUNKERS[name](mine.select("file_id", "text"), **options)
        cut = cut.select("file_id", "start_line", "end_line", "content", F.lit(name).alias("chunk_type"))
        out = cut if out is None else out.unionByName(cut)
    return out.join(docs.select("file_id", "language"), "file_id")


def line_symbols(docs: DataFrame) -> DataFrame:
    """The first capitalised word of each line as a symbol: class on even lines, function on odd ones."""
    d = docs.select("file_id", F.posexplode(F.split("text", "\n")).alias("i", "s"))
    d = d.withColumn("name", F.regexp_extract("s", r"(\p{Lu}\p{L}+)", 1)).where("name <> ''").withColumn("line", (F.col("i") + 1).cast("long"))
    d = d.withColumn("kind", F.when(F.col("line") % 2 == 0, "class").otherwise("function"))
    return d.select(symbol_id(F.col("file_id"), F.col("kind"), F.col("name"), F.col("line")).alias("symbol_id"), "file_id", "name", "kind", "line")


def symbols_in_range(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """chunk_id, symbols (sorted names) with a line inside the chunk."""
    s = symbols.select("file_id", "name", "line")
    hit = chunks.select("file_id", "chunk_id", "start_line", "end_line").join(s, "file_id").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    return hit.groupBy("chunk_id").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("symbols"))
