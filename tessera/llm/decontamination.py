"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Every item gives windows of 13 consecutive words (an item of fewer words is one window). The words of a window are ordered
by rarity, that is by how often the documents hold them (one counting pass over the words of the benchmark); a document
that contains the window must contain its rarest word, so this one-word prefix is what joins. A window with a word that no
document holds cannot occur and is dropped. A joined word fixes the window's place in the document: the place must lie
inside it (length and position bounds), the second rarest word must stand where the window has it, and then the words are
compared one for one.

If the windows are few and short enough to be broadcast, the documents' words are generated and joined inside one
code-generated stage; only true occurrences leave it. Else single words (document, place, word) are joined by a shuffle,
and only documents with a candidate are looked up again, once, to cut the candidate out and compare it.

Words are matched in lower case for A-Z only; the join itself uses full lower case, which only adds candidates.

Defined cases: null texts have no words; texts of any length are read whole; rows of the benchmark that repeat count once,
null item ids count as no item; documents that repeat id and text get the same result; with an empty benchmark nothing is
hit, an empty table gives an empty result. Columns of the input named like a result column are replaced, any other names do
no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, restored, row_hash, shielded, small_side

#: What separates words in a text that is not in lower case yet (a Java regular expression).
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
#: Windows that are broadcast, and bytes of theirs.
FEW_WINDOWS, SHORT_WINDOWS = 500_000, 64_000_000
ADDED = ["n_words", "n_hit", "n_items", "items_sha256", "items", "contaminated"]
LAST_ID = (1 << 63) - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_words(text: Column) -> Column:
    """The words; an empty string stands before or after them where the text begins or ends with another character."""
    return F.split(text, BETWEEN)


def item_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """item, words (array): the windows of the items."""
    words = F.filter(split_words(F.translate(F.col(text_col), UPPER, LOWER)), lambda x: x != "")
    one = items.select(F.col(item_col).alias("item"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    return one.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, window))).alias("words")).distinct()


def prefixes(docs: DataFrame, windows: DataFrame, text_col: str) -> DataFrame:
    """wid, words, n, and the rarest two words of each window with their offsets: t1, o1, t2, o2."""
    exploded = windows.select("wid", F.posexplode("words").alias("o", "word")).withColumn("t", F.lower("word")).drop("word")
    vocabulary = small_side(materialize(exploded.select("t").distinct(), "item-words"))
    held = docs.select(F.explode_outer(split_words(F.col(text_col))).alias("word")).select(F.lower("word").alias("t"))
    counts = materialize(held.join(vocabulary, "t").groupBy("t").agg(F.count(F.lit(1)).alias("n")), "item-rarity")
    ranked = exploded.join(counts, "t").groupBy("wid").agg(F.sort_array(F.collect_list(F.struct("n", "o", "t"))).alias("r"))
    got = windows.join(ranked, "wid").where(F.size("r") == F.size("words"))
    second = F.least(F.lit(1), F.size("r") - 1)
    return got.select("wid", "words", F.size("words").alias("n"), F.col("r")[0]["t"].alias("t1"), F.col("r")[0]["o"].alias("o1"), F.col("r")[second]["t"].alias("t2"), F.col("r")[second]["o"].alias("o2"))


def plain(words: Column) -> Column:
    """Words as one string, in lower case for A-Z."""
    return F.translate(F.array_join(words, " "), UPPER, LOWER)


def occurrences(docs: DataFrame, items: DataFrame, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, few: int = FEW_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """(id, h, start, n, wid) of each window in each document, and (wid, item). docs: id, h, text."""
    pairs = item_windows(items, item_col, item_text_col, window)
    windows = materialize(pairs.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()), "item-windows")
    of = materialize(pairs.where("item is not null").join(windows, "words").select("wid", "item"), "item-of")
    keys = materialize(prefixes(docs, windows, "text"), "item-prefixes")
    some = keys.limit(few + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.array_join("words", " "))).alias("size")).first()
    words = docs.select("id", "h", split_words(F.col("text")).alias("ws"))
    start = F.col("q") - F.col("o1")
    if some["n"] <= few and (some["size"] or 0) <= SHORT_WINDOWS:
        one = words.select("id", "h", "ws", F.posexplode_outer("ws").alias("q", "word"))
        at = one.join(F.broadcast(keys), F.lower("word") == F.col("t1"))
        at = at.where((start >= 0) & (start + F.col("n") <= F.size("ws"))).where(F.lower(F.get("ws", start + F.col("o2"))) == F.col("t2"))
        at = at.where(plain(F.slice("ws", F.greatest(start, F.lit(0)) + 1, F.col("n"))) == F.array_join("words", " "))
        return at.select("id", "h", start.alias("start"), "n", "wid"), of
    one = words.select("id", "h", F.posexplode("ws").alias("q", "word")).select("id", "h", "q", F.lower("word").alias("t"))
    met = one.join(keys.select("t1", "o1", "n", "wid").hint("merge"), F.col("t") == F.col("t1")).where(start >= 0)
    met = materialize(met.select("id", "h", start.alias("start"), "n", "wid").distinct(), "item-candidates")
    own = words.select(F.col("id").alias("_i"), F.col("h").alias("_h"), "ws").hint("merge")
    cut = F.slice("ws", F.col("start") + 1, F.col("n"))
    cut = met.join(own, (F.col("id") == F.col("_i")) & (F.col("h") == F.col("_h"))).select("id", "h", "start", "n", "wid", plain(cut).alias("got"))
    at = cut.join(keys.select("wid", F.array_join("words", " ").alias("want")).hint("merge"), "wid").where("got = want")
    return at.select("id", "h", "start", "n", "wid"), of


def hits_of(keyed: DataFrame, items: DataFrame, item_col: str, item_text_col: str, window: int, few: int) -> DataFrame:
    """_id, _h, n_hit, items of the documents that hold a window. keyed: id, h, text."""
    found, of = occurrences(keyed, items, item_col, item_text_col, window, few)
    found = materialize(found.distinct(), "item-hits")
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("start", "n")), lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1))))
    hits = found.groupBy("id", "h").agg(F.size(covered).cast("long").alias("n_hit"))
    named = found.select("id", "h", "wid").distinct().join(small_side(of), "wid").select("id", "h", "item").distinct()
    named = named.groupBy("id", "h").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    return hits.join(named, ["id", "h"], "left").select(F.col("id").alias("_id"), F.col("h").alias("_h"), "n_hit", "items")


def keyed_by(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """docs under names of its own with _i, _k (id and text hash) and n_words, and its id, h, text."""
    own, (i, t) = shielded(docs, id_col, text_col)
    ws = split_words(F.col(t))
    outer = (F.get(ws, F.lit(0)) == "").cast("long") + F.when(F.size(ws) > 1, (F.element_at(ws, -1) == "").cast("long")).otherwise(0)
    own = own.withColumn("_i", F.coalesce(F.col(i).cast("long"), F.lit(LAST_ID))).withColumn("_k", row_hash(own, t))
    keyed = own.select(F.col("_i").alias("id"), F.col("_k").alias("h"), F.col(t).alias("text"))
    return own.withColumn("n_words", F.coalesce(F.size(ws) - outer, F.lit(0).cast("long"))), keyed


SAME = "_i = _id and _k = _h"


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, few: int = FEW_WINDOWS) -> DataFrame:
    """docs with n_words, n_hit (words inside a window), n_items, items_sha256, items (array) and contaminated."""
    own, keyed = keyed_by(docs, id_col, text_col)
    out = own.join(hits_of(keyed, items, item_col, item_text_col, window, few), F.expr(SAME), "left")
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    out = out.withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
    return restored(out.withColumn("contaminated", is_contaminated()), docs, ADDED)


def uncontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, few: int = FEW_WINDOWS) -> DataFrame:
    """The rows of docs that are not contaminated. The keys of those that are join the texts, so that no text is shuffled
    where they are few."""
    own, keyed = keyed_by(docs, id_col, text_col)
    hits = small_side(materialize(hits_of(keyed, items, item_col, item_text_col, window, few).select("_id", "_h", "n_hit"), "item-documents"))
    bad = own.select("_i", "_k", "n_words").join(hits, F.expr(SAME)).where(is_contaminated()).select("_id", "_h").distinct()
    return restored(own.join(small_side(materialize(bad, "item-contaminated")), F.expr(SAME), "left_anti"), docs, [])
