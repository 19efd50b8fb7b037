"""URL filters: a list of given rules, and rules of tokens mined from labelled URLs by FP-growth.

A given rule (verdict, host, path) fits its host and all subdomains where the URL's path starts with the rule's; of those
that fit, the longest decides. What no given rule decides is left to mined ones. A URL's tokens are its host labels, the
segments of its path and the names of its parameters, digits as `#`. Labelled URLs, with their class as one more token, go
through Spark's FP-growth; a set of tokens becomes a blocking rule if it is met in blocked URLs often enough (support) and
mostly in those (confidence). A rule that contains another one can't change a verdict and is pruned. Rules are filed under
their rarest token in an inverted index; the tokens of each different URL meet the index, and a rule is held against a URL
only where that token is met.

Defined cases: a null URL, or one without `://`, has neither host nor path nor tokens and is allowed; a URL with no path
fits no rule; where two rules of one length fit, the longer host decides; repeated rows get the same verdict; without blocked
labels nothing is mined and all that is left is allowed; an empty table gives an empty result. Columns of the input named like
a result column are replaced, any other names do no harm. FP-growth takes the URLs with at most `BASKET` tokens that are
frequent among blocked ones, so that a URL with thousands of tokens can't have 2**n subsets; the sets of tokens that are in a
longer URL are counted over all URLs level by level (`levels`), with no limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, restored, scratch, shielded, small_side

SUPPORT, CONFIDENCE, BASKET = 0.002, 0.5, 12
CLASS = "=block"
ADDED = ["host", "path", "rule", "verdict", "mined_rule"]
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next of / ? #, A-Z in lower case."""
    got = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(got, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given(rules: Sequence[Rule], host: Column, path: Column, say: int | None = None) -> Column:
    """The longest rule that fits, as "host + path" (say=None) or as its verdict (say=0); null where none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):  # the longest is asked first
        fits = ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])
        out = F.when(fits, F.lit(r[1] + r[2] if say is None else r[say])).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The different tokens of a URL."""
    query = F.split(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), "&")
    parts = F.concat(
        F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x)),
        F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x)),
        F.transform(query, lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1))),
    )
    whole = F.transform(parts, lambda x: F.regexp_replace(x, "[0-9]+", "#"))
    return F.coalesce(F.array_distinct(F.filter(whole, lambda x: F.length(x) > 2)), F.array().cast("array<string>"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, basket: int = BASKET) -> DataFrame:
    """items (sorted), confidence, blocked: the minimal blocking rules. labelled: tokens, block (boolean).

    A rule's tokens and the class together must be in at least `support` of the rows. What the driver sees of FP-growth are
    frequent tokens, at most tokens a row / support. Sets that are in no row of more than `basket` frequent tokens come from
    FP-growth over the other rows, where they have all their support; sets that are in such a row come from levels().
    """
    rows = materialize(labelled.select(F.monotonically_increasing_id().alias("n"), "tokens", "block"), "url-labelled")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("block").alias("blocked")).first()
    schema = "items array<string>, confidence double, blocked long"
    if not counts.blocked:
        return labelled.sparkSession.createDataFrame([], schema)
    least = max(1, -int(-support * counts.n // 1))
    each = rows.select("n", "block", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count_if("block").alias("b"), F.count(F.lit(1)).alias("c")).where(F.col("b") >= least).select("token", "c")
    met = each.join(small_side(often), "token").groupBy("n", "block").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("t"))
    met = materialize(met.withColumn("long", F.size("t") > basket), "url-baskets")
    # rows without a frequent token count to the number of rows, by which FP-growth divides
    size = met.agg(F.count_if(~F.col("long")).alias("short"), F.count_if("long").alias("long")).first()
    out = labelled.sparkSession.createDataFrame([], schema)
    if size.short:
        items = F.col("t")["token"]
        baskets = met.where(~F.col("long")).select(F.when(F.col("block"), F.concat(items, F.array(F.lit(CLASS)))).otherwise(items).alias("items"))
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / size.short), numPartitions=max(1, min(200, size.short // 20_000 + 1))).fit(baskets)
        sets = materialize(model.freqItemsets.select(F.sort_array("items").alias("items"), "freq"), "url-sets")
        both = sets.where(F.array_contains("items", CLASS) & (F.size("items") > 1)).select(F.array_remove("items", CLASS).alias("items"), F.col("freq").alias("blocked"))
        out = both.join(sets, "items").select("items", (F.col("blocked") / F.col("freq")).alias("confidence"), "blocked")
        out = out.where((F.col("confidence") >= confidence) & (F.col("blocked") >= least))
    if size.long:
        far = met.where("long").select(F.col("t")["token"].alias("own"))
        filed = out.select("items", F.element_at("items", 1).alias("token"))
        inside = far.select("own", F.explode("own").alias("token")).join(filed, "token").where(F.forall("items", lambda x: F.array_contains("own", x)))
        out = out.join(inside.select("items").distinct(), "items", "left_anti").unionByName(levels(met, least, confidence))
    return minimal(materialize(out, "url-rules"))


def levels(met: DataFrame, least: int, confidence: float) -> DataFrame:
    """items (sorted), confidence, blocked: the blocking rules among the sets of tokens that are in a long row, with those that
    have a rule as a part left out. met: n, block, t (c and token of the frequent ones, in order), long.

    Sets are counted over all rows, level by level. A set is extended only if it has enough blocked rows, is no rule itself and
    is in fewer rows than each of its parts: what has the same rows as a part has the same confidence and is not minimal. So a
    row of many tokens that go together has no 2**n sets to count; there is no limit to the length of a row or a rule.
    """
    last = lambda x: F.element_at(x, -1)
    own = met.select("block", "long", "t", F.explode("t").alias("first"))
    tried, rules, k = met.where("long").select(F.explode("t").alias("x")).distinct().select(F.array("x").alias("set"), F.lit(None).cast("long").alias("most")), None, 1
    while True:
        filed = tried.select("set", "most", F.element_at("set", 1).alias("first"))  # under the rarest token
        hit = own.join(filed, "first").where(F.forall("set", lambda x: F.array_contains("t", x))).groupBy("set", "most")
        hit = hit.agg(F.count(F.lit(1)).alias("held"), F.count_if("block").alias("blocked"), F.bool_or("long").alias("long"))
        hit = hit.where((F.col("blocked") >= least) & F.col("long") & (F.col("most").isNull() | (F.col("held") < F.col("most"))))
        hit = materialize(hit.withColumn("confidence", F.col("blocked") / F.col("held")), "url-level")
        found = hit.where(F.col("confidence") >= confidence).select(F.sort_array(F.col("set")["token"]).alias("items"), "confidence", "blocked")
        rules = found if rules is None else rules.unionByName(found)
        kept = hit.where(F.col("confidence") < confidence).select("set", "held")
        if kept.limit(2).count() < 2:
            return rules
        a, b = kept.select(F.col("set").alias("a")), kept.select(F.col("set").alias("b"))
        joined = last(F.col("a")) < last(F.col("b"))
        if k > 1:
            joined &= F.slice("a", 1, k - 1) == F.slice("b", 1, k - 1)
        k += 1
        more = a.join(b, joined).select(F.concat("a", F.array(last(F.col("b")))).alias("set"))
        parts = more.select("set", F.explode(F.transform("set", lambda x: F.array_remove("set", x))).alias("part"))
        parts = parts.join(kept.select(F.col("set").alias("part"), "held"), "part").groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.min("held").alias("most"))
        tried = parts.where(F.col("n") == k).select("set", "most")


def minimal(rules: DataFrame) -> DataFrame:
    """The rules of which no other one is a part. A rule of n tokens looks up its parts by leaving out one
    token at a time: where rules follow from frequent sets, all parts of a set are frequent, but not all are rules, so the
    parts are looked up at every length."""
    parts, have = rules.select(F.col("items").alias("whole"), F.col("items").alias("part")), rules.select(F.col("items").alias("part"))
    covered, longest = None, rules.agg(F.max(F.size("items"))).first()[0] or 0
    for _ in range(longest - 1):
        shorter = parts.where(F.size("part") > 1).select("whole", F.explode(F.transform("part", lambda x: F.array_remove("part", x))).alias("part")).distinct()
        parts = materialize(shorter, "url-parts")
        hit = parts.join(have, "part", "left_semi").select("whole")
        covered = hit if covered is None else covered.unionByName(hit)
    return rules if covered is None else materialize(rules.join(covered.select(F.col("whole").alias("items")).distinct(), "items", "left_anti"), "url-minimal")


def index(rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """token, items, confidence, blocked: each rule under the token of it that the fewest labelled URLs have."""
    each = rules.select("*", F.explode("items").alias("token"))
    used = labelled.select(F.explode("tokens").alias("token")).join(small_side(each.select("token").distinct()), "token", "left_semi")
    c = used.groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    return each.join(c, "token").groupBy("items", "confidence", "blocked").agg(F.min(F.struct("c", "token"))["token"].alias("token"))


def matched(urls: DataFrame, filed: DataFrame) -> DataFrame:
    """url, mined_rule (tokens, joined by a space) of the URLs (url, tokens) that a mined rule fits; the surest one is named."""
    hit = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(small_side(filed), "token")
    hit = hit.where(F.forall("items", lambda x: F.array_contains("tokens", x)))
    best = F.max(F.struct("confidence", "blocked", F.array_join("items", " ").alias("text")))["text"]
    return hit.groupBy("url").agg(best.alias("mined_rule"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule], url_col: str = "url", id_col: str = "page_id", label_id: str = "doc_id", label_col: str = "toxic", support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """pages with host, path, rule (the given one that decides, else null), verdict (allow or block) and mined_rule.

    Labels for mining: the verdict of a given rule where one fits, else that of `labels` by id (a row that is not 0 blocks;
    where an id is labelled more than once, any of them).
    """
    own, (i, u) = shielded(pages, id_col, url_col)
    host, path = host_of(F.col(u)), path_of(F.col(u))
    judged = own.select(F.col(i).alias("_i"), F.col(u).alias("url"), tokens(F.col(u), host, path).alias("tokens"), given(rules, host, path, 0).alias("by_rule"))
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(label_id).alias("_i")).agg(F.max(F.col(label_col) != 0).alias("marked"))
    listed = judged.where("by_rule is not null").select("tokens", (F.col("by_rule") == "block").alias("block"))
    known = judged.where("by_rule is null").join(marks, "_i").select("tokens", F.col("marked").alias("block"))
    labelled = listed.unionByName(known)
    with scratch(pages.sparkSession) as keep:
        mined = mine(labelled, support, confidence)
        urls = judged.where("by_rule is null").groupBy("url").agg(F.first("tokens").alias("tokens"))
        found = keep(matched(urls, index(mined, labelled)), "url-matched").withColumnRenamed("url", "_url")
    out = own.join(small_side(found, 100_000), own[u] == F.col("_url"), "left")
    by = given(rules, host, path, 0)
    out = out.select(*own.columns, host.alias("host"), path.alias("path"), given(rules, host, path).alias("rule"), F.coalesce(by, F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"), F.when(by.isNull(), F.col("mined_rule")).alias("mined_rule"))
    return restored(out, pages, ADDED)
