"""Secret scan with a random forest over candidates, in DataFrame functions only.

A candidate is a run of 16 or more of the characters that keys are written in, with its padding; a '=' before it or between
a name and it is neither. What stands behind a name of a secret and an assignment, or between a user's name and the host of a
URL, is a candidate from `SHORTEST` characters on, of any kind but spaces and quotes; a dotted token is one candidate. Its features are its length, how often its characters change class, how surprising its letters
follow one another (character transitions of the documents' own words), how much of it words of the documents cover
(dictionary), its shares of digits and vowels, the path, and the words before and after it (other candidates among them,
such as a long name). A random forest, trained from labelled findings, says whether it is a secret; it is read off the
fitted trees as one SQL expression, so that scoring is part of the scan and reads every text whole.

The dictionary and the transitions come from all documents: words are counted (a sum before the shuffle), and the pairs of
letters in them, of which there are 27 * 27. The candidates' pieces are joined to the dictionary.

Labelled findings: a table (candidate, before, after, path, label); at most `MOST_LABELS` rows are used for the fit, a
documented bound. Where no reviewed findings exist, `labelled_findings` makes such a table by rule and `mined_findings` adds
what the documents themselves show: their long words, numbers and digests are no secrets, forms that issuers give to their
keys are. Secrets stand behind any names there and some of the others behind names of secrets, so that the label does not
follow from one feature.

Defined cases: null texts have no candidates; null paths count as empty; rows that repeat are scanned each on its own; texts
of any length are read whole; an empty table gives an empty result. Columns of the input named like a result column are
replaced, any other names do no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, restored, shielded

SHORTEST = 6
#: Names of secrets, in front of an assignment.
NAMED = r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|credentials?)[\"']?[ \t]{0,2}[:=]{1,2}[ \t]{0,2}[\"'`]?"
LONG = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
DOTTED = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)?"
#: A look at one to three characters before the longer one, which only few places then need.
ASSIGNED = rf"(?<=[\"'`:= \t])(?<=[\"'`:=]|[:=][ \t]|[:=][ \t][ \t])(?<={NAMED})(?!LONG)[^\s\"'`,;<>(){{}}&]{{{SHORTEST},}}+".replace("LONG", LONG)
USERINFO = rf"(?<=:)(?<=://[A-Za-z0-9._%+-]{{0,64}}:)[^\s/@:\"'<>]{{{SHORTEST},}}+(?=@)"
CANDIDATE = "|".join((DOTTED, USERINFO, ASSIGNED, LONG))
AROUND = 48  # three candidates at most
KNOWN = r"^(?:(?:AKIA|ASIA)[A-Z2-7]{16}$|gh[opsur]_[A-Za-z0-9]{20}|(?:sk|pk|rk)[_-](?:live|test)[_-]|eyJ[A-Za-z0-9_-]+[.])"  # forms that issuers give to their keys
MOST_LABELS = 20_000
MOST_MINED = 2_000  # of each kind
FEATURES = ["length", "switches", "surprise", "dictionary", "digits", "vowels", "known", "hex", "distinct", "assigned", "quoted", "keyword", "harmless", "test_path", "symbols", "userinfo"]
#: A word of a text that is not part of a longer run; letters but a to z are one class in the transitions.
ORDINARY = r"(?<![\p{L}0-9_/+=-])\p{L}{2,}+(?![\p{L}0-9_/+=-])"
LETTERS = 27
FREQUENT = 3


def dictionary(docs: DataFrame, text_col: str) -> DataFrame:
    """word, n: the words of all texts, in lower case."""
    words = F.regexp_extract_all(F.col(text_col), F.lit(ORDINARY), F.lit(0))
    counted = docs.select(F.explode(words).alias("word")).groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return materialize(counted, "secret-words")


def pairs_of(text: Column) -> Column:
    """The place in the table of transitions of each character and the next; one pass, however long the text is."""

    def letter(x: Column) -> Column:
        c = F.ascii(x)
        return F.when((c >= 97) & (c <= 122), c - 97).otherwise(LETTERS - 1)

    codes = F.transform(F.split(text, ""), letter)
    return F.transform(F.array(codes), lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c)), lambda x, y: x * LETTERS + y))[0]


def transitions(words: DataFrame) -> list[float]:
    """-log2 of the probability of a letter after another, LETTERS * LETTERS numbers. words: word, n."""
    pairs = words.where(F.length("word") > 1).select(F.explode(pairs_of(F.col("word"))).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
    n = [1.0] * (LETTERS * LETTERS)
    for r in pairs.collect():  # at most LETTERS * LETTERS rows
        n[r.pair] += r.n
    return [math.log2(sum(n[i - i % LETTERS : i - i % LETTERS + LETTERS]) / x) for i, x in enumerate(n)]


def covered(found: DataFrame, words: DataFrame) -> DataFrame:
    """found (_row, candidate) with covered: how many of its characters are in letter runs that are frequent words."""
    piece = F.explode(F.regexp_extract_all("candidate", F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0)))
    pieces = found.select("_row", piece.alias("piece")).select("_row", F.lower("piece").alias("piece"))
    known = words.where((F.col("n") >= FREQUENT) & (F.length("word") > 2)).select("word")
    n = pieces.join(known, F.col("piece") == F.col("word")).groupBy("_row").agg(F.sum(F.length("piece")).alias("covered"))
    return found.join(n.withColumnRenamed("_row", "_of"), F.col("_row") == F.col("_of"), "left").withColumn("covered", F.coalesce("covered", F.lit(0)))


def features(candidate: Column, before: Column, after: Column, path: Column, cover: Column, follow: list[float]) -> dict[str, Column]:
    n = F.greatest(F.length(candidate), F.lit(1)).cast("double")
    last = F.lower(F.regexp_extract(before, r"([A-Za-z_]+)[^A-Za-z]*$", 1))
    table = F.array(*map(F.lit, follow))
    surprise = F.aggregate(F.when(F.length(candidate) > 1, pairs_of(F.lower(candidate))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda acc, i: acc + F.get(table, i))
    return {
        "length": n,
        "switches": F.regexp_count(candidate, F.lit(r"[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])")) / n,
        "surprise": surprise / n,
        "dictionary": cover / n,
        "digits": F.regexp_count(candidate, F.lit("[0-9]")) / n,
        "vowels": F.regexp_count(candidate, F.lit("[AEIOUaeiou]")) / n,
        "known": candidate.rlike(KNOWN).cast("double"),
        "hex": candidate.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "distinct": F.size(F.array_distinct(F.split(candidate, ""))) / n,
        "assigned": before.rlike(r"[:=]\s*[\"'`]?$").cast("double"),
        "quoted": (before.rlike("[\"'`]$") & after.rlike("^[\"'`]")).cast("double"),
        "keyword": last.rlike("token|secret|passw|pwd|key|auth|cred|bearer|signature").cast("double"),
        "harmless": (last.rlike("sha|md5|commit|digest|checksum|uuid|guid|integrity|rev|etag|example|public") | candidate.rlike(r"(?i)example|placeholder|x{6,}|0{8,}|1234567")).cast("double"),
        "symbols": F.regexp_count(candidate, F.lit("[^A-Za-z0-9]")) / n,
        "userinfo": (before.rlike(r"://[^\s/@]*:$") & after.startswith("@")).cast("double"),
        "test_path": F.lower(F.coalesce(path, F.lit(""))).rlike("test|example|sample|fixture|mock|doc").cast("double"),
    }


def labelled_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(candidate, before, after, path, label) by rule, the same in every run."""
    i = F.col("id")
    digest = F.sha2(i.cast("string"), 512)
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64("id", F.lit(len(xs))), F.lit(len(xs))) + 1).cast("int"))
    hexes = F.substr(digest, F.lit(1), pick(32, 40, 40, 48, 64))
    mixed = F.translate(F.base64(F.unhex(F.substr(digest, F.lit(1), pick(36, 48, 60)))), "/", "_")
    base = F.translate(F.base64(F.unhex(digest)), "+/=", "kQz")
    letters = F.translate(base, "0123456789", "qwZxJkVpbM")  # no digit, as one key in 30 or fewer has it
    issued = F.concat(F.lit("AKIA"), F.substr(F.translate(F.upper(F.when(i % 20 == 6, letters).otherwise(base)), "0189", "XQJH"), F.lit(1), F.lit(16)))
    keyed = F.when(i % 10 == 6, issued).when(i % 10 == 8, F.substr(letters, F.lit(1), pick(20, 24, 32, 36, 40, 43))).when(i % 3 == 0, mixed).otherwise(hexes)
    name = pick("token", "api_key", "secret", "password", "auth_token", "client_secret", "access_key", "signing_key")
    other = pick("conn", "value", "login", "x", "DSN")  # one secret in five that is no bare hexadecimal number stands behind such a name
    given = F.when((i % 5 == 3) & ~keyed.rlike("^[0-9a-f]+$"), other).otherwise(name)
    good = F.struct(keyed.alias("candidate"), F.concat(F.lit("words then "), given, pick(' = "', ": '", "=", ' := "', ": ")).alias("before"), pick('" and', "'", " then", '",').alias("after"), pick("src1", "app/config.py", "deploy/env", "notes.txt").alias("path"))
    number = F.substr(F.conv(F.substr(digest, F.lit(1), F.lit(15)), 16, 10), F.lit(1), F.lit(16))
    word = F.concat(pick("retention", "condition", "interests", "versichern"), pick("_station_", "-the-", "enting", "ation"), i.cast("string"), pick("_final", "-version", "ment"))
    parts = [pick("the", "condition", "station", "versch", "heit", "internal", "public", "entre", "main", "source", "default"), pick("ening", "lichkeit", "handler", "ation", "config", "ment", "value", "client", "lecontre", "token", "secret", "access", "name"), pick("erung", "tion", "password", "key", "service", "elle", "file")]
    joined = [F.concat_ws(sep, *parts, *parts[1:]) for sep in ("", "_", "-", "/")]
    names = F.when(i % 3 == 0, F.upper(joined[1])).when(i % 7 == 0, F.concat(*(F.initcap(x) for x in [*parts, *parts[1:]]))).otherwise(F.element_at(F.array(*joined), (F.pmod(F.xxhash64("id"), F.lit(4)) + 1).cast("int")))
    plain = F.when(i % 10 == 3, names).when(i % 5 == 1, number).when(i % 5 == 2, word).when(i % 5 == 3, F.concat(F.lit("EXAMPLE0000000"), i.cast("string"), F.lit("xxxxxx"))).otherwise(hexes)
    said = F.when((i % 10 == 3) & (i % 4 == 1) | ~i.cast("string").rlike("[49]$") & (F.pmod(F.xxhash64("id"), F.lit(5)) == 1), F.concat(name, pick("=", ' = "', ": "))).when(i % 5 == 4, pick("sha256: ", 'integrity = "', "commit ", "uuid=", 'checksum: "')).otherwise(pick("running text with ", "called ", "see the ", 'value = "', "order number "))
    bad = F.struct(plain.alias("candidate"), said.alias("before"), pick(" and", '"', ",", ".").alias("after"), pick("src2", "tests/data.py", "package-lock", "docs/example.md").alias("path"))
    rows = spark.range(0, n, 1, 4)
    return rows.select(F.when(i % 2 == 0, good).otherwise(bad).alias("x"), (1 - i % 2).cast("double").alias("label")).select("x.*", "label")


def short_findings(spark: SparkSession, n: int = 2000) -> DataFrame:
    """(candidate, before, after, path, label) by rule: what people choose behind names of secrets and in URLs, and what stands
    there without being a secret."""
    i = F.col("id")
    digest = F.sha2(F.concat(F.lit("s"), i.cast("string")), 512)
    pick = lambda k, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(xs))) + 1).cast("int"))
    random = F.translate(F.base64(F.unhex(digest)), "+/=", "!@#")
    number = F.substr(F.conv(F.substr(digest, F.lit(1), F.lit(10)), 16, 10), F.lit(1), pick(1, 1, 2, 3, 4))
    word = pick(2, "hunter", "summer", "dragon", "Winter", "letmein", "Sonne", "azerty", "Admin", "monkey", "correcthorse")
    leet = F.element_at(F.array(*(F.translate(word, "oeiEas", x) for x in ("0310@$", "0eiE4s", "o3iE@5", "oeiEas"))), (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(4)) + 1).cast("int"))
    chosen = F.concat(leet, pick(4, "", "_", "-", ".", "!", "@"), number, pick(5, "!", "", "#", "?", "!x", "$9"))
    secret = F.when(i % 6 == 0, F.substr(random, F.lit(1), pick(6, 8, 10, 12, 14, 15))).when(F.length(chosen) < SHORTEST, F.rpad(chosen, SHORTEST, "7")).otherwise(chosen)
    named = F.concat(pick(7, "", "db_", "my", "user_", "admin."), pick(8, "password", "passwd", "api_key", "secret", "token", "pwd", "PASSWORD", "access_key"), pick(9, "=", ' = "', ": ", ': "', "='"))
    userinfo = F.concat(F.lit("at "), pick(10, "https", "postgres", "ftp", "mongodb"), F.lit("://"), pick(11, "user", "admin", "root", "app"), F.lit(":"))
    word_or_type = pick(12, "required", "string", "secret", "changed", "optional", "hidden", "undefined", "password", "String", "getToken", "process.env.TOKEN", "os.environ", "$PASSWORD", "config.token", "********", "<secret>", "your-password", "function", "expired", "nullable", "True-ish", "settings", "none-given", "and/or", "forgotten", "is_valid", "%s-value", "\\$TOKEN", "xxxxxxxx", "%(secret)s")
    plain = F.when(i % 4 == 1, F.concat(pick(13, "the", "internal", "main", "their", "heit", "entre"), pick(14, "", "_", "-", "."), pick(15, "handler", "value", "condition", "source", "nichts", "words"))).otherwise(word_or_type)
    at = (i % 7 == 0) & (i % 2 == 0)
    good = F.struct(secret.alias("candidate"), F.when(at, userinfo).otherwise(named).alias("before"), F.when(at, F.lit("@host/x")).otherwise(pick(16, '"', "", " then", ",")).alias("after"))
    bad = F.struct(plain.alias("candidate"), named.alias("before"), pick(17, '"', "", " then", ",").alias("after"))
    rows = spark.range(0, n, 1, 4).select(F.when(i % 2 == 0, good).otherwise(bad).alias("x"), pick(18, "src1", "app/config.py", "deploy/env", "notes.txt").alias("path"), (1 - i % 2).cast("double").alias("label"))
    return rows.select("x.*", "path", "label").where(F.length("candidate") >= SHORTEST)


def mined_findings(found: DataFrame, words: DataFrame) -> DataFrame:
    """(candidate, before, after, path, label) that the documents show: long words of theirs, numbers and named digests among
    the candidates (found) are no secrets, keys in an issuer's form are. At most MOST_MINED of each."""
    some = lambda df, label: df.orderBy(F.xxhash64("candidate", "before"), "candidate", "before").limit(MOST_MINED).select("candidate", "before", "after", F.lit("").alias("path"), F.lit(label).alias("label"))
    long = words.where((F.length("word") >= 16) & F.col("word").rlike("^[a-z]+$")).select(F.col("word").alias("candidate"), F.lit("in the words ").alias("before"), F.lit(", and").alias("after"))
    known = F.col("candidate").rlike(KNOWN)
    number = F.col("candidate").rlike("^[0-9]+$") | F.lower("before").rlike("(?:sha[0-9]*|md5|commit|checksum|digest|uuid)[^A-Za-z]*$")
    return some(long, 0.0).unionByName(some(found.where(number & ~known), 0.0)).unionByName(some(found.where(known), 1.0))


def forest(labelled: DataFrame, words: DataFrame, follow: list[float], trees: int = 16, depth: int = 6, seed: int = 5) -> list:
    """Fitted trees as nested (feature, threshold, left, right) with leaves p(secret)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = labelled.orderBy(F.xxhash64("candidate", "before", "after"), "candidate", "before", "after").limit(MOST_LABELS).withColumn("_row", F.monotonically_increasing_id())
    rows = covered(materialize(rows, "secret-labels"), words)
    f = features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"), F.col("covered"), follow)
    rows = rows.select(*(f[k].cast("double").alias(k) for k in FEATURES), "label")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows)

    def read(node) -> tuple | float:
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return float(stats[1] / max(sum(stats), 1e-9))
        split = node.split()
        return (FEATURES[split.featureIndex()], float(split.threshold()), read(node.leftChild()), read(node.rightChild()))

    return [read(t._call_java("rootNode")) for t in model.trees]


def probability(trees: list, cols: dict[str, Column]) -> Column:
    def tree(t: tuple | float) -> Column:
        return F.lit(t) if isinstance(t, float) else F.when(cols[t[0]] <= t[1], tree(t[2])).otherwise(tree(t[3]))

    return sum((tree(t) for t in trees), F.lit(0.0)) / len(trees)


ADDED = ["at", "candidate", "before", "after"]


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' columns but the text, at (from 0, within the text), candidate, before, after."""
    own, (t,) = shielded(docs, text_col)
    text = lambda column, k: F.coalesce(F.when(F.col("_at") + k >= 0, F.get(column, F.col("_at") + k)), F.lit(""))
    found = F.regexp_extract_all(F.col(t), F.lit(CANDIDATE), F.lit(0))
    some = own.where(F.col(t).rlike(CANDIDATE)).withColumn("_c", found).withColumn("_b", F.split(F.col(t), CANDIDATE))
    one = some.select(*(c for c in own.columns if c != t), "_b", "_c", F.posexplode("_c").alias("_at", "candidate"))
    before = F.concat(*(x for k in (-3, -2, -1) for x in (text("_b", k), text("_c", k))), text("_b", 0))
    after = F.concat(text("_b", 1), *(x for k in (1, 2, 3) for x in (text("_c", k), text("_b", k + 1))))
    one = one.withColumn("at", F.col("_at")).withColumn("before", F.right(before, F.lit(AROUND))).withColumn("after", F.left(after, F.lit(AROUND)))
    return restored(one, docs, ADDED, t)


def scored(found: DataFrame, path: Column, trees: list, follow: list[float]) -> DataFrame:
    """found (candidate, before, after, covered) with its features as _f_... and score.

    The features are written, since the optimizer would put a feature's expression in the place of each use in the trees.
    """
    f = features(F.col("candidate"), F.col("before"), F.col("after"), path, F.col("covered"), follow)
    found = materialize(found.select("*", *(f[k].cast("double").alias(f"_f_{k}") for k in FEATURES)), "secret-features")
    return found.withColumn("score", F.round(probability(trees, {k: F.col(f"_f_{k}") for k in FEATURES}), 6))


def scan(docs: DataFrame, path_col: str = "source", text_col: str = "text", labelled: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """docs' other columns, at, candidate, before, after, score and is_secret: a row a candidate."""
    added = [*ADDED, "score", "is_secret"]
    own, (path, t) = shielded(docs, path_col, text_col)
    found = materialize(candidates(own, t).withColumn("_row", F.monotonically_increasing_id()), "secret-candidates")
    words = dictionary(own, t)
    follow = transitions(words)
    if labelled is None:
        labelled = labelled_findings(docs.sparkSession).unionByName(short_findings(docs.sparkSession)).unionByName(mined_findings(found, words))
    trees = forest(labelled, words, follow)
    found = scored(covered(found, words), F.col(path), trees, follow)
    return restored(found.withColumn("is_secret", F.col("score") >= least), docs, added, t)
