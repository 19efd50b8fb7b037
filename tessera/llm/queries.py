"""The registered queries of this subpackage: each operator over its whole table, with the columns that are fixed for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, decontamination, line_dedup, manifest, mixing, near_dedup, perplexity, pii, quality_rules, secrets, substring_dedup, url_filter, warc

ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")
    return decontamination.decontaminate(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_dedup(docs).select("doc_id", "n_shingles", "component_id", "kept")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of a replica of pages in which every 97th page is altered and every 101st missing."""
    pages = _table(spark, sf_dir, "pages")
    replica = pages.where(F.pmod("page_id", F.lit(101)) != 7)
    replica = replica.withColumn("html", F.when(F.pmod("page_id", F.lit(97)) == 13, F.concat("html", F.lit("<!-- rot -->"))).otherwise(F.col("html")))
    records = warc.records(pages)
    copies = warc.records(replica)
    found = warc.audit(warc.tree(records), warc.tree(copies))
    named = records.unionByName(copies.join(records.select("file", "slot"), ["file", "slot"], "left_anti"))  # of extra ones, the copy
    got = found.join(named, ["file", "slot"])
    return got.select(F.col("id").alias("page_id"), "file", "slot", "kind", "length", "digest")


ORACLE["op4_merkle_audit"] = """
WITH r AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>'
    || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM pages)
SELECT page_id, page_id // 1000 AS file, page_id % 1000 AS slot, CASE WHEN page_id % 101 = 7 THEN 'missing' ELSE 'altered' END AS kind,
  CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS digest
FROM r WHERE page_id % 101 = 7 OR page_id % 97 = 13
"""


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    got = secrets.scan(docs)
    return got.select("doc_id", F.col("at").cast("long").alias("at"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, key="a key for tests").drop("text").withColumnRenamed("new_text", "text")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    got = line_dedup.line_dedup(docs)
    return got.select("doc_id", "n_lines", "n_removed", F.array_join("removed_lines", ",").alias("removed_lines"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return perplexity.classify(docs, trusted).select("doc_id", "lang", "n_scored", F.round("perplexity", 6).alias("perplexity"), "kept")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality_rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The given rules of op11: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = _table(spark, sf_dir, "pages").select("page_id", "url"), _table(spark, sf_dir, "labels")
    return url_filter.filter_urls(pages, labels, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document (by the CRC of its id) is tampered with: its letters A-Z are made lower-case."""
    docs = _table(spark, sf_dir, "documents")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest.manifest(docs, tamper=F.crc32(F.col("doc_id").cast("string")) % 5 == 0, altered={"text": lower})


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


WORD = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
PLAIN = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE["op1_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {PLAIN} AS w FROM documents), b AS (SELECT DISTINCT item_id, {PLAIN} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT * FROM dw JOIN iw USING (n, k)), cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS l FROM hit WHERE item_id IS NOT NULL GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(l), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLE["op3_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, {WORD} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM rep), each AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM each WHERE (doc_id, i) NOT IN (SELECT doc_id, i FROM cov) GROUP BY doc_id), n AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLE["op8_mix_sources"] = f"""
WITH d AS (SELECT doc_id, source, CAST(len({WORD}) AS BIGINT) AS size, CAST('0x' || left(md5(concat_ws('|', '20240', CAST(doc_id AS VARCHAR), source, md5(coalesce(text, '')))), 15) AS BIGINT) AS key FROM documents),
s AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, ([3.0, 1.0, 2.0])[(sid - 1) % 3 + 1]::DOUBLE AS w FROM s), r AS (SELECT *, cap / w AS ratio FROM c),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY ratio, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(cap, w * coalesce((SELECT arg_min(level, (ratio, sid)) FROM l WHERE level <= ratio), ratio)) AS target FROM l),
p AS (SELECT *, CAST(floor(target + 1e-6) AS BIGINT) AS words, CASE WHEN source_size > 0 THEN CAST(floor(target + 1e-6) AS BIGINT) // source_size ELSE 0 END AS whole FROM t),
q AS (SELECT d.*, p.source_size, p.target, p.whole, p.words - p.whole * p.source_size AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY key) AS upto, sum(size) OVER (PARTITION BY d.source, key) AS own, count(*) OVER (PARTITION BY d.source, key) AS n FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * whole + CASE WHEN upto <= rest THEN size WHEN upto - own < rest THEN least(size, (rest - upto + own) // n) ELSE 0 END AS BIGINT) AS taken FROM q
"""

ORACLE["op9_quality_rules"] = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORD} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
c AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  CAST(word_chars > 12 * n_words OR word_chars < 2 * n_words AS INT) + CAST(n_symbols > 0.3::DOUBLE * n_words AS INT) + CAST(n_dup_lines > 0.3::DOUBLE * n_lines AS INT) AS soft FROM c),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(CASE WHEN base_failed OR soft > 0 THEN 1 ELSE 0 END)::DOUBLE AS x FROM f GROUP BY source),
m AS (SELECT count(*) AS k, sum(n) AS n, greatest(1e-6, least(1 - 1e-6, sum(x) / sum(n))) AS p, sum(x * x / n) - sum(x) * sum(x) / sum(n) AS spread, sum(n) - sum(n * n) / sum(n) AS room FROM h),
v AS (SELECT p, least(greatest(CASE WHEN room > 0 THEN (spread - (k - 1) * p * (1 - p)) / room ELSE 0 END, p * (1 - p) / 1e4), p * (1 - p) / 2) AS between_ FROM m), e AS (SELECT p, p * (1 - p) / between_ - 1 AS mass FROM v),
r AS (SELECT source, (x + p * mass) / (n + mass) AS rate FROM h, e)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND soft < CASE WHEN rate > 0.25 THEN 1 ELSE 2 END AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""

def _url_sql() -> str:
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rules = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in rules) + " END"
    by = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in rules) + " END"
    return f"""
WITH u AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
j AS (SELECT *, {rule} AS rule, {by} AS by_rule, list_sort(list_distinct(list_filter(list_transform(list_concat(list_transform(string_split(host, '.'), lambda x: 'h:' || x), list_transform(string_split(path, '/'), lambda x: 'p:' || x),
  list_transform(string_split(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '&'), lambda x: 'q:' || string_split(x, '=')[1])), lambda x: regexp_replace(x, '[0-9]+', '#', 'g')), lambda x: length(x) > 2))) AS t FROM u),
k AS (SELECT doc_id, bool_or(toxic <> 0) AS marked FROM labels WHERE toxic IS NOT NULL GROUP BY doc_id),
lab AS (SELECT row_number() OVER () AS n, t, coalesce(by_rule = 'block', marked) AS block FROM j LEFT JOIN k ON k.doc_id = j.page_id WHERE by_rule IS NOT NULL OR marked IS NOT NULL),
lim AS (SELECT greatest(1, ceil({url_filter.SUPPORT}::DOUBLE * count(*))) AS least FROM lab), tok AS (SELECT n, block, unnest(t) AS token FROM lab),
often AS (SELECT token, count(*) AS c FROM tok GROUP BY token HAVING count(*) FILTER (block) >= (SELECT least FROM lim)),
bas AS (SELECT n, block, list_sort(list(token ORDER BY c, token)[1:{url_filter.BASKET}]) AS t FROM tok JOIN often USING (token) GROUP BY n, block),
sub AS (SELECT block, list_filter(t, lambda x, i: (m >> (i - 1)) & 1 = 1) AS items FROM (SELECT block, t, unnest(range(1, CAST(1 << len(t) AS BIGINT))) AS m FROM bas)),
r AS (SELECT items FROM sub GROUP BY items HAVING count(*) FILTER (block) >= (SELECT least FROM lim) AND count(*) FILTER (block) / count(*)::DOUBLE >= {url_filter.CONFIDENCE})
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN EXISTS (SELECT 1 FROM r WHERE list_has_all(j.t, r.items)) THEN 'block' ELSE 'allow' END) AS verdict FROM j"""


ORACLE["op11_url_filter"] = _url_sql()


def _manifest_sql(inner: int = 5, outer: int = 3) -> str:
    """Levels one by one: room for 16**inner documents a source and 16**outer sources."""
    f = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join([*(f(c) for c in ("doc_id", "source", "lang", "n_chars")), text]) + ")"
    out = f"""WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g, {leaf(f("text"))} AS leaf,
  CASE WHEN crc % 5 = 0 THEN {leaf("CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END")} END AS tampered
  FROM documents JOIN (SELECT doc_id AS crc_id, {_CRC} AS crc FROM (SELECT DISTINCT doc_id FROM documents)) ON crc_id = doc_id),
l0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, doc_id, tampered FROM d)"""

    def levels(name: str, n: int) -> tuple[str, str]:
        text = ""
        for k in range(1, n + 1):
            text += f""",
{name}{k} AS (SELECT g, i // 16 AS i, CASE WHEN max(m) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY g) AS m FROM {name}{k - 1}) GROUP BY g, i // 16),
s{name}{k} AS (SELECT g, i, count(*) OVER (PARTITION BY g) > 1 AS up, coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k - 1})"""
        joins = "".join(f" JOIN s{name}{k} ON s{name}{k}.g = {{0}} AND s{name}{k}.i = {{1}} // {16 ** (k - 1)}" for k in range(1, n + 1))
        return text, joins

    text, joins = levels("l", inner)
    out += text + f""",
o0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, g AS name FROM l{inner})"""
    text, outer_joins = levels("o", outer)
    out += text
    fold, proof = "coalesce(tampered, l0.h)", "''"
    for s in [*(f"sl{k}" for k in range(1, inner + 1)), *(f"so{k}" for k in range(1, outer + 1))]:
        proof += f" || CASE WHEN {s}.up THEN {s}.b || {s}.a ELSE '' END"
    names = [*(f"sl{k}" for k in range(1, inner + 1)), *(f"so{k}" for k in range(1, outer + 1))]
    steps, last = "", "f0"
    rest = ", ".join(f"{s}.up AS up{n}, {s}.b AS b{n}, {s}.a AS a{n}" for n, s in enumerate(names))
    out += f""",
f0 AS (SELECT doc_id, l0.h AS leaf, o0.h AS subroot, (SELECT h FROM o{outer}) AS root, sha256({proof}) AS proof_sha256, {fold} AS fold, {rest}
  FROM l0{joins.format("l0.g", "l0.i")} JOIN o0 ON o0.name = l0.g{outer_joins.format("''", "o0.i")})"""
    for n in range(len(names)):
        steps += f""",
f{n + 1} AS (SELECT * REPLACE (CASE WHEN up{n} THEN sha256(b{n} || fold || a{n}) ELSE fold END AS fold) FROM f{n})"""
        last = f"f{n + 1}"
    return out + steps + f"\nSELECT doc_id, leaf, subroot, root, proof_sha256, fold AS folded_root, fold = root AS verified FROM {last}"


#: CRC-32 of the decimal doc_id: each byte goes in, then eight shifts (the reflected polynomial 0xEDB88320).
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
  lambda s, c: list_reduce(list_prepend(xor(s, c), range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
ORACLE["op12_manifest"] = _manifest_sql()


def _clusters_sql(k: int = 40, rounds: int = 5, size: int = 64) -> str:
    out = f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT v, sha256('2:' || vec_id) AS h FROM v ORDER BY h NULLS LAST, v LIMIT {k}))"""
    near = "(SELECT v.vec_id, v.v, c, list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i]))) AS d FROM v, c{0} c)"
    for r in range(rounds + 1):
        out += f""",
a{r} AS MATERIALIZED (SELECT vec_id, v, arg_min(c, (d, c)) AS c, CAST(min(d) AS BIGINT) AS d FROM {near.format(r)} GROUP BY vec_id, v)"""
        if r < rounds:
            out += f""",
c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m, c.v) AS v FROM c{r} c LEFT JOIN (SELECT c, list(x ORDER BY i) AS m FROM (SELECT c, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) n ON n.c = c.c)"""
    return out + f"""
SELECT vec_id, CAST(a.c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c"""


ORACLE["op13_clusters"] = _clusters_sql()

QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_near_dedup, op3_substring_dedup, op4_merkle_audit, op5_secret_scan, op6_pseudonyms, op7_line_dedup, op8_mix_sources, op9_quality_rules, op10_quality_classifier, op11_url_filter, op12_manifest, op13_clusters)}
