"""URL filters, the dataset manifest and centroid clustering against plain models."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import clustering, manifest, queries, url_filter

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- URL filters

RULES = queries.URL_RULES


def plain_tokens(url):
    if url is None or "://" not in url:
        return "", "", []
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:cut].translate(LOW), rest[cut:]
    no_mark = rest.split("#")[0]
    path, _, query = no_mark.partition("?")
    path = rest[: min((rest.index(c) for c in "?#" if c in rest), default=len(rest))]
    mask = lambda x: "".join("#" if c.isdigit() and (i == 0 or not x[i - 1].isdigit()) else "" if c.isdigit() else c for i, c in enumerate(x))
    each = [*("h:" + x for x in host.split(".")), *("p:" + x for x in path.split("/")), *("q:" + x.split("=")[0] for x in query.split("&"))]
    return host, path, sorted({mask(x) for x in each if len(x) > 2})


def plain_rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def plain_verdicts(urls, marks, support, confidence):
    rows = [(i, u, *plain_tokens(u)) for i, u in urls]
    base, out = [], []
    for i, _, host, path, t in rows:
        v = plain_rule(host, path)[1]
        if v is not None or i in marks:
            base.append((frozenset(t), v == "block" if v is not None else marks[i]))
    least = max(1, math.ceil(support * len(base)))
    seen = {}
    for t, block in base:
        for n in range(1, len(t) + 1):
            for s in itertools.combinations(sorted(t), n):
                a = seen.setdefault(s, [0, 0])
                a[0] += 1
                a[1] += block
    rules = [set(s) for s, (n, b) in seen.items() if b >= least and b / n >= confidence]
    for i, u, host, path, t in rows:
        rule, v = plain_rule(host, path)
        out.append((i, host, path, rule, v or ("block" if any(r <= set(t) for r in rules) else "allow")))
    return out


def urls():
    r = random.Random(5)
    hosts = ["%s%s.%s" % (r.choice(["", "www.", "m.", "blog."]), x, tld) for x in ("alpha", "beta", "spam-farm", "example") for tld in ("com", "net", "org")]
    out = [(i, "http%s://%s/%s/%d%s" % (r.choice(["", "s"]), r.choice(hosts), r.choice(["en", "es", "fr", "de"]), r.randint(1, 99), r.choice(["", ".html", "/", "?page=2&ref=x", "#top"]))) for i in range(600)]
    odd = [None, "", "no scheme", "://", "http://", "http://COM", "http://Example.com/en/1", "http://WWW.example.com/en/x?q", "http://xexample.com/en/", "http://example.com/EN/", "http://a.net?x=/es/", "http://a.net/es", "http://a.net/es/", "x://y://z/p", "http://\u00dcber.net/fr/\nx", "http://b.org/" + "long/" * 20000]
    out += [(1000 + i, u) for i, u in enumerate(odd)] + [(None, "http://a.org/es/1"), (3, out[3][1]), (3, "http://spam-farm.org/x")]
    return out


def judged(spark, rows, marks, **options):
    pages = spark.createDataFrame([(i, u, "clash", "x") for i, u in rows], "page_id long, url string, Verdict string, token string").repartition(3)
    labels = spark.createDataFrame([(i, int(m)) for i, m in marks] + [(7, None), (None, 1)], "doc_id long, toxic int")
    got = url_filter.filter_urls(pages, labels, RULES, **options)
    assert got.columns == ["page_id", "url", "token", "host", "path", "rule", "verdict", "mined_rule"]
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()), key=repr)


def test_url_filter_against_all_subsets(spark):
    rows = [x for x in urls() if len(x[1] or "") < 1000]
    r = random.Random(8)
    marks = {i: "spam-farm" in (u or "") and "/de/" in (u or "") or r.random() < 0.05 for i, u in rows if i is not None and r.random() < 0.7}
    for support, confidence in ((0.01, 0.6), (0.002, 0.9)):
        want = sorted(plain_verdicts(rows, marks, support, confidence), key=repr)
        assert judged(spark, rows, marks.items(), support=support, confidence=confidence) == want
        mined = {x[1:] for x in want if x[3] is None}
        assert {x[3] for x in mined} == {"allow", "block"}


def test_url_filter_odd_cases(spark):
    assert judged(spark, [], []) == []
    rows = urls()
    got = judged(spark, rows, [(i, 0) for i in range(50)] + [(1, 1)])
    assert len(got) == len(rows)
    by = {x[1:3]: x[3:] for x in got}
    assert by["", ""] == (None, "allow") and by["com", ""][0] is None and by["example.com", "/en/1"] == ("example.com/en/", "block")
    assert by["www.example.com", "/en/x"] == ("www.example.com/en/", "allow") and by["xexample.com", "/en/"] == ("com/", "allow")
    assert by["example.com", "/EN/"] == ("com/", "allow") and by["a.net", ""][0] is None and by["a.net", "/es"][0] is None and by["a.net", "/es/"] == ("net/es/", "block")
    none = judged(spark, [(1, "http://x.org/a"), (2, "http://x.com/a")], [])
    assert [x[4] for x in none] == ["allow", "allow"]


def test_minimal_rules(spark):
    rows = [(["a"], 0.9, 5), (["a", "b"], 0.95, 4), (["b", "c"], 0.8, 4), (["b", "c", "d"], 1.0, 3), (["c", "e", "f", "g"], 1.0, 3), (["a", "e", "f", "g"], 1.0, 3)]
    got = url_filter.minimal(spark.createDataFrame(rows, "items array<string>, confidence double, blocked long"))
    assert sorted(r["items"] for r in got.collect()) == [["a"], ["b", "c"], ["c", "e", "f", "g"]]


# --- manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if x is None else "%d:%s" % (len(str(x).encode()), x) for x in row))


def climb(nodes, fan=16):
    """root, and for each node the siblings before and after it, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(paths, at, strict=True):
            run = i // fan * fan
            p.append(("".join(nodes[run:i]), "".join(nodes[i + 1:run + fan])))
        nodes, at = [sha(*nodes[i:i + fan]) for i in range(0, len(nodes), fan)], [i // fan for i in at]
    return nodes[0], paths


def plain_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    inner, out = {}, []
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        inner[s] = climb([leaf(r) for r in groups[s]])
    root, tops = climb([inner[s][0] for s in names])
    for s, top in zip(names, tops, strict=True):
        for r, path in zip(groups[s], inner[s][1], strict=True):
            other = r if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 or r[4] is None else (*r[:4], r[4].translate(LOW))
            h = leaf(other)
            for b, a in path + top:
                h = sha(b, h, a)
            out.append((r[0], leaf(r), inner[s][0], root, sha(*(b + a for b, a in path + top)), h, h == root))
    return sorted(out, key=repr)


def manifested(spark, rows):
    d = spark.createDataFrame([(*r, "clash", "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, digest string, pos string").repartition(5)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = manifest.manifest(d, tamper=F.crc32(F.col("doc_id").cast("string")) % 5 == 0, altered={"text": lower})
    return sorted(map(tuple, got.collect()), key=repr)


def test_manifest_against_plain_trees(spark):
    r = random.Random(2)
    sources = [None, "", "a", "B", "\u00e9t\u00e9", "\U0001f600", "\uffff"] + ["s%d" % i for i in range(30)]
    rows = [(i, r.choice(sources), r.choice(["en", None]), r.randint(0, 9), r.choice(["Text %d" % i, "low", None, "", "\u00dcber : A"])) for i in range(700)]
    rows += [(i, "hot", "en", 1, "H%d" % i) for i in range(1000, 1000 + 4096 + 17)] + [(9000, "lone", None, None, None), (None, "a", None, 3, "X"), (None, None, None, None, None)]
    rows += [rows[5], rows[5], (rows[5][0], rows[5][1], "en", 0, "other"), (9001, "s1", "en", 2, "Long " * 300_000)]
    got, want = manifested(spark, rows), plain_manifest(rows)
    assert got == want
    assert {x[6] for x in got} == {True, False}


def test_manifest_of_small_tables(spark):
    assert manifested(spark, []) == []
    one = (7, None, None, None, "A")
    assert manifested(spark, [one]) == plain_manifest([one])
    even = [(i, "s", "en", 1, "x") for i in range(256)]
    assert manifested(spark, even) == plain_manifest(even)


def test_levels_of_buckets():
    assert [manifest.levels_of(n) for n in (1, 2, 16, 17, 256, 257, 4096, 4097, 10**9)] == [0, 1, 1, 2, 2, 3, 3, 3, 3]


# --- clustering


def lloyd(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(256 * x) <= 1 << 27 for x in v)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(("2:%s" % r[0]).encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    v = np.array([x for _, x in kept], object)

    def nearest():
        d = np.array([((v - np.array(x, object)) ** 2).sum(1) for x in c], object).T
        return [min(range(len(c)), key=lambda j: (row[j], j)) for row in d], d

    for _ in range(rounds):
        own, _ = nearest()
        for j in range(len(c)):
            mine = [x for x, o in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(x[1][t] for x in mine) // len(mine) for t in range(64)]
    own, d = nearest()
    dist = [int(d[n][o]) for n, o in enumerate(own)]
    of = {j: sum(x for x, o in zip(dist, own, strict=True) if o == j) for j in set(own)}
    return sorted([(i, o, x, of[o], sum(dist), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for (i, _), o, x in zip(kept, own, dist, strict=True)], key=repr)


def clustered(spark, rows):
    d = spark.createDataFrame([(i, v, 5, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, v string").repartition(4)
    return sorted(map(tuple, clustering.cluster(d).collect()), key=repr)


def vectors(n, seed=1):
    r = np.random.default_rng(seed)
    mid = r.normal(size=(12, 64))
    return [(i, [float(np.float32(x)) for x in mid[i % 12] * 0.2 + r.normal(size=64) * 0.1]) for i in range(n)]


def test_clusters_against_plain_lloyd(spark):
    rows = vectors(400)
    bad = [(900, None), (901, [0.1] * 63), (902, [0.1] * 63 + [None]), (903, [0.1] * 63 + [float("nan")]), (904, [float("inf")] + [0.0] * 63), (905, []), (906, [1e30] * 64)]
    rows += bad + [rows[3], rows[3], (3, rows[4][1]), (None, rows[7][1]), (907, [0.0] * 64), (908, [1000.5] + [-700.25] * 63)]
    assert clustered(spark, rows) == lloyd(rows)


def test_clusters_of_equal_few_and_no_vectors(spark):
    same = [(i, [0.25] * 64) for i in range(90)] + [(i, [0.5] * 64) for i in range(90, 95)]
    assert clustered(spark, same) == lloyd(same)
    few = vectors(7)
    assert clustered(spark, few) == lloyd(few)
    assert clustered(spark, [(1, None)]) == []


def test_distances_beyond_doubles_are_exact():
    v = np.array([[1 << 27] * 64, [-(1 << 27)] * 64, [3] * 64], np.int64)
    c = np.array([[-(1 << 27)] * 64, [1] * 64], np.int64)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in v]
    assert clustering.distances(v, c).tolist() == want


def test_only_what_moved_is_compared():
    r = np.random.default_rng(4)
    v, c = r.integers(-99, 99, (500, 64)), r.integers(-99, 99, (20, 64))
    none = np.full(500, -1)
    own, d = clustering.assigned(v, none, np.zeros(500, np.int64), c, np.ones(20, bool))
    assert (own == clustering.distances(v, c).argmin(1)).all()
    moved = np.zeros(20, bool)
    moved[[3, 11]] = True
    fresh = c.copy()
    fresh[moved] += r.integers(-30, 30, (2, 64))
    again, far = clustering.assigned(v, own, d, fresh, moved)
    every = clustering.distances(v, fresh)
    assert (again == every.argmin(1)).all() and (far == every.min(1)).all()
