"""The pipeline and the pseudonyms, whole, against plain models in a loop."""

import collections
import datetime
import hashlib
import random
import re

import pytest

from tessera.llm import pii

from .test_llm import common

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = [(k, " ".join("b%d.%d" % (k, j) for j in range(n)).replace(".", "x")) for k, n in enumerate((30, 13, 5, 18))] + [(None, None), (9, "")]


def documents():
    r = random.Random(21)
    words = ["w%d" % i for i in range(600)] + ["Über", "ñandú", "A"]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    text = lambda n: "\n".join(line(r.randint(6, 14)) for _ in range(n))
    shared = [text(4), line(25), "\n".join(line(4) for _ in range(3))]
    base, out = [line(120) for _ in range(4)], [None, "", " \n", "too short", text(8)]
    out += [out[-1], "## $ " * 30 + line(40), line(8) + "\n" + (line(3) + "\n") * 1 + "same line here\n" * 9 + line(20), " ".join(["again and again it says the same old"] * 9)]
    out += [text(r.randint(1, 9)) for _ in range(40)]
    out += [text(2) + "\n" + r.choice(shared) + "\n" + text(r.randint(0, 3)) for _ in range(30)]
    for k in range(24):
        w = base[k % 4].split(" ")
        for _ in range(r.choice((0, 1, 2, 12))):
            w[r.randrange(120)] = "x%d" % r.randrange(10**6)
        out.append(" ".join(w + ["tail%d" % k]))
    out += [line(r.choice((5, 200, 700))) + " " + ITEMS[k % 4][1].upper() + " " + line(15) for k in range(16)]
    return [(3 * i, t, "en", "s%d" % (i % 5) if i % 11 else None, len(t or "")) for i, t in enumerate(out)]


def quality(docs):
    failed, soft = {}, {}
    for i, t, _, _, _ in docs:
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        at = collections.defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        n, rep = len(w), len({k + j for v in at.values() if len(v) > 1 for k in v for j in range(8)})
        chars = sum(map(len, w))
        failed[i] = n < 20 or 100 * rep > 30 * n
        soft[i] = (chars > 12 * n or chars < 2 * n) + (sum(t.count(c) for c in "#*$%&|<>") > 0.3 * n) + (len(lines) - len(set(lines)) > 0.3 * len(lines))
    of = collections.defaultdict(list)
    for i, _, _, s, _ in docs:
        of[s].append(failed[i] or soft[i] > 0)
    n, p = len(docs), sum(map(sum, of.values())) / len(docs)
    spread = sum(len(v) * (sum(v) / len(v) - p) ** 2 for v in of.values())
    between = (spread - (len(of) - 1) * p * (1 - p)) / (n - sum(len(v) ** 2 for v in of.values()) / n)
    m = p * (1 - p) / min(max(between, p * (1 - p) / 1e4), p * (1 - p) / 2) - 1
    most = {s: 1 if (sum(v) + p * m) / (len(v) + m) > 0.25 else 2 for s, v in of.items()}
    return [d for d in docs if not failed[d[0]] and soft[d[0]] < most[d[3]]]


def lines(docs):
    out, code, earlier = [], {}, []
    for i, t, lang, source, n in sorted(docs):
        live = [(k, x) for k, x in enumerate(t.split("\n")) if WORD.search(x)]
        mine = [code.setdefault(x.strip(), len(code)) for _, x in live]
        gone = {live[k][0] for b in earlier for k in common(mine, [len(WORD.findall(x)) for _, x in live], b)}
        earlier.append(mine)
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        if WORD.search(left):
            out.append((i, left, lang, source, len(left) if gone else n))
    return out


def near(docs):
    sets, top = {}, {d[0]: d[0] for d in docs}
    for i, t, *_ in docs:
        w = WORD.findall(t.translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    for _ in docs:
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    top[i] = top[j] = min(top[i], top[j])
        if all(top[top[i]] == top[i] for i in top):
            break
    return [d for d in docs if top[d[0]] == d[0]]


def benchmark(docs):
    windows = set()
    for _, t in ITEMS:
        w = ITEM_WORD.findall((t or "").translate(LOW))
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} - {()}
    sizes, out = {len(x) for x in windows}, []
    for d in docs:
        w = ITEM_WORD.findall(d[1].translate(LOW))
        hit = {k + j for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for j in range(n)}
        if not hit or 20 * len(hit) < len(w):
            out.append(d)
    return out


def mix(docs):
    size, of = {d[0]: len(WORD.findall(d[1])) for d in docs}, collections.defaultdict(list)
    for i, t, _, s, _ in docs:
        whole = "|".join(["20240", str(i), *([s] if s is not None else []), hashlib.md5(t.encode()).hexdigest()])
        of[s].append((int(hashlib.md5(whole.encode()).hexdigest()[:15], 16), i))
    names = sorted(of, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for _, i in of[s]) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        free = [s for s in names if s not in full]
        target = {s: 2.0 * total[s] if s in full else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        above = {s for s in free if target[s] > 2 * total[s]}
        if not above:
            break
        full |= above
    out = {}
    for s in names:
        words = int(target[s] + 1e-6)
        left = words % total[s]
        for _, i in sorted(of[s]):
            take = min(left, size[i])
            left -= take
            out[i] = (size[i], total[s], pytest.approx(target[s]), words // total[s] * size[i] + take)
    return {d[0]: (d[1], d[4], *out[d[0]]) for d in docs if out[d[0]][3] > 0}


def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline

    docs = documents()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), docs
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (quality, lines, near, benchmark, mix), strict=True):
        got, before, left = corpus_pipeline.materialize(stage(spark, got, str(tmp_path)), f"plain-{name}"), len(left), plain(left)
        assert len(left) < before or name == "mix"
        if name != "mix":
            assert sorted(map(tuple, got.select("doc_id", "text", "lang", "source", "n_chars").collect())) == sorted(left, key=lambda d: d[0]), name
    rows = lambda df: {r.doc_id: (r.text, r.n_chars, r["size"], r.source_size, r.target, r.taken) for r in df.collect()}
    assert rows(got) == left
    assert rows(corpus_pipeline.run(spark, str(tmp_path))) == left


def number(x, key, tweak, i):
    return int(hashlib.sha256(f"{key}|{tweak}|{i}|{x}".encode()).hexdigest()[:13], 16)


def feistel(left, right, a, b, key, tweak):
    for i in range(16):
        if i % 2 == 0:
            left = (left + number(right, key, tweak, i)) % a
        else:
            right = (right + number(left, key, tweak, i)) % b
    return left, right


def permuted(digits, key, kind):
    high = len(digits) - len(digits) // 2
    low = len(digits) - high
    x, y = feistel(int(digits[:high]), int(digits[high:]), 10**high, 10**low, key, f"{kind}{len(digits)}")
    return f"{x:0{high}d}{y:0{low}d}"


def put(template, digits):
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in template)


def check_digit(payload):
    return str(-sum(int(c) if k % 2 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(payload))) % 10)


def day_of(t):
    try:
        return datetime.date(*map(int, t.split("-"))) if "-" in t else datetime.date(*map(int, reversed(t.split("."))))
    except ValueError:
        return None


def mail(t, key):
    local, domain = t.split("@")
    kind = lambda c: "0" if c.isdigit() else "a" if c.islower() else "A"
    live = [c for c in local if c.isalnum()]
    form = "".join(kind(c) if c.isalnum() else c for c in local)
    room = [10 if c.isdigit() else 26 for c in live]
    halves = [[ord(c) - ord(kind(c)) for c in live[k::2]] for k in (0, 1)]
    for i in range(8):
        other = ",".join(map(str, halves[1 - i % 2]))
        stream = hashlib.sha512(f"{key}|email|{form}|{domain.lower()}|{i}|{other}".encode()).hexdigest()
        halves[i % 2] = [(v + int(stream[4 * (k % 32) : 4 * (k % 32) + 4], 16)) % room[2 * k + i % 2] for k, v in enumerate(halves[i % 2])]
    new = iter([chr(ord(kind(c)) + halves[k % 2][k // 2]) for k, c in enumerate(live)])
    return "".join(next(new) if c.isalnum() else c for c in local) + "@" + domain


#: Calling codes of two digits.
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def pseudonym(t, key):
    """(kind, pseudonym), or (None, t) for what fails validation."""
    digits = re.sub("[^0-9]", "", t)
    if "@" in t:
        return "email", mail(t, key)
    if t[0] == "+":
        n = 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGITS else 3
        return "phone", put(t, digits[:n] + permuted(digits[n:], key, "phone"))
    if re.fullmatch(r"\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4}", t):
        day = day_of(t)
        if not day:
            return None, t
        x = (day - datetime.date(1900, 1, 1)).days
        while True:
            a, b = feistel(x // 270, x % 270, 271, 270, key, "date")
            x = a * 270 + b
            if x < 73049:
                break
        day = datetime.date(1900, 1, 1) + datetime.timedelta(x)
        return "date", day.strftime("%Y-%m-%d" if "-" in t else "%d.%m.%Y")
    if re.fullmatch(r"\d+\.\d+\.\d+\.\d+", t):
        p = [int(x) for x in t.split(".")]
        if max(p) > 255:
            return None, t
        a, b = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, key, "ip")
        return "ip", f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if check_digit(digits[:-1]) != digits[-1]:
        return None, t
    payload = permuted(digits[:-1], key, "card")
    return "card", put(t, payload + check_digit(payload))


def test_pseudonyms_against_a_plain_model(spark):
    r = random.Random(4)
    made = []
    for k in range(60):
        pan = "".join(r.choice("0123456789") for _ in range(r.randint(12, 18)))
        pan += check_digit(pan) if k % 3 else "0"
        made.append(f"{'-'.join(re.findall('.{1,4}', pan))} {pan}, +{r.randint(1, 999)} ({r.randint(1, 9999)}) {r.randint(100, 9999)}-{r.randint(10, 9999)}; {r.randint(0, 299)}.{r.randint(0, 299)}.0.{r.randint(0, 9)}"
                    f" {r.randint(1900, 2099)}-{r.randint(1, 13):02d}-{r.randint(1, 31):02d}\n{r.randint(1, 31):02d}.{r.randint(1, 12):02d}.{r.randint(1900, 2099)} {r.choice(('a', 'J.d', 'Über.x', 'A_9+z%' * 30))}{k}@Mail{k % 5}.example.org.")  # fmt: skip
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-k - 1, t) for k, t in enumerate([*made, "\n".join(made) * 20, "", None])], "doc_id long, text string"))
    counts = collections.Counter()
    for x in pii.pseudonymise(docs, "a key").collect():
        found = [pseudonym(t, "a key") for t in re.findall(pii.ANY, x.text or "")]
        new = None if x.text is None else re.sub(pii.ANY, lambda m: pseudonym(m[0], "a key")[1], x.text)
        n = collections.Counter(k for k, _ in found)
        assert (x.new_text, *(x[f"n_{k}"] for k in pii.KINDS)) == (new, *(n[k] for k in pii.KINDS))
        counts += n
    assert min(counts[k] for k in (*pii.KINDS, None)) > 20


def test_a_number_in_two_spellings_gets_one_pseudonym(spark):
    same = [["+1 415 555 2671", "+14155552671", "+1 (415) 555-2671", "+1.415.555.2671"], ["+49 30 1234 5678", "+493012345678"], ["+354 555 1234", "+3545551234"]]
    d = spark.createDataFrame([(g, i, t) for g, ts in enumerate(same) for i, t in enumerate(ts)] + [(9, 0, "01.02.03.04"), (9, 1, "1.2.3.4")], "g int, i int, text string")
    got = {(r.g, r.i): (r.text, r.new_text, r.n_ip) for r in pii.pseudonymise(d, "k").collect()}
    for g, ts in enumerate(same):
        news = {re.sub("[^0-9]", "", got[g, i][1]) for i in range(len(ts))}
        assert len(news) == 1 and news != {re.sub("[^0-9]", "", ts[0])}
        assert all(re.sub("[0-9]", "0", got[g, i][1]) == re.sub("[0-9]", "0", t) for i, t in enumerate(ts))
    assert got[9, 0][1:] == ("01.02.03.04", 0) and got[9, 1][2] == 1
