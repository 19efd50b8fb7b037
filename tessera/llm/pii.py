"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Validated values are replaced by others of the same format under a key: card numbers (13 to 19 digits that pass the Luhn
test; the payload digits are permuted and the check digit follows), telephone numbers with a country code (the digits
after it), IPv4 addresses (as one 32-bit number) and dates (as a day between 1900 and 2099). The permutation is an
alternating Feistel network over Z_a x Z_b with SHA-256 as round function, walked until it falls inside the format; it is a
bijection, so equal values stay linked across documents and different values stay different. The local part of a mail address
keeps its format too, which characters are digits, small or capital letters and which are others: the letters and digits
are cut into two halves, and in each round those of one half are shifted within their classes by a keyed stream that the
other half picks. That is a Feistel network as well, so two addresses of a domain never become one.

What fails validation (a number that is no card, 999.1.1.1, 2023-02-30) stays as it is. Texts are read whole; rows without
a match are returned unchanged.

Defined cases: a null text stays null with no findings; an empty text stays empty; texts of any length are read whole; rows
that repeat give the same; empty tables give empty results. Columns of the input named like a result column are replaced,
any other names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import restored, shielded

ROUNDS = 8
KINDS = ["email", "phone", "date", "ip", "card"]
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
PHONE = r"\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
DATE = r"(?<![0-9.-])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3][0-9]\.[01][0-9]\.(?:19|20)[0-9]{2})(?![0-9-])"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
ANY = "|".join((EMAIL, PHONE, DATE, IP, CARD))
#: The calling codes of one and of two digits; all others have three.
CALLING = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98"
DAYS = 73049  # 1900-01-01 to 2099-12-31


def number(x: Column, key: str, tweak: Column, i: Column) -> Column:
    """The round function: 52 bits of SHA-256 as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), x.cast("string")), 256), 1, 13), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tweak: Column) -> Column:
    """A permutation of Z_a x Z_b: struct(l, r)."""

    def turn(acc: Column, i: Column) -> Column:
        even = F.struct(F.pmod(acc["l"] + number(acc["r"], key, tweak, i), a).alias("l"), acc["r"].alias("r"))
        odd = F.struct(acc["l"].alias("l"), F.pmod(acc["r"] + number(acc["l"], key, tweak, i), b).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """Digits of the same length (2 to 18), permuted among those of that length."""
    n = F.length(digits)
    low = F.floor(n / 2).cast("int")
    high = n - low
    a, b = F.pow(F.lit(10.0), high).cast("long"), F.pow(F.lit(10.0), low).cast("long")
    got = feistel(F.substr(digits, F.lit(1), high).cast("long"), F.substr(digits, high + 1, low).cast("long"), a, b, key, F.concat(F.lit(kind), n.cast("string")))
    return F.transform(F.array(got), lambda x: F.concat(F.lpad(x["l"].cast("string"), high, F.lit("0")), F.lpad(x["r"].cast("string"), low, F.lit("0"))))[0]


def into(template: Column, digits: Column) -> Column:
    """template with its digits, in order, replaced by those of digits."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))

    def put(acc: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(acc["s"], F.when(is_digit, F.substr(digits, acc["i"], F.lit(1))).otherwise(c)).alias("s"), (acc["i"] + is_digit.cast("int")).alias("i"))

    return F.aggregate(F.split(template, ""), start, put)["s"]


def digits_of(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """The Luhn sum; doubled_last: whether the last digit counts twice (as it does before its check digit)."""
    parity = 0 if doubled_last else 1

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == parity, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def card(t: Column, key: str) -> Column:
    d = digits_of(t)
    payload = permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
    return F.transform(F.array(payload), lambda p: into(t, F.concat(p, F.pmod(10 - luhn_sum(p, True) % 10, F.lit(10)).cast("string"))))[0]


def phone(t: Column, key: str) -> Column:
    """The digits behind the calling code are permuted, whatever stands between them, so that one number in two spellings
    gets one pseudonym in two spellings."""
    digits = digits_of(t)
    code = F.regexp_extract(digits, f"^(?:{CALLING}|[0-9]{{3}})", 0)
    return into(t, F.concat(code, permuted_digits(F.substr(digits, F.length(code) + 1, F.length(digits)), key, "phone")))


def ip(t: Column, key: str) -> Column:
    p = F.transform(F.split(t, r"\."), lambda x: x.cast("long"))
    got = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))
    return F.transform(F.array(got), lambda x: F.concat_ws(".", F.floor(x["l"] / 256), x["l"] % 256, F.floor(x["r"] / 256), x["r"] % 256))[0]


def date(t: Column, key: str) -> Column:
    iso = t.rlike("^[0-9]{4}")
    day = F.datediff(parsed_date(t), F.lit("1900-01-01").cast("date")).cast("long")
    a, b = 271, 270  # 73170 pairs; a walk leaves the 121 outside at once in all but 1 of 600 steps

    def walk(acc: Column, _: Column) -> Column:
        x = feistel(F.floor(acc / b), acc % b, F.lit(a), F.lit(b), key, F.lit("date"))
        step = F.transform(F.array(x), lambda y: y["l"] * b + y["r"])[0]
        return F.when((acc >= 0) & (acc < DAYS), acc).otherwise(step)

    first = feistel(F.floor(day / b), day % b, F.lit(a), F.lit(b), key, F.lit("date"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.transform(F.array(first), lambda y: y["l"] * b + y["r"])[0], walk)
    shown = F.transform(F.array(F.date_add(F.lit("1900-01-01").cast("date"), found.cast("int"))), lambda d: F.when(iso, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "dd.MM.yyyy")))
    return shown[0]


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def email(t: Column, key: str) -> Column:
    """The address with another local part of the same format, by a Feistel network over its letters and digits."""
    local = F.regexp_extract(t, "^([^@]*)@", 1)
    form = F.regexp_replace(F.regexp_replace(F.regexp_replace(local, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    tweak = F.concat_ws("|", F.lit(key), F.lit("email"), form, F.lower(F.substr(t, F.length(local) + 2, F.length(t))))
    base = lambda c: F.when(c.rlike("^[0-9]$"), 48).when(c.rlike("^[a-z]$"), 97).otherwise(65)
    room = lambda c: F.when(c.rlike("^[0-9]$"), 10).otherwise(26)

    def half(odd: int) -> Column:
        """(value, room) of every second letter or digit."""
        live = F.filter(F.split(local, ""), lambda c: c.rlike("^[0-9A-Za-z]$"))
        return F.transform(F.filter(live, lambda c, i: i % 2 == odd), lambda c: F.struct((F.ascii(c) - base(c)).alias("v"), room(c).alias("n")))

    def turn(acc: Column, i: Column) -> Column:
        def shifted(own: Column, other: Column) -> Column:
            stream = F.sha2(F.concat_ws("|", tweak, i.cast("string"), F.array_join(F.transform(other, lambda x: x["v"].cast("string")), ",")), 512)
            by = lambda d, k: F.conv(F.substr(d, 4 * (k % 32) + 1, F.lit(4)), 16, 10).cast("int")
            return let(stream, lambda d: F.transform(own, lambda x, k: F.struct(F.pmod(x["v"] + by(d, k), x["n"]).alias("v"), x["n"].alias("n"))))

        return F.when(i % 2 == 0, F.struct(shifted(acc["l"], acc["r"]).alias("l"), acc["r"].alias("r"))).otherwise(F.struct(acc["l"].alias("l"), shifted(acc["r"], acc["l"]).alias("r")))

    got = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(half(0).alias("l"), half(1).alias("r")), turn)
    blank = F.struct(F.lit("").alias("s"), F.lit(0).alias("i"))

    def put(new: Column):
        def one(acc: Column, c: Column) -> Column:
            side = F.when(acc["i"] % 2 == 0, new["l"]).otherwise(new["r"])
            v = F.get(side, F.floor(acc["i"] / 2).cast("int"))["v"]
            live = c.rlike("^[0-9A-Za-z]$")
            return F.struct(F.concat(acc["s"], F.when(live, F.chr(base(c) + v)).otherwise(c)).alias("s"), (acc["i"] + live.cast("int")).alias("i"))

        return F.aggregate(F.split(local, ""), blank, one)["s"]

    return F.concat(let(got, put), F.substr(t, F.length(local) + 1, F.length(t)))


def parsed_date(t: Column) -> Column:
    return F.coalesce(F.try_to_date(t, "yyyy-MM-dd"), F.try_to_date(t, "dd.MM.yyyy"))


def kind_of(t: Column) -> Column:
    """One of KINDS for a validated value, else null."""
    return (
        F.when(t.contains("@"), F.lit("email"))
        .when(t.startswith("+"), F.lit("phone"))
        .when(t.rlike("^" + DATE + "$"), F.when(parsed_date(t).isNotNull(), F.lit("date")))
        .when(t.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), F.when(F.forall(F.split(t, r"\."), lambda x: (x.cast("int") < 256) & (x == x.cast("int").cast("string"))), F.lit("ip")))
        .otherwise(F.when(luhn_sum(digits_of(t), False) % 10 == 0, F.lit("card")))
    )


def pseudonym(t: Column, kind: Column, key: str) -> Column:
    out = F.when(kind == "email", email(t, key)).when(kind == "phone", phone(t, key)).when(kind == "date", date(t, key))
    return F.coalesce(out.when(kind == "ip", ip(t, key)).when(kind == "card", card(t, key)), t)


def is_kind(kind: str):
    return lambda x: x == kind


ADDED = [*(f"n_{k}" for k in KINDS), "new_text"]


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with n_<kind> of each kind and new_text. The key is the caller's secret."""
    out, (t,) = shielded(docs, text_col)
    out = out.withColumn("_found", F.regexp_extract_all(F.col(t), F.lit(ANY), F.lit(0)))
    out = out.withColumn("_as", F.transform("_found", lambda x: F.struct(x.alias("t"), kind_of(x).alias("k"))))
    out = out.withColumn("_kinds", F.col("_as.k"))
    new = F.transform("_as", lambda x: pseudonym(x["t"], x["k"], key))
    between = F.split(F.col(t), ANY)
    joined = F.array_join(F.zip_with(between, F.concat(new, F.array(F.lit(""))), lambda b, n: F.concat(b, n)), "")
    out = out.withColumn("new_text", F.when(F.size("_found") > 0, joined).otherwise(F.col(t)))
    for k in KINDS:
        out = out.withColumn(f"n_{k}", F.coalesce(F.size(F.filter("_kinds", is_kind(k))).cast("long"), F.lit(0).cast("long")))
    return restored(out, docs, ADDED)
