"""Personal data: format-preserving pseudonyms, in SQL expressions only.

One regular expression finds candidates in text order. Each is validated (check digit,
octets, calendar, area numbers) and, if valid, permuted within its own format by a
keyed Feistel network, so equal values become equal pseudonyms in every
document and different values stay different. Text around candidates, and
candidates that fail validation, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import temp_name

KINDS = ["email", "phone", "card", "ssn", "ip", "date", "secret"]
ROUNDS = 10
WALKS = 24  # steps of cycle walking; each leaves at most an eighth outside the format
FIRST_DAY, DAYS = "1900-01-01", 73049  # to 2099-12-31
DAY_SIDES = (271, 270)  # the smallest near-square rectangle that holds DAYS

# in order: the first that fits at a place is taken; long digit runs are eaten whole, so that no part of one is taken for a number
# an address starts where its run of signs does, or behind the last match; a domain has 253 signs at most. So every
# sign is looked at a bounded number of times, and no group repeats, which would take one stack frame a turn.
_LOCAL = r"[A-Za-z0-9._%+\-]"
EMAIL = rf"(?:(?<!{_LOCAL}){_LOCAL}++|\G{_LOCAL}{{1,64}}+)@[A-Za-z0-9\-][A-Za-z0-9.\-]{{0,188}}\.[A-Za-z]{{2,63}}"
SECRET = r"[0-9A-Fa-f]{32,}"
PHONE = r"\+[0-9]{1,3}[ .\-]?\(?[0-9]{2,4}\)?[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}[0-9]*"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[0-9]*|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}[0-9]*"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}[0-9]*"
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}[0-9]*"
CARD = r"[0-9]{4}([ \-])[0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}[0-9]*"
CANDIDATE = "|".join([EMAIL, SECRET, PHONE, DATE, SSN, IP, CARD.replace("([ \\-])", "[ \\-]"), "[0-9]+"])


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn_sum(digits: Column, even: int) -> Column:
    """Digit sum in which every second digit, those at positions ``even`` from the right, counts doubled."""
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = 2 * d
        return total + F.when(i % 2 == even, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def feistel(x: Column, y: Column, a: Column, b: Column, tweak: Column) -> Column:
    """A keyed permutation of the pairs (x, y), x below a and y below b: struct(x, y).

    Each round adds a keyed hash of one half to the other, modulo its size.
    """
    def step(s: Column, r: Column) -> Column:
        seen = F.when(r % 2 == 0, s["y"]).otherwise(s["x"])
        noise = F.conv(F.substring(F.sha2(F.concat_ws("|", tweak, r, seen), 256), 1, 15), 16, 10).cast("long")
        return F.struct(
            F.when(r % 2 == 0, F.pmod(s["x"] + noise, a)).otherwise(s["x"]).alias("x"),
            F.when(r % 2 == 1, F.pmod(s["y"] + noise, b)).otherwise(s["y"]).alias("y"),
        )

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permute_digits(digits: Column, tweak: Column) -> Column:
    """Digits of the same number, two to nineteen, permuted among all strings of that length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    side = lambda k: F.pow(F.lit(10.0), k).cast("long")
    out = feistel(
        F.substr(digits, F.lit(1), u).cast("long"), F.substr(digits, u + 1, n - u).cast("long"),
        side(u), side(n - u), F.concat_ws("|", tweak, n),
    )
    return _spread(out, lambda s: F.concat(F.lpad(s["x"].cast("string"), u, "0"), F.lpad(s["y"].cast("string"), n - u, "0")))


def _spread(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a lambda's argument stands for it."""
    return F.transform(F.array(value), use)[0]


def weave(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    def put(i: Column) -> Column:
        c = F.substr(shape, i, F.lit(1))
        rank = F.length(_digits(F.substr(shape, F.lit(1), i)))
        return F.when(c.rlike("[0-9]"), F.substr(digits, rank, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), put), "")


def _walk(start: Column, step, inside) -> Column:
    """``step`` once, and again while the result is not ``inside``: cycle walking."""
    def once(s: Column, i: Column) -> Column:
        return F.when((i > 0) & inside(s), s).otherwise(step(s))

    return F.aggregate(F.sequence(F.lit(0), F.lit(WALKS)), start, once)


def _ssn_ok(d: Column) -> Column:
    area = F.substring(d, 1, 3)
    return (
        (area != "000") & (area != "666") & (area < "900")
        & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")
    )


def _ssn(d: Column, key: Column) -> Column:
    return _walk(d, lambda s: permute_digits(s, F.concat_ws("|", key, F.lit("ssn"))), _ssn_ok)


def _card(d: Column, key: Column) -> Column:
    body = permute_digits(F.substr(d, F.lit(1), F.length(d) - 1), F.concat_ws("|", key, F.lit("card")))
    return _spread(body, lambda p: F.concat(p, F.pmod(-luhn_sum(p, 0), F.lit(10)).cast("string")))


def _ip(m: Column, key: Column) -> Column:
    part = lambda i: F.split(m, r"\.")[i].cast("long")
    side = F.lit(65536).cast("long")
    out = feistel(part(0) * 256 + part(1), part(2) * 256 + part(3), side, side, F.concat_ws("|", key, F.lit("ip")))
    low, high = (lambda v: F.pmod(v, F.lit(256))), (lambda v: F.floor(v / 256))
    return _spread(out, lambda s: F.concat_ws(".", high(s["x"]), low(s["x"]), high(s["y"]), low(s["y"])))


def _day(m: Column) -> Column:
    """The calendar date a match names, or null: year-month-day, else day, month, year."""
    iso = F.when(m.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), m).when(
        m.rlike(r"^[0-9]{2}([/.])[0-9]{2}\1[0-9]{4}$"),
        F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)),
    )
    day = F.try_to_date(iso, "yyyy-MM-dd")
    return F.datediff(day, F.lit(FIRST_DAY).cast("date"))


def _date(m: Column, key: Column) -> Column:
    a, b = (F.lit(v).cast("long") for v in DAY_SIDES)

    def step(n: Column) -> Column:
        out = feistel(F.floor(n / b), F.pmod(n, b), a, b, F.concat_ws("|", key, F.lit("date")))
        return _spread(out, lambda s: s["x"] * b + s["y"])

    days = _walk(_day(m).cast("long"), step, lambda n: n < DAYS)
    day = _spread(days, lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int")))
    iso = F.date_format(day, "yyyy-MM-dd")
    mark = F.substring(m, 3, 1)
    european = F.concat(F.date_format(day, "dd"), mark, F.date_format(day, "MM"), mark, F.date_format(day, "yyyy"))
    return F.when(m.rlike("^[0-9]{4}-"), iso).otherwise(european)


def kind_of(m: Column) -> Column:
    """The kind of a candidate that passes validation, else null."""
    d = _digits(m)
    octets = F.forall(F.split(m, r"\."), lambda o: (F.length(o) <= 3) & (o.cast("int") <= 255))
    grouped = m.rlike("^" + CARD.replace("[ \\-][0-9]{4}[ \\-]", "\\1[0-9]{4}\\1").replace("[0-9]*", "") + "$")
    plain = m.rlike("^[0-9]{13,19}$")
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike("^[0-9A-Fa-f]{32,}$") & m.rlike("[0-9]") & m.rlike("[A-Fa-f]"), "secret")
        .when(m.startswith("+"), F.when(F.length(d).between(8, 15), "phone"))
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(_ssn_ok(d), "ssn"))
        .when(m.rlike(r"^[0-9]+(\.[0-9]+){3}$"), F.when(octets, "ip"))
        .when(plain | grouped, F.when(luhn_sum(d, 1) % 10 == 0, "card"))
        .when(_day(m).between(0, DAYS - 1), "date")
    )


def pseudonym(m: Column, kind: Column, key: Column) -> Column:
    """The replacement of a candidate; one without a kind is returned as it is."""
    tag = lambda name, value: F.sha2(F.concat_ws("|", key, F.lit(name), value), 256)
    d = _digits(m)
    hexes = F.substr(F.repeat(tag("secret", m), F.ceil(F.length(m) / 64).cast("int")), F.lit(1), F.length(m))
    phone = F.concat(F.substring(d, 1, 1), permute_digits(F.substr(d, F.lit(2), F.length(d) - 1), F.concat_ws("|", key, F.lit("phone"))))
    return (
        F.when(kind == "email", F.concat(F.lit("u"), F.substring(tag("email", F.lower(m)), 1, 16), F.lit("@mail.invalid")))
        .when(kind == "secret", hexes)
        .when(kind == "phone", weave(m, phone))
        .when(kind == "card", weave(m, _card(d, key)))
        .when(kind == "ssn", weave(m, _ssn(d, key)))
        .when(kind == "ip", _ip(m, key))
        .when(kind == "date", _date(m, key))
        .otherwise(m)
    )


def masked(text: Column, key: str) -> tuple[Column, Column]:
    """(found, text): the list of (raw, kind) candidates, and a function of it that rebuilds the text."""
    found = F.transform(
        F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda m: F.struct(m.alias("raw"), kind_of(m).alias("kind"))
    )

    def rebuilt(found: Column) -> Column:
        between = F.split(text, CANDIDATE, -1)
        new = F.transform(found, lambda f: pseudonym(f["raw"], f["kind"], F.lit(key)))
        pairs = F.zip_with(between, new, lambda t, p: F.concat(t, F.coalesce(p, F.lit(""))))
        return F.when(F.exists(found, lambda f: f["kind"].isNotNull()), F.array_join(pairs, "")).otherwise(text)

    return found, rebuilt


def pseudonymise(docs: DataFrame, text: str = "text", key: str = "training data key", counts: str = "") -> DataFrame:
    """``docs`` with pseudonyms in the text column; all other columns stay.

    ``key`` is the secret of the permutations. E-mail addresses, ``+`` phone numbers (the
    first digit stays), card numbers with a right check digit, social security
    numbers with a possible area, IPv4 addresses, calendar dates from 1900 to 2099 and hexadecimal
    secrets of 32 signs or more are replaced; cards keep a right check digit, dates
    stay dates, separators stay. With ``counts`` given, a column of this name maps each
    kind to its number in the row.

    A null text stays null, an empty one empty, and a text without a finding is
    returned unchanged, byte for byte. Repeated rows change alike, null values in other
    columns and empty tables pass, and the text is searched whole.
    """
    name = temp_name(docs, "found")
    found, rebuilt = masked(F.col(text), key)
    marked = docs.withColumn(name, found)
    out = marked.withColumn(text, rebuilt(F.col(name)))
    if counts:
        number = lambda k: F.size(F.filter(F.col(name), lambda f: f["kind"] == k))
        out = out.withColumn(counts, F.when(F.col(name).isNotNull(), F.struct(*[number(k).alias(k) for k in KINDS])))
    return out.drop(name)
