"""Format-preserving pseudonyms for personal data, with Spark SQL functions only.

Candidates are found by pattern, then validated (checksums, ranges, calendar).
A valid value is permuted inside its own format by a keyed Feistel network, so
equal values get equal pseudonyms in every document, different values differ,
and the result passes the same validation:

==========  =============================================  =======================================
kind        validated by                                   permuted
==========  =============================================  =======================================
card        13 to 19 digits, Luhn                          all digits but the first; Luhn digit anew
phone       NANP area and exchange not starting 0 or 1     area, exchange and line
ipv4        four octets to 255 without leading zeros       the 32 bits
ssn         area not 000, 666, 9xx; group, serial not 0    area, group, serial
date        calendar day of 1900 to 2099                   the day
iban        mod 97                                         letters and digits of the account
email       syntax                                         letters and digits of the local part
==========  =============================================  =======================================

Separators, brackets and everything else stay. A number is a pair (x, y) below
moduli (a, b); rounds alternate x += F(y) mod a and y += F(x) mod b, with F
from SHA-256 of key, kind, round and the other half. Any such network is a
bijection of the a*b values. Strings take the same form, with one shift for
each character inside its class (digits, capitals, small letters).

Dates are read as yyyy-mm-dd (also before a time), mm/dd/yyyy or dd.mm.yyyy. A value that fails its
validation is left alone. Null texts stay null, empty ones empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: Countries by the length of their account numbers, which a following word of four capitals doesn't lengthen.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
_IBAN_OWN = "|".join(rf"(?:{names.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9_])" for n, names in _IBAN_LENGTHS.items())

#: Longest formats first where one may start inside another; all are tried at each place in this order.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": rf"(?<![A-Za-z0-9_])(?:{_IBAN_OWN}|[A-Z]{{2}}[0-9]{{2}}(?:(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?|[A-Z0-9]{{11,30}}))(?![A-Za-z0-9_])",
    "phone": r"(?<![A-Za-z0-9_+.-])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9_])",
    "ssn": r"(?<![A-Za-z0-9_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_-])",
    "card": r"(?<![A-Za-z0-9_.-])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![A-Za-z0-9_])",
    "ipv4": r"(?<![A-Za-z0-9_.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9_]|\.[0-9])",
    "date": r"(?<![A-Za-z0-9_/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?!(?!T[0-9]{2}:[0-9]{2})[A-Za-z0-9_/-]|\.[0-9])",
}
#: 1900-01-01 to 2099-12-31 are 17 * 4297 days.
_FIRST_DAY, _DAYS = "1900-01-01", (17, 4297)


def _prf(key: str, kind: str, turn: Column, half: Column) -> Column:
    """60 bits of SHA-256, as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn, half), 256), 1, 15), 16, 10).cast("long")


def _turns() -> Column:
    return F.array(*[F.lit(i) for i in range(ROUNDS)])


def permute_pair(x: Column, y: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """A keyed bijection of [0, a) x [0, b): a struct (x, y) of longs."""

    def turn(s: Column, i: Column) -> Column:
        left = i % 2 == 0
        shift = _prf(key, kind, i, F.when(left, s["y"]).otherwise(s["x"]))
        return F.struct(F.when(left, (s["x"] + shift % a) % a).otherwise(s["x"]).alias("x"), F.when(left, s["y"]).otherwise((s["y"] + shift % b) % b).alias("y"))

    return F.aggregate(_turns(), F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), turn)


def permute_text(text: Column, key: str, kind: str) -> Column:
    """A keyed bijection of the texts of the same character classes, up to 64 characters."""

    def shifted(half: Column, other: Column, i: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i, other), 256)

        def one(c: Column, at: Column) -> Column:
            k = F.conv(F.substring(stream, at * 2 + 1, F.lit(2)), 16, 10).cast("int")
            code = F.ascii(c)
            moved = F.lit(None).cast("string")
            for low, size in ((48, 10), (65, 26), (97, 26)):
                moved = F.when(code.between(low, low + size - 1), F.char(F.lit(low) + (code - low + k) % size)).otherwise(moved)
            return F.coalesce(moved, c)

        return F.array_join(F.transform(F.split(half, ""), one), "")

    def turn(s: Column, i: Column) -> Column:
        left = i % 2 == 0
        return F.struct(F.when(left, shifted(s["x"], s["y"], i)).otherwise(s["x"]).alias("x"), F.when(left, s["y"]).otherwise(shifted(s["y"], s["x"], i)).alias("y"))

    cut = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), cut).alias("x"), F.substring(text, cut + 1, F.length(text)).alias("y"))
    return F.aggregate(_turns(), start, turn, lambda s: F.concat(s["x"], s["y"]))


def _pad(value: Column, width: int | Column) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def _relaid(original: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of ``original``."""

    def put(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), F.when(digit, s["at"] + 1).otherwise(s["at"]).alias("at"))

    return F.aggregate(F.split(original, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), put, lambda s: s["out"])


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string, modulo 10."""

    def one(c: Column, at: Column) -> Column:
        d = c.cast("int")
        return F.when(at % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda s, d: s + d) % 10


def _mod97(text: Column) -> Column:
    def add(r: Column, c: Column) -> Column:
        letter = c.between("A", "Z")
        return F.when(letter, (r * 100 + F.ascii(c) - 55) % 97).otherwise((r * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    size = F.length(digits) - 2  # permuted: neither the first nor the check digit
    half = F.floor(size / 2).cast("int")
    moved = permute_pair(F.substring(digits, F.lit(2), half).cast("long"), F.substring(digits, half + 2, size - half).cast("long"), F.pow(F.lit(10), half).cast("long"), F.pow(F.lit(10), size - half).cast("long"), key, "card")
    body = F.concat(F.substring(digits, 1, 1), _pad(moved["x"], half), _pad(moved["y"], size - half))
    whole = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))
    return F.when(_luhn(digits) == 0, _relaid(m, whole))


def _phone(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    prefix = F.substring(digits, F.lit(1), F.length(digits) - 10)
    n = F.substring(digits, F.length(digits) - 9, F.lit(10))
    moved = permute_pair(F.substring(n, 1, 3).cast("long") - 200, F.substring(n, 4, 7).cast("long") - 2_000_000, F.lit(800), F.lit(8_000_000), key, "phone")
    return F.when(n.rlike("^[2-9][0-9]{2}[2-9]"), _relaid(m, F.concat(prefix, moved["x"] + 200, moved["y"] + 2_000_000)))


def _ipv4(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda c: c.cast("long"))
    moved = permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ipv4")
    octets = [f(moved[c]) for c in "xy" for f in (lambda v: F.floor(v / 256).cast("int"), lambda v: v % 256)]
    return F.when(F.forall(o, lambda v: v < 256) & ~m.rlike(r"(^|\.)0[0-9]"), F.concat_ws(".", *octets))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.split(m, "-")[i].cast("long") for i in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    moved = permute_pair(area - 1 - (area > 666).cast("int"), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
    rest = moved["y"]
    return F.when(valid, F.concat_ws("-", _pad(moved["x"] + 1 + (moved["x"] >= 665).cast("int"), 3), _pad(F.floor(rest / 9999) + 1, 2), _pad(rest % 9999 + 1, 4)))


def _date(m: Column, key: str) -> Column:
    out = F.lit(None).cast("string")
    for form, shape in (("yyyy-MM-dd", r"^[0-9]{4}-"), ("MM/dd/yyyy", r"/"), ("dd.MM.yyyy", r"\.")):
        day = F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit(_FIRST_DAY).cast("date"))
        moved = permute_pair(F.floor(day / _DAYS[1]), day % _DAYS[1], F.lit(_DAYS[0]), F.lit(_DAYS[1]), key, "date")
        days = (moved["x"] * _DAYS[1] + moved["y"]).cast("int")
        out = F.when(m.rlike(shape), F.when(day.between(0, _DAYS[0] * _DAYS[1] - 1), F.date_format(F.date_add(F.lit(_FIRST_DAY).cast("date"), days), form))).otherwise(out)
    return out


def _iban(m: Column, key: str) -> Column:
    plain = F.regexp_replace(m, " ", "")
    country, account = F.substring(plain, 1, 2), F.substring(plain, 5, 64)
    moved = permute_text(account, key, "iban")
    check = _pad(98 - _mod97(F.concat(moved, country, F.lit("00"))), 2)
    whole = F.concat(country, check, moved)
    spaced = F.rtrim(F.regexp_replace(whole, "(.{4})", "$1 "))
    return F.when((_mod97(F.concat(account, F.substring(plain, 1, 4))) == 1) & F.length(plain).between(15, 34), F.when(m.contains(" "), spaced).otherwise(whole))


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return F.concat(permute_text(F.substring(m, F.lit(1), at - 1), key, "email"), F.substring(m, at, F.length(m)))


_PERMUTE = {"email": _email, "iban": _iban, "phone": _phone, "ssn": _ssn, "card": _card, "ipv4": _ipv4, "date": _date}


def pseudonym(match: Column, key: str) -> Column:
    """The pseudonym of one candidate, or null if it isn't valid for the first pattern that it fits."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(match.rlike(f"^{pattern}$"), _PERMUTE[kind](match, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, *, text: str = "text", count: str = "n_replaced") -> DataFrame:
    """Replaces ``text``; adds the number of replaced values, instead of any column of that name.

    Row by row inside the scan: no shuffle, no Python.
    """
    pattern = "|".join(PATTERNS.values())
    columns = [c for c in docs.columns if c != count or c == text]
    found = docs.select(*[F.col(f"`{c}`") for c in columns], F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(F.col(text), F.lit(pattern), 0)).alias("__found"))
    moved = found.withColumn("__moved", F.transform("__found", lambda m: pseudonym(m, key)))
    gaps = F.split(F.col(text), pattern, -1)
    filled = F.zip_with("__found", "__moved", lambda m, p: F.coalesce(p, m))
    whole = F.array_join(F.zip_with(gaps, filled, lambda g, p: F.concat(g, F.coalesce(p, F.lit("")))), "")
    changed = F.size("__found") > 0
    n = F.when(changed, F.size(F.filter("__moved", lambda p: p.isNotNull()))).otherwise(0)
    return moved.select(*[F.when(changed, whole).otherwise(F.col(text)).alias(text) if c == text else F.col(f"`{c}`") for c in columns], n.alias(count))
