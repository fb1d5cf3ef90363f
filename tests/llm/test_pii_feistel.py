import hashlib
import re

from pyspark.sql import functions as F

from logstrata.llm import pii_feistel as pii

KEY = "k"


def prf(kind, turn, half):
    return int(hashlib.sha256(f"{KEY}|{kind}|{turn}|{half}".encode()).hexdigest()[:15], 16)


def pair(x, y, a, b, kind):
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            x = (x + prf(kind, i, y)) % a
        else:
            y = (y + prf(kind, i, x)) % b
    return x, y


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10


def card(digits):
    n = len(digits) - 2
    h = n // 2
    x, y = pair(int(digits[1 : 1 + h]), int(digits[1 + h : 1 + n]), 10**h, 10 ** (n - h), "card")
    body = f"{digits[0]}{x:0{h}d}{y:0{n - h}d}"
    return body + str(-luhn(body + "0") % 10)


def replaced(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in pii.pseudonymise(df, KEY, **options).orderBy("doc_id").collect()]


def test_cards_equal_plain_python(spark):
    cards = ["4539578763621486", "4111111111111111", "378282246310005", "4222222222222", "6011000990139424"]
    got = replaced(spark, cards)
    assert [r.text for r in got] == [card(c) for c in cards]
    assert all(luhn(r.text) == 0 and r.n_replaced == 1 for r in got)


def test_addresses_and_phones_equal_plain_python(spark):
    a, b = replaced(spark, ["ip 192.0.2.255.", "+1 (583) 555-6359, 583-555-6359"])
    x, y = pair(192 * 256, 2 * 256 + 255, 65536, 65536, "ipv4")
    assert a.text == f"ip {x // 256}.{x % 256}.{y // 256}.{y % 256}."
    x, y = pair(583 - 200, 5556359 - 2_000_000, 800, 8_000_000, "phone")
    area, rest = x + 200, str(y + 2_000_000)
    assert b.text == f"+1 ({area}) {rest[:3]}-{rest[3:]}, {area}-{rest[:3]}-{rest[3:]}"


def test_formats_hold_and_values_stay_linked(spark):
    texts = [
        "card 4539 5787 6362 1486 and 4539-5787-6362-1486 and 4539578763621486", "born 2020-02-29, 02/29/2020 or 29.02.2020", "ssn 123-45-6789", "iban GB82 WEST 1234 5698 7654 32 or GB82WEST12345698765432", "mail Ann.b-1@mail.example.com!", "again 4539578763621486 from Ann.b-1@mail.example.com",
    ]
    out = [r.text for r in replaced(spark, texts)]
    numbers = re.findall(r"\d[\d -]+\d", out[0])
    assert len({re.sub(r"\D", "", n) for n in numbers}) == 1
    assert [re.sub(r"\d", "9", n) for n in numbers] == [re.sub(r"\d", "9", n) for n in re.findall(r"\d[\d -]+\d", texts[0])]
    y, m, d = re.search(r"(\d{4})-(\d\d)-(\d\d)", out[1]).groups()
    assert f"{m}/{d}/{y} or {d}.{m}.{y}" in out[1]
    assert re.fullmatch(r"ssn \d{3}-\d\d-\d{4}", out[2])
    one, two = re.fullmatch(r"iban (GB[A-Z0-9 ]+) or (GB[A-Z0-9]+)", out[3]).groups()
    assert one.replace(" ", "") == two
    assert int("".join(str(int(c, 36)) for c in two[4:] + two[:4])) % 97 == 1
    assert re.fullmatch(r"mail [A-Z][a-z]{2}\.[a-z]-\d@mail\.example\.com!", out[4])
    assert out[4][5:-1] in out[5]
    assert re.sub(r"\D", "", numbers[0]) in out[5]
    assert all(a != b for a, b in zip(texts, out, strict=True))


def test_what_is_not_valid_stays(spark):
    texts = [
        "4539578763621487", "0.4539578763621486", "x4539578763621486", "256.1.1.1 1.2.3 01.2.3.4 1.2.3.4.5", "000-12-1234 666-12-1234 900-12-1234 123-00-1234 123-45-0000", "2021-02-29 13/01/2020 1899-12-31 2100-01-01", "GB83 WEST 1234 5698 7654 32", "+1 (017) 555-7713 (183) 555-1111 583-155-1111",
        'token = "df9d3077bffb4cab44ba5549eeb93e1508834a91" v3.0', "no numbers", "a@b", "", "1" * 5000,
    ]
    for text, r in zip(texts, replaced(spark, texts), strict=True):
        assert (r.text, r.n_replaced) == (text, 0)


def test_nulls_long_texts_clashes_and_empty_tables(spark):
    long = "word 4539578763621486 " * 20_000
    got = replaced(spark, [None, "", long, long])
    assert (got[0].text, got[0].n_replaced) == (None, 0)
    assert got[2].n_replaced == 20_000
    assert got[2].text == got[3].text == long.replace("4539578763621486", card("4539578763621486"))
    df = spark.createDataFrame([(1, "192.0.2.1", "x", 3)], "doc_id long, text string, n_replaced string, `a b` int")
    out = pii.pseudonymise(df, KEY)
    assert out.columns == ["doc_id", "text", "a b", "n_replaced"]
    assert out.first().n_replaced == 1
    assert pii.pseudonymise(df.limit(0), KEY).count() == 0


def test_permutations_are_bijections(spark):
    n = spark.range(17 * 41).select((F.col("id") % 17).alias("x"), F.floor(F.col("id") / 17).alias("y"))
    assert n.select(pii.permute_pair(F.col("x"), F.col("y"), F.lit(17), F.lit(41), KEY, "t")).distinct().count() == 17 * 41
    words = spark.range(676).select(F.concat(F.char(97 + F.col("id") % 26), F.lit("-"), F.char((97 + F.floor(F.col("id") / 26)).cast("int"))).alias("w"))
    moved = words.select(pii.permute_text(F.col("w"), KEY, "t").alias("w"))
    assert moved.distinct().count() == 676
    assert moved.where(~F.col("w").rlike("^[a-z]-[a-z]$")).count() == 0


def test_plan_has_no_python(spark):
    plan = pii.pseudonymise(spark.createDataFrame([(1, "x")], "doc_id long, text string"), KEY)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_common_spellings(spark):
    texts = ["call (212-555-0123) now", "call (1-212-555-0123)", "at 2024-01-15T10:00:00Z", "BE68 5390 0754 7034 IBAN", "GB82 WEST 1234 5698 7654 32 AND MORE", "NO93 8601 1117 947 BANK"]
    shapes = [r"call \(\d{3}-\d{3}-\d{4}\) now", r"call \(1-\d{3}-\d{3}-\d{4}\)", r"at \d{4}-\d\d-\d\dT10:00:00Z", r"BE\d\d( \d{4}){3} IBAN", r"GB\d\d [A-Z]{4}( \d{4}){3} \d\d AND MORE", r"NO\d\d( \d{4}){2} \d{3} BANK"]
    for text, shape, r in zip(texts, shapes, replaced(spark, texts), strict=True):
        assert r.n_replaced == 1 and r.text != text and re.fullmatch(shape, r.text), (text, r.text)
    kept = ["2024-01-15Tx", "2024-01-15T1", "2024-01-15-1"]
    assert [r.text for r in replaced(spark, kept)] == kept
