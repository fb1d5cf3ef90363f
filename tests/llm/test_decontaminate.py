import random

from logstrata.llm import decontaminate as dc


def distance_to_part(pattern, text):
    before = [0] * (len(text) + 1)
    for i, a in enumerate(pattern):
        row = [i + 1]
        for j, b in enumerate(text):
            row.append(min(before[j] + (a != b), before[j + 1] + 1, row[j] + 1))
        before = row
    return min(before)


def test_search_equals_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        p, t = ("".join(rng.choices("abc", k=rng.randrange(lo, 14))) for lo in (1, 0))
        assert dc.search(dc.masks(p), len(p), t)[0] == distance_to_part(p, t)


def edited(rng, text, k):
    chars = list(text)
    for _ in range(k):
        at, kind = rng.randrange(len(chars)), rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("abcdefgh")
        elif kind == 1:
            chars.insert(at, rng.choice("abcdefgh"))
        elif len(chars) > 1:
            del chars[at]
    return "".join(chars)


def test_matcher_equals_brute_force():
    rng = random.Random(2)
    items = [(i, " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(rng.randrange(1, 16)))) for i in range(12)]
    matcher = dc.Matcher(items, 0.1)
    for _ in range(80):
        parts = ["".join(rng.choices("abcdefgh ", k=rng.randrange(60))) for _ in range(3)]
        item = rng.choice(items)[1]
        text = dc.normalise(f"{parts[0]} {edited(rng, item, rng.randrange(int(len(item) * 0.1) + 3))} {parts[1]} {parts[2]}")
        got = {h[0]: h[1] for h in sorted(matcher.hits(text), key=lambda h: -h[1])}
        want = {i: d for i, t in items if (d := distance_to_part(dc.normalise(t), text)) <= int(len(dc.normalise(t)) * 0.1)}
        assert got == want


def test_places_are_in_the_original_text(spark):
    item = "The quick brown fox, jumps over the lazy dog!"
    docs = [(1, f"Intro -- THE  quick\nBROWN fox jumps over the lazy dog. {item} End"), (2, "nothing of it"), (3, None), (4, ""), (5, "İ" * 3 + item), (1, item)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'clash' as hits", "1 as item_id")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "!!"), (7, item), (10, item)], "item_id long, text string")
    found = [(r.doc_id, r.item_id, r.distance, r.start, r.end) for r in dc.matches(df, bench).collect()]
    one = [f for f in found if f[0] == 1 and f[1] == 7]
    assert len(one) == 3
    text = docs[0][1]
    assert sorted(text[s:e] for _, _, d, s, e in one if e > 60 or s == 9) == sorted(["THE  quick\nBROWN fox jumps over the lazy dog", item[:-1]])
    assert {f[0] for f in found} == {1, 5}
    assert {f[1] for f in found} == {7, 10}
    assert all(f[2] == 0 for f in found)
    assert docs[4][1][[f[3] for f in found if f[0] == 5][0] :].startswith("The quick")
    assert sorted(r.doc_id for r in dc.clean(df, bench).collect()) == [2, 3, 4]


def test_blocks_of_items_and_empty_tables(spark):
    rng = random.Random(4)
    items = [(i, " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(12))) for i in range(9)]
    docs = spark.createDataFrame([(i, f"x {t} y") for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, dc.matches(docs, bench).collect()))
    assert [(d, i) for d, i, *_ in whole] == [(i, i) for i in range(9)]
    assert sorted(map(tuple, dc.matches(docs, bench, block_chars=200).collect())) == whole
    assert dc.matches(docs, bench.limit(0)).count() == 0
    assert dc.clean(docs, bench.limit(0)).count() == 9
    assert dc.matches(docs.limit(0), bench).count() == 0


def test_very_long_text():
    rng = random.Random(6)
    item = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(30))
    filler = " ".join("".join(rng.choices("ijklmnop", k=5)) for _ in range(60_000))
    assert [h[:2] for h in dc.Matcher([(1, item)], 0.08).hits(filler + " " + item)] == [(1, 0)]


def test_offsets_after_characters_whose_lower_case_has_a_mark():
    for text in ("İ abc def", "İİ  abc", "x İ-abc İabcİ", "ẞ abc Σ abcΣ"):
        plain = dc.normalise(text)
        for at in (i for i in range(len(plain)) if plain.startswith("abc", i)):
            own = dc.origins(text)[at : at + 3]
            assert text[own[0] : own[-1] + 1].lower() == "abc", (text, at)


def test_ids_of_any_type_and_many_blocks(spark):
    items = [(f"item-{i}", " ".join(f"{w}{i}" for w in ("the", "same", "words", "again", "and", "again"))) for i in range(5)]
    bench = spark.createDataFrame([*items, (None, "an item without an id at all")], "item_id string, text string")
    docs = spark.createDataFrame([(str(i), f"before {t} after {t}") for i, t in items] + [("x", "an item without an id at all"), ("none", None)], "doc_id string, text string")
    one = sorted(map(str, dc.matches(docs, bench).collect()))
    assert len(one) == 11 and one == sorted(map(str, dc.matches(docs, bench, block_chars=30).collect()))
    assert [r.doc_id for r in dc.clean(docs, bench, block_chars=30).collect()] == ["none"]


def test_long_repetitive_texts_take_linear_time():
    import time

    matcher = dc.Matcher([(1, "ab ab ab ab ab ab ab ab ab ab ab ab")], 0.08)
    began = time.perf_counter()
    assert len(matcher.hits("ab " * 60_000)) == 4000
    assert time.perf_counter() - began < 60
