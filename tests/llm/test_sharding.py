import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from logstrata.llm import sharding


def key(text):
    return b"" if text is None else hashlib.md5(text.encode()).digest()


def smallest_capacity(texts, shards):
    sizes = defaultdict(int)
    for t in texts:
        sizes[key(t)] += (0 if t is None else len(t.encode())) + 1
    line = [sizes[k] for k in sorted(sizes)]

    def needed(capacity):
        n, filled = 1, 0
        for s in line:
            if filled + s > capacity:
                n, filled = n + 1, 0
            filled += s
        return n

    low, high = max(line), sum(line)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if needed(middle) <= shards else (middle + 1, high)
    return low


def check(spark, texts, shards, ids=None):
    ids = ids or list(range(len(texts)))
    df = spark.createDataFrame([(i, t, 9, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, shard int, size string")
    rows = sharding.minimax_shards(df, shards).collect()
    assert len(rows) == len(texts)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        assert 0 <= r.shard < shards
        assert (r.law, r.grown_shard) == ("bytes", None)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if texts:
        assert max(sizes.values()) == smallest_capacity(texts, shards)
    if len(set(ids)) == len(ids):
        where = defaultdict(set)
        for r in rows:
            t = texts[ids.index(r.doc_id)]
            assert r.size == (0 if t is None else len(t.encode())) + 1
            assert r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
            where[t].add(r.shard)
        assert all(len(s) == 1 for s in where.values())
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_capacity_is_smallest(spark, seed):
    rng = random.Random(seed)
    texts = ["w" * rng.choice([0, 1, 5, 40, 400]) + str(rng.randrange(60)) + "é" for _ in range(300)]
    check(spark, texts, rng.choice([1, 2, 7, 16]))


def test_one_text_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 16)
    check(spark, ["the same"] * 300 + [f"text {i}" for i in range(100)], 8)


def test_a_large_group_leaves_no_shard_empty(spark):
    """40 % of the rows have one text: the others still spread evenly over the other shards."""
    rows = check(spark, ["the same text"] * 400 + [f"text {i:08d}" for i in range(600)], 16)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.shard] += r.size
    rest = sorted(sizes.values())[:-1]
    even = 600 * 14 / 15  # sides of the large group have shards of their own
    assert len(sizes) == 16 and rest[-1] <= 1.1 * even and rest[0] >= 0.7 * even


def test_shards_that_greedy_cuts_leave_over_are_used(spark):
    rows = check(spark, [c * 6 for c in "abcd"], 3)
    assert {r.shard for r in rows} == {0, 1, 2}
    assert len({r.shard for r in check(spark, [str(i) * (1 + 40 * (i % 5 == 0)) for i in range(40)], 16)}) == 16


def test_crowded_blocks_are_opened_by_sums(spark, monkeypatch):
    """Keys with long common prefixes, and no more than a few rows at a time."""
    most = []

    class Counted(sharding.Span):
        def __init__(self, found, before, leaf):
            most.append((len(found), leaf))
            super().__init__(found, before, leaf)

    monkeypatch.setattr(sharding, "FETCH", 8)
    monkeypatch.setattr(sharding, "Span", Counted)
    rng = random.Random(2)
    groups = sorted((f"{'0000' if rng.random() < 0.5 else 'AAAA'}{rng.choice(['0000', '1111'])}{i:024X}", rng.randrange(1, 30), 1) for i in range(300))
    line = sharding.Line(spark.createDataFrame(groups, "key string, bytes long, n long"))
    for shards in (1, 5, 16):
        cuts = line.partition(0, line.total, shards)
        ends = [sum(b for _, b, _ in groups[: i + 1]) for i in range(300)]
        assert set(cuts) <= set(ends) and cuts[-1] == ends[-1] and len(cuts) == shards
        best = line.least(0, line.total, shards)
        assert max(b - a for a, b in zip([0, *cuts], cuts)) == best
        needed = lambda cap: sum(1 for _ in _greedy([b for _, b, _ in groups], cap))
        assert needed(best) <= shards < needed(best - 1)
        for c in cuts[:-1]:
            assert line.first_after(c) == (groups[ends.index(c) + 1][0], ends.index(c) + 1)
    assert max((n for n, leaf in most if leaf), default=0) <= 8


def _greedy(sizes, capacity):
    filled = 0
    for s in sizes:
        if s > capacity:
            yield from range(10**6)
        if filled + s > capacity:
            yield filled
            filled = 0
        filled += s
    yield filled


def test_odd_rows(spark):
    check(spark, [None, "", "", None, "x" * 100_000, "a", "ä"], 16)
    check(spark, ["a", "a", "a", "b"], 2, ids=[1, 1, 1, None])
    check(spark, [], 16)
    check(spark, ["only"], 16)
