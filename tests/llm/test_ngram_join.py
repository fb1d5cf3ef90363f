import random
import re
from collections import Counter

import numpy as np
import pytest

from logstrata.llm import ngram_join as nj


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """(doc_id, text) to sorted (doc_id, n_shingles, component_id)."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), k), k)
    return sorted((k, len(sets[i]), least[root(i)]) for i, (k, _) in enumerate(rows))


def run(spark, rows):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, component_id string, nid int")
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in nj.join_documents(df.repartition(3)).collect())


def family(rng, words, size, edits):
    """Copies of a text with words replaced, which are more or less alike."""
    base = [rng.choice(words) for _ in range(size)]
    for _ in range(12):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(size)] = rng.choice(words)
        yield " ".join(copy)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=40))
    texts = [t for _ in range(4) for t in family(rng, words, rng.choice([30, 60, 150]), 6)]
    texts += [passage + " " + " ".join(rng.choices(words, k=rng.choice([2, 8, 30]))) for _ in range(30)]
    texts += [" ".join(rng.choices(words, k=rng.randrange(9))) for _ in range(30)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_thresholds_are_exact(spark):
    """Sets that share exactly 80 of 100 shingles, and just less."""
    base = [f"a{i}" for i in range(94)]
    rows = []
    for k, cut in enumerate((0, 10, 11)):
        rows.append((k * 10, " ".join(base[: 94 - cut] + [f"x{k}-{i}" for i in range(cut)])))
    assert run(spark, rows) == brute(rows)
    near = [(1, " ".join(f"b{i}" for i in range(12))), (2, " ".join(f"b{i}" for i in range(14)))]  # 8 of 10
    assert [c for *_, c in run(spark, near)] == [1, 1]
    far = [(1, " ".join(f"b{i}" for i in range(11))), (2, " ".join(f"b{i}" for i in range(13)))]  # 7 of 9
    assert [c for *_, c in run(spark, far)] == [1, 2]


def test_odd_rows(spark):
    rows = [(5, None), (4, ""), (3, " \n\t\x0b\x0c\r"), (9, "One two"), (2, "one\ttwo"), (7, "one two three"), (8, "É b c d e f"), (1, "é b c d e f"), (2, "one\ttwo"), (11, "a b a b a b a b a b"), (10, "a b a b a b a"), (12, "word " * 60_000), (13, "WORD " * 50_000), (14, "x\xa0y")]
    got = run(spark, rows)
    assert got == brute(rows)
    assert nj.join_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = spark.createDataFrame([(None, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert {r.component_id for r in nj.join_documents(alone).collect()} == {None}


def test_hot_tokens_and_small_buffers(spark, monkeypatch):
    """With a token in nearly every document, and buffers that hold a few documents."""
    monkeypatch.setattr(nj, "BUFFER", 600)
    monkeypatch.setattr(nj, "HOT", 4)
    monkeypatch.setattr(nj, "CHUNK", 5)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choices(words, k=30))
    buffer = nj._Buffer(7)
    sets = {}
    for i in range(40):
        text = passage + " " + " ".join(rng.choices(words, k=rng.randrange(12)))
        tokens = nj.shingles(nj.split_words(text))
        sets[nj.node_id(nj.split_words(text))] = tokens
        buffer.add(nj.node_id(nj.split_words(text)), tokens)
        buffer.add(nj.node_id(nj.split_words(text)), tokens)
    import pyarrow as pa

    back = Counter()
    dealt = pa.Table.from_pylist(buffer.deal(), nj._DEAL_ARROW)
    for b in range(7):
        part = dealt.filter(pa.compute.equal(dealt.column("bucket"), b))
        for row in nj._shared(7)(part).to_pylist() if part.num_rows else []:
            if row["names"] is not None:
                keys = np.repeat(np.frombuffer(row["keys"], np.int64), np.frombuffer(row["counts"], np.int32))
                back.update(keys.tolist())
    df = Counter(t for s in sets.values() for t in s.tolist())
    assert back == {k: n for k, s in sets.items() if (n := sum(df[t] > 1 for t in s.tolist()))}
    rows = [(i, passage + " " + " ".join(rng.choices(words, k=rng.randrange(12)))) for i in range(60)]
    assert run(spark, rows) == brute(rows)


def test_parity_maps_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 300))).astype(np.uint64) for _ in range(2))
        apart = int(np.bitwise_count(nj.parity_map(a) ^ nj.parity_map(b)).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_one_of_each(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [t for _ in range(3) for t in family(rng, words, 80, 5)] + ["short", "Short", None, "", "  "]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(k, t, "en") for k, t in rows], "doc_id long, text string, lang string")
    got = sorted(r.doc_id for r in nj.one_of_each(df).collect())
    assert got == sorted(k for k, _, c in brute(rows) if k == c)
    again = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "A b  c"), (1, "other words"), (None, "a b c"), (None, "no id"), (2, None), (2, None)], "doc_id long, text string")
    left = sorted(map(str, nj.one_of_each(again).collect()))
    assert len(left) == 5  # one of a b c, other words, no id, and the rows without words
    assert nj.one_of_each(again.limit(0)).count() == 0


def variants(n, edits, size=70):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(size)]
    rows = []
    for i in range(n):
        copy = list(base)
        for _ in range(edits):
            copy[rng.randrange(size)] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    return rows


def least_reachable(rows):
    """As ``brute`` says, for one group of near copies of unique ids."""
    sets = [nj.shingles(nj.split_words(t)) for _, t in rows]
    owner = np.repeat(np.arange(len(rows)), [s.size for s in sets])
    tokens, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    table = np.zeros((len(rows), tokens.size), np.float32)
    table[owner, at] = 1
    table = table[:, count > 1]
    both, n = table @ table.T, np.array([s.size for s in sets])
    linked = (100 * both >= 80 * (n[:, None] + n - both)) | np.eye(len(rows), dtype=bool)
    label = np.arange(len(rows))
    while ((new := np.array([label[row].min() for row in linked])) != label).any():
        label = new
    return [(k, int(s.size), int(c)) for (k, _), s, c in zip(rows, sets, label, strict=True)]


def test_candidates_of_a_large_group_of_near_copies_are_few(spark, monkeypatch):
    """2.3 million links between 5,000 texts; a bucket gives no more candidates than it has nodes."""
    counts = []
    real = nj.Scratch.table

    def table(self, df, name):
        out = real(self, df, name)
        if name.startswith("candidates"):
            counts.append(out.count())
        return out

    monkeypatch.setattr(nj.Scratch, "table", table)
    rows = variants(5000, 1)
    assert run(spark, rows) == least_reachable(rows)
    assert 0 < sum(counts) < 4 * len(rows)


@pytest.mark.parametrize("edits", [1, 2])
def test_dense_groups_are_compared_side_by_side(spark, monkeypatch, edits):
    for name, value in (("FOREST_ROUNDS", 0), ("FEW", 3), ("SIDE", 60), ("LONG", 90), ("STAR_SEEDS", ((0,),))):
        monkeypatch.setattr(nj, name, value)
    rows = variants(400, edits) + [(400 + i, t) for i, t in variants(150, 1)]
    assert run(spark, rows) == least_reachable(rows)


def test_forests():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 30))
        x, y = rng.integers(0, n, (2, int(rng.integers(0, 60))))
        kept = nj.forest(x, y, n)
        whole, part = (nj._joined_labels(np.arange(n), x[k], y[k]) for k in (np.arange(x.size), kept))
        assert (whole == part).all() and kept.size == n - np.unique(whole).size


def test_signatures_rule_out_only_what_shares_nothing():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, 2**62, 50) for _ in range(2))
    sets = [set(np.frombuffer(nj.signature(v), np.uint16).tolist()) for v in (a, b, np.r_[a[:1], b])]
    assert sets[0] & sets[2] and len(sets[0] & sets[1]) < 3
    assert nj.signature(np.arange(nj.SIGNED + 1)) == b""
