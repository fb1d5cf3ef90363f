"""Exact Jaccard join of documents on word shingles, by filters under three global token orders.

Two sets with Jaccard similarity of at least t share ceil(t * n) of the n
tokens of either, so under any order of all tokens that both follow, their
prefixes of n - ceil(t * n) + 1 tokens share one. There are three orders here:
rare tokens first (by a logarithmic class of the document frequency), and the
same with one or the other half of all tokens, by a hash, before the rest, so
that their prefixes are made of different tokens. A candidate pair has to share
a prefix token in each order and to fit in size; then the whole sets decide.

The steps, for texts that may be anything from all different to all alike:

1. One pass over the texts gives each document the size of its set and ``nid``,
   a 64-bit hash of its words. Documents of one nid are one node: copies cost
   nothing further. (Two different texts of one nid would be merged; the chance
   of one such pair among 10^9 different texts is 3 %.)
2. A second pass deals the tokens out by hash, packed by task. Each bucket
   finds the tokens that two or more nodes have, and returns those only. A token
   that ``HOT`` or more documents of one task's buffer have isn't dealt out by
   it: the bucket is told, and the token counts as hot, the last class, for all.
   So what a bucket gets of one token is bounded by HOT for each buffer.
3. A node with fewer than ceil(t * n) shared tokens can have no partner and
   ends here. The others keep their shared tokens: all that an intersection
   can hold.
4. Nodes are compared to one drawn node with the same least token hash, under a
   few seeds. These links give provisional components, in which a group of near
   copies is one star, not all its pairs. Further rounds with other seeds compare
   across components only.
5. Nodes that share a prefix token with another component are dealt out by the
   tokens of the first order. Sizes, the token's positions,
   1,024-bit parity maps and signatures of the other two prefixes rule pairs
   out. A bucket gives a forest of what is left over its components; what is
   verified joins components, and the next round compares across the new ones.
6. When a round joins little, all candidates that are left are verified. Those
   among nodes with many of them are not listed as pairs: the sets that they
   connect are compared side by side, in tasks of bounded size.

Two tokens of two sets count as equal if 64 bits of a hash are: 48 travel, the
others are those of the bucket. For one verified pair of 500-word texts a false
equal token has a chance below 10^-9.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstrata.llm.components import components
from logstrata.llm.scratch import Scratch, give_back, join_back, partitions

WORDS = 5
#: Tokens of a task's buffer, tokens of a bucket on average, documents of a buffer that make a token hot.
BUFFER, BUCKET, HOT = 1_000_000, 2_000_000, 32
HOT_CLASS = 255
#: Seeds of the rounds in which each node is compared to one other for each seed.
STAR_SEEDS = ((0, 1, 2), (3, 4, 5, 6))
#: Rows compared with one node in one task.
CHUNK = 64

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_PLACE = np.array([xxhash.xxh3_64_intdigest(b"place %d" % i) | 1 for i in range(WORDS)], dtype=np.uint64)
_U = np.uint64


class _Words(dict):
    """Hashes of words, in a dictionary that starts anew when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_words = _Words()


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers."""
    x = x ^ _U(xxhash.xxh3_64_intdigest(b"order %d" % seed))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_LOWER).split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the shingles; of fewer words than five, one of them all."""
    n = len(words)
    if not n:
        return np.empty(0, _U)
    hashed = np.fromiter(map(_words.__getitem__, words), _U, n)
    if n < WORDS:
        return mix((hashed * _PLACE[:n]).sum(keepdims=True, dtype=_U), n)
    m = n - WORDS + 1
    total = hashed[:m] * _PLACE[0]
    for i in range(1, WORDS):
        total += hashed[i : i + m] * _PLACE[i]
    return np.unique(mix(total, WORDS))


def node_id(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def _texts(batch: pa.RecordBatch, text: str) -> Iterator[str | None]:
    for value in batch.column(batch.schema.get_field_index(text)):
        yield value.as_py()


def measure(docs: DataFrame, text: str) -> DataFrame:
    """All rows and columns but the text, with nid (null for no words) and n_shingles."""
    schema = "nid long, n_shingles long"
    others = [f for f in docs.schema.fields if f.name != text]
    out = type(docs.schema)([*others, *type(docs.schema).fromDDL(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = [], []
            for value in _texts(batch, text):
                words = split_words(value) if value else []
                ids.append(node_id(words) if words else None)
                sizes.append(shingles(words).size)
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in others]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], out.fieldNames())
        _words.clear()  # the worker goes on to other tasks
        give_back()

    return docs.mapInArrow(run, out)


# --- step 2: tokens to buckets and back -------------------------------------------------------------

_DEAL = "bucket int, kind int, keys binary, counts binary, low binary, high binary"
_ENTRIES, _HOT, _SIZES, _HOT_ENTRIES = range(4)
_DEAL_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])


def _bucket_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _names(tokens: np.ndarray, bucket: np.ndarray | int) -> np.ndarray:
    """64-bit names of tokens: the low 48 bits, which travel, below the bucket."""
    return (tokens & _U((1 << 48) - 1)) | (np.asarray(bucket).astype(_U) << _U(48))


def _slices(order: np.ndarray, parts: int) -> np.ndarray:
    return np.searchsorted(order, np.arange(parts + 1))


class _Buffer:
    """Documents of one task, until they are dealt out."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.seen: set[int] = set()
        self.keys: list[int] = []
        self.sets: list[np.ndarray] = []
        self.size = 0

    def add(self, nid: int, tokens: np.ndarray) -> None:
        if nid in self.seen:
            return
        if len(self.seen) > 200_000:  # a copy that comes again is dealt out again, and counted once
            self.seen.clear()
        self.seen.add(nid)
        self.keys.append(nid)
        self.sets.append(tokens)
        self.size += tokens.size

    def deal(self) -> list[dict]:
        rows: list[dict] = []
        if not self.keys:
            return rows
        keys = np.array(self.keys, np.int64)
        sizes = np.array([s.size for s in self.sets], np.int64)
        tokens, owner = np.concatenate(self.sets), np.repeat(np.arange(keys.size), sizes)
        self.keys, self.sets, self.size = [], [], 0
        home = (keys.view(_U) % _U(self.buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        self._pack(rows, _SIZES, home[order], keys[order], sizes[order], None)
        # Hot tokens: a table of counts finds those that may be, then they are counted.
        slot = (tokens & _U((1 << 20) - 1)).astype(np.int64)
        maybe = np.bincount(slot, minlength=1 << 20)[slot] >= HOT
        if maybe.any():
            found, count = np.unique(tokens[maybe], return_counts=True)
            hot = found[count >= HOT]
            if hot.size:
                at = _bucket_of(hot, self.buckets)
                order = np.argsort(at, kind="stable")
                self._pack(rows, _HOT, at[order], None, None, hot[order])
                is_hot = maybe
                is_hot[maybe] = np.isin(tokens[maybe], hot)
                theirs, names = owner[is_hot], _names(tokens[is_hot], _bucket_of(tokens[is_hot], self.buckets))
                order = np.argsort(home[theirs], kind="stable")
                self._pack_runs(rows, _HOT_ENTRIES, home[theirs][order], theirs[order], keys, names[order])
                tokens, owner = tokens[~is_hot], owner[~is_hot]
        at = _bucket_of(tokens, self.buckets)
        order = np.argsort(at.astype(np.uint16) if self.buckets <= 65536 else at, kind="stable")
        self._pack_runs(rows, _ENTRIES, at[order], owner[order], keys, tokens[order])
        return rows

    def _pack(self, rows, kind, at, keys, counts, tokens) -> None:
        ends = _slices(at, self.buckets)
        for b in np.unique(at):
            part = slice(ends[b], ends[b + 1])
            rows.append(_row(b, kind, None if keys is None else keys[part], None if counts is None else counts[part], None if tokens is None else tokens[part]))

    def _pack_runs(self, rows, kind, at, owner, keys, tokens) -> None:
        ends = _slices(at, self.buckets)
        for b in np.unique(at):
            part = slice(ends[b], ends[b + 1])
            own = owner[part]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            rows.append(_row(b, kind, keys[own[first]], np.diff(np.r_[first, own.size]), tokens[part]))


def _row(bucket, kind, keys, counts, tokens) -> dict:
    """Tokens of 48 bits in two parts; names, which pass through, keep their upper 16 in ``high`` with them."""
    row = {"bucket": int(bucket), "kind": kind, "keys": None if keys is None else keys.astype(np.int64).tobytes(), "counts": None if counts is None else counts.astype(np.int32).tobytes(), "low": None, "high": None}
    if tokens is not None:
        row["low"] = (tokens & _U(0xFFFFFFFF)).astype(np.uint32).tobytes()
        above = tokens >> _U(32)
        row["high"] = above.astype(np.uint32).tobytes() if kind == _HOT_ENTRIES else (above & _U(0xFFFF)).astype(np.uint16).tobytes()
    return row


def deal_tokens(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = _Buffer(buckets)
        for batch in batches:
            for value in _texts(batch, text):
                words = split_words(value) if value else []
                if words:
                    buffer.add(node_id(words), shingles(words))
                    if buffer.size >= BUFFER:
                        yield pa.RecordBatch.from_pylist(buffer.deal(), _DEAL_ARROW)
        yield pa.RecordBatch.from_pylist(buffer.deal(), _DEAL_ARROW)
        _words.clear()  # the worker goes on to other tasks
        give_back()

    return docs.select(text).mapInArrow(run, _DEAL)


_BACK = "home int, keys binary, counts binary, names binary, classes binary"
_BACK_ARROW = pa.schema([("home", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("names", pa.binary()), ("classes", pa.binary())])


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_py() or b"" for v in table.column(column)), kind)


def _where(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pa.compute.equal(table.column("kind"), kind))


def _shared(buckets: int):
    """Of one bucket: each token that two nodes or more have, back to its nodes."""

    def run(table: pa.Table) -> pa.Table:
        import pyarrow.compute  # noqa: F401

        bucket = table.column("bucket")[0].as_py()
        rows: list[dict] = []
        for row in _where(table, _SIZES).to_pylist():
            rows.append({"home": bucket, "keys": row["keys"], "counts": row["counts"], "names": None, "classes": None})
        for row in _where(table, _HOT_ENTRIES).to_pylist():
            names = np.frombuffer(row["low"], np.uint32).astype(_U) | np.frombuffer(row["high"], np.uint32).astype(_U) << _U(32)
            rows.append({"home": bucket, "keys": row["keys"], "counts": row["counts"], "names": names.tobytes(), "classes": np.full(names.size, HOT_CLASS, np.uint8).tobytes()})
        hot_rows, entries = _where(table, _HOT), _where(table, _ENTRIES)
        del table
        hot = np.unique(_joined(hot_rows, "low", np.uint32).astype(_U) | _joined(hot_rows, "high", np.uint16).astype(_U) << _U(32))
        keys = np.repeat(_joined(entries, "keys", np.int64), _joined(entries, "counts", np.int32))
        tokens = _joined(entries, "low", np.uint32).astype(_U) | _joined(entries, "high", np.uint16).astype(_U) << _U(32)
        if tokens.size:
            order = np.argsort(tokens, kind="stable")
            tokens, keys = tokens[order], keys[order]
            same = tokens[1:] == tokens[:-1]
            often = np.r_[same, False] | np.r_[False, same]
            if hot.size:
                often |= np.isin(tokens, hot)
            tokens, keys = tokens[often], keys[often]
            order = np.lexsort((keys, tokens))
            tokens, keys = tokens[order], keys[order]
            new = np.r_[True, (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])][: tokens.size]  # a node dealt out by two tasks counts once
            tokens, keys = tokens[new], keys[new]
            first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]][: tokens.size])
            df = np.diff(np.r_[first, tokens.size])
            rank = np.minimum(HOT_CLASS - 1, (8 * np.log2(np.maximum(df, 1))).astype(np.int64))
            rank[np.isin(tokens[first], hot)] = HOT_CLASS
            rank, df = np.repeat(rank, df), np.repeat(df, df)
            keep = (df > 1) | (rank == HOT_CLASS)
            tokens, keys, rank = tokens[keep], keys[keep], rank[keep]
            home = (keys.view(_U) % _U(buckets)).astype(np.int64)
            order = np.lexsort((keys, home))
            home, keys, names, rank = home[order], keys[order], _names(tokens[order], bucket), rank[order].astype(np.uint8)
            ends = _slices(home, buckets)
            for h in np.unique(home):
                part = slice(ends[h], ends[h + 1])
                own = keys[part]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                rows.append({"home": int(h), "keys": own[first].tobytes(), "counts": np.diff(np.r_[first, own.size]).astype(np.int32).tobytes(), "names": names[part].tobytes(), "classes": rank[part].tobytes()})
        out = pa.Table.from_pylist(rows, _BACK_ARROW)
        del rows
        give_back()
        return out

    return run


#: c counts the shared tokens, of which map is the parity map.
_NODES = "nid long, n int, c int, tokens binary, map array<long>, prefix1 array<long>, sign2 binary, sign3 binary"
_LONGS = pa.list_(pa.int64())
_NODES_ARROW = pa.schema([("nid", pa.int64()), ("n", pa.int32()), ("c", pa.int32()), ("tokens", pa.binary()), ("map", _LONGS), ("prefix1", _LONGS), ("sign2", pa.binary()), ("sign3", pa.binary())])


def parity_map(tokens: np.ndarray) -> np.ndarray:
    """1,024 bits: for each slot, whether an odd number of tokens falls in it. Two maps differ in at most as many bits as their sets in tokens."""
    slots = (mix(tokens, 99) >> _U(54)).astype(np.int64)
    return np.packbits(np.bincount(slots, minlength=1024).astype(np.uint8) & 1).view(np.uint64)


def signature(prefix: np.ndarray) -> bytes:
    """16 bits of each token: prefixes whose signatures share none share no token. Empty for a long prefix, which says nothing."""
    return np.unique((mix(prefix.view(_U), 5) >> _U(48)).astype(np.uint16)).tobytes() if prefix.size <= SIGNED else b""


def least_common(n: np.ndarray | int, percent: int):
    """Tokens that a set of n shares with any partner, at least."""
    return -(-n * percent // 100)


def _nodes(percent: int):
    """Of the nodes of one home: those that have enough shared tokens, with their prefixes under both orders."""

    def run(table: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        sizes, entries = table.filter(pc.is_null(table.column("names"))), table.filter(pc.is_valid(table.column("names")))
        del table
        ids, at = np.unique(_joined(sizes, "keys", np.int64), return_index=True)
        n = _joined(sizes, "counts", np.int32)[at].astype(np.int64)
        own = np.searchsorted(ids, np.repeat(_joined(entries, "keys", np.int64), _joined(entries, "counts", np.int32)))
        names, rank = _joined(entries, "names", _U), _joined(entries, "classes", np.uint8)
        order = np.lexsort((names, own))
        own, names, rank = own[order], names[order], rank[order]
        new = np.r_[True, (own[1:] != own[:-1]) | (names[1:] != names[:-1])][: own.size]  # hot tokens of a node dealt out twice
        own, names, rank = own[new], names[new], rank[new]
        have = np.bincount(own, minlength=ids.size)
        stays = have >= least_common(n, percent)
        stays &= have > 0
        keep = stays[own]
        own, names, rank = own[keep], names[keep], rank[keep]
        prefix = n - least_common(n, percent) + 1 - (n - have)  # tokens of one node come first and aren't kept
        start = np.zeros(ids.size, np.int64)
        start[stays] = np.r_[0, np.cumsum(have[stays])[:-1]]
        kept = np.flatnonzero(stays)
        orders = []
        half = (mix(names, 7) >> _U(63)).astype(np.int8)
        for seed, turn in ((1, None), (2, 0), (3, 1)):  # all tokens, or either half of them first
            keys = (mix(names, seed), rank) if turn is None else (mix(names, seed), rank, half ^ turn, rank == HOT_CLASS)
            ordered = names[np.lexsort((*keys, own))].view(np.int64)
            orders.append([ordered[start[i] : start[i] + prefix[i]] for i in kept])
        signs = [pa.array([signature(x) for x in o], pa.binary()) for o in orders[1:]]
        sets = [names[start[i] : start[i] + have[i]] for i in kept]
        plain = [pa.array(ids[kept], pa.int64()), pa.array(n[kept], pa.int32()), pa.array(have[kept], pa.int32()), pa.array([x.tobytes() for x in sets], pa.binary())]
        return pa.Table.from_arrays([*plain, pa.array([parity_map(x).view(np.int64) for x in sets], _LONGS), pa.array(orders[0], _LONGS), *signs], schema=_NODES_ARROW)

    return run


# --- steps 4 and 5: candidates ------------------------------------------------------------------------


def star_pairs(nodes: DataFrame, groups: DataFrame | None, seeds: tuple[int, ...], percent: int) -> DataFrame:
    """(a, b): each node b with one drawn node a that has the same token first under a hash order, for each seed.

    Similar sets mostly have the same first token there, rare or not. Sizes and parity maps rule out
    most other pairs. With ``groups``, only pairs across them.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(v.as_py(), _U) for v in batch.column(1)]
            for seed in seeds:
                least = [mix(s, 10 + seed).min() for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array([seed] * len(sets), pa.int32()), pa.array(np.array(least, _U).view(np.int64))], ["nid", "n", "c", "map", "o", "t"])

    keyed = nodes.select("nid", "tokens", "n", "c", "map").mapInArrow(first, "nid long, n int, c int, map array<long>, o int, t long")
    if groups is None:
        keyed = keyed.withColumn("g", F.col("nid"))
    else:
        keyed = keyed.join(groups, keyed.nid == groups.node, "left").withColumn("g", F.coalesce("component", "nid")).drop("node", "component")
    # A leader that differs from seed to seed: a node that one leader misses finds another.
    lead = F.struct(F.xxhash64("nid", "o").alias("draw"), "nid", "g", "n", "c", "map")
    least = keyed.groupBy("o", "t").agg(F.min(lead).alias("a"), F.max("g").alias("high"), F.min("g").alias("low")).where("low < high").select("o", "t", "a")
    both = join_back(keyed, least, "t", beside=("o",)).where("g != a.g")
    apart = F.aggregate(F.zip_with("map", "a.map", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    fits = F.expr(f"n * 100L >= a.n * {percent}L and a.n * 100L >= n * {percent}L")
    shared = F.expr(f"2 * (({percent}L * (n + a.n) + {99 + percent}) div {100 + percent})")
    both = both.where(fits & (F.col("c") + F.col("a.c") - apart >= shared))
    return both.select(F.col("a.nid").alias("a"), F.col("nid").alias("b")).distinct()


#: Tokens of a prefix that a signature holds; of longer ones there is none, and every pair passes it.
SIGNED = 256
#: Nodes of a posting list that one task compares with as many others; longer lists are split.
LONG = 4096
#: Candidates of a node in one bucket that are given one by one.
FEW = 16
#: Rounds in which only a forest of the candidates is verified, before all that are left are.
FOREST_ROUNDS = 6
#: A round of which fewer than one in so many candidates is a link is the last but one.
LAST_YIELD = 10
#: Nodes, and bytes of their sets, of one side of a task that compares a dense group.
SIDE, SIDE_BYTES = 1024, 8_000_000

_NODE = np.dtype([("nid", np.int64), ("g", np.int64), ("n", np.int32), ("c", np.int32), ("map", np.uint64, 16)])
_POSTING = np.dtype([("t", np.int64), ("node", np.int32), ("at", np.int32), ("part", np.int32), ("side", np.int8)])


def _needed(n, x, y, percent: int) -> np.ndarray:
    """Tokens that similar sets of these sizes share: overlap / (sum - overlap) >= percent / 100."""
    return -(-percent * (n[x].astype(np.int64) + n[y]) // (100 + percent))


def _alike(nodes, x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs their sizes and parity maps leave, and by how much a pair's maps are above what is needed."""
    n, c = nodes["n"].astype(np.int64), nodes["c"].astype(np.int64)
    spare = np.empty(x.size, np.int64)
    for s in range(0, x.size, 1 << 16):
        i, j = x[s : s + (1 << 16)], y[s : s + (1 << 16)]
        apart = np.bitwise_count(nodes["map"][i] ^ nodes["map"][j]).sum(axis=1, dtype=np.int64)
        # Tokens of one node only aren't in the maps; all others that differ are.
        spare[s : s + (1 << 16)] = c[i] + c[j] - apart - 2 * _needed(n, i, j, percent)
    return (spare >= 0) & (n[x] * 100 >= n[y] * percent) & (n[y] * 100 >= n[x] * percent), spare


def forest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Which of the edges (x, y) of ``n`` nodes make a spanning forest, earlier ones first."""
    label, left, kept = np.arange(n), np.arange(x.size), [np.empty(0, np.int64)]
    while left.size:
        low, high = np.minimum(label[x[left]], label[y[left]]), np.maximum(label[x[left]], label[y[left]])
        left, low, high = (v[low < high] for v in (left, low, high))
        child, first = np.unique(high, return_index=True)  # each goes below a smaller one, so there is no circle
        kept.append(left[first])
        parent = np.arange(n)
        parent[child] = low[first]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]
    return np.sort(np.concatenate(kept))


def _joined_labels(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The labels after the edges (x, y), a forest over them."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while v in root:
            v = root[v]
        return v

    for i, j in zip(label[x].tolist(), label[y].tolist(), strict=True):
        a, b = sorted((find(i), find(j)))
        if a != b:
            root[b] = a
    to = np.arange(label.max(initial=0) + 1)
    for v in root:
        to[v] = find(v)
    return to[label]


class _Candidates:
    """Pairs of nodes of one bucket that may be similar, without those that the filters rule out.

    Unless ``whole``, a spanning forest of them over the groups: what is connected already isn't looked at further, and
    ``more`` says that there was such a thing.
    """

    def __init__(self, nodes: np.ndarray, signs: tuple[list[bytes], ...], percent: int, *, whole: bool):
        self.nodes, self.signs, self.percent, self.whole = nodes, signs, percent, whole
        self.met: list[dict[int, frozenset]] = [{} for _ in signs]
        self.waiting: list[np.ndarray] = []
        self.size, self.most, self.more = 0, 2_000_000 if whole else 100_000, False
        self.passed = np.empty(0, np.int64)
        self.label = np.unique(nodes["g"], return_inverse=True)[1]

    def add(self, x: int, at: int, others: np.ndarray, ats: np.ndarray) -> None:
        n, c = self.nodes["n"], self.nodes["c"]
        # Shared tokens stand before this one (tokens of one node apart), are this one, or come after it.
        most = np.minimum(at, ats) + 1 + np.minimum(c[x] - at - 1, c[others] - ats - 1)
        fits = most >= _needed(n, x, others, self.percent)
        if not self.whole:
            new = self.label[others] != self.label[x]
            self.more |= bool((fits & ~new).any())
            fits &= new
        others = others[fits].astype(np.int64)
        if others.size:
            self.waiting.append(np.minimum(x, others) * len(self.nodes) + np.maximum(x, others))
            self.size += others.size
            if self.size > self.most:
                self.settle()

    def _sign(self, order: int, node: int) -> frozenset | None:
        met = self.met[order]
        if node not in met:
            raw = self.signs[order][node]
            met[node] = frozenset(np.frombuffer(raw, np.uint16).tolist()) if raw else None
        return met[node]

    def _signed(self, x: int, y: int) -> bool:
        """May they share a prefix token under each of the other orders?"""
        for order in range(len(self.signs)):
            a, b = self._sign(order, x), self._sign(order, y)
            if a is not None and b is not None and a.isdisjoint(b):
                return False
        return True

    def settle(self) -> None:
        if not self.waiting:
            return
        pairs = np.unique(np.concatenate(self.waiting))
        self.waiting, self.size = [], 0
        x, y = pairs // len(self.nodes), pairs % len(self.nodes)
        fits, spare = _alike(self.nodes, x, y, self.percent)
        order = np.argsort(-spare[fits], kind="stable")  # those with the most alike maps first
        pairs = pairs[fits][order]
        while pairs.size:
            x, y = pairs // len(self.nodes), pairs % len(self.nodes)
            chosen = np.arange(x.size) if self.whole else forest(self.label[x], self.label[y], len(self.nodes))
            good = np.fromiter((self._signed(i, j) for i, j in zip(x[chosen].tolist(), y[chosen].tolist(), strict=True)), bool, chosen.size)
            if self.whole or good.all():
                self.passed = np.concatenate([self.passed, pairs[chosen[good]]])
                break
            pairs = np.delete(pairs, chosen[~good])
        if not self.whole and pairs.size:
            self.more |= chosen.size < pairs.size
            self.label = _joined_labels(self.label, x[chosen], y[chosen])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        found = np.unique(self.passed)
        return found // len(self.nodes), found % len(self.nodes)


def mixed_postings(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Of the nodes that share a token of their first prefix with a node of another group: nid, g and ``post``, those
    tokens, each with its place and its number of nodes."""
    placed = nodes.join(groups, nodes.nid == groups.node, "left").withColumn("g", F.coalesce("component", "nid")).select("nid", "g", "prefix1")
    shared = placed.select("g", F.explode("prefix1").alias("t")).groupBy("t").agg(F.count("*").alias("k"), F.min("g").alias("low"), F.max("g").alias("high")).where("low < high").select("t", "k")
    found = join_back(placed.select("nid", "g", F.posexplode("prefix1").alias("at", "t")), shared, "t")
    return found.groupBy("nid", "g").agg(F.collect_list(F.struct("at", "t", "k")).alias("post"))


def candidates(place: DataFrame, nodes: DataFrame, percent: int, *, all_of_them: bool) -> DataFrame:
    """(a, b, kind) of nodes of different groups that share a prefix token under the first order and that neither sizes,
    positions, parity maps nor the signatures of the other orders' prefixes rule out.

    Each bucket gives a forest of its candidates over the groups, so never more rows than nodes: kind 0, or 1 if it
    has more candidates than it gives. With ``all_of_them`` it gives all candidates (kind 0) of nodes
    with up to ``FEW`` of them; those between two nodes with more are given as a forest over the nodes (kind 2).
    """
    sums = place.select(F.sum(F.aggregate("post", F.lit(0).cast("long"), lambda s, p: s + F.ceil(p["k"] / LONG).cast("long"))))
    buckets = 4 + (sums.first()[0] or 0) // 250_000  # a pair comes from as many buckets as it shares prefix tokens in

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.zeros(batch.num_rows, _NODE)
            for f in ("nid", "g", "n", "c"):
                own[f] = batch.column(f).to_numpy()
            own["map"] = batch.column("map").flatten().to_numpy().view(np.uint64).reshape(-1, 16)
            signs = [batch.column(c).to_pylist() for c in ("sign2", "sign3")]
            lists = batch.column("post")
            fields, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
            node, t, k = np.repeat(np.arange(len(counts)), counts), fields.field("t").to_numpy(), fields.field("k").to_numpy()
            parts = -(-k // LONG)
            mine = (mix(own["nid"][node].view(_U) ^ t.view(_U), 5) % parts.astype(_U)).astype(np.int64)
            # A list in several parts: each pair of parts meets in one place.
            again = np.repeat(np.arange(t.size), parts)
            other = np.arange(again.size) - np.repeat(np.cumsum(parts) - parts, parts)
            rows = np.empty(again.size, _POSTING)
            rows["t"], rows["node"], rows["at"] = t[again], node[again], fields.field("at").to_numpy()[again]
            low, high = np.minimum(mine[again], other), np.maximum(mine[again], other)
            rows["part"], rows["side"] = low * parts[again] + high, mine[again] > other
            rows["side"][low == high] = -1
            at = mix(t[again].view(_U) + rows["part"].astype(_U) * _U(0x9E3779B97F4A7C15), 3) % _U(buckets)
            order = np.argsort(at, kind="stable")
            rows, at = rows[order], at[order].astype(np.int64)
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: at.size])
            out: list[list] = [[], [], [], [], []]
            for i, j in zip(first, [*first[1:], at.size], strict=True):
                part = rows[i:j]
                there, part["node"] = np.unique(part["node"], return_inverse=True)
                for c, v in zip(out, (int(at[i]), own[there].tobytes(), part.tobytes(), *([s[x] for x in there] for s in signs)), strict=True):
                    c.append(v)
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["bucket", "nodes", "rows", "sign2", "sign3"])

    def pair(table: pa.Table) -> pa.Table:
        give_back()
        blobs = [np.frombuffer(v.as_py(), _NODE) for v in table.column("nodes")]
        parts = [np.frombuffer(v.as_py(), _POSTING).copy() for v in table.column("rows")]
        before = 0
        for own, part in zip(blobs, parts, strict=True):
            part["node"] += before
            before += own.size
        known, rows = np.concatenate(blobs), np.concatenate(parts)
        signs = tuple([x for v in table.column(c).to_pylist() for x in v] for c in ("sign2", "sign3"))
        del table, blobs, parts
        g = known["g"]
        rows = rows[np.lexsort((g[rows["node"]], rows["side"], rows["part"], rows["t"]))]
        first = np.flatnonzero(np.r_[True, (rows["t"][1:] != rows["t"][:-1]) | (rows["part"][1:] != rows["part"][:-1])])
        found = _Candidates(known, signs, percent, whole=all_of_them)
        for i, j in zip(first, np.r_[first[1:], rows.size], strict=True):
            own = rows[i:j]
            who, at = own["node"], own["at"]
            if own["side"][0] < 0:
                ends = np.searchsorted(g[who], g[who], "right")  # partners stand after the own group
                for x in np.flatnonzero(ends < own.size):
                    found.add(int(who[x]), int(at[x]), who[ends[x] :], at[ends[x] :])
            else:
                cut = int(np.searchsorted(own["side"], 1))
                for x in range(cut):
                    far = g[who[cut:]] != g[who[x]]
                    if far.any():
                        found.add(int(who[x]), int(at[x]), who[cut:][far], at[cut:][far])
        x, y = found.pairs()
        if all_of_them:
            many = np.bincount(np.r_[x, y], minlength=g.size) > FEW
            dense = many[x] & many[y]
            inside = np.flatnonzero(dense)[forest(x[dense], y[dense], g.size)]
            keep = np.r_[np.flatnonzero(~dense), inside]
            kind = np.repeat([0, 2], [keep.size - inside.size, inside.size])
        else:
            keep, kind = np.arange(x.size), np.full(x.size, int(found.more))
        a, b = known["nid"][x[keep]], known["nid"][y[keep]]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64()), "kind": pa.array(kind, pa.int32())})

    whole = place.join(nodes.select(F.col("nid").alias("__nid"), "n", "c", "map", "sign2", "sign3"), place.nid == F.col("__nid")).drop("__nid")
    return whole.mapInArrow(deal, "bucket int, nodes binary, rows binary, sign2 array<binary>, sign3 array<binary>").groupBy("bucket").applyInArrow(pair, "a long, b long, kind int")


def dense_links(pairs: DataFrame, nodes: DataFrame, groups: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(a, b): links that, with the groups, join all that are similar among the nodes that ``pairs`` connect.

    The members of such a connected set are dealt out in sides of a bounded size, and every two sides are compared once,
    where a side isn't all of one group. A task gives a forest of its links only.
    """
    areas = components(pairs, scratch, "dense").select(F.col("node").alias("nid"), F.col("component").alias("area"))
    placed = areas.join(groups, areas.nid == groups.node, "left").select("nid", "area", F.coalesce("component", "nid").alias("g"))
    placed = scratch.table(placed.join(nodes.select("nid", F.length("tokens").alias("bytes")), "nid"), "dense-nodes")
    # Large groups have sides of their own; the others share sides.
    size = F.ceil(F.greatest(F.count("*") / SIDE, F.sum("bytes") / SIDE_BYTES)).cast("long")
    own = placed.groupBy("area", "g").agg(size.alias("sides"))
    large = own.where("sides > 1")
    keyed = placed.join(large.select(F.col("area").alias("__area"), F.col("g").alias("__g"), "sides"), (placed.area == F.col("__area")) & (placed.g == F.col("__g")), "left").drop("__area", "__g")
    rest = keyed.where("sides is null").groupBy("area").agg(size.alias("others")).select(F.col("area").alias("__area"), "others")
    keyed = keyed.join(rest, keyed.area == rest["__area"], "left").drop("__area")
    alone = F.col("sides").isNotNull()
    side = F.when(alone, F.xxhash64("g", F.pmod(F.xxhash64("nid"), "sides"))).otherwise(F.pmod(F.xxhash64("g"), "others"))
    keyed = scratch.table(keyed.select("nid", "area", "g", side.alias("side"), F.when(alone, F.col("g")).alias("only")), "dense-sides")
    sides = keyed.select("area", "side", "only").distinct()
    left, right = sides.select("area", F.col("side").alias("i"), F.col("only").alias("x")), sides.select("area", F.col("side").alias("j"), F.col("only").alias("y"))
    meet = left.join(right, "area").where("i <= j and (x is null or y is null or x != y)").select("area", "i", "j")
    one = meet.select("area", "i", "j", F.col("i").alias("side"), F.lit(0).alias("at"))
    two = meet.where("i < j").select("area", "i", "j", F.col("j").alias("side"), F.lit(1).alias("at"))
    members = keyed.join(one.unionByName(two), ["area", "side"]).select("area", "i", "j", "at", "nid", "g")
    members = members.join(nodes.select("nid", "n", "c", "map", "tokens"), "nid")

    def compare(table: pa.Table) -> pa.Table:
        known = np.zeros(table.num_rows, _NODE)
        for f in ("nid", "g", "n", "c"):
            known[f] = table.column(f).to_numpy()
        known["map"] = table.column("map").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, 16)
        at, sets = table.column("at").to_numpy(), [np.frombuffer(v.as_py(), _U) for v in table.column("tokens")]
        _, group = np.unique(known["g"], return_inverse=True)
        label = group.copy()
        hits: list[tuple[int, int]] = []
        two = bool(at.any())
        for x in np.flatnonzero(at == 0):
            y = np.flatnonzero((at == 1) & (label != label[x])) if two else x + 1 + np.flatnonzero(label[x + 1 :] != label[x])
            y = y[_alike(known, np.full(y.size, x), y, percent)[0]]
            for other in y:
                if label[other] != label[x]:
                    common = np.intersect1d(sets[x], sets[other], assume_unique=True).size
                    if common * 100 >= percent * (int(known["n"][x]) + int(known["n"][other]) - common):
                        hits.append((int(known["nid"][x]), int(known["nid"][other])))
                        label[label == label[other]] = label[x]
        return pa.table({"a": pa.array([a for a, _ in hits], pa.int64()), "b": pa.array([b for _, b in hits], pa.int64())})

    return members.groupBy("area", "i", "j").applyInArrow(compare, "a long, b long")


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar. A node a with many partners is compared in chunks of them."""
    counts = pairs.groupBy("a").agg(F.count("*").alias("k"))
    salted = join_back(pairs, counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / CHUNK)).cast("int").alias("s"))
    sets = nodes.select("nid", "n", "tokens")
    members = salted.join(sets, salted.b == sets.nid).select("a", "s", F.lit(False).alias("lead"), "nid", "n", "tokens")
    leads = salted.select("a", "s").distinct()
    leads = leads.join(sets, leads.a == sets.nid).select("a", "s", F.lit(True).alias("lead"), "nid", "n", "tokens")

    def compare(table: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        lead = table.filter(table.column("lead")).slice(0, 1)
        rest = table.filter(pc.invert(table.column("lead")))
        mine, n = np.frombuffer(lead.column("tokens")[0].as_py(), _U), lead.column("n")[0].as_py()
        hits = []
        for nid, m, raw in zip(rest.column("nid").to_pylist(), rest.column("n").to_pylist(), rest.column("tokens"), strict=True):
            other = np.frombuffer(raw.as_py(), _U)
            at = np.searchsorted(mine, other)
            at[at == mine.size] = 0
            common = int((mine[at] == other).sum())
            if common * 100 >= percent * (n + m - common):
                hits.append(nid)
        return pa.table({"a": pa.array([lead.column("nid")[0].as_py()] * len(hits), pa.int64()), "b": pa.array(hits, pa.int64())})

    return members.unionByName(leads).groupBy("a", "s").applyInArrow(compare, "a long, b long")


def _free(spark) -> None:
    """Lets Spark drop the shuffle files of steps that were written down."""
    gc.collect()
    spark._jvm.System.gc()


def _crossing_links(nodes: DataFrame, groups: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(a, b): the groups as links and all that join them further."""
    def as_links(groups: DataFrame) -> DataFrame:
        return groups.select(F.col("node").alias("a"), F.col("component").alias("b"))

    turn, full = 0, FOREST_ROUNDS == 0
    while True:
        # Groups only grow, so a node that has no partner outside its group in one round has none later.
        place = scratch.table(mixed_postings(nodes if turn == 0 else nodes.join(place.select("nid"), "nid", "left_semi"), groups), f"place-{turn}")
        found = scratch.table(candidates(place, nodes, percent, all_of_them=full), f"candidates-{turn}")
        _free(nodes.sparkSession)
        kinds = {r.kind for r in found.select("kind").distinct().collect()}  # three at most
        if not kinds:
            return as_links(groups)
        links = scratch.table(verified(found.where("kind < 2").select("a", "b").distinct(), nodes, percent), f"far-{turn}")
        joined = links.unionByName(as_links(groups))
        if 2 in kinds:
            return joined.unionByName(dense_links(found.where("kind = 2").select("a", "b"), nodes, groups, scratch, percent))
        if 1 not in kinds:
            return joined  # every candidate has been verified
        turn, some = turn + 1, links.count()
        full = turn >= FOREST_ROUNDS or some * LAST_YIELD < found.count()
        if some:
            groups = scratch.table(components(joined, scratch, f"round-{turn}"), f"round-groups-{turn}")


def join_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """All columns but the text, with n_shingles, group and component_id, the least doc_id reachable by links.

    Columns of these names are replaced. ``group`` names the component whatever its ids are. Documents without a word have n_shingles 0 and are
    components of their own, as are repeated rows of them; copies of other texts are linked. A null
    doc_id is no candidate for the least; a component of such rows only has a null id. ``percent``
    of 100 links equal sets only.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    docs = docs.drop("n_shingles", "component_id", "nid", "group")
    rows = scratch.table(measure(docs, text), "rows")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(partitions(spark), -(-total // BUCKET))
    dealt = deal_tokens(docs, text, buckets).groupBy("bucket").applyInArrow(_shared(buckets), _BACK)
    nodes = scratch.table(dealt.groupBy("home").applyInArrow(_nodes(percent), _NODES), "nodes")
    del dealt
    _free(spark)
    groups = None
    for turn, seeds in enumerate(STAR_SEEDS):
        found = scratch.table(verified(star_pairs(nodes, groups, seeds, percent), nodes, percent), f"stars-{turn}")
        some = found.limit(1).count()
        if groups is not None and not some:
            break
        if groups is not None:  # the components so far stand for their links
            found = found.unionByName(groups.select(F.col("node").alias("a"), F.col("component").alias("b")))
        groups = scratch.table(components(found, scratch, f"near-{turn}"), f"groups-{turn}")
        _free(spark)
        if not some:
            break
    links = _crossing_links(nodes, groups, scratch, percent)
    final = scratch.table(components(links, scratch, "all-components"), "final")
    scratch.drop("nodes")
    placed = rows.join(final, rows.nid == final.node, "left").withColumn("group", F.coalesce("component", "nid")).drop("node", "component", "nid")
    least = placed.where(F.col("group").isNotNull()).groupBy("group").agg(F.min(doc_id).alias("component_id"))
    return join_back(placed, least, "group", how="left").withColumn("component_id", F.when(F.col("group").isNull(), F.col(doc_id)).otherwise(F.col("component_id")))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The rows that stay when one of each component does: its least doc_id (a null one only if there is
    no other; of rows with that id the one of the least text hash). Rows without a word all stay."""
    scratch = Scratch(docs.sparkSession, "one-of-each")
    keyed = docs.withColumn("__key", F.coalesce(F.xxhash64(text), F.lit(0)))
    found = join_documents(keyed.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), "__key"), doc_id="__id", text="__text", percent=percent)
    found = scratch.table(found.select("__id", "__key", F.col("group").alias("__group")), "found")
    order = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("__id"), F.col("__key").alias("__key"))
    chosen = found.where(F.col("__group").isNotNull()).groupBy("__group").agg(F.min(order).alias("row")).select(F.col("row.__id").alias("__id"), F.col("row.__key").alias("__key"))
    chosen = scratch.table(chosen.distinct(), "chosen")
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & (keyed["__key"] == chosen["__key"])
    words = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = keyed.where(words).join(chosen, same, "left_semi")
    # Equal rows that are chosen together, which only tables with repeated ids have.
    repeated = found.where(F.col("__group").isNotNull()).groupBy("__id", "__key").count().where("count > 1").limit(1).count()
    if repeated:
        kept = kept.dropDuplicates([doc_id, "__key"])
    return kept.unionByName(keyed.where(~words)).drop("__key")
