"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a ``.model`` file into arrays:

* the normaliser N: the dummy prefix, optional white-space folding and the
  escape of spaces to U+2581. Models with a compiled character map are refused
  unless their rule set is ``identity``.
* the pieces P: states and arcs of a trie over characters (a hash table from
  state and symbol to the next state), with the piece that ends in a state.
* byte fallback B: one arc for a character that no piece spells, which emits
  the byte pieces of its UTF-8 form (or the unknown id where the model has no
  bytes).

Composing them with an input gives a lattice: a node for each place between two
characters and an arc for each piece that is spelled there. Its shortest path in
the tropical semiring is the encoding: the cost of a node is the least sum of the
cost of a node before and the weight of the arc between. All segments of a batch
of texts are composed and searched together, place by place.

For unigram models the weight of an arc is the negated piece score, in single
precision as in the library. BPE models don't minimise a sum of scores: they
merge by priority. Here the weight depends on the piece before: an arc weighs
0 if BPE leaves a boundary between the two pieces, and is infinite if a merge
would cross it. That is decided by the two pieces alone, because merges are
ordered by (score, position) and those inside a piece don't depend on the rest:
undoing the later of the last merges of either side, step by step, shows whether
a pair across the boundary would have been merged before. A text has one path
of finite cost, for each prefix as well, so a node needs the best piece before
it only; and that path is the BPE result.

Texts are cut into segments where no arc can span the cut, so paths are put
together from those of the segments. For BPE models that is between any two
characters that aren't neighbours in a piece; merges on either side don't depend
on each other. For unigram models, whose sums are rounded and whose unknown
characters run together, it is before each U+2581 that follows another
character, or nowhere if a piece spans such a cut. Paths of equal segments are
searched once and kept, within bounds; a segment is looked up by a hash of its
characters and compared with the characters that are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from logstrata.llm.scratch import give_back

SPACE = "▁"
#: Piece types of the public model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


class Table:
    """A hash table from non-negative integers to integers, looked up for whole arrays; -1 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, *, room: int = 1):
        self.bits = max(4, int(2 * max(room, keys.size) - 1).bit_length() + 1)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        self.add(keys, values)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't there; all keys together are ``room`` at most."""
        left = np.arange(keys.size)
        at = self._slot(keys)
        while left.size:
            free = self.keys[at[left]] < 0
            slots, first = np.unique(at[left][free], return_index=True)
            placed = left[free][first]
            self.keys[slots], self.values[slots] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while left.size:
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[left]]
            same = there == keys[left]
            out[left[same]] = self.values[at[left[same]]]
            left = left[~same & (there >= 0)]
        return out


class Pieces:
    """P: the trie of the pieces over symbols (numbered characters), and the weights of its arcs.

    Pieces are numbered from 0, first those of the vocabulary; a character that is part of a piece and none itself is a
    piece without an id. ``other`` stands for all characters that are in no piece.
    """

    def __init__(self, id_of: dict[str, int], score: list[float], *, merges: bool):
        self.symbol = {c: i for i, c in enumerate(sorted({c for p in id_of for c in p}))}
        self.symbol_of = np.full(0x110000, len(self.symbol), np.int32)  # by code point
        self.symbol_of[[ord(c) for c in self.symbol]] = list(self.symbol.values())
        names = [*id_of, *(c for c in self.symbol if c not in id_of)]
        self.known, self.other = len(id_of), len(names)
        self.ids = np.array([*id_of.values(), *[-1] * (len(names) - self.known + 1)], np.int64)
        self.score = np.array([*(score[i] for i in id_of.values()), *[0.0] * (len(names) - self.known + 1)], np.float32)
        number = {p: i for i, p in enumerate(names)}
        self.alone = np.full(len(self.symbol) + 1, self.other)  # the piece of one symbol
        for c, i in self.symbol.items():
            self.alone[i] = number[c]
        self.left, self.right = (np.full(len(names) + 1, -1, np.int64) for _ in range(2))
        spelled = np.ones(len(names), bool)
        if merges:
            for piece, i in id_of.items():
                n = number[piece]
                if len(piece) > 1:
                    last = self._last_merge(piece, id_of, score)
                    spelled[n] = last is not None  # else merging never gives this piece
                    if last:
                        self.left[n], self.right[n] = (number[x] for x in last)
            # The order of merges; characters are there from the start.
            many = np.flatnonzero(self.left >= 0)
            self.rank = np.full(len(names) + 1, -1, np.int64)
            self.rank[many] = np.unique([-score[id_of[names[n]]] for n in many], return_inverse=True)[1]
            if (self.rank[many] < np.maximum(self.rank[self.left[many]], self.rank[self.right[many]])).any():
                raise ValueError("the scores of a BPE model have to be an order of merges: no whole before its parts")
            pairs = {number[p[:k]] * (len(names) + 1) + number[p[k:]]: number[p] for p in (names[n] for n in many) for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
            self.merged = Table(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64))
        keys, final, states = {}, [-1], 1
        for n, piece in enumerate(names):
            if n >= self.known or not spelled[n]:
                continue
            state = 0
            for c in piece:
                key = state * (len(self.symbol) + 1) + self.symbol[c]
                if key not in keys:
                    keys[key] = states
                    final.append(-1)
                    states += 1
                state = keys[key]
            final[state] = n
        self.final, self.arcs = np.array(final, np.int64), Table(np.array(list(keys), np.int64), np.array(list(keys.values()), np.int64))
        self.root = self.arcs.get(np.arange(len(self.symbol) + 1))
        # Pairs met before, where their hash has room: the pair, doubled, plus whether its boundary stays.
        self.met = np.full(1 << 18, -1, np.int64)

    @staticmethod
    def _last_merge(piece: str, id_of: dict[str, int], score: list[float]) -> tuple[str, str] | None:
        """The two parts whose merge is the last one in the text of a piece, or None if merging ends before."""
        parts = list(piece)
        while True:
            best = None
            for k in range(len(parts) - 1):
                i = id_of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or score[i] > best[0]):
                    best = (score[i], k)
            if best is None:
                return None
            k = best[1]
            if len(parts) == 2:
                return parts[0], parts[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def stay_apart(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Does merging the text of p and q leave the boundary between them?"""
        width = self.other + 1
        pairs = p * width + q
        slot = ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)
        known = self.met[slot]
        out = (known & 1).astype(bool)
        new = np.flatnonzero(known >> 1 != pairs)
        if new.size:
            fresh, back = np.unique(pairs[new], return_inverse=True)
            found = self._stay_apart(fresh // width, fresh % width, width)
            out[new] = found[back]
            self.met[slot[new]] = pairs[new] << 1 | out[new]
        return out

    def _stay_apart(self, p: np.ndarray, q: np.ndarray, width: int) -> np.ndarray:
        pairs = p
        apart = np.ones(pairs.size, bool)
        limit = np.full(pairs.size, np.iinfo(np.int64).max)
        todo = np.arange(pairs.size)
        while todo.size:
            a, b = p[todo], q[todo]
            both = self.merged.get(a * width + b)
            crossed = (both >= 0) & (self.rank[both] < limit[todo])
            apart[todo[crossed]] = False
            todo, a, b = todo[~crossed], a[~crossed], b[~crossed]
            # Before the later of the two last merges, the boundary had the inner part of its piece on that side. Of equal
            # ones the left one was first.
            ra, rb = self.rank[a], self.rank[b]
            first = (ra > rb) & (self.left[a] >= 0) | (self.left[b] < 0)
            done = (self.left[a] < 0) & (self.left[b] < 0)
            limit[todo] = np.where(first, ra, rb + 1)
            p[todo], q[todo] = np.where(first & ~done, self.right[a], a), np.where(~first & ~done, self.left[b], b)
            todo = todo[~done]
        return apart


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each run of ``sizes`` places, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if ends.size else 0)


class Lattice:
    """Segments composed with P and B: nodes are places between characters, in the order of segments and places."""

    def __init__(self, pieces: Pieces, segments: list[str] | np.ndarray, sizes: np.ndarray | None = None):
        """``segments``: texts, or with their ``sizes`` their code points in a row."""
        if sizes is None:
            sizes, segments = np.array([len(s) for s in segments], np.int64), code_points("".join(segments))
        none = len(pieces.symbol)
        text = pieces.symbol_of[segments].astype(np.int64)
        owner = np.repeat(np.arange(sizes.size), sizes)
        ends = np.cumsum(sizes)
        self.first = ends - sizes + np.arange(sizes.size)  # the first node of each segment; it has one node more than characters
        place = np.arange(text.size) - np.repeat(ends - sizes, sizes)
        self.nodes = text.size + sizes.size
        room = np.repeat(ends, sizes)
        source, target, piece, spelled = [], [], [], np.zeros(text.size, bool)
        state, at, d = np.zeros(text.size, np.int64), np.arange(text.size), 0
        while at.size:  # all arcs that begin anywhere, a character further each time
            state = pieces.arcs.get(state * (none + 1) + text[at + d]) if d else pieces.root[text]
            alive = state >= 0
            state, at, d = state[alive], at[alive], d + 1
            found = pieces.final[state] >= 0
            source.append(at[found])
            target.append(at[found] + d)
            piece.append(pieces.final[state][found])
            if d == 1:
                spelled[at[found]] = True
            inside = at + d < room[at]
            state, at = state[inside], at[inside]
        bare = np.flatnonzero(~spelled)  # B
        source, target, piece = (np.concatenate(x) for x in ([*source, bare], [*target, bare + 1], [*piece, pieces.alone[text[bare]]]))
        base, end = np.concatenate([owner, [0]]), place[target - 1] + 1
        order = np.lexsort((source, target, end))
        source, target, self.piece = source[order], target[order], piece[order]
        self.source, self.target = source + base[source], target + base[target - 1]
        self.cuts = np.concatenate([[0], np.flatnonzero(np.diff(end[order])) + 1, [order.size]]) if order.size else np.zeros(1, np.int64)
        self.last = self.first + sizes

    def shortest(self, weight) -> tuple[np.ndarray, np.ndarray]:
        """(node before, piece) of each node on its path of least cost; ``weight(piece before, piece)`` gives arrays of
        single precision. Of equal sums the longest piece."""
        cost, before, piece = np.full(self.nodes, np.inf, np.float32), np.full(self.nodes, -1, np.int64), np.full(self.nodes, -1, np.int64)
        cost[self.first] = 0
        for i, j in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            source, target, arc = self.source[i:j], self.target[i:j], self.piece[i:j]
            total = cost[source] + weight(piece[source], arc)
            group = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
            least = np.repeat(np.minimum.reduceat(total, group), np.diff(np.concatenate([group, [target.size]])))
            hit = np.flatnonzero((total == least) & (total < np.inf))
            hit = hit[np.concatenate([[True], target[hit][1:] != target[hit][:-1]])[: hit.size]]
            cost[target[hit]], before[target[hit]], piece[target[hit]] = total[hit], source[hit], arc[hit]
        return before, piece

    def paths(self, weight) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of the segments' paths, the places where they end, and where the paths begin and end in these."""
        before, piece = self.shortest(weight)
        at, who, steps = self.last.copy(), np.arange(self.first.size), []
        while at.size:
            on = at > self.first[who]
            at, who = at[on], who[on]
            steps.append((who, piece[at], at - self.first[who]))
            at = before[at]
        who, pieces, ends = (np.concatenate([s[k] for s in steps][::-1]) if steps else np.empty(0, np.int64) for k in range(3))
        order = np.argsort(who, kind="stable")
        return pieces[order], ends[order], np.searchsorted(who[order], np.arange(self.first.size + 1))


#: Of the segments' hashes, modulo 2^64: the base of the polynomial, an odd number.
BASE = 0x9E3779B97F4A7C15


class Paths:
    """Segments and the ids of their paths, both in a row, and a table from a segment's hash to its number."""

    def __init__(self, room: int):
        self.room, self.used, self.table = room, 0, Table(np.empty(0, np.int64), np.empty(0, np.int64), room=room)
        self.chars, self.ids = np.empty(0, np.uint32), np.empty(0, np.int32)
        self.begins, self.sizes, self.firsts, self.counts = (np.empty(0, np.int64) for _ in range(4))  # of characters and ids

    def full(self) -> bool:
        return max(self.used * 8, self.sizes.size * 4) > self.room * 7 or max(self.chars.size, self.ids.size) > 32 * self.room + 100_000

    def append(self, chars: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
        """The numbers of new segments; without ``keys``, or beyond the room, they can't be looked up."""
        numbers = self.sizes.size + np.arange(sizes.size)
        if keys is not None:
            fit = min(keys.size, self.room - self.used)
            self.table.add(keys[:fit], numbers[:fit])
            self.used += fit
        self.begins = np.concatenate([self.begins, self.chars.size + np.cumsum(sizes) - sizes])
        self.firsts = np.concatenate([self.firsts, self.ids.size + np.cumsum(counts) - counts])
        self.sizes, self.counts = np.concatenate([self.sizes, sizes]), np.concatenate([self.counts, counts])
        self.chars, self.ids = np.concatenate([self.chars, chars]), np.concatenate([self.ids, ids])
        return numbers

    def differ(self, numbers: np.ndarray, text: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which segments of a text, that follow each other without a gap, aren't those of these numbers."""
        same = text == self.chars.take(spread(self.begins[numbers], sizes), mode="clip")
        return np.flatnonzero(~np.logical_and.reduceat(same, begin) | (self.sizes[numbers] != sizes))


class SentencePieceFst:
    """The compiled machines of one model."""

    def __init__(self, model: bytes, cache_size: int = 1 << 18):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.kind = proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if spec.precompiled_charsmap and spec.name != "identity":
            raise ValueError(f"normaliser {spec.name!r} is not supported, only identity")
        if any(p.type == USER_DEFINED for p in proto.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.dummy_prefix = spec.add_dummy_prefix
        self.fold_space = spec.remove_extra_whitespaces
        self.escape = spec.escape_whitespaces
        id_of = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        score = [p.score for p in proto.pieces]
        found = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_ids = [found[f"<0x{b:02X}>"] for b in range(256)] if len(found) == 256 else None
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.unknown_surface = proto.trainer_spec.unk_surface.encode()
        self.pieces = Pieces(id_of, score, merges=self.kind == BPE)
        self.weights = np.where(self.pieces.ids >= 0, -self.pieces.score, np.float32(10.0) - np.float32(min((score[i] for i in id_of.values()), default=0.0))).astype(np.float32)
        inner = any(SPACE in p.lstrip(SPACE) for p in id_of)
        self.cut = not inner  # before spaces; for unigram models
        # Characters by what they may be followed by, or follow, in a piece: 0 for nothing.
        pairs = {pair for p in id_of for pair in zip(p, p[1:], strict=False)}
        self.before, self.after = (np.zeros(0x110000, np.int32) for _ in range(2))
        for of, side in ((self.before, 0), (self.after, 1)):
            for n, c in enumerate(sorted({pair[side] for pair in pairs}), 1):
                of[ord(c)] = n
        self.width = int(self.after.max()) + 1
        self.neighbours = np.zeros((int(self.before.max()) + 1) * self.width, bool)
        for x, y in pairs:
            self.neighbours[self.before[ord(x)] * self.width + self.after[ord(y)]] = True
        #: What each id spells when decoded.
        self.bytes_of = [b""] * len(proto.pieces)
        for i, p in enumerate(proto.pieces):
            if p.type == NORMAL:
                self.bytes_of[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == BYTE:
                self.bytes_of[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == UNKNOWN:
                self.bytes_of[i] = self.unknown_surface
        self.bytes_in_a_row = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.n_bytes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.first_byte = np.cumsum(self.n_bytes) - self.n_bytes
        self.cache_size = cache_size
        self._paths = Paths(cache_size)

    # N
    def normalise(self, text: str) -> str:
        if self.fold_space:
            text = re.sub(" +", " ", text.strip(" "))
        if text and self.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def _weight(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        if self.kind == UNIGRAM:
            return self.weights[piece]
        found = np.zeros(piece.size, np.float32)
        inner = np.flatnonzero(before >= 0)
        found[inner[~self.pieces.stay_apart(before[inner], piece[inner])]] = np.inf
        return found

    def _emit(self, segment: str, pieces: list[int], ends: list[int]) -> tuple[int, ...]:
        """The ids of a path with characters without a piece: these become bytes, or one unknown for a run of them."""
        out, unknown = [], False
        for n, end in zip(pieces, ends, strict=True):
            known = n >= 0
            if known:
                out.append(n)
            elif self.byte_ids is not None:
                out.extend(self.byte_ids[b] for b in segment[end - 1].encode())
            elif not unknown or self.kind == BPE:
                out.append(self.unknown)
            unknown = not known
        return tuple(out)

    def _search(self, text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the paths of segments, which lie in a row, and how many each has; searched 8,000 together."""
        found, counts, ends = [], [], np.cumsum(sizes)
        for at in range(0, sizes.size, 8_000):
            own = sizes[at : at + 8_000]
            part = text[ends[at] - own[0] : ends[at + own.size - 1]]
            pieces, places, stops = Lattice(self.pieces, part, own).paths(self._weight)
            ids, count, done = self.pieces.ids[pieces], np.diff(stops), 0
            begin = np.cumsum(own) - own
            for n in np.unique(np.searchsorted(stops, np.flatnonzero(ids < 0), "right") - 1).tolist():
                a, b = stops[n], stops[n + 1]
                segment = part[begin[n] : begin[n] + own[n]].tobytes().decode("utf-32-le", "surrogatepass")
                emitted = self._emit(segment, ids[a:b].tolist(), places[a:b].tolist())
                found += [ids[done:a], np.array(emitted, np.int64)]
                count[n], done = len(emitted), b
            found.append(ids[done:])
            counts.append(count)
        return np.concatenate(found).astype(np.int32), np.concatenate(counts)

    def _cuts(self, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where the segments of texts begin that lie in a row and begin at ``starts``."""
        new = np.zeros(text.size, bool)
        new[starts] = True
        if self.kind == BPE:
            new[1:] |= ~self.neighbours[self.before[text[:-1]] * self.width + self.after[text[1:]]]
        elif self.cut:
            new[1:] |= (text[1:] == ord(SPACE)) & (text[:-1] != ord(SPACE))
        return np.flatnonzero(new)

    def encode_row(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's end."""
        plain = [self.normalise(t) for t in texts]
        ends, text = np.cumsum([len(t) for t in plain], dtype=np.int64), code_points("".join(plain))
        if not text.size:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        begin = self._cuts(text, np.concatenate([[0], ends[ends < text.size]]))
        sizes = np.diff(begin, append=text.size)
        # A polynomial over the characters; sums up to a place differ by that of a segment times a power.
        power, back = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(text.size - 1, x % (1 << 64), np.uint64)])) for x in (BASE, pow(BASE, -1, 1 << 64)))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text + np.uint64(1)) * power)])
        keys = ((total[begin + sizes] - total[begin]) * back[begin] & np.uint64((1 << 63) - 1)).astype(np.int64)
        if self._paths.full():
            self._paths = Paths(self.cache_size)
        paths = self._paths
        number = paths.table.get(keys)
        new = np.flatnonzero(number < 0)
        if new.size:
            own, first, where = np.unique(keys[new], return_index=True, return_inverse=True)
            first = new[first]
            number[new] = self._add(text[spread(begin[first], sizes[first])], sizes[first], own)[where]
        other = paths.differ(number, text, begin, sizes)
        if other.size:  # their hash is that of another segment
            number[other] = self._add(text[spread(begin[other], sizes[other])], sizes[other], None)
        counts = paths.counts[number]
        so_far = np.concatenate([[0], np.cumsum(counts)])
        return paths.ids[spread(paths.firsts[number], counts)], so_far[np.searchsorted(begin, ends)]

    def _add(self, chars: np.ndarray, sizes: np.ndarray, keys: np.ndarray | None) -> np.ndarray:
        return self._paths.append(chars, sizes, *self._search(chars, sizes), keys)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        ids, ends = self.encode_row(texts)
        return [ids[a:b].tolist() for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode_row(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of ids that lie in a row and end at ``ends``."""
        sizes = self.n_bytes[ids]
        data = self.bytes_in_a_row[spread(self.first_byte[ids], sizes)].tobytes()
        stops = np.concatenate([[0], np.cumsum(sizes)])[ends].tolist()
        out = [data[a:b].decode("utf-8", "replace") for a, b in zip([0, *stops], stops, strict=False)]
        return [t[1:] if t[:1] == " " else t for t in out] if self.dummy_prefix else out

    def decode(self, ids: list[int]) -> str:
        return self.decode_row(np.array(ids, np.int64), np.array([len(ids)]))[0]


@lru_cache(maxsize=2)
def compiled(model: bytes) -> SentencePieceFst:
    """Once per Python worker."""
    return SentencePieceFst(model)


def _portions(texts: list[str], chars: int = 500_000) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``chars`` characters at most, or one text."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > chars:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    yield part


def encode_decode(docs: DataFrame, model: bytes, text: str = "text", *, decoded: bool = False) -> DataFrame:
    """Adds ``ids`` array<int>, ``n_ids`` and ``round_trip`` (does decoding give the text back),
    with ``decoded`` also ``decoded_text``.

    A null text has null ids, n_ids 0 and round_trip true; an empty one empty ids. Columns of
    these names that the input has are replaced. Rows never leave their partition: no shuffle.
    """
    added = ["ids", "n_ids", "round_trip"] + ["decoded_text"] * decoded
    kept = docs.drop(*[c for c in added if c != text])
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.IntegerType()), T.StructField("round_trip", T.BooleanType())]
    schema = T.StructType(kept.schema.fields + fields + [T.StructField("decoded_text", T.StringType())] * decoded)
    compiled(model)  # an unsupported model fails here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                there = [t for t in texts if t is not None]
                ids, counts, decoded_there = [np.empty(0, np.int32)], [], []
                for part in _portions(there):
                    own, stops = fst.encode_row(part)
                    ids.append(own)
                    counts.extend(np.diff(stops, prepend=0).tolist())
                    decoded_there.extend(fst.decode_row(own, stops))
                n_ids, back, ends = iter(counts), iter(decoded_there), [0]
                back = [None if t is None else next(back) for t in texts]
                for t in texts:
                    ends.append(ends[-1] + (0 if t is None else next(n_ids)))
                same = [a == b for a, b in zip(texts, back, strict=True)]
                offsets = pa.array([None if t is None else e for t, e in zip(texts, ends, strict=False)] + [ends[-1]], pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))
                columns = [*batch.columns, lists, pa.array(np.diff(ends).astype(np.int32)), pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(back, pa.string())] * decoded, [*batch.schema.names, *added])
        give_back()

    return kept.mapInArrow(run, schema)
