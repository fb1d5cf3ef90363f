"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared after lower-casing and with each run of other
characters than letters and digits as one space. An item of m characters is
found in a text where some part of the text is within k = floor(m * rate)
edits of it. The item is split into k + 1 pieces: k edits leave one of them
whole, so every such place has an exact piece hit. An Aho-Corasick automaton
finds all hits of all pieces in one pass over a text; each is verified with
Myers' bit-parallel edit distance, first on up to 64 characters beside the
piece (their distance can't exceed k either) and then on the whole item.

A benchmark of more than ``block_chars`` characters is searched for in blocks, one
after the other, with the rows written down between them, so that a worker holds
the automaton of one block only.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logstrata.llm.scratch import Scratch, give_back

_OTHER = re.compile(r"[\W_]+")
HIT = ("item_id", "distance", "start", "end")


def normalise(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def origins(text: str) -> list[int]:
    """For each character of normalise(text) where it stands in ``text``."""
    at: list[int] = []
    for i, c in enumerate(text):
        for low in c.lower():  # some characters become two, the second of which may be a mark
            if not _OTHER.match(low):
                at.append(i)
            elif at and at[-1] >= 0:
                at.append(-1 - i)
    return [x if x >= 0 else -1 - x for x in at]


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def search(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Myers: the least distance of a pattern of m > 0 characters to a substring of ``text``, and its first end."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    get = peq.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, j + 1
        ph = ph << 1
        pv = (mh << 1 | ~(xv | ph)) & full
        mv = ph & xv & full
    return best, end


class Matcher:
    """The pieces of a block of items."""

    SIDE = 64

    def __init__(self, items: list[tuple], rate: float):
        self.items: list[tuple] = []
        self.sides: dict[tuple[int, int, int], dict[str, int]] = {}
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            plain = normalise(text)
            m = len(plain)
            if not m:
                continue
            k = int(m * rate)
            n = len(self.items)
            self.items.append((item_id, plain, k, masks(plain), masks(plain[::-1])))
            ends = [m * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(ends, ends[1:], strict=False):
                pieces.setdefault(plain[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()

    def _side(self, n: int, a: int, b: int) -> dict[str, int]:
        found = self.sides.get((n, a, b))
        if found is None:
            found = self.sides[n, a, b] = masks(self.items[n][1][a:b])
        return found

    def hits(self, text: str) -> list[tuple]:
        """(item_id, distance, start, end) for each place, with offsets into ``text``. Of overlapping places of one item the nearest, then the first, stays."""
        if not len(self.automaton):
            return []
        plain = normalise(text)
        found: dict[int, list[tuple[int, int, int]]] = {}
        exact: dict[int, tuple[int, int]] = {}  # the last place of each item without edits
        for last, (size, owners) in self.automaton.iter(plain):
            begin, stop = last + 1 - size, last + 1
            for n, offset in owners:
                item_id, item, k, peq, reverse = self.items[n]
                m, after = len(item), offset + size
                mine = found.setdefault(n, [])
                s, e = exact.get(n, (0, 0))
                if s <= begin and stop <= e:
                    continue
                if m - after >= offset:  # the longer side of the piece
                    side = min(self.SIDE, m - after)
                    near = search(self._side(n, after, after + side), side, plain[stop : stop + side + k])[0] if side else 0
                else:
                    side = min(self.SIDE, offset)
                    near = search(self._side(n, offset - side, offset), side, plain[max(0, begin - side - k) : begin])[0]
                if near > k:
                    continue
                low = max(0, begin - offset - k)
                window = plain[low : begin - offset + m + k]
                distance, end = search(peq, m, window)
                if distance > k:
                    continue
                # The start: the same search from the end, over the reversed text.
                back = window[:end][::-1]
                start = end - search(reverse, m, back[: m + distance])[1]
                mine.append((distance, low + start, low + end))
                if not distance:
                    exact[n] = mine[-1][1:]
        out = []
        at_of = origins(text) if any(found.values()) else []
        for n, mine in found.items():
            taken: list[tuple[int, int]] = []  # in order, apart
            for distance, s, e in sorted(set(mine)):
                at = bisect_left(taken, (s, e))
                if (not at or taken[at - 1][1] <= s) and (at == len(taken) or e <= taken[at][0]):
                    insort(taken, (s, e))
                    out.append((self.items[n][0], distance, at_of[s], at_of[e - 1] + 1))
        return sorted(out, key=lambda h: (h[2], h[0], h[1], h[3]))


@lru_cache(maxsize=1)
def _matcher(block: bytes, rate: float) -> Matcher:
    """Once per Python worker and block."""
    return Matcher(pickle.loads(block), rate)


def blocks(benchmark: DataFrame, item_id: str, text: str, chars: int) -> Iterator[list[tuple]]:
    """The items in blocks of at most ``chars`` characters (or one item), in the order of their ids."""
    block, size = [], 0
    rows = benchmark.where(F.col(text).isNotNull()).select(item_id, text).distinct().orderBy(item_id, text)
    for row in rows.toLocalIterator():
        if block and size + len(row[1]) > chars:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block:
        yield block


def find_items(docs: DataFrame, benchmark: DataFrame, *, rate: float = 0.08, text: str = "text", item_id: str = "item_id", item_text: str = "text", hits: str = "hits", block_chars: int = 4_000_000) -> DataFrame:
    """Adds ``hits``, an array of (item_id, distance, start, end), empty where nothing is found.

    A column of that name is replaced. Null and empty texts have no hits; null items and those
    without a letter or digit hit nothing; equal texts under two ids hit under both. Every text is
    searched whole, inside the scan and without a shuffle. Items, whose ids may be of any type, go to
    the tasks in blocks of ``block_chars``; more items mean more passes over the rows, not larger tasks.
    """
    kind = benchmark.schema[item_id].dataType
    type_of = T.ArrayType(T.StructType([T.StructField(n, kind if n == "item_id" else T.IntegerType()) for n in HIT]))
    kept = docs.drop(hits).withColumn(hits, F.lit(None).cast(type_of))
    scratch: Scratch | None = None
    for nth, block in enumerate(blocks(benchmark, item_id, item_text, block_chars)):
        if nth:
            scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
            kept = scratch.table(kept, f"after-{nth}")
            scratch.drop(f"after-{nth - 1}")

        def run(batches: Iterator[pa.RecordBatch], block=pickle.dumps(block)) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(block, rate)
            for batch in batches:
                at, to = batch.schema.get_field_index(text), batch.schema.get_field_index(hits)
                found = []
                for value, before in zip(batch.column(at), batch.column(to).to_pylist(), strict=True):
                    value = value.as_py()
                    mine = [dict(zip(HIT, h, strict=True)) for h in matcher.hits(value)] if value else []
                    found.append((before or []) + mine)
                yield batch.set_column(to, batch.schema.field(to).name, pa.array(found, batch.schema.field(to).type))
            give_back()

        kept = kept.mapInArrow(run, kept.schema)
    return kept.withColumn(hits, F.coalesce(hits, F.array().cast(type_of)))


def matches(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row for each place: doc_id, item_id, distance, start, end."""
    found = find_items(docs, benchmark, **options)
    return found.select(F.col(doc_id).alias("doc_id"), F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows without any hit."""
    return find_items(docs, benchmark, **options).where(F.size("hits") == 0).drop("hits")
