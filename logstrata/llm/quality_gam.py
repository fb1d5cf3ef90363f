"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into quantile bins. Training visits the features
in turn, again and again; each visit fits a shallow regression tree on one
feature's bins to the current gradient and adds a small part of it to that
feature's lookup table, so a table is the sum of its trees. Then the pairs with
the largest remaining gain get two-dimensional tables in the same way. A score
is the logistic of the intercept plus one addition per table.

Features come from the text alone. Training rows are a bounded sample
(``max_rows``, smallest hashes of doc_id first) of the labelled rows that are
not held out; scoring covers every row and whole texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logstrata.llm.scratch import give_back

FEATURES = (
    "log_bytes", "log_words", "bytes_per_word", "upper_share", "digit_share", "symbols_per_word", "pipes_per_word", "shouts_per_word",
    "marks_per_word", "stops_per_word", "distinct_words", "top_word_share", "repeated_lines", "words_per_line", "wide_share", "entropy", "longest_word",
)
_SYMBOLS = np.frombuffer(b"#$%&*@^~<>=+_{}[]\\/", np.uint8)


def features(text: str | None) -> list[float]:
    """All zeros for a null or empty text."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    hist = np.bincount(raw, minlength=256)
    n = raw.size
    words = text.split()
    w = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    letters = hist[65:91].sum() + hist[97:123].sum()
    p = hist[hist > 0] / n
    return [
        math.log1p(n),
        math.log1p(len(words)),
        n / w,
        hist[65:91].sum() / max(1, letters),
        hist[48:58].sum() / n,
        hist[_SYMBOLS].sum() / w,
        hist[124] / w,
        hist[33] / w,
        (hist[44] + hist[58] + hist[59] + hist[63]) / w,
        hist[46] / w,
        len(counts) / w,
        max(counts.values(), default=0) / w,
        1 - len(set(lines)) / max(1, len(lines)),
        w / max(1, len(lines)),
        hist[128:].sum() / n,
        float(-(p * np.log2(p)).sum()),
        math.log1p(max(map(len, counts), default=0)),
    ]


@dataclass
class Gam:
    """Lookup tables; the model is some kilobytes whatever the corpus."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], "right")]
        coarse = {f: np.searchsorted(self.pair_edges[f], x[:, f], "right") for f in {f for p in self.pairs for f in p}}
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def _quantile_edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, l2: float, leaf: float) -> np.ndarray:
    """A tree of up to three leaves over ordered bins: the value for each bin."""
    k = len(g)
    cuts = [0, k]
    for _ in range(2):
        best = (1e-12, -1)
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi - lo < 2:
                continue
            gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
            gt, ht = g[lo:hi].sum(), h[lo:hi].sum()
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < leaf) | (ht - hl < leaf)] = -1
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], lo + at + 1)
        if best[1] < 0:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(k)
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + l2)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """The best cut of each side of a two-dimensional histogram: gain and the value for each cell."""
    best, value = 0.0, np.zeros_like(g)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    gt, ht = cg[-1, -1], ch[-1, -1]
    i, j = np.meshgrid(range(g.shape[0] - 1), range(g.shape[1] - 1), indexing="ij")
    if not i.size:
        return best, value
    parts = []
    for c in (cg, ch):
        a, top, left, t = c[i, j], c[i, -1], c[-1, j], c[-1, -1]
        parts.append((a, top - a, left - a, t - top - left + a))
    gain = sum(x**2 / (y + l2) for x, y in zip(*parts, strict=True)) - gt**2 / (ht + l2)
    at = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if gain[at] > 0:
        best = float(gain[at])
        v = [float(x[at] / (y[at] + l2)) for x, y in zip(*parts, strict=True)]
        r, c = at[0] + 1, at[1] + 1
        value[:r, :c], value[:r, c:], value[r:, :c], value[r:, c:] = v
    return best, value


def train(x: np.ndarray, y: np.ndarray, *, bins: int = 64, rounds: int = 150, rate: float = 0.08, n_pairs: int = 6, pair_bins: int = 12, pair_rounds: int = 60, l2: float = 2.0, leaf: float = 1.0) -> Gam:
    """With no rows, or labels of one kind only, the score is their smoothed share everywhere."""
    k = x.shape[1]
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(math.log(share / (1 - share)), [np.empty(0)] * k, [np.zeros(1)] * k, [], [np.empty(0)] * k, [])
    if len(y) == 0 or y.min() == y.max():
        return model
    model.edges = [_quantile_edges(x[:, f], bins) for f in range(k)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    total = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for f in range(k):
            p = 1 / (1 + np.exp(-total))
            size = len(model.tables[f])
            step = rate * _tree(np.bincount(at[f], y - p, size), np.bincount(at[f], p * (1 - p), size), l2, leaf)
            model.tables[f] += step
            total += step[at[f]]
    model.pair_edges = [_quantile_edges(x[:, f], pair_bins) for f in range(k)]
    coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.pair_edges)]
    sizes = [len(e) + 1 for e in model.pair_edges]

    def pair_tree(a: int, b: int) -> tuple[float, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        cell = coarse[a] * sizes[b] + coarse[b]
        shape = (sizes[a], sizes[b])
        g = np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape)
        h = np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)
        return *_quadrants(g, h, l2), cell

    ranked = sorted(((pair_tree(a, b)[0], -a, -b) for a in range(k) for b in range(a + 1, k)), reverse=True)
    model.pairs = [(-a, -b) for gain, a, b in ranked[:n_pairs] if gain > 0]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            _, value, cell = pair_tree(a, b)
            table += rate * value
            total += rate * value.ravel()[cell]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _vectors(batch: pa.RecordBatch, text: str) -> np.ndarray:
    values = batch.column(batch.schema.get_field_index(text))
    return np.array([features(v.as_py()) for v in values], dtype=float).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000) -> Gam:
    """Learns from at most ``max_rows`` labelled documents outside the held-out fold. Rows without a label or text are not
    learnt from; of several labels of one id the least counts, and of several texts the one with the least features."""
    usable = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0.0, 1.0) & ~held_out(F.col("_id")))
    usable = usable.groupBy("_id").agg(F.min("_y").alias("_y"))
    spread = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    there = usable.count()
    if there > max_rows:
        # The fraction leaves a few more than enough, so that the exact cut sorts little.
        usable = usable.where(spread < math.ceil((1 << 30) * 1.1 * max_rows / there)).orderBy(spread, "_id", "_y").limit(max_rows)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    rows = rows.join(F.broadcast(usable), "_id")  # of max_rows rows at most
    schema = T.StructType([rows.schema["_id"], *[T.StructField(f, T.DoubleType()) for f in ("_y", *FEATURES)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("_id", "_y")]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, _vectors(batch, "_text").T)], schema.fieldNames())
        give_back()

    # One row for each id before anything comes to the driver: max_rows at most.
    found = rows.mapInArrow(run, schema).groupBy("_id").agg(F.min(F.struct("_y", *FEATURES)).alias("row")).select("row.*").toArrow()
    data = np.column_stack([c.to_numpy() for c in found.columns]) if found.num_rows else np.zeros((0, 1 + len(FEATURES)))
    data = data[np.lexsort(data.T[::-1])]  # the order of rows must not change the sums
    return train(data[:, 1:], data[:, 0])


def score(docs: DataFrame, model: Gam, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Adds ``held_out``, ``score`` and ``predicted`` to every row; columns of these names are replaced.

    Null and empty texts get the score of all-zero features. One pass, no shuffle.
    """
    kept = docs.drop("held_out", "score", "predicted")
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(_vectors(batch, text)))], schema.fieldNames())
        give_back()

    scored = kept.mapInArrow(run, schema)
    return scored.withColumns({"held_out": held_out(F.col(doc_id)), "predicted": (F.col("score") >= threshold).cast("int")})
