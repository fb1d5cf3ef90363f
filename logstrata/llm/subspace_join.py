"""Exact cosine join of vectors by a subspace pigeonhole.

Unit vectors with cosine of at least t have a squared distance of at most
d2 = 2 - 2t. A seeded rotation spreads each vector evenly over its coordinates,
which are split into blocks; each block gets a part of d2 in proportion to its
number of coordinates. If every block of a pair were beyond its part, their sum
would be beyond d2, so a pair that holds is within budget in some block. Each
block is range-joined under its budget, and the union of what is found is
verified by the cosine in double precision. A pair is counted in the first
block that is within budget, so nothing is collected to be made distinct.

The range join of a block lays a grid on its coordinates, cut at quantiles of the
sample that fixes the grid (any cuts give the same result): first each coordinate
in two, then in four and so on. A vector is a target in its own cell and a probe
in each cell after its own that is within reach of it, found coordinate by
coordinate within what the budget leaves. The number of cuts grows with the
number of vectors, so cells keep their size. Cells are dealt out in chunks of
targets and chunks of what these are compared with, so a task holds a bounded
number of vectors whatever crowds there are. Tasks return counts of links per
vector and a spanning forest of their links, never the pairs.

Equal vectors are one class with a weight, so copies cost nothing further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logstrata.llm.components import components
from logstrata.llm.scratch import Scratch, join_back

BLOCK = 8
#: Targets of a cell on average, targets of a task at most, and other vectors that a task compares them with on average.
CELL, CHUNK, OTHERS = 1024, 2048, 8192
_SLACK = 1e-9


def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(20_240_601 + size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def block_bounds(size: int) -> np.ndarray:
    return np.linspace(0, size, max(1, round(size / BLOCK)) + 1).astype(int)


def encode(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): the components as bytes of doubles; null for a vector that links with nothing."""
    schema = T.StructType([T.StructField("vec_id", vectors.schema[vec_id].dataType), T.StructField("v", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1):
                value = value.values
                if value is None or not len(value) or value.null_count:
                    out.append(None)
                    continue
                x = value.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0.0 is 0.0
                out.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "v"])

    return vectors.select(vec_id, embedding).mapInArrow(run, schema)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _units(raw: list[bytes]) -> np.ndarray:
    return _unit(np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1))


class Grid:
    """Of one vector length: the blocks, their budgets and the cells of their grids."""

    def __init__(self, size: int, threshold: float, cuts: list[list[np.ndarray]]):
        self.bounds = block_bounds(size)
        self.turn = rotation(size)
        widths = np.diff(self.bounds)
        self.budgets = (2 - 2 * threshold) * widths / size + _SLACK
        self.cuts = cuts  # of each block, of each coordinate: where it is cut

    def within(self, x: np.ndarray, y: np.ndarray, block: int) -> np.ndarray:
        """Which pairs of turned rows are within budget in a block: the one test for this, by the difference itself."""
        low, high = self.bounds[block], self.bounds[block + 1]
        return ((x[:, low:high] - y[:, low:high]) ** 2).sum(1) <= self.budgets[block]

    def cells(self, turned: np.ndarray, block: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The own cell of each row, and for each the cells after it that are within reach."""
        low = self.bounds[block]
        own, row, cell, cost = np.zeros(len(turned), np.int64), np.arange(len(turned)), np.zeros(len(turned), np.int64), np.zeros(len(turned))
        for c, cuts in enumerate(self.cuts[block]):
            x, n = turned[:, low + c], len(cuts) + 1
            own = own * n + np.searchsorted(cuts, x, "right")
            # To reach an interval, a row has to go to its nearer end.
            ends = np.concatenate([[-np.inf], cuts, [np.inf]])
            far = np.maximum(0, np.maximum(ends[:-1] - x[:, None], x[:, None] - ends[1:])) ** 2
            cost = (cost[:, None] + far[row]).ravel()
            row, cell = np.repeat(row, n), (cell[:, None] * n + np.arange(n)).ravel()
            near = cost <= self.budgets[block] + _SLACK
            row, cell, cost = row[near], cell[near], cost[near]
        later = cell > own[row]
        row, cell = row[later], cell[later]
        return own, np.split(cell, np.cumsum(np.bincount(row, minlength=len(turned)))[:-1]) if len(turned) else []


def block_cuts(sample: np.ndarray, n: int) -> list[np.ndarray]:
    """The cuts of each coordinate for n vectors in cells of CELL: as many halvings as that takes, dealt out in turn."""
    halvings, width = max(0, int(np.ceil(np.log2(max(1, n) / CELL)))), sample.shape[1]
    each = [halvings // width + (c < halvings % width) for c in range(width)]
    return [np.unique(np.quantile(sample[:, c], np.arange(1, 1 << h) / (1 << h))) for c, h in enumerate(each)]


def _pairs(a: np.ndarray, b: np.ndarray, grid: Grid, block: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows of a with rows of b (turned unit vectors) that are first within budget in this block."""
    low, high = grid.bounds[block], grid.bounds[block + 1]
    x, y = a[:, low:high], b[:, low:high]
    d2 = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    i, j = np.nonzero(d2 <= grid.budgets[block] + _SLACK)  # with room for its rounding
    keep_i, keep_j = [], []
    for at in range(0, i.size, 1 << 17):
        m, n = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
        p, q = a[m], b[n]
        ok = np.einsum("ij,ij->i", p, q) >= threshold - 1e-7
        m, n, p, q = m[ok], n[ok], p[ok], q[ok]
        first = grid.within(p, q, block)
        for earlier in range(block):
            first &= ~grid.within(p, q, earlier)
        keep_i.append(m[first])
        keep_j.append(n[first])
    return (np.concatenate(keep_i), np.concatenate(keep_j)) if keep_i else (np.empty(0, int), np.empty(0, int))


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links connect."""
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def join_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    n_links counts the other rows with cosine >= ``threshold`` (equal vectors among them), in doubles.
    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing;
    vectors of different lengths don't link. component_id is the least vec_id of the rows that links
    reach; kept says that it is the row's own. Repeated rows are rows of their own. Other columns are
    not read. ``threshold`` is above 0.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = scratch.table(encode(vectors, vec_id, embedding).withColumn("class", F.xxhash64("v")), "rows")
    # A class is named by a hash of 64 bits; the bytes decide what is in it.
    least = rows.where(F.col("v").isNotNull()).groupBy("v").agg(F.first("class").alias("class"), F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    classes = scratch.table(least, "classes")
    doubled = classes.groupBy("class").count().where("count > 1").limit(1).count()
    if doubled:
        raise ValueError("two different vectors have the same 64-bit hash; use another hash for the class")
    grids: dict[int, Grid] = {}
    for size, n in classes.groupBy((F.octet_length("v") / 8).cast("int")).count().collect():  # a row for each vector length
        sample = classes.where(F.octet_length("v") == size * 8).select("v").orderBy("class").limit(2048).toPandas()
        turned = _units(list(sample.v)) @ rotation(size)
        bounds = block_bounds(size)
        grids[size] = Grid(size, threshold, [block_cuts(turned[:, a:b], n) for a, b in zip(bounds, bounds[1:], strict=False)])
    place_schema = "size int, block int, cell long, probe boolean, class long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                raw = batch.column(batch.schema.get_field_index("v")).to_pylist()
                ids = np.array(batch.column(batch.schema.get_field_index("class")).to_pylist(), np.int64)
                lengths = np.array([len(v) // 8 for v in raw])
                out: list[list[np.ndarray]] = [[], [], [], [], []]
                for size in np.unique(lengths):
                    grid, mine = grids[int(size)], np.flatnonzero(lengths == size)
                    turned = _units([raw[m] for m in mine]) @ grid.turn
                    for block in range(len(grid.budgets)):
                        own, others = grid.cells(turned, block)
                        counts = [o.size for o in others]
                        cells = np.concatenate([own, *others])
                        for c, v in zip(out, (np.full(cells.size, size), np.full(cells.size, block), cells, np.arange(cells.size) >= own.size, np.r_[ids[mine], np.repeat(ids[mine], counts)]), strict=True):
                            c.append(v)
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], k) for c, k in zip(out, kinds, strict=True)], ["size", "block", "cell", "probe", "class"])

    # Without the vectors: a row per class and cell that it takes part in.
    placed = scratch.table(classes.select("class", "v").mapInArrow(place, place_schema), "placed")
    where = ["size", "block", "cell"]
    crowd = placed.groupBy(*where).agg(F.count_if(~F.col("probe")).alias("targets"), F.count("*").alias("all")).where("targets > 0")
    crowd = crowd.select(*where, F.ceil(F.col("targets") / CHUNK).cast("int").alias("chunks"), F.ceil(F.col("all") / OTHERS).cast("int").alias("parts"))
    spread = join_back(placed, crowd, "cell", beside=("size", "block"))  # a cell without targets has nothing to be compared with
    own = F.pmod(F.xxhash64("class", "block"), F.col("chunks")).cast("int")
    part = F.pmod(F.xxhash64("class", "block", F.lit(1)), F.col("parts")).cast("int")
    # A target stands in each part of its chunk and is a probe of the chunks after it; a probe of another cell goes to all
    # chunks. Of a chunk's probes each part has some.
    mine = F.when(~F.col("probe"), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(own.alias("chunk"), p.alias("part"), F.lit(False).alias("probe"))))
    first = F.when(F.col("probe"), F.lit(0)).otherwise(own + 1)
    others = F.when(first < F.col("chunks"), F.transform(F.sequence(first, F.col("chunks") - 1), lambda c: F.struct(c.alias("chunk"), part.alias("part"), F.lit(True).alias("probe"))))
    none = F.array().cast("array<struct<chunk:int,part:int,probe:boolean>>")
    spread = spread.select(*where, "class", F.inline(F.concat(F.coalesce(mine, none), F.coalesce(others, none))))
    filled = spread.join(classes.select("class", "v", "weight"), "class")

    def compare(table: pa.Table) -> pa.Table:
        size, block, part = (table.column(c)[0].as_py() for c in ("size", "block", "part"))
        grid = grids[size]
        probe = np.array(table.column("probe").to_pylist(), bool)
        ids, weight = table.column("class").to_numpy(), table.column("weight").to_numpy()
        order = np.lexsort((ids, probe))  # targets first
        probe, ids, weight = probe[order], ids[order], weight[order]
        raw = np.frombuffer(b"".join(v.as_py() for v in table.column("v")), np.float64).reshape(len(ids), size)[order]
        del table
        unit = _unit(raw)
        turned = unit @ grid.turn
        t = int((~probe).sum())
        links = np.zeros(len(ids), np.int64)
        edges: list[tuple[int, int]] = []
        for at in range(0, len(ids), CHUNK):
            rows = slice(at, min(at + CHUNK, len(ids)))
            # Targets with later targets, then all targets with probes.
            for same, x, y in ((True, slice(0, min(t, rows.stop)), slice(rows.start, min(t, rows.stop))), (False, slice(0, t), slice(max(t, rows.start), rows.stop))):
                if x.stop <= x.start or y.stop <= y.start or same and part:  # targets meet in the first part only
                    continue
                i, j = _pairs(turned[x], turned[y], grid, block, threshold)
                i, j = i + x.start, j + y.start
                if same:
                    i, j = i[i < j], j[i < j]
                exact = np.concatenate([(unit[i[s : s + 65536]] * unit[j[s : s + 65536]]).sum(1) for s in range(0, i.size, 65536)] or [np.empty(0)])
                i, j = i[exact >= threshold], j[exact >= threshold]
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                edges += _forest(len(ids), i, j)
        edges = _forest(len(ids), np.array([e[0] for e in edges], int), np.array([e[1] for e in edges], int))
        linked = np.flatnonzero(links)
        a = np.r_[ids[linked], ids[[e[0] for e in edges]].astype(np.int64)]
        b = np.r_[ids[linked], ids[[e[1] for e in edges]].astype(np.int64)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(np.r_[links[linked], np.zeros(len(edges), np.int64)], pa.int64())})

    found = scratch.table(filled.groupBy(*where, "chunk", "part").applyInArrow(compare, "a long, b long, links long"), "found")
    links = found.where("a = b").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    groups = components(found.where("a != b").select("a", "b"), scratch)
    marked = classes.select("class", "least", "weight").join(links, "class", "left").join(groups, F.col("class") == F.col("node"), "left")
    marked = scratch.table(marked.select("class", "least", F.coalesce("component", "class").alias("g"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "marked")
    lowest = marked.groupBy("g").agg(F.min("least").alias("component_id"))
    marked = join_back(marked, lowest, "g").select("class", "n_links", "component_id")
    whole = rows.where(F.col("v").isNotNull()).select("vec_id", "class").join(marked, "class").select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("v").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return whole.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
