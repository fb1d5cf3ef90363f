import numpy as np
import pytest

from logstrata.llm import subspace_join as sj


def brute(rows, threshold=0.95):
    """rows: (id, vector or None); n_links and component_id of each row."""
    units = []
    for _, v in rows:
        a = None if v is None or None in v or not len(v) else np.array(v, float)
        units.append(None if a is None or not np.isfinite(a).all() or not a.any() else a / np.linalg.norm(a))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b >= threshold:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), k), k)
    return sorted((k, links[i], least[root(i)]) for i, (k, _) in enumerate(rows))


def run(spark, rows, **options):
    df = spark.createDataFrame([(k, v, 7, "x") for k, v in rows], "vec_id long, embedding array<float>, label int, n_links string")
    found = sj.join_vectors(df, **options).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    return sorted((r.vec_id, r.n_links, r.component_id) for r in found)


def as_float32(v):
    return [float(x) for x in np.asarray(v, np.float32)]


@pytest.mark.parametrize("size", [64, 16, 5, 1])
def test_equals_brute_force(spark, size):
    rng = np.random.default_rng(size)
    centres = rng.standard_normal((6, size))
    rows = []
    for i in range(240):
        v = centres[i % 6] + rng.standard_normal(size) * rng.choice([0.05, 0.15, 0.25, 2.0])
        rows.append((i * 3 % 241, as_float32(v)))
    assert run(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1e-30, 0.0]), (11, [1e30, 0.0]), (12, [-1.0, -0.0]), (13, [-2.0, 0.0])]
    assert run(spark, rows) == brute(rows)


def test_chains_copies_and_crowds(spark, monkeypatch):
    """A chain whose ends aren't alike, many copies, and cells that are split into chunks and compared across cuts."""
    monkeypatch.setattr(sj, "CHUNK", 16)
    monkeypatch.setattr(sj, "CELL", 8)
    angle = np.arccos(0.96)
    rows = [(100 + i, as_float32([np.cos(i * angle), np.sin(i * angle)] + [0.0] * 14)) for i in range(12)]
    rows += [(i, as_float32([0.0] * 15 + [1.0])) for i in range(40)]
    rng = np.random.default_rng(3)
    rows += [(200 + i, as_float32(np.ones(16) + rng.standard_normal(16) * 0.1)) for i in range(150)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert sj.join_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert run(spark, [(5, None)]) == [(5, 0, 5)]


@pytest.mark.parametrize("cell", [4, 0.25])
def test_small_cells_and_small_tasks(spark, monkeypatch, cell):
    """Coordinates cut in two and in four, tasks of a few vectors; every pair is counted in one block."""
    for name, value in (("CHUNK", 8), ("OTHERS", 20), ("CELL", cell)):
        monkeypatch.setattr(sj, name, value)
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((9, 16))
    rows = [(i, as_float32(centres[i % 9] + rng.standard_normal(16) * rng.choice([0.05, 0.2, 1.0]))) for i in range(300)]
    rows += [(1000 + i, as_float32(np.eye(16)[0] + 1e-4 * rng.standard_normal(16))) for i in range(60)]
    assert run(spark, rows) == brute(rows)


def test_cells_within_reach_are_all_found():
    rng = np.random.default_rng(2)
    points = rng.standard_normal((200, 8)) * 0.12
    cuts = sj.block_cuts(points, 1 << 21)
    assert [len(c) for c in cuts] == [3, 3, 3, 1, 1, 1, 1, 1]
    grid = sj.Grid(8, 0.95, [cuts])
    own, others = grid.cells(points, 0)
    far = ((points[:, None] - points[None]) ** 2).sum(2)
    for i, j in np.argwhere(far <= grid.budgets[0]):
        assert own[i] == own[j] or (own[j] in others[i]) == (own[j] > own[i])
        assert own[i] >= own[j] or own[j] in others[i]
