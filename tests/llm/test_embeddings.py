"""Collision counting against all pairs, on planted pairs around the threshold and on broken vectors."""

import numpy as np
import pytest
from test_operators import components

from sonolake.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, key string, n string"


def planted(rng, n, dim, cos):
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((n, dim))
    y -= (x * y).sum(1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    return x, cos[:, None] * x + np.sqrt(1 - cos**2)[:, None] * y


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    x, y = planted(rng, 4000, 64, np.full(4000, 0.9002))
    found = np.zeros(4000, bool)
    for i, j in embeddings.link(x[:, :], y, False):
        assert ((x[i] * y[j]).sum(1) >= 0.9 - 1e-9).all()
        found[i[i == j]] = True
    assert found.mean() >= 0.99


def test_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    x, y = planted(rng, 150, 64, rng.uniform(0.85, 1.0, 150))
    v = [*x.astype(np.float32), *(3 * y[:100]).astype(np.float32), *x[:9].astype(np.float32), *[x[0].astype(np.float32)] * 30]
    rows = [(i, [float(c) for c in e]) for i, e in enumerate(v)]
    broken = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [float("inf")] * 64]
    rows += [(1000 + i, e) for i, e in enumerate(broken)] + [(2000, [1.0, 0.0]), (2001, [2.0, 0.1])]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame([(*r, 0, "a", "b") for r in rows], SCHEMA), tile=40, cell=30).collect()}
    a = np.array(v, np.float64)
    a /= np.linalg.norm(a, axis=1)[:, None]
    near = a @ a.T >= 0.9
    np.fill_diagonal(near, False)
    want = components(range(len(v)), zip(*(k.tolist() for k in np.nonzero(near))))
    assert len(got) == len(rows)
    for i in range(len(v)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum(), want[i], want[i] == i)
    for i in range(len(broken)):
        assert (got[1000 + i]["n_links"], got[1000 + i]["component_id"], got[1000 + i]["kept"]) == (0, 1000 + i, True)
    assert got[2001]["component_id"] == 2000
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_cells_lose_few_threshold_pairs():
    """Pairs at the threshold of which one end reaches the other's cell; and how many cells are asked."""
    rng = np.random.default_rng(8)
    x, y = planted(rng, 3000, 64, np.full(3000, 0.9002))
    for g in (1, 4, 9):
        (hx, cx), (hy, cy) = (embeddings.sides_of(v, np.zeros(64), g) for v in (x, y))
        crossed = ((hx ^ hy)[:, None] >> np.arange(g)) & 1
        most = embeddings.reach(64, g)
        ways = ((crossed * cx).sum(axis=1) <= most).astype(int) + ((crossed * cy).sum(axis=1) <= most)
        assert (ways > 0).mean() >= 0.99
        for k in range(200):
            cells = embeddings.reached(int(hx[k]), cx[k], most).tolist()
            want = [c for c in range(1 << g) if sum(int(cx[k, b]) for b in range(g) if (c ^ int(hx[k])) >> b & 1) <= most]
            assert sorted(cells) == want and cells[0] == hx[k]


def test_doubles_of_any_size(spark):
    rows = [(1, [1e300, 0.0, 1e299]), (2, [1e300, 0.0, 1e299]), (3, [1e-300, 0.0, 1e-301]), (4, [0.0, 1.0, 0.0]), (4, [-0.0, 1.0, 0.0]), (None, [0.0, 2.0, 0.0])]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 2, 4), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 2, 4), (4, 2, 4)]


def test_recall_over_cells(spark):
    """Links of a table over many cells against all pairs; every pair counts once."""
    rng = np.random.default_rng(9)
    x, y = planted(rng, 1500, 64, rng.uniform(0.9, 0.95, 1500))
    v = np.concatenate([x, y]).astype(np.float32)
    got = embeddings.near_duplicates(spark.createDataFrame([(i, [float(c) for c in e]) for i, e in enumerate(v)], "vec_id long, embedding array<float>"), tile=64, cell=40).collect()
    a = v.astype(np.float64)
    a /= np.linalg.norm(a, axis=1)[:, None]
    near = a @ a.T >= 0.9
    np.fill_diagonal(near, False)
    found = np.array([r["n_links"] for r in sorted(got, key=lambda r: r["vec_id"])])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.99 * near.sum() and found.max() == near.sum(axis=1).max()


def test_cells_lose_no_pair():
    """Of every pair at the threshold one end reaches the other's cell, wherever the mean lies."""
    rng = np.random.default_rng(10)
    for dim in (3, 8, 64):
        x, y = planted(rng, 20_000, dim, np.full(20_000, 0.9))
        for g in [k for k in (1, 2, 3, 6, 9) if k <= dim]:
            for mean in (np.zeros(dim), x[0] / 3):
                (hx, cx), (hy, cy) = (embeddings.sides_of(v, mean, g) for v in (x, y))
                crossed = ((hx ^ hy)[:, None] >> np.arange(g)) & 1
                most = embeddings.reach(dim, g)
                assert (np.minimum((crossed * cx).sum(axis=1), (crossed * cy).sum(axis=1)) <= most).all()


@pytest.mark.parametrize("dim,sides", [(64, None), (64, 5), (8, 4)])
def test_results_do_not_depend_on_the_cells(spark, monkeypatch, dim, sides):
    """One cell and many give the same rows, and so does a table to which far vectors are added."""
    rng = np.random.default_rng(11)
    x, y = planted(rng, 1200, dim, np.full(1200, 0.9002))
    v, more = np.concatenate([x, y]).astype(np.float32), 40 * rng.standard_normal((2000, dim)).astype(np.float32)
    if sides:
        monkeypatch.setattr(embeddings, "best_sides", lambda sample, mean, n, cell: sides)

    def run(vectors, cell):
        rows = [(i, [float(c) for c in e]) for i, e in enumerate(vectors)]
        return sorted(map(tuple, embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), tile=512, cell=cell).collect()))

    want = run(v, 1 << 20)
    assert run(v, 40) == want
    if dim == 64:  # nothing that is added is near
        assert run(np.concatenate([v, more]), 1000)[: len(v)] == want


def test_tiles_meet_in_groups(spark, monkeypatch):
    """However many groups tiles are met in, every pair counts once."""
    rng = np.random.default_rng(12)
    x, y = planted(rng, 400, 64, rng.uniform(0.9, 1.0, 400))
    table = spark.createDataFrame([(i, [float(c) for c in e]) for i, e in enumerate(np.concatenate([x, y, x[:50]]))], "vec_id long, embedding array<double>")
    got = []
    for groups, together in ((32, 1), (3, 32), (1, 32), (2, 3)):
        monkeypatch.setattr(embeddings, "GROUPS", groups)
        monkeypatch.setattr(embeddings, "TOGETHER", together)
        got.append(sorted(map(tuple, embeddings.near_duplicates(table, tile=64).collect())))
    assert got[1:] == got[:1] * 3 and sum(r[1] for r in got[0]) >= 0.99 * (800 + 200)
