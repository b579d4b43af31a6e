import numpy as np
import pytest

from tidemark.operators import pairs as N
from tidemark.operators.linkage import single_linkage


def brute(a, b, k, p, ids):
    d = N.distances(a, b, p)
    if ids:
        d[ids[0][:, None] == ids[1][None, :]] = np.inf
    d[~np.isfinite(d)] = np.inf
    top = np.argsort(d, axis=1, kind="stable")[:, :k]
    found = np.take_along_axis(d, top, 1)
    kept = np.isfinite(found)
    return np.nonzero(kept)[0], top[kept], found[kept]


@pytest.mark.parametrize("dims", [1, 4, 40])
@pytest.mark.parametrize("p", [1, 2])
def test_tiles_give_all_pairs_to_the_bit(monkeypatch, dims, p):
    """Ties, copies, blobs far from zero, and numbers that are none; tiles smaller than the blocks."""
    monkeypatch.setattr(N, "TILE_ROWS", 37)
    monkeypatch.setattr(N, "TILE_COLUMNS", 53)
    rng = np.random.default_rng(dims)
    plain = lambda n: rng.standard_normal((n, dims))
    odd = plain(200)
    odd[:90], odd[95, 0], odd[97] = 1.0, np.nan, np.inf
    far = lambda n: plain(n) * 1e-3 + rng.integers(0, 3, (n, 1)) * 1e6
    for a, b in [(plain(150), plain(200)), (np.round(plain(150)), np.round(plain(200))), (far(150), far(200)), (odd[:150], odd)]:
        for ids in (None, (rng.integers(0, 200, 150), np.sort(rng.integers(0, 200, 200)))):
            got = N.k_closest(a, b, 7, p, ids)
            assert all(np.array_equal(x, y) for x, y in zip(got, brute(a, b, 7, p, ids)))
    a, b = far(150), far(200)
    member = np.eye(3)[rng.integers(0, 3, 200)]
    assert np.allclose(N.distance_sums(a, b, member), N.distances(a, b) @ member, rtol=1e-9)


def test_cells_instead_of_all_rows(spark, monkeypatch):
    """Few coordinates: no task is given all pairs of blocks, however many rows are equal."""
    rng = np.random.default_rng(4)
    x = np.round(rng.standard_normal((3000, 2)), 2)
    x[::3] = x[0]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, features array<double>").persist()
    rows = lambda found: sorted(tuple(r) for r in found.collect())
    want = rows(N.nearest(df, df, "id", 4))

    def refuse(*_, **__):
        raise AssertionError("all rows were compared")

    monkeypatch.setattr(N, "block_pairs", refuse)
    assert rows(N.nearest(df, df, "id", 4, block_rows=64)) == want


def test_linkage_in_cells(spark, monkeypatch):
    """Copies, and clumps wider apart than any neighbour sees, on a line; against the widest gaps."""
    from tidemark.operators import linkage

    monkeypatch.setattr(linkage, "block_pairs", None)
    rng = np.random.default_rng(5)
    x = np.round(np.concatenate([rng.uniform(c, c + 1, 400) for c in (0, 5, 11, 18)]), 2)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
    got = {r["id"]: r["cluster"] for r in single_linkage(df, "id", ["x"], 3, block_rows=32).clusters(4).collect()}
    assert got == {i: i // 400 for i in range(1600)}
