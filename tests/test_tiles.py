"""Tiles and cells give the same rows; chains stay in tiles; each tile has its own form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom import Tensor, einsum
from tensorloom.errors import ShapeMismatch
from tensorloom.operators import tiers
from tensorloom.operators.tiers import Sum, Tile, Tiled, block_matmul, gram_rows, tiled, untiled
from tensorloom.sources.tensors import from_numpy, to_numpy


def rows(t):
    return sorted((tuple(r[a] for a in t.axes), tuple("nan" if x != x else x for x in (r[v] for v in t.values))) for r in t.resolved().df.collect())


def stored(spark, array, keep):
    at = [f"a{k}" for k in range(array.ndim)]
    t = from_numpy(spark, array)
    mask = spark.createDataFrame([tuple(map(int, i)) for i in np.argwhere(keep)], ", ".join(f"{a} long" for a in at))
    return Tensor(t.df.join(mask, at), array.shape, t.dtype, cells=float(keep.sum()))


def operands(case, rng):
    a, b = rng.integers(-3, 4, (11, 9)).astype(float), rng.integers(-3, 4, (9, 13)).astype(float)
    keep_a, keep_b = np.ones(a.shape, bool), np.ones(b.shape, bool)
    if case == "cancelling":
        a, b = np.tile([1.0, -1.0], (11, 5))[:, :8], np.ones((8, 13))
        keep_a, keep_b = np.ones(a.shape, bool), np.ones(b.shape, bool)
    elif case == "infinite":
        a[2, 3], b[4, 5], b[3, 1] = np.inf, -np.inf, 0
        keep_a, keep_b = rng.random(a.shape) < 0.6, rng.random(b.shape) < 0.6
        keep_a[2, 3] = keep_b[4, 5] = True
    elif case == "infinite and whole":
        a[2, 3], b[3, 1] = np.inf, 0
    elif case == "masked":
        keep_a, keep_b = rng.random(a.shape) < 0.5, rng.random(b.shape) < 0.5
    elif case == "sparse":
        keep_a, keep_b = rng.random(a.shape) < 0.1, rng.random(b.shape) < 0.1
    elif case == "empty":
        keep_a[:] = False
    elif case == "complex":
        a, b = a + 1j * a[::-1], b - 2j * b[:, ::-1]
        keep_a, keep_b = rng.random(a.shape) < 0.4, rng.random(b.shape) < 0.7
    return a, b, keep_a, keep_b


@pytest.mark.parametrize("case", ["whole", "cancelling", "infinite", "infinite and whole", "masked", "sparse", "empty", "complex"])
def test_tiles_and_cells_agree(spark, monkeypatch, case):
    a, b, keep_a, keep_b = operands(case, np.random.default_rng(len(case)))
    ta, tb = stored(spark, a, keep_a), stored(spark, b, keep_b)
    cells = rows(einsum("ij,jk->ik", ta, tb))
    assert rows(block_matmul(ta, tb, tile=4)) == cells
    monkeypatch.setattr(tiers, "BLOCKS_FROM", 1)
    monkeypatch.setattr(tiers, "DENSE", -1)
    found = einsum("ij,jk->ik", ta, tb)
    assert "MapInArrow" in found.df._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found) == cells


def test_whole_numbers_stay_whole(spark):
    a = np.array([[2**40, 1], [3, 2**41 + 1]])
    found = block_matmul(from_numpy(spark, a), from_numpy(spark, np.eye(2, dtype=int)), tile=2)
    assert dict(found.df.dtypes)["v"] == "bigint" and sorted(r.v for r in found.df.collect()) == sorted(a.reshape(-1).tolist())


def test_chains_stay_in_tiles(spark, monkeypatch):
    """Between the products of a chain no cells are laid open; tables are measured, not given sizes."""
    monkeypatch.setattr(tiers, "BLOCKS_FROM", 1)
    rng = np.random.default_rng(2)
    arrays = [rng.integers(1, 9, (12, 12)).astype(float) for _ in range(4)]
    tensors = [Tensor(from_numpy(spark, a).df, (None, None)).measured() for a in arrays]
    found = einsum("ij,jk,kl,lm->im", *tensors)
    plan = found.df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("open_") == 1 and plan.count("build") == 4
    np.testing.assert_array_equal(to_numpy(Tensor(found.df, (12, 12))), np.linalg.multi_dot(arrays))
    gram = einsum("ij,kj->ik", einsum("ij,jk->ik", *tensors[:2]).measured(), tensors[2])
    np.testing.assert_array_equal(to_numpy(Tensor(gram.df, (12, 12))), arrays[0] @ arrays[1] @ arrays[2].T)


def test_transposed_and_stored_tiles(spark, tmp_path):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 5, (10, 7)).astype(float), rng.integers(0, 5, (10, 6)).astype(float)
    left, right = (stored(spark, x, x > 1) for x in (a, b))
    a, b = a * (a > 1), b * (b > 1)
    tiled(left, 4).write(str(tmp_path / "tiles"))
    again = Tiled.read(spark, str(tmp_path / "tiles"), [], [("a0", 10)], [("a1", 7)], tile=4)
    np.testing.assert_array_equal(to_numpy(untiled(again)), a)
    np.testing.assert_array_equal(to_numpy(untiled(again.transposed())), a.T)
    np.testing.assert_array_equal(to_numpy(untiled(again.transposed().times(tiled(right, 4)))), a.T @ b)
    with pytest.raises(ShapeMismatch):
        again.times(tiled(right, 8))


def test_forms_of_a_tile():
    area = np.arange(16)
    for n, form in ((3, "s"), (9, "m"), (16, "f")):
        tile = Tile.of(area[:n][::-1], 1.0 + area[:n][::-1], 16)
        where, data = tile.pack()
        again = Tile.unpack(where, data, np.float64, 16)
        assert where[:1].decode() == form
        at, values = again.stored()
        assert at.tolist() == list(range(n)) and values.tolist() == [1.0 + k for k in range(n)]
        total = Sum(4, np.float64)
        total.add(again.flipped(4))
        at, values = total.tile().stored()
        assert sorted(at.tolist()) == sorted(k % 4 * 4 + k // 4 for k in range(n))


def test_rows_as_matrices(spark):
    df = spark.createDataFrame([(1000, [1, 2, 3]), (7, [4, 5]), (8, [])], "k long, x array<long>")
    found = gram_rows(df, "k", "x", queries=df.where(F.col("k") == 7), tile=2)
    assert sorted(found.df.collect()) == [(7, 7, 41), (7, 1000, 14)]
    assert "Cartesian" not in found.df._jdf.queryExecution().executedPlan().toString()
