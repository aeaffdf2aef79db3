"""Views, maps, reductions, sources and physical tiers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom import Tensor
from tensorloom.errors import InvalidAxis, NonSquare, OffsetOverflow, RankMismatch, ScalarConversion, ShapeMismatch, StrideLengthMismatch
from tensorloom.functions.monoids import MAX, PRODUCT
from tensorloom.operators import elementwise as ew
from tensorloom.operators import reduce as rd
from tensorloom.operators import tiers
from tensorloom.operators.einsum import einsum
from tensorloom.operators.tiers import block_matmul, gram_rows, matmul
from tensorloom.sources.tensors import from_array_column, from_buffer, from_fn, from_numpy, from_parts, from_table, read_parquet, to_buffer, to_numpy, write_parquet, zeros
from tensorloom.streaming.accumulate import stream_contract

M = np.arange(12.0).reshape(3, 4)
Z = M + 1j * M[::-1]


def test_views(spark):
    t, z = from_numpy(spark, M), from_numpy(spark, Z)
    np.testing.assert_array_equal(to_numpy(t.permute((1, 0))), M.T)
    np.testing.assert_array_equal(to_numpy(z.adjoint_2d()), Z.conj().T)
    np.testing.assert_array_equal(to_numpy(z.conj().conj()), Z)
    np.testing.assert_array_equal(to_numpy(t.diagonal([(0, 1)])), np.diag(M))
    cube = np.arange(27.0).reshape(3, 3, 3)
    np.testing.assert_array_equal(to_numpy(from_numpy(spark, cube).diagonal([(0, 1), (0, 2)])), [cube[k, k, k] for k in range(3)])
    np.testing.assert_array_equal(to_numpy(from_numpy(spark, M[:1]).broadcast((3, 4))), np.repeat(M[:1], 3, axis=0))
    assert to_numpy(t.get((1, 2))) == M[1, 2]
    changed = M.copy()
    changed[2, 3] = -1
    np.testing.assert_array_equal(to_numpy(t.set((2, 3), -1)), changed)
    assert len(t) == 12 and t.ndim == 2 and not t.is_empty


def test_view_errors(spark):
    t = from_numpy(spark, M)
    for error, call in [
        (RankMismatch, lambda: t.permute((0,))), (InvalidAxis, lambda: t.permute((0, 0))), (InvalidAxis, lambda: t.diagonal([(0, 5)])), (ShapeMismatch, lambda: t.broadcast((3, 5))),
        (RankMismatch, lambda: from_numpy(spark, np.ones(2)).transpose_2d()), (InvalidAxis, lambda: t.get((9, 0))), (InvalidAxis, lambda: rd.reduce_axis(t, 2)),
        (ShapeMismatch, lambda: ew.zip_map(lambda a, b: a, t, t.transpose_2d())), (NonSquare, lambda: ew.symmetrize(t)), (RankMismatch, lambda: ew.symmetrize(from_numpy(spark, np.ones(3)))),
        (StrideLengthMismatch, lambda: from_buffer(spark, [1.0], (1,), (1, 1))), (OffsetOverflow, lambda: from_buffer(spark, [1.0, 2.0], (3,), (1,))), (OffsetOverflow, lambda: from_buffer(spark, [1.0, 2.0], (2,), (-1,))),
        (ScalarConversion, lambda: from_numpy(spark, np.array(["a"]))),
    ]:
        with pytest.raises(error):
            call()


def test_maps(spark):
    t, z = from_numpy(spark, M), from_numpy(spark, Z)
    np.testing.assert_allclose(to_numpy(ew.map_cells(t, lambda v: F.exp(-v))), np.exp(-M))
    np.testing.assert_array_equal(to_numpy(ew.map_cells(z, lambda re, im: (im, re))), Z.imag + 1j * Z.real)
    np.testing.assert_array_equal(to_numpy(ew.zip_map(lambda a, b, c, d: a + b * c - d, t, t, t, t)), M * M)
    other = from_numpy(spark, M + 1)
    np.testing.assert_array_equal(to_numpy(ew.zip_map(lambda a, b: a * b, t, other)), M * (M + 1))
    np.testing.assert_array_equal(to_numpy(ew.add(t, z)), M + Z)
    np.testing.assert_array_equal(to_numpy(ew.mul(t, z)), M * Z)
    np.testing.assert_array_equal(to_numpy(ew.axpy(t, z, 2j)), 2j * Z + M)
    np.testing.assert_array_equal(to_numpy(ew.fma(t, t, other)), M + M * (M + 1))
    np.testing.assert_array_equal(to_numpy(ew.copy_scale(t, 3.0)), 3 * M)
    np.testing.assert_array_equal(to_numpy(ew.copy_conj(z)), Z.conj())
    np.testing.assert_array_equal(to_numpy(ew.copy_transpose_scale(t, 2.0)), 2 * M.T)
    np.testing.assert_array_equal(to_numpy(ew.symmetrize(from_numpy(spark, M[:, :3]))), (M[:, :3] + M[:, :3].T) / 2)
    np.testing.assert_array_equal(to_numpy(ew.symmetrize_conj(from_numpy(spark, Z[:, :3]))), (Z[:, :3] + Z[:, :3].conj().T) / 2)
    assert "Join" not in ew.zip_map(lambda a, b: a + b, t, t).df._jdf.queryExecution().optimizedPlan().toString()


def test_sparse_cells_are_zero(spark):
    df = spark.createDataFrame([(0, 0, 2.0), (0, 0, 3.0), (1, 2, 4.0), (None, 1, 9.0), (1, 1, None)], "i int, j int, v double")
    t = from_table(df, ["i", "j"], "v", (2, 3))
    np.testing.assert_array_equal(to_numpy(t), [[5, 0, 0], [0, 0, 4]])
    assert t.densify().df.count() == 6
    np.testing.assert_array_equal(to_numpy(ew.map_cells(t, lambda v: v + 1, dense=True)), [[6, 1, 1], [1, 1, 5]])
    np.testing.assert_array_equal(to_numpy(ew.zip_map(lambda a, b: a - b, t, from_numpy(spark, np.ones((2, 3))))), [[4, -1, -1], [-1, -1, 3]])
    assert to_numpy(rd.reduce(t.densify(), PRODUCT)) == 0
    assert to_numpy(t.get((0, 1))) == 0


def test_reductions(spark):
    t, z = from_numpy(spark, M + 1), from_numpy(spark, Z)
    assert to_numpy(rd.total(t)) == (M + 1).sum()
    assert to_numpy(rd.reduce(t, PRODUCT)) == (M + 1).prod()
    assert to_numpy(rd.reduce(t, MAX)) == 12
    assert to_numpy(rd.reduce(t, f=lambda v: v * v)) == ((M + 1) ** 2).sum()
    np.testing.assert_array_equal(to_numpy(rd.reduce_axis(t, 0)), (M + 1).sum(axis=0))
    np.testing.assert_array_equal(to_numpy(rd.reduce_axis(z, 1)), Z.sum(axis=1))
    np.testing.assert_array_equal(to_numpy(rd.reduce_axes(from_numpy(spark, np.ones((2, 3, 4))), [0, 2])), [8, 8, 8])
    assert rd.reduce_axis(from_numpy(spark, np.ones(4)), 0).rank == 0
    assert to_numpy(rd.dot(z, t)) == (Z * (M + 1)).sum()


def test_sources(spark, tmp_path):
    np.testing.assert_array_equal(to_numpy(from_buffer(spark, list(range(24)), (3, 2), (-8, 2), 20)), [[20, 22], [12, 14], [4, 6]])
    np.testing.assert_array_equal(to_numpy(from_buffer(spark, [5.0], (2, 2), (0, 0))), np.full((2, 2), 5))
    np.testing.assert_array_equal(to_numpy(from_parts(spark, list(range(6)), (2, 3))), np.arange(6).reshape((2, 3), order="F"))
    np.testing.assert_array_equal(to_numpy(from_fn(spark, (2, 3), lambda i, j: (i * 10 + j).cast("double"))), [[0, 1, 2], [10, 11, 12]])
    assert to_buffer(from_numpy(spark, M)) == M.reshape(-1, order="F").tolist()
    assert zeros(spark, (2, 2), "complex").df.count() == 4
    np.testing.assert_array_equal(to_numpy(from_numpy(spark, M[::-1, ::2].T)), M[::-1, ::2].T)
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0])], "k int, x array<double>")
    np.testing.assert_array_equal(to_numpy(from_array_column(rows, ["k"], "x", (2, 2))), [[1, 2], [3, 0]])
    for t, a in ((from_numpy(spark, M), M), (from_numpy(spark, Z).conj(), Z.conj())):
        write_parquet(t, str(tmp_path / "t"), partition_by_first=True)
        np.testing.assert_array_equal(to_numpy(read_parquet(spark, str(tmp_path / "t"), a.shape)), a)


def test_types(spark):
    t = from_numpy(spark, M).to_complex()
    assert t.is_complex() and to_numpy(t.try_to_real()).dtype == float
    assert from_numpy(spark, Z).try_to_real() is None


def test_tiers_agree(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 9, (13, 17)).astype(float), rng.integers(0, 9, (17, 5)).astype(float)
    ta, tb = from_numpy(spark, a), from_numpy(spark, b)
    np.testing.assert_array_equal(to_numpy(block_matmul(ta, tb, tile=4)), a @ b)
    np.testing.assert_array_equal(to_numpy(matmul(ta, tb)), a @ b)
    z, w = a + 1j * a[::-1], b - 2j * b
    np.testing.assert_array_equal(to_numpy(block_matmul(from_numpy(spark, z).conj(), from_numpy(spark, w), tile=4)), z.conj() @ w)
    np.testing.assert_array_equal(to_numpy(block_matmul(ta, from_numpy(spark, w), tile=32)), a @ w)
    rows = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(a)], "k long, row array<double>")
    got = gram_rows(rows, "k", "row")
    np.testing.assert_array_equal(to_numpy(Tensor(got.df, (13, 13))), a @ a.T)


@pytest.mark.parametrize("complex_", [False, True])
def test_einsum_takes_blocks_for_dense_operands(spark, monkeypatch, complex_):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-9, 9, (3, 4, 5, 6)).astype(float), rng.integers(-9, 9, (6, 3, 7, 5)).astype(float)
    if complex_:
        a = a * (1 + 2j)
    ta, tb = from_numpy(spark, a), from_numpy(spark, b)
    planned = lambda t: "MapInArrow" in t.df._jdf.queryExecution().optimizedPlan().toString()
    assert not planned(einsum("xijk,kxlj->lxi", ta, tb))
    monkeypatch.setattr(tiers, "BLOCKS_FROM", 100)
    found = einsum("xijk,kxlj->lxi", ta, tb)
    assert planned(found)
    np.testing.assert_array_equal(to_numpy(found), np.einsum("xijk,kxlj->lxi", a, b))
    whole = from_numpy(spark, a.real.astype(int))
    assert not planned(einsum("xijk,kxlj->lxi", whole, from_numpy(spark, b.astype(int))))
    assert not planned(einsum("xijk,kxlj->xj", ta, tb))
    chain = [from_numpy(spark, rng.integers(-9, 9, (12, 12)).astype(float)) for _ in range(3)]
    np.testing.assert_array_equal(to_numpy(einsum("ij,jk,kl->il", *chain)), np.linalg.multi_dot([to_numpy(t) for t in chain]))


def test_stream_contraction(spark, tmp_path):
    spark.createDataFrame([(0, 1, 2.0), (1, 1, 3.0), (0, 0, 1.0)], "i long, j long, w double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i long, j long, w double").parquet(str(tmp_path / "in"))
    out = stream_contract(stream, ["i", "j"], "w", from_numpy(spark, np.array([[1.0, 10.0], [100.0, 1000.0]])), "jk", "ik")
    query = out.writeStream.format("memory").queryName("contracted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(120)
    got = {(r.i, r.k): r.value for r in spark.table("contracted").collect()}
    want = np.array([[1.0, 2.0], [0.0, 3.0]]) @ np.array([[1.0, 10.0], [100.0, 1000.0]])
    assert got == {(i, k): want[i, k] for i in range(2) for k in range(2)}
