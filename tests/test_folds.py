"""Folds with a state, exact sums, and complex values in folds, maps and semirings."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom import BOOL_OR_AND, MAX_PLUS, Tensor, einsum
from tensorloom.errors import TypeMismatch
from tensorloom.functions.exact import EXACT_SUM, rounded
from tensorloom.functions.monoids import COMPLEX_PRODUCT, COUNT, LOGSUMEXP, MAX, MIN, PRODUCT, VARIANCE, Fold, extreme_place, segments
from tensorloom.operators import elementwise as ew
from tensorloom.operators import reduce as rd
from tensorloom.operators.contract import einsum2
from tensorloom.sources.tensors import from_numpy, from_table, to_numpy

Z = np.array([[1 + 2j, 3 + 1j, -1j], [2, 1 - 1j, 1j]])
M = np.array([[1.0, -3.0, 2.0, 2.0], [0.5, 0.5, -1.0, 0.25], [7.0, 1.0, 7.0, -7.0]])


def test_complex_folds(spark):
    z = from_numpy(spark, Z)
    assert to_numpy(rd.reduce(z, PRODUCT)) == pytest.approx(np.prod(Z))
    assert to_numpy(rd.reduce(from_numpy(spark, Z[0, :2]), PRODUCT)) == 1 + 7j
    np.testing.assert_allclose(to_numpy(rd.reduce_axis(z, 0, PRODUCT)), np.prod(Z, axis=0))
    np.testing.assert_allclose(to_numpy(rd.reduce_axis(z.conj(), 1, COMPLEX_PRODUCT)), np.prod(Z.conj(), axis=1))
    square = lambda re, im: (re * re - im * im, re * im * 2)
    np.testing.assert_allclose(to_numpy(rd.reduce(z, f=square)), (Z**2).sum())
    np.testing.assert_allclose(to_numpy(rd.reduce_axis(z, 0, f=square)), (Z**2).sum(axis=0))
    np.testing.assert_allclose(to_numpy(rd.reduce_axis(z, 1, MAX, lambda re, im: re * re + im * im)), (abs(Z) ** 2).max(axis=1))
    assert to_numpy(rd.reduce(z, COUNT)) == 6 and not rd.reduce(z, COUNT).is_complex()
    for fold in (MAX, MIN):
        with pytest.raises(TypeMismatch):
            rd.reduce(z, fold)
        with pytest.raises(TypeMismatch):
            rd.reduce_axis(z, 0, fold)


def test_complex_maps_and_semirings(spark):
    z, t = from_numpy(spark, Z[:, :2]), from_numpy(spark, M[:2, :2])
    got = einsum2(z, z, "ij", "jk", "ik", map_a=lambda re, im: (re + 1, im))
    np.testing.assert_allclose(to_numpy(got), (Z[:, :2] + 1) @ Z[:, :2])
    row = from_numpy(spark, np.array([1 + 2j, 3 + 1j]))
    assert to_numpy(einsum2(row, row, "i", "i", "", map_a=lambda re, im: (re + 1, im))) == pytest.approx(9 + 13j)
    np.testing.assert_allclose(to_numpy(einsum2(z, t, "ij", "jk", "ik", map_a=lambda re, im: re * re + im * im)), abs(Z[:, :2]) ** 2 @ M[:2, :2])
    np.testing.assert_allclose(to_numpy(einsum2(t, t, "ij", "jk", "ik", map_a=lambda v: (v, -v))), (M[:2, :2] * (1 - 1j)) @ M[:2, :2])
    sparse = Tensor(z.df.where("a0 = a1"), (2, 2), "complex")
    np.testing.assert_allclose(to_numpy(einsum2(sparse, z, "ij", "jk", "ik", map_a=lambda re, im: (re, im + 1))), (np.diag(np.diag(Z[:, :2])) + 1j) @ Z[:, :2])
    for semiring in (MAX_PLUS, BOOL_OR_AND):
        with pytest.raises(TypeMismatch):
            einsum("ij,jk->ik", z, z, semiring=semiring)
        with pytest.raises(TypeMismatch):
            einsum("ij,jk->ik", t, z, semiring=semiring)


def test_folds_with_state(spark):
    t = Tensor(from_numpy(spark, M).df.repartition(5), M.shape)
    np.testing.assert_allclose(to_numpy(rd.reduce_axis(t, 1, LOGSUMEXP)), np.log(np.exp(M).sum(axis=1)))
    np.testing.assert_allclose(to_numpy(rd.reduce(t, LOGSUMEXP, lambda v: v + 5000)), 5000 + np.log(np.exp(M).sum()))
    np.testing.assert_array_equal(to_numpy(rd.reduce_axis(t, 1, extreme_place(1))), [2, 0, 0])
    np.testing.assert_array_equal(to_numpy(rd.reduce_axis(t, 0, extreme_place(0, largest=False))), [1, 0, 1, 2])
    np.testing.assert_allclose(to_numpy(rd.reduce_axis(t, 0, VARIANCE)), M.var(axis=0))
    np.testing.assert_allclose(to_numpy(rd.reduce(t, VARIANCE)), M.var())
    assert rd.reduce(Tensor(t.df.where("v > 100"), M.shape), LOGSUMEXP).df.collect() == [(None,)]
    assert to_numpy(rd.reduce(Tensor(from_numpy(spark, Z).df.where("re > 100"), Z.shape, "complex"), PRODUCT)) == 1


def test_a_fold_of_ones_own(spark):
    """The two largest values."""

    def merge(a, b):
        four = np.sort(np.stack([*a, *b]), axis=0)
        return four[-1], four[-2]

    two = Fold("two", (("first", "double"), ("second", "double")), lambda c, s: segments([c[0], np.full(len(c[0]), -np.inf)], s, merge), merge, lambda a, b: b)
    t = Tensor(from_numpy(spark, M).df.repartition(7), M.shape)
    np.testing.assert_array_equal(to_numpy(rd.reduce_axis(t, 1, two)), np.sort(M, axis=1)[:, -2])
    assert to_numpy(rd.reduce(t, two)) == 7


def test_states_are_merged_before_the_exchange(spark):
    """Whatever the number of rows, a task sends one state a key."""
    t = Tensor(spark.range(0, 20_000, 1, 8).select((F.col("id") % 3).alias("a0"), F.col("id").alias("a1"), F.lit(0.0).alias("v")), (3, None))
    found = rd.reduce_axis(t, 1, LOGSUMEXP)
    plan = found.df._jdf.queryExecution().executedPlan().toString()
    np.testing.assert_allclose(to_numpy(found), np.log([6667, 6667, 6666]))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInArrow") == 3
    assert to_numpy(rd.reduce(t, LOGSUMEXP)) == pytest.approx(math.log(20_000))


def test_segments():
    values = np.arange(1.0, 11.0)
    starts = np.array([0, 1, 4, 6])
    (sums,) = segments([values], starts, lambda a, b: (a[0] + b[0],))
    np.testing.assert_array_equal(sums, np.add.reduceat(values, starts))


def values(n, seed):
    rng = random.Random(seed)
    return [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-30, 30) for _ in range(n)]


@pytest.mark.parametrize("parts", [1, 64])
def test_exact_sums(spark, parts):
    rows = [(k % 4, x) for k, x in enumerate(values(3000, 1) + [5e-324, -5e-324, 2.2e-308, 1.7e308, -1.7e308, 0.0, -0.0, 1e16, 1.0, -1e16, 0.1])]
    df = spark.createDataFrame(rows, "k long, v double").repartition(parts)
    got = dict(from_table(df, ["k"], "v", exact=True).df.collect())
    assert got == {k: math.fsum(x for i, x in rows if i == k) for k in range(4)}
    cells = from_table(df.withColumn("n", F.monotonically_increasing_id()), ["k", "n"], "v", unique=True)
    assert rd.reduce(cells, EXACT_SUM).df.first()[0] == math.fsum(x for _, x in rows)


def test_exact_sums_of_prices(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_suppkey", "l_extendedprice")
    found = [sorted(from_table(df.repartition(n), ["l_suppkey"], "l_extendedprice", exact=True).df.collect()) for n in (1, 64)]
    want: dict = {}
    for k, v in df.collect():
        want.setdefault(k, []).append(v)
    assert found[0] == found[1] == sorted((k, math.fsum(v)) for k, v in want.items())


def test_exact_values_that_are_not_finite(spark):
    rows = [(0, math.inf), (0, 1.0), (1, -math.inf), (2, math.inf), (2, -math.inf), (3, math.nan), (4, 1.7e308), (4, 1.7e308)]
    got = dict(from_table(spark.createDataFrame(rows, "k long, v double"), ["k"], "v", exact=True).df.collect())
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and math.isnan(got[3]) and got[4] == math.inf


def test_exact_complex_and_dot(spark):
    z = from_numpy(spark, np.array([0.1 + 1e16j, 0.2 + 1j, 0.3 - 1e16j]))
    assert to_numpy(rd.reduce(z, EXACT_SUM)) == complex(math.fsum([0.1, 0.2, 0.3]), 1)
    a = from_numpy(spark, np.array([1e16, 1.0, -1e16]))
    assert to_numpy(rd.dot(a, from_numpy(spark, np.ones(3)), exact=True)) == 1
    assert rounded([0], [(3, 0, 0)]) == 3.0
    assert to_numpy(ew.map_cells(rd.reduce(Tensor(a.df.where("v > 1e20"), (3,)), EXACT_SUM), lambda v: v)) == 0
