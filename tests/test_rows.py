"""Products over few inner coordinates: whole in one task, with the rows that cells give."""

import numpy as np
import pytest

from tensorloom import Tensor, einsum
from tensorloom.operators import rows, tiers
from tensorloom.operators.tiers import dense_product
from tensorloom.sources.tensors import from_numpy


def cells(spark, array, keep):
    t = from_numpy(spark, array)
    at = spark.createDataFrame([tuple(map(int, i)) for i in np.argwhere(keep)], ", ".join(f"a{k} long" for k in range(array.ndim)))
    return Tensor(t.df.join(at, t.axes), [None] * array.ndim, t.dtype)


def found(t):
    return sorted((tuple(r[a] for a in t.axes), *[str(r[v]) for v in t.values]) for r in t.df.collect())


@pytest.mark.parametrize("notation,kind", [("ik,jk->ij", "long"), ("bik,bjk->bij", "long"), ("kmi,jkm->ji", "double"), ("ik,jk->ij", "complex"), ("ik,jk->ij", "infinite")])
def test_blocks_of_rows_and_cells_agree(spark, monkeypatch, notation, kind):
    """Nothing of the product's size is shuffled: above the product there is no grouping."""
    rng = np.random.default_rng(5)
    size = dict(b=3, i=21, j=34, k=6, m=2)
    left, right = (rng.integers(-4, 5, [size[x] for x in side]) for side in notation.split("->")[0].split(","))
    if kind != "long":
        left, right = left.astype(float), right.astype(float)
    if kind == "complex":
        left = left + 1j * left[::-1]
        right = right - 2j * right
    if kind == "infinite":
        left[3, 2], right[4, 2], right[5, 2] = np.inf, 0, -np.inf
    a, b = (cells(spark, x, rng.random(x.shape) < 0.8) for x in (left, right))
    want = found(einsum(notation, a, b))
    monkeypatch.setattr(tiers, "BLOCKS_FROM", 1)
    monkeypatch.setattr(rows, "OUT_ROWS", 50)
    monkeypatch.setattr(rows.row_product, "__defaults__", ((8, 5),))
    product = einsum(notation, a.measured(), b.measured())
    assert "Aggregate" not in product.df._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow multiply")[0]
    assert "MapInArrow multiply" in product.df._jdf.queryExecution().optimizedPlan().toString()
    assert found(product) == want and len(want) > 100


def test_whole_products_are_exact_or_an_error():
    """Beyond 2 ** 53 no bit is lost, and what has no long is an error as in SQL."""
    a = np.array([[2**40 + 1, 2**40], [3, -1]])
    b = np.array([[2**20 + 1], [1 - 2**20]])
    assert dense_product(a, None, b, None)[0].tolist() == (a.astype(object) @ b.astype(object)).tolist()
    near = np.array([[2**62, 2**62]])
    assert dense_product(near, None, np.array([[1], [-1]]), None)[0].tolist() == [[0]]
    with pytest.raises(OverflowError):
        dense_product(near, None, np.array([[1], [1]]), None)
