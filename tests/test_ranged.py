"""Cycles dealt out by runs of coordinates: few copies where coordinates go together, the same results, packed rows."""

import numpy as np
import pytest

from tensorloom import Tensor, einsum
from tensorloom.operators import multiway
from tensorloom.operators.contract import label_columns, labelled
from tensorloom.operators.multiway import contract_cycle, packed, unpacked
from tensorloom.plans.multiway import range_shares
from tensorloom.sources.tensors import from_numpy


def sparse(spark, array):
    t = from_numpy(spark, array)
    return Tensor(t.df.where(" or ".join(f"{v} <> 0" for v in t.values)), [None] * array.ndim, t.dtype)


def test_runs_that_go_together_are_dealt_once():
    diagonal = [(own, np.eye(8, dtype=int) * 10) for own in ("ij", "jk", "ki")]
    share, rows = range_shares(diagonal, "ijk", 8, 8, 40)
    assert rows.sum() == 240 and (rows > 0).sum() == 8 and rows.max() == 30
    even = [(own, np.full((8, 8), 10)) for own in ("ij", "jk", "ki")]
    share, rows = range_shares(even, "ijk", 8, 1, 500)
    assert rows.max() <= 500 and (rows > 0).all()
    lone = [("ij", np.eye(8, dtype=int)), ("jk", np.eye(8, dtype=int)), ("ki", np.eye(8, dtype=int)[::-1])]
    share, rows = range_shares(lone, "ijk", 8, 1, 0)
    assert rows.sum() == 0  # no cell has rows of all three


def test_joined_blocks_of_coordinates(spark, monkeypatch):
    """Eight apart blocks of keys: no cell is over its rows, and few rows go to more than one cell."""
    monkeypatch.setattr(multiway, "CELL_ROWS", 256)
    rng = np.random.default_rng(7)
    arrays = [np.kron(np.eye(8), np.ones((6, 6))) * rng.integers(1, 5, (48, 48)) for _ in range(3)]
    names = label_columns("ijk")
    parts = [labelled(sparse(spark, a), x, names) for a, x in zip(arrays, ("ij", "jk", "ki"), strict=True)]
    stats = [multiway._measured(p) for p in parts]
    routes, cells = multiway._ranged(parts, stats, list("ijk"), multiway._heavy(parts, stats, list("ijk"), 8), 8)
    dealt = {}
    for p, route in zip(parts, routes, strict=True):
        table = p.df.toPandas()
        for rows, to in route([table[names[x]].to_numpy() for x in p.labels]):
            for c in to:
                dealt[c] = dealt.get(c, 0) + len(rows)
    assert 8 <= cells and max(dealt.values()) <= 256 and sum(dealt.values()) <= 1.5 * 3 * 8 * 36
    assert contract_cycle(parts, []).df.first().v == np.einsum("ij,jk,ki->", *arrays)


@pytest.mark.parametrize("kind", ["float", "int", "complex"])
def test_five_labels_go_by_hash(spark, kind):
    rng = np.random.default_rng(8)
    arrays = [(rng.integers(-3, 4, (5, 5)) * (rng.random((5, 5)) < 0.6)).astype(kind) for _ in range(5)]
    found = einsum("ab,bc,cd,de,ea->a", *[sparse(spark, a) for a in arrays])
    want = np.einsum("ab,bc,cd,de,ea->a", *arrays)
    got = {r["a0"]: complex(r["re"], r["im"]) if kind == "complex" else r["v"] for r in found.df.collect()}
    assert all(got.get(k, 0) == x for k, x in enumerate(want))


@pytest.mark.parametrize("value", [[1.0, -0.0, 2.0], [np.inf, 1.0, np.nan], [1.5, 2e300, -3.0], [2**62, -(2**62), 7], [3.0, -4.0, 5.0], [1 + 2j, -1j, 0]])
def test_packed_rows(value):
    value = np.array(value)
    cols = [np.array([2**40, -3, -3]), np.array([7, 2**62, -(2**62)])]
    again, v = unpacked(packed(cols, value))
    order = np.lexsort(cols[::-1])
    assert [c.tolist() for c in again] == [c[order].tolist() for c in cols] and v.dtype == value.dtype
    assert v.tobytes() == value[order].tobytes()
