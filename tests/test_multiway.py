"""Cyclic networks joined at once, their plans, and orders from statistics."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom import Tensor, einsum
from tensorloom.operators import multiway
from tensorloom.operators.contract import label_columns, labelled
from tensorloom.operators.multiway import contract_cycle
from tensorloom.operators.statistics import measure
from tensorloom.plans.multiway import binding_order, cyclic_core, patterns, shares
from tensorloom.plans.planner import best_order, greedy_order
from tensorloom.sources.tensors import from_numpy, to_numpy


def sparse(spark, array, dims=False):
    """Only the cells that are not zero, sizes unknown."""
    t = from_numpy(spark, array)
    kept = t.df.where("re <> 0 or im <> 0" if t.is_complex() else "v <> 0")
    return Tensor(kept, array.shape if dims else [None] * array.ndim, t.dtype)


def some(rng, *shape, kind=float, density=0.3):
    values = rng.integers(1, 9, shape) * (rng.random(shape) < density)
    return values.astype(kind) + (1j * rng.integers(0, 5, shape) * (values != 0) if kind is complex else 0)


def dense(t, shape):
    return to_numpy(Tensor(t.df, shape, t.dtype))


@pytest.mark.parametrize(
    "notation",
    ["ij,jk,ki->", "ij,jk,ki->i", "ij,jk,ki->ijk", "ij,jk,ki->kj", "ij,jk,kl,li->", "ij,jk,kl,li->jl", "ij,jk,ki,il->l", "ij,jk,ki,kl,lm->m", "ijk,jkl,kli,lij->", "ij,jk,ki,ij->j", "ij,jk,kix->x", "ij,jk,kl,li,ik->i"],
)
def test_against_numpy(spark, notation):
    rng = np.random.default_rng(len(notation))
    arrays = [some(rng, *[7] * len(x)) for x in notation.split("->")[0].split(",")]
    want = np.einsum(notation, *arrays)
    np.testing.assert_array_equal(dense(einsum(notation, *[sparse(spark, a) for a in arrays]), want.shape), want)


def test_complex_and_whole_values(spark):
    rng = np.random.default_rng(1)
    a, b, c = some(rng, 6, 5, kind=complex), some(rng, 5, 4), some(rng, 4, 6, kind=complex)
    np.testing.assert_array_equal(dense(einsum("ij,jk,ki->i", *[sparse(spark, x) for x in (a, b, c)]), (6,)), np.einsum("ij,jk,ki->i", a, b, c))
    whole = einsum("ij,jk,ki->", *[sparse(spark, some(rng, 5, 5, kind=int)) for _ in range(3)])
    assert dict(whole.df.dtypes)["v"] == "double" or dict(whole.df.dtypes)["v"] == "bigint"


def test_small_chunks_and_many_cells(spark, monkeypatch):
    monkeypatch.setattr(multiway, "CHUNK", 3)
    rng = np.random.default_rng(2)
    arrays = [some(rng, 9, 9, density=0.5) for _ in range(3)]
    names = label_columns("ijk")
    parts = [labelled(sparse(spark, a), x, names) for a, x in zip(arrays, ("ij", "jk", "ki"), strict=True)]
    found = contract_cycle(parts, ["i"], cells=64).df.toPandas()
    out = np.zeros(9)
    out[found[names["i"]]] = found["v"]
    np.testing.assert_array_equal(out, np.einsum("ij,jk,ki->i", *arrays))


@pytest.mark.parametrize("notation", ["ij,jk,ki->", "ij,jk,kl,li->i"])
def test_frequent_coordinates(spark, monkeypatch, notation):
    """One coordinate of each label has half of the rows."""
    monkeypatch.setattr(multiway, "CELL_ROWS", 64)
    rng = np.random.default_rng(3)
    arrays = []
    for _ in notation.split("->")[0].split(","):
        a = some(rng, 40, 40, density=0.05)
        a[3, :] = rng.integers(1, 5, 40)
        a[:, 5] = rng.integers(1, 5, 40)
        arrays.append(a)
    want = np.einsum(notation, *arrays)
    assert multiway._heavy([labelled(sparse(spark, arrays[0]), "ij", label_columns("ij"))], [measure(sparse(spark, arrays[0]))], ["i", "j"], 16) == {"i": [3], "j": [5]}
    np.testing.assert_array_equal(dense(einsum(notation, *[sparse(spark, a) for a in arrays]), want.shape), want)


def test_a_frequent_coordinate_is_spread(spark, monkeypatch):
    """With one i in all rows of two operands, no cell has much more than its share."""
    monkeypatch.setattr(multiway, "CELL_ROWS", 256)
    names = label_columns("ijk")
    one = lambda a, b: Tensor(spark.range(4000).select(a.alias("a0"), b.alias("a1"), F.lit(1.0).alias("v")), (None, None))
    i, j = F.lit(7).cast("long"), F.col("id")
    parts = [labelled(one(i, j), "ij", names), labelled(one(j, j), "jk", names), labelled(one(j, i), "ki", names)]
    stats = [measure(one(i, j)), measure(one(j, j)), measure(one(j, i))]
    heavy = multiway._heavy(parts, stats, list("ijk"), 16)
    grids = multiway._grids(parts, stats, list("ijk"), heavy, 16)
    cells = None
    for p in parts:
        rows = p.df.select(F.explode(multiway._cells(p, grids, heavy)).alias("cell"))
        cells = rows if cells is None else cells.unionByName(rows)
    counts = [r["count"] for r in cells.groupBy("cell").count().collect()]
    assert len(counts) >= 16 and max(counts) <= 3 * sorted(counts)[len(counts) // 2]
    assert contract_cycle(parts, []).df.first().v == 4000


def test_one_exchange_an_operand(spark):
    rng = np.random.default_rng(4)
    found = einsum("ij,jk,ki->", *[sparse(spark, some(rng, 9, 9)) for _ in range(3)])
    plan = found.df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and len(re.findall(r"\bExchange hashpartitioning", plan)) == 1  # all operands go through one


def test_known_sizes_and_acyclic_networks_go_in_pairs(spark):
    rng = np.random.default_rng(5)
    arrays = [some(rng, 4, 4) for _ in range(3)]
    found = einsum("ij,jk,ki->", *[sparse(spark, a, dims=True) for a in arrays])
    assert "Join" in found.df._jdf.queryExecution().optimizedPlan().toString()
    assert to_numpy(found) == np.einsum("ij,jk,ki->", *arrays)


def test_cyclic_core():
    assert cyclic_core(["ij", "jk", "ki"]) == [0, 1, 2]
    assert cyclic_core(["ij", "jk", "kl"]) == [] and cyclic_core(["ij", "ik", "ik"]) == [] and cyclic_core(["ij", "jk", "ki", "ijk"]) == []
    assert cyclic_core(["ij", "jk", "ki", "kl", "lm"]) == [0, 1, 2]


def test_shares():
    even = shares([("ij", 1e6), ("jk", 1e6), ("ki", 1e6)], "ijk", frozenset(), 64, 1e9)
    assert even == {"i": 4, "j": 4, "k": 4}
    assert shares([("ij", 10), ("jk", 1e6), ("ki", 10)], "ijk", frozenset(), 16, 1e9) == {"i": 1, "j": 4, "k": 4}
    held = shares([("ij", 1e6), ("jk", 1e6), ("ki", 1e6)], "ijk", frozenset("i"), 16, 1e9)
    assert held["i"] == 1 and held["j"] * held["k"] == 16
    finer = shares([("ij", 1e6), ("jk", 1e6), ("ki", 1e6)], "ijk", frozenset(), 1, 1e4)
    assert sum(1e6 / (finer[a] * finer[b]) for a, b in ("ij", "jk", "ki")) <= 1e4
    assert patterns("ijk", {"i": [1], "k": [2]}) == [frozenset(), frozenset("i"), frozenset("k"), frozenset("ik")]


def test_binding_order():
    """From orders to their one customer and few parts, not from suppliers to all of theirs."""
    relations = [("op", 6e5, {"o": 1.5e5, "p": 2e4}), ("sp", 6e5, {"s": 1e3, "p": 2e4}), ("sc", 6e5, {"s": 1e3, "c": 1.5e4}), ("oc", 1.5e5, {"o": 1.5e5, "c": 1.5e4})]
    order = binding_order(relations, "opsc")
    assert order.index("s") == 3 and sorted(order) == sorted("opsc")
    assert sorted(binding_order([("ab", 10, {"a": 3, "b": 5}), *[(x + y, 10, {x: 5, y: 5}) for x, y in zip("bcdefghi", "cdefghia", strict=True)]], "abcdefghi")) == sorted("abcdefghi")


def test_statistics(spark):
    t = Tensor(spark.range(1000).select((F.col("id") % 10).alias("a0"), F.when(F.col("id") < 500, 7).otherwise(F.col("id")).cast("long").alias("a1"), F.lit(1.0).alias("v")), (None, None))
    stats = measure(t)
    assert stats.rows == 1000 and abs(stats.distinct[0] - 10) <= 1 and 450 <= stats.distinct[1] <= 550
    assert stats.frequent[1][7] >= 500
    assert measure(t.measured()) is not None and t.measured().cells == 1000.0


def joined_rows(arrays, labels, steps, out):
    """Rows that the joins of an order make."""
    parts, made = [((a != 0).astype(float), x) for a, x in zip(arrays, labels, strict=True)], 0
    for i, j in steps:
        (a, x), (b, y) = parts[i], parts[j]
        every = "".join(dict.fromkeys(x + y))
        made += int(np.einsum(f"{x},{y}->", a, b))
        parts[i] = parts[j] = None
        others = set(out).union(*[p[1] for p in parts if p])
        kept = "".join(c for c in every if c in others)
        parts.append(((np.einsum(f"{x},{y}->{kept}", a, b) > 0).astype(float), kept))
    return made


def test_order_by_statistics_makes_fewer_rows(spark):
    """``ij`` and ``jk`` are large and meet in one j; ``kl`` leaves one k."""
    rng = np.random.default_rng(6)
    a, b, c = np.zeros((60, 40)), np.zeros((40, 60)), np.zeros((60, 5))
    a[:, 0], b[0, :] = 1, 1
    a[rng.integers(0, 60, 30), rng.integers(0, 40, 30)] = 1
    b[rng.integers(0, 40, 30), rng.integers(0, 60, 30)] = 1
    c[3, :] = 1
    arrays, labels = [a, b, c], ["ij", "jk", "kl"]
    tensors = [sparse(spark, x).measured() for x in arrays]
    steps = best_order([(x, t.stats.rows, dict(zip(x, t.stats.distinct, strict=True))) for x, t in zip(labels, tensors, strict=True)], "il")
    unknown = greedy_order([(x, None) for x in labels], "il", {})
    assert joined_rows(arrays, labels, steps, "il") < joined_rows(arrays, labels, unknown, "il")
    np.testing.assert_array_equal(dense(einsum("ij,jk,kl->il", *tensors), (60, 5)), np.einsum("ij,jk,kl->il", *arrays))


def test_best_order_has_all_operands():
    five = [("ab", 100, {"a": 10, "b": 50}), ("bc", 1e6, {"b": 50, "c": 1000}), ("cd", 10, {"c": 10, "d": 3}), ("de", 5, {"d": 3, "e": 5}), ("x", 3, {"x": 3})]
    steps = best_order(five, "axe")
    assert len(steps) == 4 and sorted(k for s in steps for k in s) == list(range(8))
    parts = [{x} for x in "ab bc cd de x".split()]
    for i, j in steps:
        parts.append(parts[i] | parts[j])
    apart = sum(not set("".join(parts[i])) & set("".join(parts[j])) for i, j in steps)
    assert parts[-1] == {"ab", "bc", "cd", "de", "x"} and apart == 1  # only x shares no label


def test_empty_operands(spark):
    rng = np.random.default_rng(7)
    full, none = sparse(spark, some(rng, 5, 5)), Tensor(sparse(spark, some(rng, 5, 5)).df.where("v > 100"), (None, None))
    assert einsum("ij,jk,ki->", full, none, full).df.collect() == [(0.0,)]
    assert einsum("ij,jk,ki->i", full, none, full).df.count() == 0
    assert einsum("ij,jk,kl->il", *[t.measured() for t in (full, none, full)]).df.count() == 0
