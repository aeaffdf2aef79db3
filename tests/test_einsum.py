"""Einsum against NumPy, with the cases that NumPy has no notation for spelled out."""

import numpy as np
import pytest

from tensorloom import MAX_PLUS, EinsumCode, Tensor, einsum, einsum2, einsum_into
from tensorloom.errors import DimensionMismatch, DuplicateAxis, OperandCountMismatch, OrphanOutputAxis, OutputShapeMismatch, ParseError, RankMismatch, TypeMismatch
from tensorloom.functions.semiring import MAX_TIMES
from tensorloom.operators.einsum import einsum_numpy_into
from tensorloom.sources.tensors import from_numpy, to_numpy

CASES = [
    "ij,jk->ik", "ij,kj->ik", "i,j->ij", "i,i->", "bij,bjk->bik", "ij->ji", "ii->", "ij->i", "ij->j", "ij->", "ij->ij", "iij->j", "iji->j", "jii->j", "ijj->i", "ijj->ij", "iijj->", "iijj->ij", "iii->",
    "ijk->ik", "ijkl->ljki", "ij,jk,kl->il", "(ij,jk),kl->il", "ij,(jk,kl)->il", "((ij,jk),(kl,lm))->im", "ij,ik,il->jkl", "ij,ik,ik->j", "ijk,jlk->il", "ijk,jlk->ilk", "ij,kl->ijkl", "ij,ij->ij", "ijk,ijk->",
    "ij,jk->k", "ij,jk->i", "ij,k->k", "ii,ij->j", "(ii),ij->j", ",k->k", "i,->i", ",->", "αβ,βγ->αγ", "αα->", "ijk,jlk->li", "ijk,kl->ijl", "iI,IJ->iJ", "illljkk->kij",
]


def operands(notation, rng, kind="real", sizes=None):
    sizes = sizes or {}
    out = []
    for labels in notation.split("->")[0].replace("(", "").replace(")", "").split(","):
        dims = [sizes.setdefault(x, int(rng.integers(1, 4))) for x in labels]
        a = rng.uniform(-1, 1, dims)
        wide = kind == "complex" or (kind == "mixed" and len(out) % 2)
        out.append(a + 1j * rng.uniform(-1, 1, dims) if wide else a)
    return out


def expected(notation, arrays):
    plain = notation.replace("(", "").replace(")", "")
    letters = {x: chr(97 + k) for k, x in enumerate(dict.fromkeys(c for c in plain if c.isalpha()))}
    return np.einsum("".join(letters.get(c, c) for c in plain), *arrays)


@pytest.mark.parametrize("notation", CASES)
def test_real(spark, notation):
    arrays = operands(notation, np.random.default_rng(len(notation)))
    got = to_numpy(einsum(notation, *[from_numpy(spark, a) for a in arrays]))
    np.testing.assert_allclose(got, expected(notation, arrays), atol=1e-10)


@pytest.mark.parametrize("kind", ["complex", "mixed"])
@pytest.mark.parametrize("notation", ["ij,jk->ik", "i,i->", "ii->", "iij->j", "ij->ji", "ij,jk,kl->il", "ij,ij->ij"])
def test_complex_and_mixed(spark, notation, kind):
    arrays = operands(notation, np.random.default_rng(7), kind)
    np.testing.assert_allclose(to_numpy(einsum(notation, *[from_numpy(spark, a) for a in arrays])), expected(notation, arrays), atol=1e-10)


@pytest.mark.parametrize("notation", ["ij,jk->ik", "ij->", "ii->", "ij->i"])
def test_empty_axes(spark, notation):
    arrays = operands(notation, np.random.default_rng(1), sizes={"i": 0 if notation != "ij,jk->ik" else 2, "j": 0, "k": 3})
    np.testing.assert_allclose(to_numpy(einsum(notation, *[from_numpy(spark, a) for a in arrays])), expected(notation, arrays))


def test_generative_and_duplicate_outputs(spark):
    v, one = from_numpy(spark, np.array([1.0, 2.0, 3.0])), from_numpy(spark, np.array(2.0))
    np.testing.assert_array_equal(to_numpy(einsum("i->ii", v)), np.diag([1.0, 2.0, 3.0]))
    np.testing.assert_array_equal(to_numpy(einsum("ii->i", einsum("i->ii", v))), [1.0, 2.0, 3.0])
    np.testing.assert_array_equal(to_numpy(einsum("i->ij", v, sizes={"j": 4})), np.repeat([[1.0], [2.0], [3.0]], 4, axis=1))
    np.testing.assert_array_equal(to_numpy(einsum("->ij", one, sizes={"i": 2, "j": 3})), np.full((2, 3), 2.0))
    cube = to_numpy(einsum("->iii", one, sizes={"i": 3}))
    assert cube.sum() == 6 and all(cube[k, k, k] == 2 for k in range(3))
    m = np.arange(6.0).reshape(2, 3)
    four = to_numpy(einsum("ij->ijij", from_numpy(spark, m)))
    assert all(four[i, j, i, j] == m[i, j] for i in range(2) for j in range(3)) and four.sum() == m.sum()
    got = to_numpy(einsum("ab,bc->acc", from_numpy(spark, m), from_numpy(spark, m.T)))
    np.testing.assert_array_equal(got[:, [0, 1], [0, 1]], m @ m.T)
    got = to_numpy(einsum("ab,bc->ace", from_numpy(spark, m), from_numpy(spark, m.T), sizes={"e": 2}))
    np.testing.assert_array_equal(got, np.repeat((m @ m.T)[:, :, None], 2, axis=2))


def test_alpha_and_beta(spark):
    a, b, c = (np.random.default_rng(3).uniform(-1, 1, (2, 2)) for _ in range(3))
    ta, tb, tc = (from_numpy(spark, x) for x in (a, b, c))
    np.testing.assert_allclose(to_numpy(einsum_into("ij,jk->ik", ta, tb, out=tc, alpha=2.0, beta=3.0)), 2 * a @ b + 3 * c)
    np.testing.assert_allclose(to_numpy(einsum_into("ij->ji", ta, out=tc, alpha=2.0, beta=3.0)), 2 * a.T + 3 * c)
    np.testing.assert_allclose(to_numpy(einsum_into("ii->", ta, out=from_numpy(spark, np.array(4.0)), alpha=2.0, beta=5.0)), 2 * np.trace(a) + 20)
    bad = from_numpy(spark, np.full((2, 2), np.nan))
    np.testing.assert_allclose(to_numpy(einsum_into("ij,jk->ik", ta, tb, out=bad)), a @ b)
    np.testing.assert_allclose(to_numpy(einsum_into("ij->ii", from_numpy(spark, np.eye(2)), out=tc, beta=1.0)), np.eye(2) + c)
    z = from_numpy(spark, c + 0j)
    np.testing.assert_allclose(to_numpy(einsum_into("ij,jk->ik", ta, tb, out=z, alpha=1j, beta=2.0)), 1j * a @ b + 2 * c)


def test_pair_interface(spark):
    a = np.random.default_rng(4).uniform(-1, 1, (2, 3)) + 1j
    b = np.random.default_rng(5).uniform(-1, 1, (3, 2)) - 2j
    ta, tb = from_numpy(spark, a), from_numpy(spark, b)
    np.testing.assert_allclose(to_numpy(einsum2(ta, tb, [10, 20], [20, 30], [10, 30], conj_a=True, conj_b=True)), a.conj() @ b.conj())
    r = from_numpy(spark, a.real)
    np.testing.assert_allclose(to_numpy(einsum2(r, r, "ij", "ij", "ij", map_a=lambda v: v * 2)), 2 * a.real**2)
    got = to_numpy(einsum2(r, from_numpy(spark, b.real), "ij", "jk", "ik", semiring=MAX_PLUS))
    np.testing.assert_allclose(got, (a.real[:, :, None] + b.real[None]).max(axis=1))
    np.testing.assert_allclose(to_numpy(einsum("ij,ij->", ta.conj(), ta)), (abs(a) ** 2).sum())


def test_errors(spark):
    a = from_numpy(spark, np.ones((2, 3)))
    z = from_numpy(spark, np.ones((2, 3), complex))
    for error, call in [
        (ParseError, lambda: einsum("ij,jk", a, a)),
        (OperandCountMismatch, lambda: einsum("ij,jk->ik", a)),
        (RankMismatch, lambda: einsum("ijk->i", a)),
        (DimensionMismatch, lambda: einsum("ij,jk->ik", a, a)),
        (DimensionMismatch, lambda: einsum("ii->", a)),
        (DimensionMismatch, lambda: einsum("ij->ij", a, sizes={"i": 5})),
        (OrphanOutputAxis, lambda: einsum("ij->iz", a)),
        (TypeMismatch, lambda: einsum_into("ij->ij", z, out=a)),
        (OutputShapeMismatch, lambda: einsum_into("ij->ji", a, out=a)),
        (DuplicateAxis, lambda: einsum2(a, a, "ij", "ij", "ii")),
        (OrphanOutputAxis, lambda: einsum2(a, a, "ij", "ij", "iz")),
    ]:
        with pytest.raises(error):
            call()


def test_code_runs_many_times(spark):
    code = EinsumCode("ij,jk->ik")
    for n in (1, 2):
        a = np.full((n, n), 2.0)
        np.testing.assert_array_equal(to_numpy(code.evaluate([from_numpy(spark, a)] * 2)), a @ a)


def plan_of(t: Tensor) -> str:
    return t.df._jdf.queryExecution().optimizedPlan().toString()


def test_no_grouping_where_nothing_is_summed(spark):
    a = from_numpy(spark, np.ones((3, 3)))
    assert "Aggregate" not in plan_of(einsum("ij,ij->ij", a, a))
    assert "Aggregate" not in plan_of(einsum("ij,kl->ijkl", a, a))
    assert "Aggregate" not in plan_of(einsum("ij->ji", a))


def test_early_sums_and_no_cross_joins(spark):
    a = from_numpy(spark, np.ones((3, 3)))
    plan = plan_of(einsum("ij,jk->k", a, a))
    assert plan.count("Aggregate") == 2  # one below the join
    assert "Cross" not in plan_of(einsum("ij,jk,kl->il", a, a, a))


def test_maps_see_absent_cells(spark):
    a, b = np.array([[0.0, 2.0], [3.0, 0.0]]), np.array([[1.0, 0.0], [0.0, 4.0]])
    got = einsum2(from_numpy(spark, a), from_numpy(spark, b), "ij", "jk", "ik", map_a=lambda v: v + 1)
    np.testing.assert_allclose(to_numpy(got), (a + 1) @ b)


def test_max_times_with_negative_factors(spark):
    a, b = np.array([[1.0, 5.0], [2.0, 3.0]]), np.array([-2.0, -1.0])
    got = to_numpy(einsum("ij,k->ik", from_numpy(spark, a), from_numpy(spark, b), semiring=MAX_TIMES))
    np.testing.assert_allclose(got, (a[:, :, None] * b[None, None, :]).max(axis=1))


def test_numpy_into(spark):
    rng = np.random.default_rng(0)
    a, b, out = rng.random((2, 3)), rng.random((3, 4)), np.asfortranarray(rng.random((2, 4)))
    want = 2.0 * a @ b + 0.5 * out
    assert einsum_numpy_into(spark, "ij,jk->ik", a, b, out=out, alpha=2.0, beta=0.5) is out
    np.testing.assert_allclose(out, want)
