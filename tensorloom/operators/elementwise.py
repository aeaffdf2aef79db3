"""Maps over cells of one or several tensors of one shape.

Tensors that are projections of one DataFrame are combined in a plain select; others
by an outer join on all axes, absent cells counting as zero. A function that is not
zero for zeros must be asked for ``dense`` results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tensorloom.errors import NonSquare, ShapeMismatch
from tensorloom.operators.contract import accumulated, scale
from tensorloom.tensor import Tensor

Function = Callable[..., Column | tuple[Column, Column]]


def _values(found: Column | tuple[Column, Column]) -> list[Column]:
    parts = list(found) if isinstance(found, tuple) else [found]
    return [p.alias(n) for p, n in zip(parts, ["re", "im"] if len(parts) == 2 else ["v"], strict=True)]


def map_cells(t: Tensor, f: Function, *, dense: bool = False) -> Tensor:
    """``f`` of each value: of one column, or of real and imaginary part. A pair returned is complex."""
    t = t.densify() if dense else t
    values = _values(f(*t.parts()))
    return Tensor(t.df.select(*t.axes, *values), t.dims, "complex" if len(values) == 2 else "real", cells=t.cells)


def zip_map(f: Function, *tensors: Tensor, dense: bool = False) -> Tensor:
    """``f`` of the values at the same place; real tensors give one column each, complex ones two.

    If some tensor is complex all are.
    """
    first = tensors[0]
    for t in tensors[1:]:
        if t.rank != first.rank or any(None not in (m, n) and m != n for m, n in zip(t.dims, first.dims, strict=True)):
            raise ShapeMismatch(f"shapes {first.dims} and {t.dims}")
    dims = [next((t.dims[k] for t in tensors if t.dims[k] is not None), None) for k in range(first.rank)]
    if any(t.is_complex() for t in tensors):
        tensors = tuple(t.to_complex() for t in tensors)
    if all(t.df is first.df for t in tensors) and not dense:
        values = _values(f(*[p for t in tensors for p in t.parts()]))
        return Tensor(first.df.select(*first.axes, *values), dims, "complex" if len(values) == 2 else "real")
    sides = []
    for k, t in enumerate(tensors):
        sides.append(t.df.select(*t.axes, *[p.alias(f"{n}{k}_") for p, n in zip(t.parts(), t.values, strict=True)]))
    joined = sides[0]
    for side in sides[1:]:
        joined = joined.join(side, first.axes, "full") if first.rank else joined.crossJoin(side)
    if dense and first.rank:
        from tensorloom.tensor import index_grid

        joined = index_grid(first.df.sparkSession, dims).join(joined, first.axes, "left")
    values = _values(f(*[F.coalesce(F.col(f"{n}{k}_"), F.lit(0.0)) for k, t in enumerate(tensors) for n in t.values]))
    return Tensor(joined.select(*first.axes, *values), dims, "complex" if len(values) == 2 else "real")


def copy(t: Tensor) -> Tensor:
    """With any conjugation carried out."""
    return t.resolved()


def add(dest: Tensor, src: Tensor) -> Tensor:
    """``dest + src``: a union and one grouping, which needs no join."""
    return accumulated(src, dest.to_complex() if src.is_complex() else dest, 1.0, 1.0)


def axpy(dest: Tensor, src: Tensor, alpha: complex) -> Tensor:
    """``alpha * src + dest``."""
    wide = src.is_complex() or (isinstance(alpha, complex) and alpha.imag)
    return accumulated(src, dest.to_complex() if wide else dest, alpha, 1.0)


def mul(dest: Tensor, src: Tensor) -> Tensor:
    """``dest * src`` by an inner join: where one is zero the product is."""
    from tensorloom.operators.contract import einsum2

    if dest.rank != src.rank:
        raise ShapeMismatch(f"shapes {dest.dims} and {src.dims}")
    labels = list(range(dest.rank))
    return einsum2(dest, src, labels, labels, labels)


def fma(dest: Tensor, a: Tensor, b: Tensor) -> Tensor:
    """``dest + a * b``."""
    return add(dest, mul(a, b))


def copy_scale(src: Tensor, s: complex) -> Tensor:
    return scale(src, s).resolved()


def copy_conj(src: Tensor) -> Tensor:
    return src.conj().resolved()


def copy_transpose_scale(src: Tensor, s: complex) -> Tensor:
    return scale(src.transpose_2d(), s).resolved()


def _square(t: Tensor) -> None:
    t.need_rank(2)
    if None not in t.dims and t.dims[0] != t.dims[1]:
        raise NonSquare(f"{t.dims[0]} x {t.dims[1]}")


def symmetrize(t: Tensor) -> Tensor:
    """``(A + A transposed) / 2``: both triangles in one grouping."""
    _square(t)
    return scale(add(t.resolved(), t.transpose_2d().resolved()), 0.5)


def symmetrize_conj(t: Tensor) -> Tensor:
    """``(A + A adjoint) / 2``."""
    _square(t)
    return scale(add(t.resolved(), t.adjoint_2d().resolved()), 0.5)
