"""A tensor as a relation: one row a cell, one long column an axis, and the value.

Columns are ``a0, a1, ...`` and ``v``, or ``re`` and ``im`` for complex values. Cells
without a row are zero, and no two rows share their coordinates. ``dims`` are known
on the driver (None where a size is not), never counted from the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.errors import InvalidAxis, RankMismatch, ShapeMismatch


def axis(k: int) -> str:
    return f"a{k}"


class Tensor:
    """See the module. ``cells``: about how many rows there are, if known; ``conj``: values count as conjugated; ``stats``: what ``measured`` found."""

    def __init__(self, df: DataFrame, dims: Sequence[int | None], dtype: str = "real", *, cells: float | None = None, conj: bool = False, stats=None) -> None:
        self.df, self.dims, self.dtype, self.cells, self.stats = df, tuple(dims), dtype, cells, stats
        self.conjugated = conj and dtype == "complex"

    # what it is

    @property
    def rank(self) -> int:
        return len(self.dims)

    ndim = rank

    @property
    def axes(self) -> list[str]:
        return [axis(k) for k in range(self.rank)]

    @property
    def values(self) -> list[str]:
        return ["re", "im"] if self.dtype == "complex" else ["v"]

    def __len__(self) -> int:
        """Number of cells, stored or not."""
        if None in self.dims:
            raise ShapeMismatch("not all sizes are known")
        return prod(self.dims)

    @property
    def is_empty(self) -> bool:
        return 0 in self.dims

    def is_complex(self) -> bool:
        return self.dtype == "complex"

    def parts(self) -> list[Column]:
        """Value columns with a pending conjugation applied."""
        if self.dtype != "complex":
            return [F.col("v")]
        return [F.col("re"), -F.col("im") if self.conjugated else F.col("im")]

    def resolved(self) -> Tensor:
        """The same with any conjugation carried out."""
        if not self.conjugated:
            return self
        return Tensor(self.df.select(*self.axes, *[p.alias(n) for p, n in zip(self.parts(), self.values, strict=True)]), self.dims, self.dtype, cells=self.cells)

    def measured(self) -> Tensor:
        """The same with statistics of its cells, from one pass; contractions are ordered by them."""
        from tensorloom.operators.statistics import measure

        stats = measure(self)
        return Tensor(self.df, self.dims, self.dtype, cells=float(stats.rows), conj=self.conjugated, stats=stats)

    def _same(self, df: DataFrame, dims: Sequence[int | None] | None = None, cells: float | None = None) -> Tensor:
        return Tensor(df, self.dims if dims is None else dims, self.dtype, cells=self.cells if cells is None else cells, conj=self.conjugated)

    def need_rank(self, rank: int) -> None:
        if self.rank != rank:
            raise RankMismatch(f"{self.rank} axes; {rank} are needed")

    # views: projections and filters, never a shuffle

    def permute(self, order: Sequence[int]) -> Tensor:
        """Axis k of the result is axis ``order[k]``."""
        if len(order) != self.rank:
            raise RankMismatch(f"{len(order)} axes given for {self.rank}")
        if sorted(order) != list(range(self.rank)):
            raise InvalidAxis(f"{list(order)} is no permutation")
        return self._same(self.df.select(*[F.col(axis(o)).alias(axis(k)) for k, o in enumerate(order)], *self.values), [self.dims[o] for o in order])

    def transpose_2d(self) -> Tensor:
        self.need_rank(2)
        return self.permute((1, 0))

    def conj(self) -> Tensor:
        """Lazily conjugated; twice is nothing."""
        return Tensor(self.df, self.dims, self.dtype, cells=self.cells, conj=not self.conjugated)

    def adjoint_2d(self) -> Tensor:
        return self.transpose_2d().conj()

    def diagonal(self, pairs: Sequence[tuple[int, int]]) -> Tensor:
        """Cells where both axes of each pair agree; the higher one goes, the size is the smaller."""
        gone, dims, keep = set(), list(self.dims), []
        for a, b in pairs:
            if not (0 <= a < self.rank and 0 <= b < self.rank and a != b) or max(a, b) in gone:
                raise InvalidAxis(f"no diagonal of axes {a} and {b}")
            lo, hi = min(a, b), max(a, b)
            keep.append(F.col(axis(lo)) == F.col(axis(hi)))
            dims[lo] = min((n for n in (dims[lo], dims[hi]) if n is not None), default=None)
            gone.add(hi)
        left = [k for k in range(self.rank) if k not in gone]
        df = self.df.where(reduce(lambda x, y: x & y, keep)) if keep else self.df
        return self._same(df.select(*[F.col(axis(o)).alias(axis(k)) for k, o in enumerate(left)], *self.values), [dims[k] for k in left])

    def broadcast(self, target: Sequence[int]) -> Tensor:
        """Axes of size 1 repeated to the target's size, without a row for any repeat until it is asked for."""
        if len(target) != self.rank:
            raise RankMismatch(f"{len(target)} axes given for {self.rank}")
        from tensorloom.operators.virtual import Repeated

        for k, (have, want) in enumerate(zip(self.dims, target, strict=True)):
            if have not in (want, 1):
                raise ShapeMismatch(f"axis {k} has size {have}; it cannot become {want}")
        kept = [k for k, (have, want) in enumerate(zip(self.dims, target, strict=True)) if have == want]
        df = self.df.select(*[F.col(axis(k)).alias(axis(n)) for n, k in enumerate(kept)], *self.values)
        base = Tensor(df, [self.dims[k] for k in kept], self.dtype, cells=self.cells, conj=self.conjugated)
        return Repeated(base, [kept.index(k) if k in kept else -1 - k for k in range(self.rank)], target)

    # cells

    def _at(self, index: Sequence[int]) -> Column:
        if len(index) != self.rank:
            raise RankMismatch(f"{len(index)} numbers given for {self.rank} axes")
        for k, (i, n) in enumerate(zip(index, self.dims, strict=True)):
            if i < 0 or (n is not None and i >= n):
                raise InvalidAxis(f"{i} is out of range on axis {k} of size {n}")
        return reduce(lambda x, y: x & y, [F.col(axis(k)) == F.lit(int(i)) for k, i in enumerate(index)], F.lit(True))

    def get(self, index: Sequence[int]) -> Tensor:
        """One cell as a tensor without axes."""
        return self._same(self.df.where(self._at(index)).select(*self.values), ()).filled()

    def set(self, index: Sequence[int], value: complex) -> Tensor:
        """A tensor that differs in one cell."""
        new = [float(value)] if self.dtype != "complex" else [complex(value).real, complex(value).imag]
        row = self.df.sparkSession.range(1).select(*[F.lit(int(i)).cast("long").alias(axis(k)) for k, i in enumerate(index)], *[F.lit(x).alias(n) for x, n in zip(new, self.values, strict=True)])
        here = self.resolved()
        return here._same(here.df.where(~self._at(index)).unionByName(row))

    # zeros

    def filled(self) -> Tensor:
        """Without axes: a row even if no cell is stored."""
        self.need_rank(0)
        return self._same(self.df.agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in self.values]))

    def densify(self, zero: float = 0.0) -> Tensor:
        """With a row for every cell, absent ones being ``zero``."""
        if not self.rank:
            return self.filled()
        here = self.resolved()
        grid = index_grid(self.df.sparkSession, self.dims)
        df = grid.join(here.df, self.axes, "left").select(*self.axes, *[F.coalesce(F.col(n), F.lit(zero)).alias(n) for n in self.values])
        return here._same(df, cells=float(len(self)))

    # types

    def to_complex(self) -> Tensor:
        if self.dtype == "complex":
            return self
        return Tensor(self.df.select(*self.axes, F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im")), self.dims, "complex", cells=self.cells)

    def try_to_real(self, tolerance: float = 1e-15) -> Tensor | None:
        """The real part if no imaginary part reaches ``tolerance``; one aggregate runs to know."""
        if self.dtype != "complex":
            return self
        most = self.df.agg(F.max(F.abs("im"))).first()[0]
        if most is not None and most >= tolerance:
            return None
        return Tensor(self.df.select(*self.axes, F.col("re").alias("v")), self.dims, "real", cells=self.cells)

    def named(self, names: Sequence[str], value: str = "value") -> DataFrame:
        """Columns by the caller's names; complex values as ``<value>_re`` and ``<value>_im``."""
        if len(names) != self.rank:
            raise RankMismatch(f"{len(names)} names given for {self.rank} axes")
        out = [value] if self.dtype != "complex" else [f"{value}_re", f"{value}_im"]
        return self.df.select(*[F.col(axis(k)).alias(n) for k, n in enumerate(names)], *[p.alias(n) for p, n in zip(self.parts(), out, strict=True)])


def index_grid(spark, dims: Sequence[int]) -> DataFrame:
    """All coordinates of a shape: a range, decoded; one row for no axes."""
    if None in dims:
        raise ShapeMismatch("all sizes must be known")
    grid, step, columns = spark.range(prod(dims)), 1, {}
    for k in range(len(dims) - 1, -1, -1):
        columns[k] = F.expr(f"id div {step}") % F.lit(dims[k] or 1)
        step *= dims[k] or 1
    return grid.select(*[columns[k].cast("long").alias(axis(k)) for k in range(len(dims))])
