"""Axes that no row is stored for: repeats, deltas and constants as symbols.

A ``Repeated`` tensor is a base tensor seen through a layout: each axis shows one of the
base's axes, or a virtual index that runs over its size whatever the cell. Two axes that show
the same one are a delta: only cells with equal coordinates there are not zero. ``i->ij``,
``i->ii``, ``->ij``, broadcasts, constants and identity matrices are of this kind. Rows are
made only if they are asked for. A contraction needs none: a virtual axis puts no condition
on its label, so it is dropped from the operand where others have the label, is a factor where
it is summed, and stays virtual in the result; a delta gives two labels one name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.errors import InvalidAxis, RankMismatch
from tensorloom.plans.notation import Contract, Leaf, Node, Notation
from tensorloom.tensor import Tensor, axis


class Repeated(Tensor):
    """``layout`` has an entry an axis: the number of the base's axis, or below 0 a virtual index's."""

    def __init__(self, base: Tensor, layout: Sequence[int], dims: Sequence[int | None]) -> None:
        self.base, self.layout, self._rows = base, tuple(layout), None
        repeats = prod({k: n for k, n in zip(layout, dims, strict=True) if k < 0}.values())
        super().__init__(None, dims, base.dtype, cells=None if base.cells is None else base.cells * repeats, conj=base.conjugated)

    @property
    def df(self) -> DataFrame:
        """A row for every cell, made when it is first asked for."""
        if self._rows is None:
            rows, spark = self.base.df, self.base.df.sparkSession
            for k, n in dict(zip(self.layout, self.dims, strict=True)).items():
                if k < 0:
                    rows = rows.crossJoin(spark.range(n).select(F.col("id").alias(f"r{-k}")))
            self._rows = rows.select(*[F.col(axis(k) if k >= 0 else f"r{-k}").alias(axis(n)) for n, k in enumerate(self.layout)], *self.values)
        return self._rows

    @df.setter
    def df(self, rows: DataFrame | None) -> None:
        self._rows = rows

    def permute(self, order: Sequence[int]) -> Tensor:
        if len(order) != self.rank:
            raise RankMismatch(f"{len(order)} axes given for {self.rank}")
        if sorted(order) != list(range(self.rank)):
            raise InvalidAxis(f"{list(order)} is no permutation")
        return Repeated(self.base, [self.layout[o] for o in order], [self.dims[o] for o in order])

    def conj(self) -> Tensor:
        return Repeated(self.base.conj(), self.layout, self.dims)

    def to_complex(self) -> Tensor:
        return Repeated(self.base.to_complex(), self.layout, self.dims)


def constant(spark: SparkSession, dims: Sequence[int], value: complex = 1.0) -> Tensor:
    """One value at every cell."""
    parts = [F.lit(value.real).alias("re"), F.lit(value.imag).alias("im")] if isinstance(value, complex) else [F.lit(float(value)).alias("v")]
    base = Tensor(spark.range(1).select(*parts), (), "complex" if len(parts) == 2 else "real", cells=1.0)
    return Repeated(base, [-1 - k for k in range(len(dims))], dims)


def identity(spark: SparkSession, n: int) -> Tensor:
    """The delta of two axes."""
    return Repeated(constant(spark, ()).base, [-1, -1], (n, n))


def _renamed(node: Node, labels: Mapping[int, str]) -> Node:
    return Leaf(labels[node.operand], node.operand) if isinstance(node, Leaf) else Contract(tuple(_renamed(a, labels) for a in node.args))


def eliminated(notation: Notation, operands: Sequence[Tensor], sizes: Mapping[str, int | None]) -> tuple[Notation, list[Tensor], dict[str, int | None], int]:
    """The same contraction over base tensors alone, the sizes of its labels, and a factor.

    Labels are renamed where deltas make them one; a virtual axis's label that others have
    is bounded there, by a filter where a size is not known.
    """
    one: dict[str, str] = {}

    def find(x: str) -> str:
        while x in one:
            x = one[x]
        return x

    virtual: list[tuple[str, int]] = []
    shown: dict[int, dict[int, str]] = {}
    for leaf, t in zip(notation.leaves, operands, strict=True):
        if not isinstance(t, Repeated):
            continue
        first = shown.setdefault(leaf.operand, {})
        for x, k, n in zip(leaf.labels, t.layout, t.dims, strict=True):
            if k not in first:
                first[k] = x
                if k < 0:
                    virtual.append((x, n))
            elif find(x) != find(first[k]):
                one[find(x)] = find(first[k])
    labels, bases = {}, []
    for leaf, t in zip(notation.leaves, operands, strict=True):
        own = shown.get(leaf.operand)
        labels[leaf.operand] = "".join(find(x) for x in leaf.labels) if own is None else "".join(find(own[k]) for k in range(t.base.rank))
        bases.append(t if own is None else t.base)
    known: dict[str, int | None] = {}
    for x, n in sizes.items():
        known[find(x)] = n if n is not None else known.get(find(x))
    output, factor = "".join(find(x) for x in notation.output), 1
    for x, n in {find(x): n for x, n in virtual}.items():
        having = [k for k, own in labels.items() if x in own]
        for k in having:
            t = bases[k]
            for place, y in enumerate(labels[k]):
                if y == x and t.dims[place] is None:
                    t = Tensor(t.df.where(F.col(axis(place)) < n), [n if p == place else m for p, m in enumerate(t.dims)], t.dtype, cells=t.cells, conj=t.conjugated, stats=t.stats)
            bases[k] = t
        if not having and x not in output:
            factor *= n
        known[x] = n
    return Notation(_renamed(notation.root, labels), output), bases, known, factor
