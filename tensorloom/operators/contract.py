"""Binary contraction: join on what is shared, multiply, sum what is not asked for.

Axes that only one operand has and the output lacks are summed before the join, and
no grouping is planned where nothing is summed. Complex values are two columns, so
all arithmetic stays in generated code. Large products of dense operands go by tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Mapping, Sequence
from functools import reduce
from math import prod
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.errors import DuplicateAxis, OrphanOutputAxis, OutputShapeMismatch, RankMismatch, TypeMismatch
from tensorloom.functions.semiring import PLUS_TIMES, Semiring
from tensorloom.operators import tiers
from tensorloom.operators.rows import row_product
from tensorloom.operators.statistics import Statistics
from tensorloom.operators.tiers import DENSE, Tiled, by_blocks, placed
from tensorloom.plans.planner import label_sizes, plan_pair
from tensorloom.tensor import Tensor, axis


#: Rows of one coordinate that are never dealt out over several tasks.
HOT_ROWS = 1 << 17

#: Inner coordinates up to which rows are multiplied whole.
SHALLOW = 4096

#: Of a real value, or of real and imaginary part; a pair returned is complex.
Map = Callable[..., "Column | tuple[Column, Column]"]


class Labelled:
    """A tensor whose axis columns carry the names of their labels, for joins by name; ``form``: its tiles, if it is one of them."""

    def __init__(self, df: DataFrame | None, labels: Sequence[Hashable], names: dict, dtype: str, cells: float | None, stats: Statistics | None = None, form: Tiled | None = None) -> None:
        self._df, self.labels, self.names, self.dtype, self.cells, self.stats, self.form = df, list(labels), names, dtype, cells, stats, form

    @property
    def df(self) -> DataFrame:
        """The cells; those of tiles are laid open when they are first asked for."""
        if self._df is None:
            self._df = self.form.cells()
        return self._df

    @property
    def values(self) -> list[str]:
        return ["re", "im"] if self.dtype == "complex" else ["v"]

    def columns(self, labels: Sequence[Hashable]) -> list[str]:
        return [self.names[x] for x in labels]

    def summed(self, keep: Sequence[Hashable], semiring: Semiring = PLUS_TIMES) -> Labelled:
        """Only the labels in ``keep``: one grouping, or none if they are all there."""
        if set(keep) == set(self.labels):
            stats = self.stats and self.stats.picked([self.labels.index(x) for x in keep])
            return Labelled(self._df, keep, self.names, self.dtype, self.cells, stats, self.form)
        sums = [semiring.plus(F.col(n)).alias(n) for n in self.values]
        if keep:
            df = self.df.groupBy(*self.columns(keep)).agg(*sums)
        else:
            df = self.df.agg(*[F.coalesce(s, F.lit(semiring.zero)).alias(n) for s, n in zip(sums, self.values, strict=True)])
        return Labelled(df, keep, self.names, self.dtype, self.cells)

    def promoted(self) -> Labelled:
        if self.dtype == "complex":
            return self
        df = self.df.select(*self.columns(self.labels), F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im"))
        return Labelled(df, self.labels, self.names, "complex", self.cells)


def label_columns(labels: Sequence[Hashable]) -> dict[Hashable, str]:
    """A column name by label: letters of any script and case stay apart."""
    return {x: f"x{k}" for k, x in enumerate(dict.fromkeys(labels))}


def labelled(t: Tensor, labels: Sequence[Hashable], names: dict, value: Map | None = None) -> Labelled:
    """A tensor under labels; a label that stands twice selects the diagonal."""
    if len(labels) != t.rank:
        raise RankMismatch(f"{len(labels)} labels for {t.rank} axes")
    seen: dict[Hashable, int] = {}
    df = t.df
    for k, x in enumerate(labels):
        if x in seen:
            df = df.where(F.col(axis(seen[x])) == F.col(axis(k)))
        else:
            seen[x] = k
    parts = t.parts() if value is None else _mapped(value, t.parts())
    columns = [F.col(axis(k)).alias(names[x]) for x, k in seen.items()]
    return Labelled(df.select(*columns, *[p.alias(n) for p, n in zip(parts, ["re", "im"] if len(parts) == 2 else ["v"], strict=True)]), list(seen), names, "complex" if len(parts) == 2 else "real", t.cells, t.stats if len(seen) == t.rank else None)


def _mapped(value: Map, parts: Sequence[Column]) -> list[Column]:
    found = value(*parts)
    return list(found) if isinstance(found, list | tuple) else [found]


def contract_pair(a: Labelled, b: Labelled, out: Sequence[Hashable], semiring: Semiring = PLUS_TIMES, sizes: Mapping[Hashable, int | None] | None = None) -> Labelled:
    """Contract two operands to the labels ``out``, which all are in one of them.

    By tiles if ``sizes`` and the numbers of cells tell that both are dense and large
    (values other than doubles stay with cells, so that their type never depends on size).
    """
    if semiring is not PLUS_TIMES and "complex" in (a.dtype, b.dtype):
        raise TypeMismatch(f"complex values have no {semiring.name}")
    plan = plan_pair(a.labels, b.labels, list(out))
    last = list(plan.summed)
    if semiring.distributes:
        a = a.summed([x for x in a.labels if x not in plan.left_trace], semiring)
        b = b.summed([x for x in b.labels if x not in plan.right_trace], semiring)
    else:
        last += [*plan.left_trace, *plan.right_trace]
    if a.dtype != b.dtype:
        a, b = a.promoted(), b.promoted()
    plain = semiring is PLUS_TIMES and last == list(plan.summed)
    known = {x: _size(x, (a, b), sizes or {}) for x in [*plan.order, *plan.summed]}
    groups = (plan.batch, plan.left, plan.right, plan.summed)
    if plain and by_blocks([[known[x] for x in g] for g in groups], (a.cells, b.cells)) and all(dict(x.df.dtypes)[n] == "double" for x in (a, b) for n in x.values):
        # a size that was only measured tells what pays; one axis needs no size, several together do
        sides = [[(a.names[x], (sizes or {}).get(x)) for x in g] for g in groups]
        if all(len(side) < 2 or all(n is not None for _, n in side) for side in sides):
            batch, left, right, inner = sides
            form = placed(a.form, lambda: a.df, a.names, batch, left, inner, a.values).times(placed(b.form, lambda: b.df, b.names, batch, inner, right, b.values))
            pairs = float(prod(known[x] for x in plan.order))
            return Labelled(None, plan.order, a.names, a.dtype, pairs, Statistics(int(pairs), tuple(known[x] for x in plan.order), ({},) * len(plan.order)) if a.stats and b.stats else None, form=form)
    if plain and (rows := _shallow(a, b, groups)) and {dict(x.df.dtypes)[n] for x in (a, b) for n in x.values} in ({"bigint"}, {"double"}):
        df = row_product(a.df, b.df, *[a.columns(g) for g in groups], a.values, rows)
        return Labelled(df.select(*a.columns(plan.order), *a.values), plan.order, a.names, a.dtype, None)
    keys = a.columns([*plan.batch, *plan.summed])
    left = a.df.select(*a.columns(a.labels), *[F.col(n).alias(f"l_{n}") for n in a.values])
    right = b.df.select(*b.columns(b.labels), *[F.col(n).alias(f"r_{n}") for n in b.values])
    left, right, salt = _salted(a, b, left, right, [*plan.batch, *plan.summed])
    joined = left.join(right, [*keys, *salt]) if keys else left.crossJoin(right)
    if a.dtype == "complex":
        products = [F.col("l_re") * F.col("r_re") - F.col("l_im") * F.col("r_im"), F.col("l_re") * F.col("r_im") + F.col("l_im") * F.col("r_re")]
    else:
        products = [semiring.times(F.col("l_v"), F.col("r_v"))]
    every = [*plan.order, *last]
    df = joined.select(*a.columns(every), *[p.alias(n) for p, n in zip(products, a.values, strict=True)])
    found = Labelled(df, every, a.names, a.dtype, None)
    found = found.summed(plan.order, semiring)
    if not plan.order and not last:  # scalars: a row each, so a product without a grouping
        found = Labelled(found.df, [], a.names, a.dtype, 1.0)
    return found


def _shallow(a: Labelled, b: Labelled, groups: Sequence[Sequence[Hashable]]) -> tuple[float, float] | None:
    """About how many rows both sides have, if both were measured, each row stores a good part of the
    few inner coordinates there are, and cells would make many pairs for each row of the product."""
    batch, left, right, inner = groups
    if not (a.stats and b.stats and left and right and inner):
        return None
    distinct = [dict(zip(p.labels, p.stats.distinct, strict=True)) for p in (a, b)]
    width = prod(max(d[x] for d in distinct) for x in inner)
    rows = tuple(float(max(d[x] for x in (*batch, *own))) for d, own in zip(distinct, (left, right), strict=True))
    pairs = a.stats.rows * b.stats.rows / max(1, width * prod(max(d[x] for d in distinct) for x in batch))
    dense = all(p.stats.rows > DENSE * width * n for p, n in zip((a, b), rows, strict=True))
    return tuple(p.stats.rows / max(1, width) for p in (a, b)) if 1 < width <= SHALLOW and dense and pairs >= tiers.BLOCKS_FROM else None


def _size(x: Hashable, parts: Sequence[Labelled], sizes: Mapping[Hashable, int | None]) -> int | None:
    """A label's size, or the distinct coordinates that were measured, the most of both operands."""
    if sizes.get(x) is not None:
        return sizes[x]
    seen = [p.stats.distinct[p.labels.index(x)] for p in parts if x in p.labels and p.stats]
    return max(seen) if seen and len(seen) == sum(x in p.labels for p in parts) else None


def _salted(a: Labelled, b: Labelled, left: DataFrame, right: DataFrame, joined: Sequence[Hashable]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with one more key, if one of them was measured and has frequent coordinates.

    Rows of such a coordinate are dealt out over several tasks by their other axes, and the
    other side's rows of it go to each of them. What they add up to is summed in each task and
    then across tasks, as for all rows.
    """
    tasks = max(2, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot: list[tuple[int, Hashable, int, int]] = []
    for side, p in enumerate((a, b)):
        for x in joined if p.stats else ():
            fair = max(p.stats.rows / tasks, HOT_ROWS)
            hot += [(n, x, v, side) for v, n in p.stats.frequent[p.labels.index(x)].items() if n > 2 * fair]
    if not hot:
        return left, right, []
    of = {(x, v): (n, side) for n, x, v, side in sorted(hot, key=lambda h: (h[0], h[3]))}  # the larger side is dealt out
    sides = []
    for side, (df, p) in enumerate(((left, a), (right, b))):
        rest = [F.col(c) for c in df.columns]
        mine = {x: [v for (y, v), (_, s) in of.items() if y == x and s == side] for x in joined}
        theirs = {x: [v for (y, v), (_, s) in of.items() if y == x and s != side] for x in joined}
        any_of = lambda found, p=p: reduce(or_, [F.col(p.names[x]).isin(v) for x, v in found.items() if v], F.lit(False))
        own = F.when(any_of(mine), F.pmod(F.xxhash64(*rest), F.lit(tasks)).cast("int")).otherwise(F.lit(-1))
        copies = F.when(any_of(theirs), F.sequence(F.lit(0), F.lit(tasks - 1))).otherwise(F.array(F.lit(-1)))
        sides.append(df.withColumn(f"salt{side}", own).withColumn(f"salt{1 - side}", F.explode(copies)))
    return sides[0], sides[1], ["salt0", "salt1"]


def accumulated(result: Tensor, out: Tensor | None, alpha: complex = 1.0, beta: complex = 0.0) -> Tensor:
    """``alpha * result + beta * out``; ``out`` is not read for a beta of 0."""
    scaled = scale(result, alpha)
    if out is None or beta == 0:
        return scaled
    if result.is_complex() and not out.is_complex():
        raise TypeMismatch("a real output cannot take a complex result")
    if any(None not in (m, n) and m != n for m, n in zip(result.dims, out.dims, strict=False)) or result.rank != out.rank:
        raise OutputShapeMismatch(f"the result has shape {result.dims}, the output {out.dims}")
    other = scale(out, beta)
    if other.is_complex() and not scaled.is_complex():
        scaled = scaled.to_complex()
    both = scaled.df.unionByName(other.df)
    sums = [F.sum(n).alias(n) for n in scaled.values]
    df = both.groupBy(*scaled.axes).agg(*sums) if scaled.rank else both.agg(*[F.coalesce(s, F.lit(0.0)).alias(n) for s, n in zip(sums, scaled.values, strict=True)])
    return Tensor(df, scaled.dims, scaled.dtype)


def scale(t: Tensor, s: complex) -> Tensor:
    """``s * t``, the scalar on the left."""
    if s == 1 and not t.conjugated:
        return t
    if isinstance(s, complex) and s.imag:
        t = t.to_complex()
        re, im = t.parts()
        parts = [F.lit(s.real) * re - F.lit(s.imag) * im, F.lit(s.real) * im + F.lit(s.imag) * re]
    else:
        s = s.real if isinstance(s, complex) else s
        parts = [F.lit(s) * p for p in t.parts()]
    return Tensor(t.df.select(*t.axes, *[p.alias(n) for p, n in zip(parts, t.values, strict=True)]), t.dims, t.dtype, cells=t.cells)


def as_tensor(found: Labelled, out: Sequence[Hashable], sizes: dict) -> Tensor:
    df = found.df.select(*[F.col(found.names[x]).alias(axis(k)) for k, x in enumerate(out)], *found.values)
    return Tensor(df, [sizes.get(x) for x in out], found.dtype, cells=found.cells)


def dense_for(t: Tensor, value: Map | None) -> Tensor:
    """``t`` with a row for every cell if ``value`` makes something else than zero of zero."""
    if value is None:
        return t
    at_zero = t.df.sparkSession.range(1).select(*_mapped(value, [F.lit(0.0) for _ in t.values])).first()
    return t if all(x == 0 for x in at_zero) else t.densify()


def einsum2(
    a: Tensor, b: Tensor, ia: Sequence[Hashable], ib: Sequence[Hashable], ic: Sequence[Hashable], *, out: Tensor | None = None, alpha: complex = 1.0, beta: complex = 0.0,
    conj_a: bool = False, conj_b: bool = False, map_a: Map | None = None, map_b: Map | None = None, semiring: Semiring = PLUS_TIMES,
) -> Tensor:
    """``alpha * contract(a, b) + beta * out`` with labels of any hashable type.

    ``map_a`` and ``map_b`` are applied to values before the product, to absent cells
    too; of a complex operand they take real and imaginary part and return a pair (or one
    column, which is real). Where a map of zero is not zero, the operand is made dense, so its sizes are
    found or known. With a semiring other than plus and times, alpha and beta must be
    left out.
    """
    if len(set(ic)) < len(ic):
        raise DuplicateAxis(f"an output label stands twice in {list(ic)}")
    for x in ic:
        if x not in ia and x not in ib:
            raise OrphanOutputAxis(f"{x!r} is in no operand")
    sizes = label_sizes([(ia, a.dims), (ib, b.dims)] + ([(ic, out.dims)] if out is not None else []))
    names = label_columns([*ia, *ib, *ic])
    a, b = dense_for(a, map_a), dense_for(b, map_b)
    left = labelled(a.conj() if conj_a else a, ia, names, map_a)
    right = labelled(b.conj() if conj_b else b, ib, names, map_b)
    found = as_tensor(contract_pair(left, right, ic, semiring, sizes), ic, sizes)
    return found if semiring is not PLUS_TIMES else accumulated(found, out, alpha, beta)
