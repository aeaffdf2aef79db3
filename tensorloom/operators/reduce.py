"""Reductions of whole tensors and of single axes.

Spark's own aggregates are used where they say what is meant. Other folds keep a state of
a few numbers a group: each task folds its rows by key and sends one state a key on, and
states are merged where keys meet, for a whole tensor in rounds of fewer and fewer tasks.
No group is ever gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.errors import InvalidAxis, TypeMismatch
from tensorloom.functions.exact import EXACT_SUM, exact_total
from tensorloom.functions.monoids import COMPLEX_PRODUCT, COUNT, PRODUCT, SUM, Fold, Monoid, segments
from tensorloom.tensor import Tensor

Function = Callable[..., Column | tuple[Column, Column]]
#: States that one task merges in a round of a whole tensor's fold.
FAN_IN = 64


def reduce(t: Tensor, monoid: Monoid | Fold = SUM, f: Function | None = None) -> Tensor:
    """Fold of ``f`` of all values.

    ``f`` takes one column, or real and imaginary part of a complex tensor, and returns one
    column for a real and a pair for a complex value. Absent cells take no part; ``densify``
    first where zeros matter (product, max, min). Complex values have no maximum or
    minimum: that is a ``TypeMismatch``.
    """
    return reduce_axes(t, range(t.rank), monoid, f)


def reduce_axis(t: Tensor, k: int, monoid: Monoid | Fold = SUM, f: Function | None = None) -> Tensor:
    """Fold along one axis; the last axis leaves a tensor without axes."""
    if not 0 <= k < t.rank:
        raise InvalidAxis(f"axis {k} of {t.rank}")
    return reduce_axes(t, [k], monoid, f)


def reduce_axes(t: Tensor, gone: Sequence[int], monoid: Monoid | Fold = SUM, f: Function | None = None) -> Tensor:
    """Fold along several axes in a single grouping."""
    if any(not 0 <= k < t.rank for k in gone):
        raise InvalidAxis(f"axes {list(gone)} of {t.rank}")
    left = [k for k in range(t.rank) if k not in set(gone)]
    found = t.parts() if f is None else f(*t.parts())
    values = list(found) if isinstance(found, list | tuple) else [found]
    dims = [t.dims[k] for k in left]
    if len(values) == 2 and monoid is PRODUCT:
        monoid = COMPLEX_PRODUCT
    if isinstance(monoid, Fold):
        return _folded(t, values, left, dims, monoid)
    if len(values) == 2 and monoid not in (SUM, COUNT, EXACT_SUM):
        raise TypeMismatch(f"complex values have no {monoid.name}")
    if monoid is EXACT_SUM:
        return exact_total(t, values, left, dims)
    names = ["re", "im"] if len(values) == 2 and monoid is SUM else ["v"]
    folds = [monoid.fold(p) for p in values[: len(names)]]
    if left:
        df = t.df.groupBy(*[F.col(f"a{o}").alias(f"a{k}") for k, o in enumerate(left)]).agg(*[p.alias(n) for p, n in zip(folds, names, strict=True)])
    else:
        df = t.df.agg(*[(p if monoid.identity is None else F.coalesce(p, F.lit(monoid.identity))).alias(n) for p, n in zip(folds, names, strict=True)])
    return Tensor(df, dims, "complex" if len(names) == 2 else "real", cells=None if left else 1.0)


def _runs(keys: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts equal keys together, and where each run of them starts."""
    if not keys:
        return np.arange(n), np.zeros(min(n, 1), dtype=np.int64)
    order = np.lexsort(keys[::-1])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(new)


def _folded(t: Tensor, values: list[Column], left: list[int], dims: list, fold: Fold) -> Tensor:
    names = [n for n, _ in fold.state]
    inputs = [v.cast("double").alias(f"in{k}") for k, v in enumerate(values)] + ([F.col(f"a{k}").alias(f"at{k}") for k in range(t.rank)] if fold.places else [])
    keys = [f"a{k}" for k in range(len(left))]
    rows = t.df.select(*[F.col(f"a{o}").alias(f"a{k}") for k, o in enumerate(left)], *inputs)
    schema = ", ".join([f"{k} long" for k in keys] + [f"`{n}` {kind}" for n, kind in fold.state])
    n_keys, step, merge = len(keys), fold.step, fold.merge

    def arrays(b: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
        found = [b.column(k).to_numpy(zero_copy_only=False) for k in range(b.num_columns)]
        return found[:n_keys], found[n_keys:]

    def batch(keys_: list[np.ndarray], state: Sequence[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*keys_, *state)], [*keys, *names])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One state a key and batch, in the order of the keys."""
        for b in batches:
            if b.num_rows:
                by, columns = arrays(b)
                order, starts = _runs(by, b.num_rows)
                yield batch([k[order][starts] for k in by], step([c[order] for c in columns], starts))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """States that follow each other by key, merged; of the last key one is held."""
        held: tuple[list, list] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            by, state = arrays(b)
            if held is not None:
                by, state = ([np.concatenate(x) for x in zip(a, c, strict=True)] for a, c in zip(held, (by, state), strict=True))
            order, starts = _runs(by, len(state[0]))
            by, state = [k[order][starts] for k in by], segments([c[order] for c in state], starts, merge)
            if len(starts) > 1:
                yield batch([k[:-1] for k in by], [c[:-1] for c in state])
            held = [k[-1:] for k in by], [c[-1:] for c in state]
        if held is not None:
            yield batch(*held)

    def combine(df: DataFrame, tasks: int | None) -> DataFrame:
        if keys:
            dealt = df.repartition(*keys) if tasks is None else df
            return dealt.sortWithinPartitions(*keys).mapInArrow(merged, schema)
        return (df if tasks is None else df.repartition(tasks)).mapInArrow(merged, schema)

    states = combine(rows.mapInArrow(partial, schema), 0 if keys else None)  # within each task
    if keys:
        states = combine(states, None)
    else:
        tasks = max(1, rows.sparkSession.sparkContext.defaultParallelism)
        while tasks > FAN_IN:
            tasks = -(-tasks // FAN_IN)
            states = combine(states, tasks)
        states = combine(states, 1)
    out = fold.finish(*[F.col(n) for n in names])
    parts = list(out) if isinstance(out, tuple) else [out]
    columns = ["re", "im"] if len(parts) == 2 else ["v"]
    df = states.select(*keys, *[p.alias(n) for p, n in zip(parts, columns, strict=True)])
    if not keys:  # a row even for no values
        given = fold.identity if isinstance(fold.identity, tuple) else (fold.identity,) * len(columns)
        df = df.agg(*[F.coalesce(F.max(c), F.lit(g)).alias(c) if g is not None else F.max(c).alias(c) for c, g in zip(columns, given, strict=True)])
    return Tensor(df, dims, "complex" if len(parts) == 2 else "real", cells=None if keys else 1.0)


def total(t: Tensor) -> Tensor:
    return reduce(t)


def dot(a: Tensor, b: Tensor, *, exact: bool = False) -> Tensor:
    """Sum of products, nothing conjugated but what is already; ``exact`` rounds that sum once, whatever the order."""
    from tensorloom.operators.contract import einsum2

    labels = list(range(a.rank))
    if exact:
        return reduce(einsum2(a, b, labels, labels, labels), EXACT_SUM)
    return einsum2(a, b, labels, labels, []).filled()


def trace_axes(own: Sequence[Hashable], other: Sequence[Hashable], out: Sequence[Hashable]) -> list[int]:
    """Places of the labels that only one operand has and the output lacks."""
    return [k for k, x in enumerate(own) if x not in other and x not in out]
