"""Aggregates for reductions: Spark's own ones, and folds with a state that merges."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any, NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Monoid(NamedTuple):
    """One of Spark's aggregates over real values; the fold's identity is what it starts from.

    ``complex_``: what it is over complex values, another fold or None where it has no meaning.
    """

    name: str
    fold: Callable[[Column], Column]
    identity: Any


class Fold(NamedTuple):
    """A fold with a state of several numbers, which need not be one of Spark's aggregates.

    ``step(columns, starts)`` folds runs of rows: ``columns`` are NumPy arrays (the values, or
    real and imaginary parts, and then the axes where ``places`` is set), a run lasts from
    one of ``starts`` to the next, and what is returned is an array a state column, an entry a
    run. ``merge(a, b)`` joins two states a run each, as tuples of arrays. It must be
    associative and commutative. ``finish(state)`` gives the value columns: one for a real
    result, two for a complex one. ``state`` names the columns of the state and their types
    (``double`` or ``long``). ``identity`` is the result for no values at all, or None.
    """

    name: str
    state: Sequence[tuple[str, str]]
    step: Callable[[Sequence[np.ndarray], np.ndarray], Sequence[np.ndarray]]
    merge: Callable[[Sequence[np.ndarray], Sequence[np.ndarray]], Sequence[np.ndarray]]
    finish: Callable[..., Column | tuple[Column, Column]]
    identity: Any = None
    places: bool = False


SUM = Monoid("sum", F.sum, 0.0)
PRODUCT = Monoid("product", F.product, 1.0)
MAX = Monoid("max", F.max, None)
MIN = Monoid("min", F.min, None)
COUNT = Monoid("count", F.count, 0)


def segments(columns: Sequence[np.ndarray], starts: np.ndarray, merge: Callable) -> Sequence[np.ndarray]:
    """Runs folded with ``merge`` alone, by halves: any associative merge becomes a step."""
    ends = np.append(starts[1:], len(columns[0]))
    columns, lengths = [np.asarray(c) for c in columns], ends - starts
    while len(lengths) and lengths.max() > 1:
        first = np.cumsum(lengths) - lengths
        inside = np.arange(lengths.sum()) - np.repeat(first, lengths)
        paired = (inside % 2 == 0) & (inside + 1 < np.repeat(lengths, lengths))
        left = np.flatnonzero(inside % 2 == 0)
        both = np.flatnonzero(paired)
        joined = merge([c[both] for c in columns], [c[both + 1] for c in columns])
        at, out = np.searchsorted(left, both), []
        for c, j in zip(columns, joined, strict=True):
            kept = c[left]
            kept[at] = j
            out.append(kept)
        columns, lengths = out, (lengths + 1) // 2
    return columns


def _logaddexp(a, b):
    top = np.maximum(a[0], b[0])
    safe = np.where(np.isfinite(top), top, 0.0)
    return top, a[1] * np.exp(a[0] - safe) + b[1] * np.exp(b[0] - safe)


def _times(a, b):
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


#: Product of complex values.
COMPLEX_PRODUCT = Fold("complex_product", (("p_re", "double"), ("p_im", "double")), lambda c, s: segments(c[:2], s, _times), _times, lambda p, q: (p, q), identity=(1.0, 0.0))
#: log(sum(exp(v))), without overflow: the largest value and the sum of exponentials below it.
LOGSUMEXP = Fold("logsumexp", (("top", "double"), ("sum", "double")), lambda c, s: segments([c[0], np.ones(len(c[0]))], s, _logaddexp), _logaddexp, lambda top, total: top + F.log(total))


def extreme_place(axis: int, largest: bool = True) -> Fold:
    """The coordinate on ``axis`` of the largest (smallest) value; of equal ones the smallest coordinate."""

    def merge(a, b):
        better = (a[0] > b[0]) if largest else (a[0] < b[0])
        first = better | ((a[0] == b[0]) & (a[1] <= b[1]))
        return np.where(first, a[0], b[0]), np.where(first, a[1], b[1])

    return Fold("argmax" if largest else "argmin", (("best", "double"), ("place", "long")), lambda c, s: segments([c[0], c[1 + axis]], s, merge), merge, lambda best, place: place, places=True)


def _moments(a, b):
    n = a[0] + b[0]
    gap = b[1] - a[1]
    share = b[0] / np.maximum(n, 1)
    return n, a[1] + gap * share, a[2] + b[2] + gap * gap * a[0] * share


#: Population variance, by counts, means and squared deviations.
VARIANCE = Fold(
    "variance", (("n", "double"), ("mean", "double"), ("dev", "double")), lambda c, s: segments([np.ones(len(c[0])), c[0], np.zeros(len(c[0]))], s, _moments), _moments, lambda n, mean, dev: dev / n
)
