"""Pairs of operations to contract with in place of times and plus."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Semiring(NamedTuple):
    """``times`` joins two values, ``plus`` is an aggregate over a group; absent cells are ``zero``.

    ``distributes``: whether ``times`` distributes over ``plus`` for all values, so that
    an operand's own axes may be summed before the product.
    """

    name: str
    times: Callable[[Column, Column], Column]
    plus: Callable[[Column], Column]
    zero: Any
    one: Any
    distributes: bool = True


PLUS_TIMES = Semiring("plus_times", lambda a, b: a * b, F.sum, 0.0, 1.0)
MAX_PLUS = Semiring("max_plus", lambda a, b: a + b, F.max, float("-inf"), 0.0)
MIN_PLUS = Semiring("min_plus", lambda a, b: a + b, F.min, float("inf"), 0.0)
#: Of values of at least zero: an absent cell is zero, the least of them. Where values are negative, ``densify`` first.
MAX_TIMES = Semiring("max_times", lambda a, b: a * b, F.max, 0.0, 1.0, distributes=False)  # a negative factor turns the order around
BOOL_OR_AND = Semiring("bool_or_and", lambda a, b: a & b, F.bool_or, False, True)
COUNTING = Semiring("counting", lambda a, b: a * b, F.sum, 0, 1)
#: Those whose sum of equal values is known without adding: n times the value, or the value.
KNOWN = (PLUS_TIMES, MAX_PLUS, MIN_PLUS, MAX_TIMES, BOOL_OR_AND, COUNTING)
