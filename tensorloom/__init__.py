"""Tensor analytics on Spark: tensors as relations, einsum as joins and aggregations."""

from tensorloom.functions.semiring import BOOL_OR_AND, COUNTING, MAX_PLUS, MAX_TIMES, MIN_PLUS, PLUS_TIMES, Semiring
from tensorloom.operators.contract import einsum2
from tensorloom.operators.einsum import EinsumCode, einsum, einsum_into
from tensorloom.plans.notation import parse_einsum
from tensorloom.tensor import Tensor

__all__ = ["BOOL_OR_AND", "COUNTING", "MAX_PLUS", "MAX_TIMES", "MIN_PLUS", "PLUS_TIMES", "EinsumCode", "Semiring", "Tensor", "einsum", "einsum2", "einsum_into", "parse_einsum"]
