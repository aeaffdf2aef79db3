"""Notation and planner: no Spark."""

import pytest

from tensorloom.errors import DimensionMismatch, DuplicateAxis, OrphanOutputAxis, ParseError
from tensorloom.plans.notation import Contract, Leaf, parse_einsum, reverse_notation
from tensorloom.plans.planner import column_major_strides, greedy_order, label_sizes, plan_pair, row_major_strides


def test_flat_notation():
    found = parse_einsum(" ij , jk -> ik ")
    assert found.output == "ik"
    assert found.root == Contract((Leaf("ij", 0), Leaf("jk", 1)))


def test_nested_notation_counts_operands_from_the_left():
    found = parse_einsum("((ij,jk),(kl,lm))->im")
    assert [x.labels for x in found.leaves] == ["ij", "jk", "kl", "lm"]
    assert found.root == Contract((Contract((Leaf("ij", 0), Leaf("jk", 1))), Contract((Leaf("kl", 2), Leaf("lm", 3)))))


@pytest.mark.parametrize(("text", "labels"), [("->ij", [""]), (",k->k", ["", "k"]), ("i,->i", ["i", ""]), (",->", ["", ""]), ("αβ,βγ->αγ", ["αβ", "βγ"]), ("iI->I", ["iI"])])
def test_scalars_and_letters(text, labels):
    assert [x.labels for x in parse_einsum(text).leaves] == labels


@pytest.mark.parametrize("text", ["ij,jk", "i->j->k", "(ij,jk->ik", "ij),jk->ik", "i1->i", "i->1", "(ij)k->i"])
def test_malformed_notation(text):
    with pytest.raises(ParseError):
        parse_einsum(text)


def test_reverse_notation():
    assert reverse_notation("(ij,jk),kl->il") == "(ji,kj),lk->li"


def test_classes_of_axes():
    plan = plan_pair("bijt", "bjku", "bik")
    assert (plan.batch, plan.left, plan.right, plan.summed, plan.left_trace, plan.right_trace) == (["b"], ["i"], ["k"], ["j"], ["t"], ["u"])
    assert plan.order == ["i", "k", "b"]
    assert plan_pair("ij", "ij", "ij").elementwise


def test_plan_errors():
    with pytest.raises(DuplicateAxis):
        plan_pair("ii", "ij", "j")
    with pytest.raises(OrphanOutputAxis):
        plan_pair("ij", "jk", "iz")
    with pytest.raises(DimensionMismatch):
        label_sizes([("ij", (2, 3)), ("jk", (4, 5))])
    with pytest.raises(DimensionMismatch):
        label_sizes([("i", (3,))], {"i": 5})
    assert label_sizes([("i", (3,))], {"z": 9})["z"] == 9


def test_greedy_order_takes_the_cheapest_pair_first():
    sizes = {"i": 100, "j": 2, "k": 100, "l": 2}
    assert greedy_order([("ij", None), ("jk", None), ("kl", None)], "il", sizes)[0] == (1, 2)
    assert greedy_order([("i", None), ("j", None), ("ij", None)], "", {"i": 5, "j": 5})[0] != (0, 1)


def test_strides():
    assert column_major_strides((2, 3, 4)) == [1, 2, 6]
    assert row_major_strides((2, 3, 4)) == [12, 4, 1]
    assert row_major_strides(()) == []
