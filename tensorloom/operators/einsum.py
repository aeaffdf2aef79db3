"""Einsum of any number of tensors in string notation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import functions as F

from tensorloom.errors import OperandCountMismatch, OrphanOutputAxis, OutputShapeMismatch, TypeMismatch
from tensorloom.functions.semiring import COUNTING, KNOWN, PLUS_TIMES, Semiring
from tensorloom.operators.contract import Labelled, accumulated, contract_pair, label_columns, labelled, scale
from tensorloom.operators.multiway import contract_cycle
from tensorloom.operators.virtual import Repeated, eliminated
from tensorloom.plans.multiway import cyclic_core
from tensorloom.plans.notation import Leaf, Node, Notation, parse_einsum
from tensorloom.plans.planner import MANY, best_order, greedy_order, label_sizes
from tensorloom.tensor import Tensor, axis


class EinsumCode:
    """A notation read once, to be evaluated for many operands."""

    def __init__(self, notation: str | Notation) -> None:
        self.notation = parse_einsum(notation) if isinstance(notation, str) else notation

    def evaluate(self, operands: Sequence[Tensor], size_dict: Mapping[str, int] | None = None, semiring: Semiring = PLUS_TIMES) -> Tensor:
        leaves, output = self.notation.leaves, self.notation.output
        if len(leaves) != len(operands):
            raise OperandCountMismatch(f"{len(leaves)} operands in the notation, {len(operands)} given")
        for leaf, t in zip(leaves, operands, strict=True):
            t.need_rank(len(leaf.labels))
        sizes = label_sizes([(x.labels, t.dims) for x, t in zip(leaves, operands, strict=True)], size_dict)
        known = set("".join(x.labels for x in leaves))
        for x in output:
            if x not in known and sizes.get(x) is None:
                raise OrphanOutputAxis(f"{x!r} is in no operand and has no size")
        if semiring in KNOWN and any(isinstance(t, Repeated) and 0 not in t.dims for t in operands):
            plain, bases, sizes, factor = eliminated(self.notation, [t if 0 not in t.dims else Tensor(t.df, t.dims, t.dtype) for t in operands], sizes)
            found = EinsumCode(plain).evaluate(bases, sizes, semiring)
            return _times(found, factor) if semiring in (PLUS_TIMES, COUNTING) else found  # the others' plus is idempotent
        names = label_columns([*"".join(x.labels for x in leaves), *output])
        needed = [x for x in dict.fromkeys(output) if x in known]
        found = self._node(self.notation.root, needed, operands, names, sizes, semiring)
        t = _finish(found, output, sizes)
        return t.filled() if not output and semiring is PLUS_TIMES else t

    def evaluate_into(self, operands: Sequence[Tensor], out: Tensor, alpha: complex = 1.0, beta: complex = 0.0, size_dict: Mapping[str, int] | None = None) -> Tensor:
        if any(t.is_complex() for t in operands) and not out.is_complex():
            raise TypeMismatch("a real output cannot take a complex result")
        found = self.evaluate(operands, size_dict)
        if found.rank != out.rank or any(None not in (m, n) and m != n for m, n in zip(found.dims, out.dims, strict=True)):
            raise OutputShapeMismatch(f"the result has shape {found.dims}, the output {out.dims}")
        if out.is_complex():
            found = found.to_complex()
        return accumulated(found, out, alpha, beta)

    def _node(self, node: Node, needed: Sequence[str], operands: Sequence[Tensor], names: dict, sizes: dict, semiring: Semiring) -> Labelled:
        """A node's tensor with exactly the labels ``needed``; all else is summed as early as it can be."""
        if isinstance(node, Leaf):
            return labelled(operands[node.operand], node.labels, names)
        below = [set(_labels(a)) for a in node.args]
        parts = []
        for k, arg in enumerate(node.args):
            others = set(needed).union(*[s for n, s in enumerate(below) if n != k])
            parts.append(self._node(arg, [x for x in dict.fromkeys(_labels(arg)) if x in others], operands, names, sizes, semiring))
            if not isinstance(arg, Leaf):
                below[k] = set(parts[-1].labels)
        if len(parts) == 1:
            return parts[0].summed(list(needed), semiring)
        core = cyclic_core([p.labels for p in parts]) if len(parts) > 2 and semiring is PLUS_TIMES else []
        if core and any(sizes.get(x) is None for k in core for x in parts[k].labels):
            ring, rest = [parts[k] for k in core], [p for k, p in enumerate(parts) if k not in core]
            others = set(needed).union(*[p.labels for p in rest])
            parts = [contract_cycle(ring, [x for x in dict.fromkeys(x for p in ring for x in p.labels) if x in others]), *rest]
        if all(p.stats for p in parts) and len(parts) <= MANY:
            order = best_order([(p.labels, p.stats.rows, dict(zip(p.labels, p.stats.distinct, strict=True))) for p in parts], needed)
        else:
            order = greedy_order([(p.labels, p.cells) for p in parts], needed, sizes)
        for i, j in order:
            others = set(needed).union(*[p.labels for k, p in enumerate(parts) if p is not None and k not in (i, j)])
            kept = [x for x in dict.fromkeys([*parts[i].labels, *parts[j].labels]) if x in others]
            parts.append(contract_pair(parts[i], parts[j], kept, semiring, sizes))
            parts[i] = parts[j] = None
        return parts[-1].summed(list(needed), semiring)


def _labels(node: Node) -> str:
    return node.labels if isinstance(node, Leaf) else "".join(_labels(a) for a in node.args)


def _finish(found: Labelled, output: str, sizes: Mapping[str, int | None]) -> Tensor:
    """Order of axes; labels that stand twice and labels of the output alone stay symbols (``Repeated``)."""
    df = found.df.select(*[F.col(found.names[x]).alias(axis(k)) for k, x in enumerate(found.labels)], *found.values)
    base = Tensor(df, [sizes.get(x) for x in found.labels], found.dtype, cells=found.cells)
    virtual = [x for x in dict.fromkeys(output) if x not in found.labels]
    layout = [found.labels.index(x) if x in found.labels else -1 - virtual.index(x) for x in output]
    if virtual or len(set(output)) < len(output):
        return Repeated(base, layout, [sizes.get(x) for x in output])
    return base if layout == list(range(base.rank)) else base.permute(layout)


def _times(t: Tensor, factor: int) -> Tensor:
    if factor == 1:
        return t
    if isinstance(t, Repeated):
        return Repeated(_times(t.base, factor), t.layout, t.dims)
    whole = not t.is_complex() and dict(t.df.dtypes)["v"] in ("bigint", "int")
    return scale(t, factor if whole else float(factor))


def einsum(notation: str | EinsumCode, *operands: Tensor, sizes: Mapping[str, int] | None = None, semiring: Semiring = PLUS_TIMES) -> Tensor:
    """``einsum("(ij,jk),kl->il", a, b, c)``. ``sizes``: of labels that only the output has."""
    code = notation if isinstance(notation, EinsumCode) else EinsumCode(notation)
    return code.evaluate(operands, sizes, semiring)


def einsum_into(notation: str | EinsumCode, *operands: Tensor, out: Tensor, alpha: complex = 1.0, beta: complex = 0.0, sizes: Mapping[str, int] | None = None) -> Tensor:
    """``alpha * einsum(...) + beta * out``."""
    code = notation if isinstance(notation, EinsumCode) else EinsumCode(notation)
    return code.evaluate_into(operands, out, alpha, beta, sizes)


def einsum_numpy_into(spark, notation: str, *arrays, out, alpha: complex = 1.0, beta: complex = 0.0, sizes: Mapping[str, int] | None = None):
    """``alpha * einsum(...) + beta * out`` over NumPy arrays; the result is written to ``out`` and returned."""
    from tensorloom.sources.tensors import from_numpy, to_numpy

    found = einsum_into(notation, *[from_numpy(spark, a) for a in arrays], out=from_numpy(spark, out), alpha=alpha, beta=beta, sizes=sizes)
    out[...] = to_numpy(found)
    return out


def einsum_numpy(spark, notation: str, *arrays, sizes: Mapping[str, int] | None = None):
    """NumPy arrays of any layout in, a NumPy array out."""
    from tensorloom.sources.tensors import from_numpy, to_numpy

    return to_numpy(einsum(notation, *[from_numpy(spark, a) for a in arrays], sizes=sizes))
