"""Einsum notation: ``"(ij,jk),kl->il"`` to a tree of leaves and contractions.

    notation := operands "->" labels
    operands := operand ("," operand)*
    operand  := labels | "(" operands ")"
    labels   := any letters, none for a scalar

White space means nothing. Parentheses fix the order of contraction.
"""

from __future__ import annotations

from dataclasses import dataclass

from tensorloom.errors import ParseError


@dataclass(frozen=True)
class Leaf:
    labels: str
    operand: int


@dataclass(frozen=True)
class Contract:
    args: tuple[Node, ...]


Node = Leaf | Contract


@dataclass(frozen=True)
class Notation:
    root: Node
    output: str

    @property
    def leaves(self) -> list[Leaf]:
        def walk(node: Node) -> list[Leaf]:
            return [node] if isinstance(node, Leaf) else [x for a in node.args for x in walk(a)]

        return sorted(walk(self.root), key=lambda x: x.operand)


class _Reader:
    """Recursive descent over the operands."""

    def __init__(self, text: str) -> None:
        self.text, self.at, self.count = text, 0, 0

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def operands(self) -> tuple[Node, ...]:
        found = [self.operand()]
        while self.peek() == ",":
            self.at += 1
            found.append(self.operand())
        return tuple(found)

    def operand(self) -> Node:
        if self.peek() == "(":
            self.at += 1
            inner = self.operands()
            if self.peek() != ")":
                raise ParseError(f"no closing parenthesis at {self.at} in {self.text!r}")
            self.at += 1
            return Contract(inner)
        start = self.at
        while self.peek().isalpha():
            self.at += 1
        if self.peek() not in ("", ",", ")"):
            raise ParseError(f"unexpected {self.peek()!r} at {self.at} in {self.text!r}")
        self.count += 1
        return Leaf(self.text[start : self.at], self.count - 1)


def parse_einsum(notation: str) -> Notation:
    """Read a notation; ``ParseError`` if it has no or several arrows, or is malformed."""
    text = "".join(notation.split())
    left, arrow, output = text.partition("->")
    if not arrow or "->" in output:
        raise ParseError(f"exactly one '->' is needed in {notation!r}")
    if output and not output.isalpha():
        raise ParseError(f"output labels must be letters: {output!r}")
    reader = _Reader(left)
    args = reader.operands()
    if reader.at < len(left):
        raise ParseError(f"unexpected {reader.peek()!r} at {reader.at} in {left!r}")
    if len(args) == 1 and isinstance(args[0], Contract):
        return Notation(args[0], output)
    return Notation(Contract(args), output)


def reverse_notation(notation: str) -> str:
    """Labels of each operand and of the output in reverse; parentheses and commas stay."""
    out, word = [], ""
    for c in "".join(notation.split()):
        if c.isalpha():
            word += c
        else:
            out += [word[::-1], c]
            word = ""
    return "".join([*out, word[::-1]])
