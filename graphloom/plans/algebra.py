"""Logical plan of a query: plain dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    name: str
    hidden: bool = False  # blank node in a query


@dataclass(frozen=True)
class Term:
    text: str


Node = Var | Term


@dataclass(frozen=True)
class Pattern:
    s: Node
    p: Node
    o: Node

    def nodes(self) -> tuple[Node, Node, Node]:
        return (self.s, self.p, self.o)

    def variables(self) -> list[str]:
        return [n.name for n in self.nodes() if isinstance(n, Var)]


@dataclass(frozen=True)
class Call:
    """An expression: operator or function name in lower case, arguments expressions, Node or plain values."""

    name: str
    args: tuple


@dataclass
class Group:
    """Elements in order: Pattern, ("filter", expr), ("optional", Group), ("union", [Group]), ("minus", Group), ("bind", expr, var), ("values", [vars], rows), ("group", Group), ("query", Query), ("exists", Group, bool),
    ("path", node, Group from ?_from to ?_to, node, with zero steps): one or more repetitions of the group."""

    elements: list = field(default_factory=list)


@dataclass
class Query:
    select: list[tuple[str, Call | None]] | None  # None: all variables; (name, expression or None)
    where: Group
    distinct: bool = False
    group_by: list[str] = field(default_factory=list)
    having: Call | None = None
    order_by: list[tuple] = field(default_factory=list)  # (expression, ascending)
    limit: int | None = None
    offset: int = 0


def expression_variables(e) -> set[str]:
    if isinstance(e, Var):
        return {e.name}
    if isinstance(e, Call):
        return set().union(*(expression_variables(a) for a in e.args)) if e.args else set()
    return set()
