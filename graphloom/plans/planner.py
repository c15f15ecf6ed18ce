"""Stars, kept variables, and the order in which stars are joined."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import permutations

from graphloom.operators.schema import Statistics
from graphloom.plans.algebra import Node, Pattern, Term, Var

#: Up to so many stars all orders are tried, else the order is greedy.
EXHAUSTIVE = 6


@dataclass
class Star:
    """Patterns with one subject, predicates fixed; or a single pattern with a variable predicate."""

    root: Node
    edges: list[Pattern] = field(default_factory=list)
    free: bool = False  # variable predicate

    def variables(self) -> set[str]:
        return {v for p in self.edges for v in p.variables()}

    def predicates(self) -> set[str]:
        return {p.p.text for p in self.edges if isinstance(p.p, Term)}

    def constants(self) -> int:
        return sum(isinstance(p.o, Term) for p in self.edges) + 4 * isinstance(self.root, Term)


def kept_variables(patterns: list[Pattern], wanted: set[str] | None, reference: bool) -> set[str]:
    """Variables whose values matter: wanted ones and those in more than one place.

    A variable in one place only and not wanted just has to exist. With
    ``reference`` false each of its values makes a row, as SPARQL has it.
    """
    seen = Counter(v for p in patterns for v in p.variables())
    return {v for v, n in seen.items() if wanted is None or v in wanted or n > 1 or not reference}


def stars(patterns: list[Pattern]) -> list[Star]:
    by_root: dict[Node, Star] = {}
    out = []
    for p in dict.fromkeys(patterns):
        if isinstance(p.p, Var):
            out.append(Star(p.s, [p], True))
        else:
            if p.s not in by_root:
                by_root[p.s] = Star(p.s)
                out.append(by_root[p.s])
            by_root[p.s].edges.append(p)
    return out


def _size(star: Star, stats: Statistics | None, bound: dict[str, float]) -> float:
    """Rows a star is expected to have once the variables in ``bound`` have so many values."""
    if stats is None:
        size = 1e6 if not star.free else 1e9
        size /= 10.0 ** (2 * star.constants())
    else:
        size = 1.0 if isinstance(star.root, Term) else (stats.count(star.predicates()) if not star.free else sum(n for _, n in stats.types.values()))
        for p in star.edges:
            if isinstance(p.o, Term) and isinstance(p.p, Term):
                size /= max(1.0, stats.leaf(star.predicates(), p.p.text, size))
    for p in star.edges:
        for node in (p.s, p.o):
            if isinstance(node, Var) and node.name in bound:
                size = min(size, bound[node.name] * 4)
    return size


def _cost(order: tuple[Star, ...], stats: Statistics | None) -> tuple[int, float]:
    """(steps without a shared variable, sum of sizes)."""
    bound: dict[str, float] = {}
    apart, total = 0, 0.0
    for k, star in enumerate(order):
        apart += bool(k) and not (star.variables() & bound.keys())
        size = _size(star, stats, bound)
        total += size
        for v in star.variables():
            bound[v] = min(bound.get(v, size), size)
    return apart, total


def order(found: list[Star], stats: Statistics | None = None) -> list[Star]:
    """The cheapest connected order; Cartesian steps only where the pattern is disconnected."""
    if len(found) <= EXHAUSTIVE:
        return list(min(permutations(found), key=lambda o: _cost(o, stats))) if found else []
    done: list[Star] = []
    left = list(found)
    while left:
        best = min(left, key=lambda s: _cost((*done, s), stats))
        left.remove(best)
        done.append(best)
    return done


def explain(ordered: list[Star], kept: set[str]) -> str:
    """The plan in words, one line per star."""
    lines, seen = [], set()
    text = lambda n: n.text if isinstance(n, Term) else f"?{n.name}"
    for k, star in enumerate(ordered):
        on = sorted(star.variables() & seen & kept)
        how = "scan" if not k else f"join on {', '.join(on)}" if on else "cross join"
        edges = ", ".join(f"{text(p.p)} {text(p.o)}{'' if isinstance(p.o, Term) or p.o.name in kept else ' (exists)'}" for p in star.edges)
        lines.append(f"{k + 1}. {how}: {'any predicate of ' if star.free else 'star '}{text(star.root)} [{edges}]")
        seen |= star.variables()
    return "\n".join(lines)
