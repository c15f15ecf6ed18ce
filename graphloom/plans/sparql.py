"""SPARQL SELECT queries to the algebra: a tokenizer and a recursive-descent parser.

What is not supported raises; nothing is ignored silently.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from graphloom.functions.terms import RDF_TYPE, XSD
from graphloom.plans.algebra import Call, Group, Pattern, Query, Term, Var


class UnsupportedQuery(ValueError):
    pass


_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<var>[?$]\w+)|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<lang>@[A-Za-z][A-Za-z0-9-]*)
    |(?P<number>[0-9]+\.[0-9]+(?:[eE][+-]?[0-9]+)?|\.?[0-9]+(?:[eE][+-]?[0-9]+)?)|(?P<bnode>_:\w+)|(?P<name>[A-Za-z_][\w.-]*?(?:\w)?:(?:[\w%-](?:[\w.%-]*[\w%-])?)?|:(?:[\w-](?:[\w.-]*[\w-])?)?)
    |(?P<word>[A-Za-z_]\w*)|(?P<op>\^\^|\^|&&|\|\||!=|<=|>=|[{}()\[\].,;*=<>!+\-/|])""",
    re.VERBOSE,
)
_BUILTINS = {"str", "lang", "langmatches", "datatype", "bound", "sameterm", "isiri", "isuri", "isblank", "isliteral", "regex", "if", "coalesce", "strlen", "ucase", "lcase", "contains", "strstarts", "strends", "concat", "abs", "floor", "ceil", "round", "isnumeric"}
_AGGREGATES = {"count", "sum", "avg", "min", "max", "sample"}


class _Parser:
    def __init__(self, text: str, term_fix: Callable[[str], str] | None):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise UnsupportedQuery(f"can't read {text[at : at + 20]!r}")
            at = m.end()
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
        self.at, self.prefixes, self.base, self.hidden, self.fix = 0, {}, "", 0, term_fix or (lambda t: t)

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def word(self, *words: str) -> bool:
        kind, text = self.peek()
        if kind == "word" and text.lower() in words:
            self.at += 1
            return True
        return False

    def op(self, *ops: str) -> str | None:
        kind, text = self.peek()
        if kind == "op" and text in ops:
            self.at += 1
            return text
        return None

    def need(self, op: str) -> None:
        if not self.op(op):
            raise UnsupportedQuery(f"expected {op!r}, found {self.peek()[1]!r}")

    def query(self, top: bool = True) -> Query:
        while top:
            if self.word("prefix"):
                name, uri = self.next()[1], self.next()[1]
                self.prefixes[name[:-1]] = uri[1:-1]
            elif self.word("base"):
                self.base = self.next()[1][1:-1]
            else:
                break
        if not self.word("select"):
            raise UnsupportedQuery("only SELECT queries are supported")
        distinct = self.word("distinct", "reduced")
        select: list | None = []
        if self.op("*"):
            select = None
        else:
            while True:
                if self.peek()[0] == "var":
                    select.append((self.next()[1][1:], None))
                elif self.op("("):
                    e = self.expression()
                    if not self.word("as"):
                        raise UnsupportedQuery("expected AS")
                    select.append((self.next()[1][1:], e))
                    self.need(")")
                else:
                    break
            if not select:
                raise UnsupportedQuery("empty SELECT list")
        if self.word("from"):
            raise UnsupportedQuery("FROM")
        self.word("where")
        out = Query(select, self.group(), distinct)
        while True:
            if self.word("group"):
                self.word("by")
                while self.peek()[0] == "var":
                    out.group_by.append(self.next()[1][1:])
            elif self.word("having"):
                out.having = self.expression()
            elif self.word("order"):
                self.word("by")
                while True:
                    if self.word("asc"):
                        out.order_by.append((self.primary(), True))
                    elif self.word("desc"):
                        out.order_by.append((self.primary(), False))
                    elif self.peek()[0] == "var":
                        out.order_by.append((self.primary(), True))
                    else:
                        break
            elif self.word("limit"):
                out.limit = int(self.next()[1])
            elif self.word("offset"):
                out.offset = int(self.next()[1])
            else:
                break
        if top and self.peek()[0] != "end":
            raise UnsupportedQuery(f"unexpected {self.peek()[1]!r}")
        return out

    def group(self) -> Group:
        self.need("{")
        out = Group()
        if self.peek() == ("word", self.peek()[1]) and self.peek()[1].lower() == "select":
            out.elements.append(("query", self.query(top=False)))
            self.need("}")
            return out
        while not self.op("}"):
            if self.op("."):
                continue
            if self.word("filter"):
                if self.peek()[1].lower() in ("exists", "not") and self.peek()[0] == "word":
                    negated = self.word("not")
                    self.word("exists")
                    out.elements.append(("exists", self.group(), not negated))
                else:
                    out.elements.append(("filter", self.expression() if self.peek()[1] == "(" else self.primary()))
            elif self.word("optional"):
                out.elements.append(("optional", self.group()))
            elif self.word("minus"):
                out.elements.append(("minus", self.group()))
            elif self.word("bind"):
                self.need("(")
                e = self.expression()
                self.word("as")
                out.elements.append(("bind", e, self.next()[1][1:]))
                self.need(")")
            elif self.word("values"):
                out.elements.append(self.values())
            elif self.word("graph", "service"):
                raise UnsupportedQuery("GRAPH and SERVICE")
            elif self.peek()[1] == "{":
                branches = [self.group()]
                while self.word("union"):
                    branches.append(self.group())
                out.elements.append(("union", branches) if len(branches) > 1 else ("group", branches[0]))
            else:
                self.triples(out)
        return out

    def values(self) -> tuple:
        single = self.peek()[0] == "var"
        names = []
        if single:
            names = [self.next()[1][1:]]
        else:
            self.need("(")
            while not self.op(")"):
                names.append(self.next()[1][1:])
        self.need("{")
        rows = []
        while not self.op("}"):
            if not single:
                self.need("(")
            row = [None if self.word("undef") else self.term().text for _ in names]
            if not single:
                self.need(")")
            rows.append(row)
        return ("values", names, rows)

    def triples(self, out: Group) -> None:
        s = self.node(out)
        while True:
            p = self.verb()
            while True:
                self.link(out, s, p, self.node(out))
                if not self.op(","):
                    break
            if not self.op(";"):
                break
            if self.peek()[1] in (".", "}", "]"):
                break

    def verb(self):
        """A variable, or a path: a term, ("alt", parts), ("seq", parts), ("inverse", path), ("repeat", path, with zero steps)."""
        if self.peek()[0] == "var":
            return Var(self.next()[1][1:])
        parts = [self.sequence()]
        while self.op("|"):
            parts.append(self.sequence())
        return ("alt", parts) if len(parts) > 1 else parts[0]

    def sequence(self):
        parts = [self.step()]
        while self.op("/"):
            parts.append(self.step())
        return ("seq", parts) if len(parts) > 1 else parts[0]

    def step(self):
        if self.op("^"):
            return ("inverse", self.step())
        if self.op("("):
            found = self.verb()
            self.need(")")
            if isinstance(found, Var):
                raise UnsupportedQuery("a variable in a path")
        elif self.peek() == ("word", "a"):
            self.at += 1
            found = Term(RDF_TYPE)
        elif self.peek()[1] == "!":
            raise UnsupportedQuery("negated property sets")
        else:
            found = self.term()
        if many := self.op("*", "+"):
            return ("repeat", found, many == "*")
        return found

    def link(self, out: Group, s, path, o) -> None:
        """A path as patterns and groups. Steps of a sequence meet in hidden variables."""
        if not isinstance(path, tuple):
            out.elements.append(Pattern(s, path, o))
        elif path[0] == "inverse":
            self.link(out, o, path[1], s)
        elif path[0] == "seq":
            for k, part in enumerate(path[1]):
                self.hidden += k < len(path[1]) - 1
                after = Var(f"_anon{self.hidden}", True) if k < len(path[1]) - 1 else o
                self.link(out, s, part, after)
                s = after
        elif path[0] == "alt":
            branches = [Group() for _ in path[1]]
            for branch, part in zip(branches, path[1], strict=True):
                self.link(branch, s, part, o)
            out.elements.append(("union", branches))
        else:
            inner = Group()
            self.link(inner, Var("_from", True), path[1], Var("_to", True))
            out.elements.append(("path", s, inner, o, path[2]))

    def node(self, out: Group):
        if self.peek()[0] == "var":
            return Var(self.next()[1][1:])
        if self.peek()[0] == "bnode":
            return Var("_" + self.next()[1][2:], True)
        if self.op("["):
            self.hidden += 1
            fresh = Var(f"_anon{self.hidden}", True)
            while not self.op("]"):
                p = self.verb()
                self.link(out, fresh, p, self.node(out))
                self.op(";")
            return fresh
        return self.term()

    def term(self) -> Term:
        kind, text = self.next()
        if kind == "iri":
            body = text[1:-1]
            return Term(self.fix(f"<{body if re.match(r'[A-Za-z][A-Za-z0-9+.-]*:', body) else self.base + body}>"))
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise UnsupportedQuery(f"unknown prefix {prefix!r}")
            return Term(self.fix(f"<{self.prefixes[prefix]}{local}>"))
        if kind == "string":
            body = '"' + text[1:-1].replace('"', '\\"' if text[0] == "'" else '"') + '"'
            if self.peek()[0] == "lang":
                return Term(self.fix(body + self.next()[1]))
            if self.op("^^"):
                return Term(self.fix(f"{body}^^{self.term().text}"))
            return Term(self.fix(body))
        if kind == "op" and text in "+-" and self.peek()[0] == "number":
            return Term(f'"{text if text == "-" else ""}{self.next()[1]}"^^<{XSD}integer>')
        if kind == "number":
            return Term(f'"{text}"^^<{XSD}{"integer" if text.isdigit() else "decimal"}>')
        if kind == "word" and text.lower() in ("true", "false"):
            return Term(f'"{text.lower()}"^^<{XSD}boolean>')
        raise UnsupportedQuery(f"unexpected {text!r}")

    def expression(self):
        left = self.conjunction()
        while self.op("||"):
            left = Call("or", (left, self.conjunction()))
        return left

    def conjunction(self):
        left = self.relation()
        while self.op("&&"):
            left = Call("and", (left, self.relation()))
        return left

    def relation(self):
        left = self.sum()
        if found := self.op("=", "!=", "<=", ">=", "<", ">"):
            return Call(found, (left, self.sum()))
        negated = self.peek()[1].lower() == "not" and self.word("not")
        if self.word("in"):
            self.need("(")
            items = []
            while not self.op(")"):
                items.append(self.expression())
                self.op(",")
            found = Call("in", (left, *items))
            return Call("not", (found,)) if negated else found
        return left

    def sum(self):
        left = self.product()
        while found := self.op("+", "-"):
            left = Call(found, (left, self.product()))
        return left

    def product(self):
        left = self.primary()
        while found := self.op("*", "/"):
            left = Call(found, (left, self.primary()))
        return left

    def primary(self):
        if self.op("("):
            e = self.expression()
            self.need(")")
            return e
        if self.op("!"):
            return Call("not", (self.primary(),))
        if self.peek()[1] in ("-", "+") and self.peek(1)[0] != "number":
            return Call("neg" if self.next()[1] == "-" else "pos", (self.primary(),))
        kind, text = self.peek()
        if kind == "var":
            return Var(self.next()[1][1:])
        if kind == "word" and text.lower() not in ("true", "false"):
            name = text.lower()
            self.at += 1
            if name in _AGGREGATES:
                self.need("(")
                distinct = self.word("distinct")
                arg = None if self.op("*") else self.expression()
                self.need(")")
                return Call(f"agg_{name}", (arg, distinct))
            if name not in _BUILTINS:
                raise UnsupportedQuery(f"function {text}")
            return Call(name, self.arguments())
        found = self.term()
        if self.peek()[1] == "(" and found.text.startswith(f"<{XSD}"):
            return Call("cast", (found.text[len(XSD) + 1 : -1], *self.arguments()))
        return found

    def arguments(self) -> tuple:
        self.need("(")
        out = []
        while not self.op(")"):
            out.append(self.expression())
            self.op(",")
        return tuple(out)


def parse(text: str, term_fix: Callable[[str], str] | None = None) -> Query:
    """``term_fix`` may rewrite every constant term before planning."""
    return _Parser(text, term_fix).query()
