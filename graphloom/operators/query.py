"""Queries: the algebra to one lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions.numbering import settled
from graphloom.operators.match import Store, _bind, match
from graphloom.plans.algebra import Call, Group, Pattern, Query, Term, Var, expression_variables
from graphloom.plans.sparql import UnsupportedQuery

_NUMERIC = {"+", "-", "*", "/", "neg", "pos", "abs", "floor", "ceil", "round", "strlen"}
_NUMBER_AGGREGATES = {"agg_count", "agg_sum", "agg_avg"}
_TEXT = {"str", "lang", "ucase", "lcase", "concat"}
_BOOLEAN = {"or", "and", "not", "=", "!=", "<", "<=", ">", ">=", "in", "bound", "sameterm", "isiri", "isuri", "isblank", "isliteral", "isnumeric", "regex", "langmatches", "contains", "strstarts", "strends"}


class Expressions:
    """Expressions over term columns. Values are terms, numbers (double), texts or truth values."""

    def __init__(self, columns: list[str], native: set[str] = frozenset()):
        self.columns, self.native = set(columns), native

    def kind(self, e) -> str:
        if isinstance(e, Call):
            if e.name == "cast":
                return "number" if e.args[0] in ("integer", "decimal", "double", "float", "int", "long") else "text"
            if e.name in ("if", "coalesce"):
                return self.kind(e.args[-1])
            if e.name.startswith("agg_"):
                return "number" if e.name in _NUMBER_AGGREGATES else "term"
            return "number" if e.name in _NUMERIC else "text" if e.name in _TEXT else "truth" if e.name in _BOOLEAN else "term"
        if isinstance(e, Term) and "^^<" + T.XSD in e.text and e.text.endswith(("integer>", "decimal>", "double>")):
            return "number"
        if isinstance(e, Var) and e.name in self.native:
            return "number"
        return "term"

    def term(self, e) -> Column:
        if isinstance(e, Var):
            return F.col(e.name) if e.name in self.columns else F.lit(None).cast("string")
        if isinstance(e, Term):
            return F.lit(e.text)
        k, value = self.kind(e), self.value(e)
        if k == "term":
            return value
        if k == "text":
            return F.concat(F.lit('"'), value, F.lit('"'))
        return F.concat(F.lit('"'), value.cast("string"), F.lit(f'"^^<{T.XSD}{"boolean" if k == "truth" else "double"}>'))

    def text(self, e) -> Column:
        return self.value(e) if self.kind(e) == "text" else self.value(e).cast("string") if self.kind(e) in ("number", "truth") else T.lexical(self.term(e))

    def number(self, e) -> Column:
        if isinstance(e, Var) and e.name in self.native:
            return F.col(e.name).cast("double")
        if isinstance(e, Term):
            return T.number(F.lit(e.text))
        return self.value(e).cast("double") if self.kind(e) in ("number", "truth") else self.value(e).try_cast("double") if self.kind(e) == "text" else T.number(self.term(e))

    def truth(self, e) -> Column:
        if self.kind(e) == "truth":
            return self.value(e)
        return self.number(e) != 0 if self.kind(e) == "number" else T.lexical(self.term(e)) == "true"

    def compare(self, op: str, a, b) -> Column:
        kinds = {self.kind(a), self.kind(b)}
        tests = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
        test = tests[op]
        if "number" in kinds:
            return test(self.number(a), self.number(b))
        if kinds & {"text", "truth"}:
            return test(self.text(a), self.text(b))
        x, y = self.term(a), self.term(b)
        plain = test(x, y) if op in ("=", "!=") else test(T.lexical(x), T.lexical(y))
        if isinstance(a, Term) or isinstance(b, Term):
            if op in ("=", "!="):
                return plain
        numbers = T.number(x).isNotNull() & T.number(y).isNotNull()
        return F.when(numbers, test(T.number(x), T.number(y))).otherwise(plain)

    def value(self, e) -> Column:
        if not isinstance(e, Call):
            return self.number(e) if self.kind(e) == "number" else self.term(e)
        n, a = e.name, e.args
        if n in ("=", "!=", "<", "<=", ">", ">="):
            return self.compare(n, *a)
        if n in ("+", "-", "*", "/"):
            x, y = self.number(a[0]), self.number(a[1])
            return x + y if n == "+" else x - y if n == "-" else x * y if n == "*" else F.try_divide(x, y)
        simple = {
            "or": lambda: self.truth(a[0]) | self.truth(a[1]), "and": lambda: self.truth(a[0]) & self.truth(a[1]), "not": lambda: ~self.truth(a[0]),
            "neg": lambda: -self.number(a[0]), "pos": lambda: self.number(a[0]), "str": lambda: self.text(a[0]), "lang": lambda: T.language(self.term(a[0])),
            "datatype": lambda: T.datatype(self.term(a[0])), "bound": lambda: self.term(a[0]).isNotNull(), "sameterm": lambda: self.term(a[0]) == self.term(a[1]),
            "isiri": lambda: self.term(a[0]).startswith("<"), "isuri": lambda: self.term(a[0]).startswith("<"), "isblank": lambda: self.term(a[0]).startswith("_:"),
            "isliteral": lambda: self.term(a[0]).startswith('"'), "isnumeric": lambda: T.number(self.term(a[0])).isNotNull(), "strlen": lambda: F.char_length(self.text(a[0])).cast("double"),
            "ucase": lambda: F.upper(self.text(a[0])), "lcase": lambda: F.lower(self.text(a[0])), "contains": lambda: self.text(a[0]).contains(self.text(a[1])),
            "strstarts": lambda: self.text(a[0]).startswith(self.text(a[1])), "strends": lambda: self.text(a[0]).endswith(self.text(a[1])), "concat": lambda: F.concat(*map(self.text, a)),
            "abs": lambda: F.abs(self.number(a[0])), "floor": lambda: F.floor(self.number(a[0])).cast("double"), "ceil": lambda: F.ceil(self.number(a[0])).cast("double"), "round": lambda: F.round(self.number(a[0])),
        }
        if n in simple:
            return simple[n]()
        if n == "in":
            out = F.lit(False)
            for item in a[1:]:
                out = out | self.compare("=", a[0], item)
            return out
        if n == "langmatches":
            tag, wanted = F.lower(self.text(a[0])), F.lower(self.text(a[1]))
            return F.when(wanted == "*", tag != "").otherwise((tag == wanted) | tag.startswith(F.concat(wanted, F.lit("-"))))
        if n == "regex":
            flags = "".join(sorted(set(T_lexical(a[2])) & set("imsx"))) if len(a) > 2 else ""
            return self.text(a[0]).rlike((f"(?{flags})" if flags else "") + T_lexical(a[1]))
        if n == "if":
            k = self.kind(e)
            pick = self.number if k == "number" else self.text if k == "text" else self.truth if k == "truth" else self.term
            return F.when(self.truth(a[0]), pick(a[1])).otherwise(pick(a[2]))
        if n == "coalesce":
            k = self.kind(e)
            return F.coalesce(*[(self.number if k == "number" else self.text if k == "text" else self.term)(x) for x in a])
        if n == "cast":
            if self.kind(e) == "number":
                value = self.number(a[1]) if self.kind(a[1]) == "number" else self.text(a[1]).try_cast("double")
                return F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("double") if a[0] in ("integer", "int", "long") else value
            return self.text(a[1])
        raise UnsupportedQuery(n)

    def aggregate(self, e: Call) -> Column:
        name, (arg, distinct) = e.name[4:], e.args
        if name == "count":
            if arg is None:
                return F.count(F.lit(1))
            return F.count_distinct(self.term(arg)) if distinct else F.count(self.term(arg))
        if name in ("sum", "avg"):
            value = self.number(arg)
            if name == "sum":
                return F.sum_distinct(value) if distinct else F.sum(value)
            return F.try_divide(F.sum_distinct(value), F.count_distinct(value)) if distinct else F.avg(value)
        # The order of ORDER BY: terms without a numeric value by text, then numbers. A sample is the first, so that runs agree.
        value = self.term(arg)
        ranked = F.when(value.isNotNull(), F.struct(T.number(value).alias("n"), value.alias("t")))
        return (F.max(ranked) if name == "max" else F.min(ranked)).getField("t")


def T_lexical(e) -> str:
    """The text of a constant, with escapes undone."""
    if not isinstance(e, Term):
        raise UnsupportedQuery("a constant is needed here")
    return e.text[1 : e.text.rindex('"')].replace("\\\\", "\\").replace('\\"', '"')


def _join(left: DataFrame | None, right: DataFrame, how: str = "inner") -> DataFrame:
    """Natural join; nothing shared gives the product (or, for a left join, the left rows with each right row)."""
    if left is None:
        return right
    shared = sorted(set(left.columns) & set(right.columns))
    if not shared:
        return left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)
    return left.join(right, shared, how)


def having_rows(df: DataFrame, other: DataFrame, some: bool) -> DataFrame:
    """Rows of ``df`` with (or without) a partner in ``other``; nothing shared asks only whether ``other`` has rows."""
    shared = sorted(set(df.columns) & set(other.columns))
    how = "left_semi" if some else "left_anti"
    return df.join(other, shared, how) if shared else df.join(other.limit(1).select(F.lit(1).alias("_one")), F.lit(True), how)


class Runner:
    def __init__(self, store: Store, reference: bool, inverse: bool, stats):
        self.store, self.reference, self.inverse, self.stats = store, reference, inverse, stats

    def group(self, group: Group, wanted: set[str] | None) -> DataFrame | None:
        # Neighbouring patterns are one pattern, whatever stands between them but OPTIONAL and the like.
        patterns = [e for e in group.elements if isinstance(e, Pattern)]
        others = [e for e in group.elements if not isinstance(e, Pattern)]
        used = set() if wanted is None else set(wanted)
        for e in others:
            used |= _variables(e)
        df = match(self.store, patterns, None if wanted is None else used, self.reference, self.inverse, self.stats) if patterns else None
        filters = [e for e in others if e[0] in ("filter", "exists")]
        for e in [e for e in others if e not in filters]:
            name = e[0]
            if name == "group":
                df = _join(df, self.group(e[1], None if wanted is None else used | set(df.columns if df is not None else ())))
            elif name == "query":
                df = _join(df, self.query(e[1]))
            elif name == "union":
                branches = [self.group(b, None if wanted is None else used) for b in e[1]]
                out = branches[0]
                for b in branches[1:]:
                    out = out.unionByName(b, allowMissingColumns=True)
                df = _join(df, out)
            elif name == "optional":
                inner = Group([x for x in e[1].elements if not (isinstance(x, tuple) and x[0] == "filter")])
                right = self.group(inner, None if wanted is None else used | set(df.columns if df is not None else ()))
                tests = [x[1] for x in e[1].elements if isinstance(x, tuple) and x[0] == "filter"]
                df = self.optional(df, right, tests) if df is not None else self.or_unit(right, tests)
            elif name == "minus":
                df = self.unit() if df is None else df
                right = self.group(e[1], None)
                df = having_rows(df, right, False) if set(df.columns) & set(right.columns) else df
            elif name == "path":
                df = _join(df, self.path(*e[1:]))
            elif name == "bind":
                df = self.unit() if df is None else df
                df = df.withColumn(e[2], Expressions(df.columns).term(e[1]))
            elif name == "values":
                rows = self.store.spark.createDataFrame([tuple(r) for r in e[2]], ", ".join(f"`{v}` string" for v in e[1]))
                df = _join(df, rows)
        for e in filters:
            df = self.unit() if df is None else df
            df = df.filter(Expressions(df.columns).truth(e[1])) if e[0] == "filter" else having_rows(df, self.group(e[1], None), e[2])
        return df

    def path(self, s, step: Group, o, zero: bool) -> DataFrame:
        """Pairs that one or more repetitions of a step connect, each once; with ``zero`` every term and itself, too.

        Repetitions are joins until no pair is new: as many rounds as the longest shortest way has
        steps. From a constant, or back from one, only its own pairs are followed.
        """
        edges = settled(self.group(step, {"_from", "_to"}).select("_from", "_to").distinct())
        back = isinstance(o, Term) and not isinstance(s, Term)
        if back:
            edges = edges.select(F.col("_to").alias("_from"), F.col("_from").alias("_to"))
        start = o if back else s
        ends = edges.select(F.col("_from").alias("_to"), F.col("_to").alias("_next"))
        new = edges.filter(F.col("_from") == start.text) if isinstance(start, Term) else edges
        found = new
        while not new.isEmpty():
            new = settled(new.join(ends, "_to").select("_from", F.col("_next").alias("_to")).distinct().join(found, ["_from", "_to"], "left_anti"))
            found = found.unionByName(new)
        if zero:
            constants = [n.text for n in (s, o) if isinstance(n, Term)]
            terms = self.store.spark.createDataFrame([(t,) for t in constants], "t string") if constants else self.store.triples().select(F.explode(F.array("s", "o")).alias("t"))
            found = found.unionByName(terms.select(F.col("t").alias("_from"), F.col("t").alias("_to"))).distinct()
        if back:
            found = found.select(F.col("_to").alias("_from"), F.col("_from").alias("_to"))
        return _bind(found, [("_from", s), ("_to", o)], {n.name for n in (s, o) if isinstance(n, Var)})

    def unit(self) -> DataFrame:
        """One solution without bindings: what a group starts from."""
        return self.store.spark.range(1).select()

    def or_unit(self, right: DataFrame, tests: list) -> DataFrame:
        """A group that opens with OPTIONAL: its rows, or one solution without bindings if it has none."""
        for t in tests:
            right = right.filter(Expressions(right.columns).truth(t))
        nothing = self.unit().select(*[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in right.columns])
        return right.unionByName(having_rows(nothing.withColumnsRenamed({c: f"_u_{c}" for c in right.columns}), right, False).withColumnsRenamed({f"_u_{c}": c for c in right.columns}))

    def optional(self, left: DataFrame, right: DataFrame, tests: list) -> DataFrame:
        shared = sorted(set(left.columns) & set(right.columns))
        other = [c for c in right.columns if c not in shared]
        right = right.select(*[F.col(c).alias(f"_r_{c}") for c in shared], *other)
        condition = F.lit(True)
        for c in shared:
            condition = condition & (F.col(c) == F.col(f"_r_{c}"))
        both = Expressions([*left.columns, *other])
        for t in tests:
            condition = condition & both.truth(t)
        return left.join(right, condition, "left").select(*left.columns, *other)

    def query(self, q: Query) -> DataFrame:
        names = None if q.select is None else {v for v, _ in q.select} | set().union(set(), *(expression_variables(e) for _, e in q.select if e is not None))
        if names is not None:
            names |= set(q.group_by) | (expression_variables(q.having) if q.having else set()) | set().union(set(), *(expression_variables(e) for e, _ in q.order_by))
        df = self.group(q.where, names)
        if df is None:
            raise UnsupportedQuery("empty pattern")
        native: set[str] = set()
        order_by = q.order_by
        if q.group_by or (q.select and any(isinstance(e, Call) and e.name.startswith("agg_") for _, e in q.select)):
            on = Expressions(df.columns)
            aggregates: dict[str, Call] = {}

            def lift(e, name: str | None = None):
                """The expression with its aggregates as columns of their own."""
                if isinstance(e, Call) and e.name.startswith("agg_"):
                    name = name or next((v for v, x in aggregates.items() if x == e), f"_agg{len(aggregates)}")
                    aggregates[name] = e
                    return Var(name)
                return Call(e.name, tuple(map(lift, e.args))) if isinstance(e, Call) else e

            for v, e in q.select:
                if e is None and v not in q.group_by:
                    raise UnsupportedQuery(f"?{v} is neither grouped nor aggregated")
            # Plain aggregates first: they keep their names, others refer to them.
            plain = {v for v, e in q.select if isinstance(e, Call) and e.name.startswith("agg_")}
            lifted = {v: lift(e, v) for v, e in q.select if v in plain}
            lifted |= {v: lift(e) for v, e in q.select if e is not None and v not in plain}
            having = lift(q.having) if q.having else None
            order_by = [(lift(e), up) for e, up in order_by]
            df = df.groupBy(*q.group_by).agg(*[on.aggregate(e).alias(v) for v, e in aggregates.items()]) if aggregates else df.select(*q.group_by).distinct()
            native = {v for v, e in aggregates.items() if e.name in _NUMBER_AGGREGATES}
            for v, e in lifted.items():
                if v not in plain:
                    df = df.withColumn(v, Expressions(df.columns, native).term(e))
            if having is not None:
                df = df.filter(Expressions(df.columns, native).truth(having))
        elif q.select:
            for v, e in q.select:
                if e is not None:
                    df = df.withColumn(v, Expressions(df.columns).term(e))
        keys = []
        for e, up in order_by:
            on = Expressions(df.columns, native)
            for part in [on.number(e)] if on.kind(e) == "number" else [T.number(on.term(e)), on.term(e)]:
                df = df.withColumn(f"_key{len(keys)}", part)
                keys.append(up)
        names = [v for v, _ in q.select] if q.select is not None else [c for c in _order(q.where, df.columns) if not c.startswith("_")]
        df = df.withColumns({v: F.lit(None).cast("string") for v in names if v not in df.columns})
        by = [f"_key{k}" for k in range(len(keys))]
        if q.distinct:
            # Equal rows are one before they are cut; of keys that it doesn't show, a row has the first.
            df = df.groupBy(*names).agg(*[(F.min if up else F.max)(k).alias(k) for k, up in zip(by, keys, strict=True)]) if by else df.select(*names).distinct()
        if by:
            df = df.orderBy(*[F.col(k).asc() if up else F.col(k).desc() for k, up in zip(by, keys, strict=True)])
        df = df.select(*names)
        if q.offset:
            df = df.offset(q.offset)
        return df.limit(q.limit) if q.limit is not None else df


def _variables(e) -> set[str]:
    if isinstance(e, Pattern):
        return set(e.variables())
    if isinstance(e, Group):
        return set().union(set(), *(_variables(x) for x in e.elements))
    if isinstance(e, Query):
        return {v for v, _ in e.select} if e.select else _variables(e.where)
    if isinstance(e, tuple):
        if e[0] == "values":
            return set(e[1])
        return set().union(set(), *(_variables(x) for x in e[1:] if isinstance(x, (Group, Query))), *(_variables(x) for x in (e[1] if isinstance(e[1], list) else [])), *(expression_variables(x) for x in e[1:]))
    return set()


def _order(group: Group, columns: list[str]) -> list[str]:
    """Columns in order of first appearance."""
    seen: list[str] = []
    for e in group.elements:
        seen += e.variables() if isinstance(e, Pattern) else sorted(_variables(e)) + ([e[2]] if isinstance(e, tuple) and e[0] == "bind" else [])
    return [c for c in dict.fromkeys(seen) if c in columns] + [c for c in columns if c not in seen]
