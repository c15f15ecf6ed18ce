"""Triples kept together by entity: what a table row says of its subject, before it becomes triples.

Operators that work on whole subjects read these rows. The subjects of most rows occur once; a shuffle of
their hashes alone finds the rest, so whole triples are exchanged only where subjects repeat.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.numbering import stored
from graphloom.functions.terms import RDF_TYPE

#: Predicates per mask column.
BITS = 62


@dataclass
class Part:
    """Rows of one table: the subject, and per predicate its object or null, columns over ``df``. All subjects start with ``prefix``."""

    df: DataFrame
    subject: Column
    values: dict[str, Column]
    type_iri: str | None
    prefix: str

    def objects(self) -> dict[str, Column]:
        return self.values | ({RDF_TYPE: F.lit(self.type_iri)} if self.type_iri else {})

    def triples(self) -> DataFrame:
        pairs = [F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in self.objects().items()]
        return self.df.select(self.subject.alias("s"), F.inline(F.array(*pairs))).filter("o is not null")

    def names(self, fold: bool) -> dict[str, Column]:
        """Predicates as a type counts them, with the object that must be there."""
        return {f"{RDF_TYPE} {self.type_iri}" if fold and p == RDF_TYPE else p: o for p, o in self.objects().items()}

    def words(self, names: list[str], fold: bool) -> list[Column]:
        own = self.names(fold)
        return words(names, lambda n: own[n].isNotNull() if n in own else None)


def words(names: list[str], has) -> list[Column]:
    """Bits of the names that ``has`` tells to be there, as columns m0, m1, ...; without a test, none is."""
    out = []
    for start in range(0, len(names), BITS):
        tests = [(1 << k, has(name)) for k, name in enumerate(names[start : start + BITS])]
        bits = [F.when(test, F.lit(bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for bit, test in tests if test is not None]
        out.append((reduce(Column.bitwiseOR, bits) if bits else F.lit(0).cast("bigint")).alias(f"m{start // BITS}"))
    return out


class EntityRows:
    def __init__(self, spark: SparkSession, parts: list[Part]):
        self.spark, self.parts = spark, parts
        self._split: tuple[EntityRows, EntityRows] | None = None

    def triples(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [p.triples() for p in self.parts]) if self.parts else self.spark.createDataFrame([], "s string, p string, o string")

    def only(self, predicates) -> EntityRows:
        """The rows' triples with these predicates."""
        kept = [replace(p, values={k: v for k, v in p.values.items() if k in predicates}, type_iri=p.type_iri if RDF_TYPE in predicates else None) for p in self.parts]
        return EntityRows(self.spark, [p for p in kept if p.objects()])

    def of_subject(self, subject: str) -> EntityRows:
        return EntityRows(self.spark, [replace(p, df=p.df.filter(p.subject == subject)) for p in self.parts if subject.startswith(p.prefix)])

    def repeated(self, parts: list[Part], extra: DataFrame | None) -> DataFrame | None:
        """Hashes of subjects that these parts hold more than once or that ``extra`` holds; None without any."""
        found = []
        if parts:
            hashes = reduce(DataFrame.union, [p.df.select(F.xxhash64(p.subject).alias("_h")) for p in parts])
            # Dealt first: most are different, so counting before the exchange would only take memory.
            found.append(hashes.repartition("_h").groupBy("_h").agg(F.count("*").alias("_n")).filter("_n > 1").select("_h"))
        if extra is not None:
            found.append(extra.select(F.xxhash64("s").alias("_h")))
        if not found:
            return None
        kept = stored(reduce(DataFrame.union, found).distinct(), "repeated")
        return None if kept.isEmpty() else kept

    def split(self, extra: DataFrame | None = None) -> tuple[EntityRows, EntityRows]:
        """Rows whose subject has no other row, and the rest: subjects of several rows, of several tables or in ``extra``.

        Subjects are told apart by hash. Two that share one by chance count as repeated, which costs time only.
        """
        if extra is None and self._split is not None:
            return self._split
        near = lambda a, b: a.prefix.startswith(b.prefix) or b.prefix.startswith(a.prefix)
        single = [p for p in self.parts if not any(q is not p and near(p, q) for q in self.parts)]
        rest = [p for p in self.parts if not any(p is q for q in single)]
        gone = self.repeated(single, extra)
        if gone is not None:
            hashed = [replace(p, df=p.df.withColumn("_h", F.xxhash64(p.subject))) for p in single]
            single = [replace(p, df=p.df.join(gone, "_h", "left_anti")) for p in hashed]
            rest += [replace(p, df=p.df.join(gone, "_h", "left_semi")) for p in hashed]
        out = EntityRows(self.spark, single), EntityRows(self.spark, rest)
        if extra is None:
            self._split = out
        return out

    def distinct(self, extra: DataFrame | None = None) -> DataFrame:
        """The triples without duplicates; with ``extra`` triples, those of both."""
        single, rest = self.split(extra)
        others = ([rest.triples()] if rest.parts else []) + ([] if extra is None else [extra.select("s", "p", "o")])
        once = [reduce(DataFrame.unionByName, others).dropDuplicates(["s", "p", "o"])] if others else []
        return reduce(DataFrame.unionByName, ([single.triples()] if single.parts or not once else []) + once)

    def names(self, fold: bool = False) -> list[str]:
        return sorted({n for p in self.parts for n in p.names(fold)})

    def under_ids(self, pids: dict[str, int], terms: DataFrame) -> DataFrame:
        """(sid, pid, o): the rows' triples under the ids of their subjects; duplicates of repeated subjects stay.

        Rows are exchanged as the table holds them, and triples made after it.
        """
        out = []
        for p in self.parts:
            pairs = [F.struct(F.lit(pids[n]).alias("pid"), o.alias("o")) for n, o in p.objects().items() if n in pids]
            if pairs:
                # Of the dictionary, only terms that subjects of this table can be.
                near = terms.filter(F.col("term").startswith(p.prefix)).select(F.col("term").alias("_term"), F.col("eid").alias("_eid"))
                out.append(p.df.join(near, p.subject == F.col("_term")).select(F.col("_eid").alias("sid"), F.inline(F.array(*pairs))).filter("o is not null"))
        return reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], "sid bigint, pid int, o string")

    def row_masks(self, names: list[str], fold: bool = False) -> DataFrame:
        """(s, m0, ...): the predicates of every row that has any. Subjects may repeat."""
        out = []
        for p in self.parts:
            out.append(p.df.select(p.subject.alias("s"), *p.words(names, fold)))
        if not out:
            return self.spark.createDataFrame([], ", ".join(["s string", *[f"m{k} bigint" for k in range(-(-len(names) // BITS))]]))
        df = reduce(DataFrame.unionByName, out)
        return df.filter(reduce(Column.__or__, [F.col(c) != 0 for c in df.columns[1:]]))

    def masks(self, fold: bool = False) -> DataFrame:
        """(s, m0, ...) once per subject; bits in the order of ``names``."""
        names = self.names(fold)
        single, rest = self.split()
        parts = [single.row_masks(names, fold)] if single.parts else []
        parts += [joined_masks(rest.row_masks(names, fold), "s")] if rest.parts or not parts else []
        return reduce(DataFrame.unionByName, parts)

    def objects(self) -> DataFrame:
        """(s): every object of every row."""
        return reduce(DataFrame.union, [p.df.select(F.explode(F.array(*p.objects().values())).alias("s")).filter("s is not null") for p in self.parts])

    def typed(self, types: DataFrame, fold: bool = False) -> EntityRows:
        """Single rows with their type as column ``_tid``; ``split`` gives the rest."""
        names, single = self.names(fold), self.split()[0]
        codes = type_codes(types, names).withColumnRenamed("tid", "_tid")
        out = []
        for p in single.parts:
            marked = p.df.select("*", *p.words(names, fold))
            on = [c for c in codes.columns if c != "_tid"]
            out.append(replace(p, df=marked.join(F.broadcast(codes), on, "left").withColumn("_tid", F.coalesce("_tid", F.lit(0)))))
        return EntityRows(self.spark, out)


def joined_masks(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(*[F.bit_or(c).alias(c) for c in df.columns if c != key])


def type_codes(types: DataFrame, names: list[str]) -> DataFrame:
    """(tid, m0, ...) of a type table; as large as the schema."""
    return types.select("tid", *words(names, lambda n: F.array_contains("preds", n)))


def predicate_names(names: list[str]) -> Column:
    """The names of a mask, in their order."""
    has = lambda k: F.col(f"m{k // BITS}").bitwiseAND(F.lit(1 << k % BITS).cast("bigint")) != 0
    return F.array_compact(F.array(*[F.when(has(k), F.lit(n)) for k, n in enumerate(names)])).alias("preds")
