"""Characteristic sets, entity types, dictionary, entities and statistics."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.numbering import number_in_groups, stored
from graphloom.functions.terms import RDF_TYPE
from graphloom.sources.rows import BITS, EntityRows, joined_masks, predicate_names, type_codes

TID_SHIFT = 48


def folded(triples: DataFrame) -> DataFrame:
    """Type triples with their class fused into the predicate: ``rdf:type C``."""
    is_type = F.col("p") == RDF_TYPE
    return triples.withColumn("p", F.when(is_type, F.concat_ws(" ", "p", "o")).otherwise(F.col("p")))


def predicate_sets(triples: DataFrame, fold: bool = False) -> DataFrame:
    """(s, preds): the exact predicate set of every subject. Distinct pairs are combined before the shuffle."""
    source = folded(triples) if fold else triples
    return source.select("s", "p").groupBy("s").agg(F.array_sort(F.collect_set("p")).alias("preds"))


def characteristic_sets(triples: DataFrame | EntityRows, fold: bool = False, top: int | None = None) -> DataFrame:
    """(preds, n): how many subjects carry each set; the ``top`` most frequent if given, ties by set text."""
    if isinstance(triples, EntityRows):
        masks = triples.masks(fold)
        found = masks.groupBy(*masks.columns[1:]).agg(F.count("*").alias("n")).select(predicate_names(triples.names(fold)), "n")
    else:
        found = predicate_sets(triples, fold).groupBy("preds").agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), F.array_join("preds", " ")).limit(top) if top else found


def type_table(triples: DataFrame | EntityRows, fold: bool = False, top: int | None = None) -> DataFrame:
    """(tid, preds, n): type ids from 1 by falling frequency, ties by set text. One row per characteristic set, not per entity."""
    from pyspark.sql import Window

    found = characteristic_sets(triples, fold)
    found = stored(found, "types") if isinstance(triples, EntityRows) else found
    ranked = found.withColumn("tid", F.row_number().over(Window.orderBy(F.desc("n"), F.array_join("preds", " "))))
    return (ranked.filter(F.col("tid") <= top) if top else ranked).select("tid", "preds", "n")


def entity_types(triples: DataFrame | EntityRows, types: DataFrame, fold: bool = False) -> DataFrame:
    """(s, tid) of every subject; 0 is the generic type of sets beyond the table."""
    if isinstance(triples, EntityRows):
        return _types_of(triples.masks(fold), types, triples.names(fold))
    return predicate_sets(triples, fold).join(types.select("tid", "preds"), "preds", "left").select("s", F.coalesce("tid", F.lit(0)).alias("tid"))


def _types_of(masks: DataFrame, types: DataFrame, names: list[str]) -> DataFrame:
    """(s, tid) of (s, m0, ...)."""
    return masks.join(F.broadcast(type_codes(types, names)), masks.columns[1:], "left").select("s", F.coalesce("tid", F.lit(0)).alias("tid"))


def triples_of_types(rows: EntityRows, types: DataFrame, tids: list[int], fold: bool = False) -> DataFrame:
    """The distinct triples of all entities of some types."""
    names = rows.names(fold)
    single, rest = rows.split()
    parts = [EntityRows(rows.spark, [replace(p, df=p.df.filter(F.col("_tid").isin(tids))) for p in rows.typed(types, fold).parts]).triples()] if single.parts else []
    if rest.parts or not parts:
        of = _types_of(joined_masks(rest.row_masks(names, fold), "s"), types, names)
        parts.append(rest.triples().dropDuplicates(["s", "p", "o"]).join(of.filter(F.col("tid").isin(tids)), "s", "left_semi"))
    return reduce(DataFrame.unionByName, parts)


def dictionary(triples: DataFrame | EntityRows, types: DataFrame, fold: bool = False) -> DataFrame:
    """(term, tid, eid) for all subjects and objects; eid packs the type id above a counter per type.

    Terms that are objects only are of type 0. Numbers follow the term order.
    """
    if isinstance(triples, EntityRows):
        # Subjects with their predicates and objects with none, combined by term in one exchange.
        names = triples.names(fold)
        masks = triples.row_masks(names, fold)
        objects = triples.objects().select("s", *[F.lit(0).cast("bigint").alias(c) for c in masks.columns[1:]])
        terms = _types_of(joined_masks(masks.unionByName(objects), "s"), types, names)
    else:
        subjects = entity_types(triples, types, fold)
        objects = triples.select(F.col("o").alias("s")).distinct().join(subjects, "s", "left_anti").withColumn("tid", F.lit(0))
        terms = subjects.unionByName(objects)
    numbered = number_in_groups(terms, "tid", "s", "counter")
    return numbered.select(F.col("s").alias("term"), "tid", (F.shiftleft(F.col("tid").cast("bigint"), TID_SHIFT).bitwiseOR(F.col("counter"))).alias("eid"))


def predicate_ids(triples: DataFrame | EntityRows) -> DataFrame:
    """(pid, pred): from 1 in predicate order, an id space of its own."""
    from pyspark.sql import Window

    if isinstance(triples, EntityRows):
        # One row per predicate that occurs; names need no triples.
        names = triples.names()
        bits = triples.row_masks(names).agg(*[F.bit_or(f"m{k}").alias(f"m{k}") for k in range(-(-len(names) // BITS))])
        bits = stored(bits, "predicates")
        return bits.select(F.posexplode(predicate_names(names)).alias("pid", "pred")).select((F.col("pid") + 1).alias("pid"), "pred")
    return triples.select(F.col("p").alias("pred")).distinct().withColumn("pid", F.row_number().over(Window.orderBy("pred"))).select("pid", "pred")


def encode(triples: DataFrame | EntityRows, terms: DataFrame, predicates: DataFrame) -> DataFrame:
    """(sid, pid, oid). Predicates become ids first."""
    if isinstance(triples, EntityRows):
        return reduce(DataFrame.unionByName, [ids for ids, _ in encoded_parts(triples, terms, predicates)])
    s, o = (terms.select(F.col("term").alias(c), F.col("eid").alias(f"{c}id")) for c in "so")
    found = triples.join(F.broadcast(predicates.withColumnRenamed("pred", "p")), "p").select("s", "pid", "o").join(s, "s")
    return found.join(o, "o").select("sid", "pid", "oid")


#: Different objects, in all, that are looked up by a broadcast.
FEW = 100_000


def encoded_parts(rows: EntityRows, terms: DataFrame, predicates: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """The encoded triples in parts of (sid, pid, oid), each with the (term, eid) of its objects.

    A row's subject is looked up once for all its triples, before they are made. Predicates with few different objects are
    looked up by a broadcast; only objects of the others are exchanged, with the terms between their smallest and largest.
    Which is which is told by approximate counts, so these decide on the way, not on the result.
    """
    found = stored(rows.under_ids({r["pred"]: r["pid"] for r in predicates.collect()}, terms), "subjects")
    few, total = [], 0
    counts = found.groupBy("pid").agg(F.approx_count_distinct("o").alias("n")).collect()
    for n, pid in sorted((r["n"], r["pid"]) for r in counts):
        total += n
        if total <= FEW:
            few.append(pid)
    rest, parts = sorted({r["pid"] for r in counts} - set(few)), []
    if few or not rest:
        some = found.filter(F.col("pid").isin(few))
        held = F.broadcast(some.select(F.col("o").alias("term")).distinct())
        parts.append((some, F.broadcast(stored(terms.join(held, "term", "left_semi").select("term", "eid"), "few"))))
    if rest:
        ends = [f(F.when(F.col("pid") == pid, F.col("o"))).alias(f"{name}{pid}") for pid in rest for f, name in ((F.min, "a"), (F.max, "z"))]
        at = found.filter(F.col("pid").isin(rest)).agg(*ends).first()
        between = reduce(Column.__or__, [F.col("term").between(F.lit(at[f"a{pid}"]), F.lit(at[f"z{pid}"])) for pid in rest])
        parts.append((found.filter(F.col("pid").isin(rest)), terms.filter(between).select("term", "eid")))
    return [(part.join(table, F.col("o") == F.col("term")).select("sid", "pid", F.col("eid").alias("oid")), table) for part, table in parts]


def decode(ids: DataFrame | list[tuple[DataFrame, DataFrame]], terms: DataFrame, predicates: DataFrame) -> DataFrame:
    """(s, p, o) of encoded triples, or of their parts. Objects come first: most are shorter than subjects, so less goes through the second exchange."""
    s = terms.select(F.col("eid").alias("sid"), F.col("term").alias("s"))
    parts = ids if isinstance(ids, list) else [(ids, terms)]
    objects = reduce(DataFrame.unionByName, [part.join(table.select(F.col("eid").alias("oid"), F.col("term").alias("o")), "oid").select("sid", "pid", "o") for part, table in parts])
    return objects.join(s, "sid").join(F.broadcast(predicates.withColumnRenamed("pred", "p")), "pid").select("s", "p", "o")


def entities(triples: DataFrame) -> DataFrame:
    """(s, props): all of an entity's values as map<predicate, array<object>>, the source of star reads without joins."""
    slots = triples.groupBy("s", "p").agg(F.collect_list("o").alias("os"))
    return slots.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("p", "os"))).alias("props"))


def _row_selectivity(rows: EntityRows, types: DataFrame) -> DataFrame:
    """``selectivity`` of entity rows: single rows carry their type, only repeated subjects are joined with theirs."""
    names = rows.names()
    single, rest = rows.split()
    typed, masks = [], []
    for part in rows.typed(types).parts:
        pairs = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in part.objects().items()])
        typed.append(part.df.select(F.col("_tid").alias("tid"), F.inline(pairs)).filter("o is not null"))
    if single.parts:
        masks.append(_types_of(single.row_masks(names), types, names))
    if rest.parts:
        of = _types_of(joined_masks(rest.row_masks(names), "s"), types, names)
        typed.append(rest.triples().join(of, "s").select("tid", "p", "o"))
        masks.append(of)
    pairs = reduce(DataFrame.unionByName, typed).distinct().groupBy("tid", "p").agg(F.count("*").alias("n_objects"))
    sizes = reduce(DataFrame.unionByName, masks).groupBy("tid").agg(F.count("*").alias("n"))
    return pairs.join(sizes, "tid").select("tid", "p", "n", "n_objects", (F.col("n_objects") / F.col("n")).alias("sel"))


def selectivity(triples: DataFrame | EntityRows, of: DataFrame) -> DataFrame:
    """(tid, p, n, n_objects, sel): distinct objects of a predicate per entity of its type; exact.

    ``of``: the types of subjects; for entity rows, the type table.
    """
    if isinstance(triples, EntityRows):
        return _row_selectivity(triples, of)
    typed = triples.join(of, "s")
    pairs = typed.select("tid", "p", "o").distinct().groupBy("tid", "p").agg(F.count("*").alias("n_objects"))
    sizes = of.groupBy("tid").agg(F.count("*").alias("n"))
    return pairs.join(sizes, "tid").select("tid", "p", "n", "n_objects", (F.col("n_objects") / F.col("n")).alias("sel"))


def twig_size(triples: DataFrame, predicates: list[str]) -> DataFrame:
    """(n_roots, n_rows): rows of a star over all predicates, from counts, without building it."""
    counts = triples.filter(F.col("p").isin(predicates)).groupBy("s").agg(*[F.count(F.when(F.col("p") == p, 1)).alias(f"c{k}") for k, p in enumerate(predicates)])
    product = F.lit(1).cast("bigint")
    for k in range(len(predicates)):
        product = product * F.col(f"c{k}")
    return counts.agg(F.count(F.when(product > 0, 1)).alias("n_roots"), F.coalesce(F.sum(product), F.lit(0)).cast("bigint").alias("n_rows"))


@dataclass
class Statistics:
    """Type counts and selectivities on the driver; as large as the schema, not the data."""

    types: dict[int, tuple[frozenset[str], int]] = field(default_factory=dict)
    sel: dict[tuple[int, str], float] = field(default_factory=dict)

    @classmethod
    def collect(cls, types: DataFrame, selectivities: DataFrame) -> Statistics:
        return cls({r["tid"]: (frozenset(r["preds"]), r["n"]) for r in types.collect()}, {(r["tid"], r["p"]): r["sel"] for r in selectivities.select("tid", "p", "sel").collect()})

    def types_with(self, preds: set[str]) -> list[int]:
        return [t for t, (have, _) in self.types.items() if preds <= have]

    def count(self, preds: set[str]) -> float:
        return float(sum(self.types[t][1] for t in self.types_with(preds)))

    def leaf(self, preds: set[str], p: str, roots: float) -> float:
        """Expected distinct objects of ``p`` below ``roots`` entities that carry ``preds``."""
        whole = self.count(preds)
        return roots / whole * sum(self.types[t][1] * self.sel.get((t, p), 1.0) for t in self.types_with(preds)) if whole else 0.0
