"""Copy-on-write updates of a triple set. Types are recomputed from triples, so an emptied predicate leaves the type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.numbering import stored
from graphloom.operators.schema import type_table
from graphloom.sources.rows import EntityRows

_KEY = ["s", "p", "o"]


def add_triples(triples: DataFrame | EntityRows, new: DataFrame) -> DataFrame:
    """Of entity rows only subjects that repeat or that are in ``new`` are exchanged."""
    if isinstance(triples, EntityRows):
        return triples.distinct(new.select(*_KEY))
    return triples.select(*_KEY).unionByName(new.select(*_KEY)).dropDuplicates(_KEY)


def remove_triples(triples: DataFrame, gone: DataFrame) -> DataFrame:
    """What goes is stored first, so the planner knows its size: if it is small, the triples stay where they are."""
    return triples.join(stored(gone.select(*_KEY).distinct(), "gone"), _KEY, "left_anti")


def delete_entity(triples: DataFrame, entity: str) -> DataFrame:
    """Without the entity as subject and as object."""
    return triples.filter((F.col("s") != entity) & (F.col("o") != entity))


def _rows(triples: DataFrame, entity: str, props: dict[str, list[str]]) -> DataFrame:
    return triples.sparkSession.createDataFrame([(entity, p, o) for p, os in props.items() for o in os], "s string, p string, o string")


def add_entity(triples: DataFrame, entity: str, props: dict[str, list[str]]) -> DataFrame:
    return add_triples(triples, _rows(triples, entity, props))


def remove_from_entity(triples: DataFrame, entity: str, props: dict[str, list[str]]) -> DataFrame:
    return remove_triples(triples, _rows(triples, entity, props))


def update_entity(triples: DataFrame, entity: str, props: dict[str, list[str]]) -> DataFrame:
    """Sets the given predicates to exactly these values; others stay."""
    rest = triples.filter((F.col("s") != entity) | ~F.col("p").isin(list(props)))
    return add_triples(rest, _rows(triples, entity, props))


def by_entity(triples: DataFrame | EntityRows) -> DataFrame:
    """(s, p, os): updates grouped by entity and predicate."""
    if isinstance(triples, EntityRows):
        single, rest = triples.split()
        parts = [single.triples().select("s", "p", F.array("o").alias("os"))] if single.parts else []
        return reduce(DataFrame.unionByName, parts + ([by_entity(rest.triples())] if rest.parts or not parts else []))
    return triples.groupBy("s", "p").agg(F.sort_array(F.collect_list("o")).alias("os"))


def refreshed_types(triples: DataFrame, top: int | None = None) -> DataFrame:
    """What a monitor of types runs now and then: the most frequent predicate sets as they are."""
    return type_table(triples, top=top)
