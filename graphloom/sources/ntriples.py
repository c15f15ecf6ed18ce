"""N-Triples-like text: reading, writing, pairing with reversed triples."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.rows import EntityRows

SCHEMA = "s string, p string, o string"


def read_ntriples(spark: SparkSession, path: str | list[str], sep: str = " ", distinct: bool = True) -> DataFrame:
    """(s, p, o) of lines ``s SEP p SEP o [SEP .]``; lines of fewer fields and comments are skipped, duplicates dropped.

    Separators inside ``<...>`` and quotes belong to the term, and a backslash
    escapes a quote.
    """
    sep = sep if sep == "\t" else re.escape(sep)
    gap = rf"[{sep}\t]+" if sep != "\t" else r"\t+"
    stop = sep if sep == "\t" else rf"{sep}\t"
    term = rf'<[^>]*>|"(?:[^"\\]|\\.)*+"[^{stop}]*|[^<"#{stop}][^{stop}]*'
    pattern = rf"^\s*({term}){gap}({term}){gap}({term})(?:{gap})?\.?\s*$"
    lines = spark.read.text(path)
    cut = lines.select(*[F.regexp_extract("value", pattern, k).alias(c) for k, c in enumerate("spo", 1)]).filter("s <> ''")
    cut = cut.withColumn("o", F.when(F.col("o").startswith('"') | F.col("o").startswith("<"), F.col("o")).otherwise(F.regexp_replace("o", r"\.$", "")))
    return cut.dropDuplicates(["s", "p", "o"]) if distinct else cut


def write_ntriples(triples: DataFrame, path: str, sep: str = " ") -> None:
    triples.select(F.concat_ws(sep, "s", "p", "o", F.lit("."))).write.text(path)


def merge(*parts: DataFrame | EntityRows) -> DataFrame:
    """Union of triple sets, without duplicates. A set given twice is read once."""
    parts = tuple({id(p): p for p in parts}.values())
    if all(isinstance(p, EntityRows) for p in parts):
        return EntityRows(parts[0].spark, [t for p in parts for t in p.parts]).distinct()
    return reduce(lambda a, b: a.unionByName(b), [p.triples() if isinstance(p, EntityRows) else p for p in parts]).dropDuplicates(["s", "p", "o"])


def reversed_triples(triples: DataFrame) -> DataFrame:
    """(o, _p, s) for every (s, p, o)."""
    return triples.select(F.col("o").alias("s"), F.concat(F.lit("_"), "p").alias("p"), F.col("s").alias("o"))


def paired(triples: DataFrame) -> DataFrame:
    return triples.select("s", "p", "o").unionByName(reversed_triples(triples))
