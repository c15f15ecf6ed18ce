"""Point lookups: predicates, objects, subjects and neighbours of a term. All lazy, all filters that reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TripleServer:
    """Works on text terms; ``by_id`` variants take an encoded graph's ids through the same methods."""

    def __init__(self, triples: DataFrame):
        self.rows = triples

    def predicates_of(self, s: str) -> DataFrame:
        return self.rows.filter(F.col("s") == s).select("p").distinct()

    def objects(self, s: str, p: str) -> DataFrame:
        return self.rows.filter((F.col("s") == s) & (F.col("p") == p)).select("o")

    def subjects(self, p: str, o: str) -> DataFrame:
        return self.rows.filter((F.col("p") == p) & (F.col("o") == o)).select("s")

    def neighbours_out(self, s: str) -> DataFrame:
        return self.rows.filter(F.col("s") == s).select("o")

    def neighbours_in(self, o: str) -> DataFrame:
        return self.rows.filter(F.col("o") == o).select("s")

    def subjects_having(self, predicates: list[str]) -> DataFrame:
        """Subjects that carry all the predicates; none asked for, all subjects."""
        wanted = sorted(set(predicates))
        if not wanted:
            return self.rows.select("s").distinct()
        # A bit per predicate: partial aggregates are one number per subject.
        bit = F.lit(0).cast("bigint")
        for k, p in enumerate(wanted):
            bit = F.when(F.col("p") == p, F.lit(1 << k).cast("bigint")).otherwise(bit)
        if len(wanted) > 62:
            return self.rows.filter(F.col("p").isin(wanted)).groupBy("s").agg(F.count_distinct("p").alias("n")).filter(F.col("n") == len(wanted)).select("s")
        return self.rows.filter(F.col("p").isin(wanted)).groupBy("s").agg(F.bit_or(bit).alias("bits")).filter(F.col("bits") == (1 << len(wanted)) - 1).select("s")


def decode_columns(df: DataFrame, columns: list[str], terms: DataFrame) -> DataFrame:
    """Replaces id columns by their terms, one dictionary join each."""
    for c in columns:
        df = df.join(terms.select(F.col("eid").alias(c), F.col("term").alias("_term")), c, "left").drop(c).withColumnRenamed("_term", c)
    return df
