"""A table of solutions: one column per variable, with the row operators of a query API."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.query import having_rows


class Solutions:
    """Wraps a DataFrame; every operator gives a new table."""

    def __init__(self, df: DataFrame):
        self.df = df

    @property
    def heads(self) -> list[str]:
        return self.df.columns

    def _known(self, *columns: str) -> None:
        for c in columns:
            if c not in self.df.columns:
                raise KeyError(f"no column {c!r}")

    def contains(self, column: str) -> bool:
        return column in self.df.columns

    def filter(self, test: Callable[..., Column], *columns: str) -> Solutions:
        """``test`` gets the named columns, or without names a dict of all."""
        self._known(*columns)
        return Solutions(self.df.filter(test(*map(F.col, columns)) if columns else test({c: F.col(c) for c in self.df.columns})))

    def expand(self, column: str, new: str, values: Callable[[Column], Column]) -> Solutions:
        """A row per element of ``values(column)``, an array; rows without elements go."""
        self._known(column)
        return Solutions(self.df.withColumn(new, F.explode(values(F.col(column)))))

    def expand_table(self, table: DataFrame, on: str) -> Solutions:
        """The same with the elements in a table (on, ...): a join."""
        self._known(on)
        return Solutions(self.df.join(table, on))

    def product(self, other: Solutions | str, values: list[str] | None = None) -> Solutions:
        """All pairs with another table, or with the given values as a new column."""
        if isinstance(other, str):
            return Solutions(self.df.withColumn(other, F.explode(F.array(*map(F.lit, values or [])).cast("array<string>"))))
        return Solutions(self.df.crossJoin(other.df))

    def join(self, other: Solutions) -> Solutions:
        """On all shared columns; the product of tables that share none."""
        shared = [c for c in self.df.columns if c in other.df.columns]
        return Solutions(self.df.join(other.df, shared)) if shared else self.product(other)

    def semi_join(self, other: Solutions) -> Solutions:
        """Rows with a partner; without shared columns all rows if the other table has any."""
        return Solutions(having_rows(self.df, other.df, True))

    def select(self, *columns: str) -> Solutions:
        self._known(*columns)
        return Solutions(self.df.select(*columns))

    def distinct_values(self, column: str) -> DataFrame:
        self._known(column)
        return self.df.select(column).distinct()

    def all_distinct_values(self) -> DataFrame:
        """(head, value): the distinct values of every column."""
        return self.df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("head"), F.col(c).cast("string").alias("value")) for c in self.df.columns]))).distinct()

    def append(self, rows: list[tuple]) -> Solutions:
        return Solutions(self.df.unionByName(self.df.sparkSession.createDataFrame(rows, self.df.schema)))

    def brief(self, n: int = 10) -> str:
        """Header and the first rows, decoded."""
        return "\n".join(["\t".join(self.df.columns), *("\t".join(map(str, r)) for r in self.df.take(n))])

    def count(self) -> int:
        return self.df.count()
