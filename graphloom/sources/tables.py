"""Relational tables as typed entities.

An entity table has one row per subject and one column per single-valued
predicate, null where the subject lacks it. A star over one table is one scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

V = "urn:v:"


@dataclass
class EntityTable:
    """``load`` reads the table; subject and values are columns over it. Subjects are unique."""

    name: str
    load: Callable[[], DataFrame]
    subject: Column
    values: dict[str, Column]
    type_iri: str | None = None
    prefix: str = ""
    cached: DataFrame | None = field(default=None, repr=False)

    def frame(self) -> DataFrame:
        if self.cached is None:
            self.cached = self.load()
        return self.cached


def _key(table: str, *columns: Column | str) -> Column:
    return F.concat(F.lit(f"<urn:{table}:"), F.concat_ws("-", *[c if isinstance(c, Column) else F.col(c).cast("string") for c in columns]), F.lit(">"))


def _lit(column: str) -> Column:
    return F.concat(F.lit('"'), F.col(column).cast("string"), F.lit('"'))


def entity_tables(spark: SparkSession, sf_dir: str) -> list[EntityTable]:
    """The test tables as entities; free text stays out."""

    def table(name: str, key: Column, links: dict[str, Column], literals: dict[str, str], of: str | None = None) -> EntityTable:
        values = {f"<{V}{p}>": c for p, c in links.items()} | {f"<{V}{p}>": _lit(c) for p, c in literals.items()}
        kind = None if of else f"<urn:class:{name.capitalize()}>"
        return EntityTable(name, lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet"), key, values, kind, f"<urn:{of or name}:")

    quantity = F.col("l_quantity").cast("bigint").cast("string")
    return [
        table("region", _key("region", "r_regionkey"), {}, {"r_name": "r_name"}),
        table("nation", _key("nation", "n_nationkey"), {"n_region": _key("region", "n_regionkey")}, {"n_name": "n_name"}),
        table("customer", _key("customer", "c_custkey"), {"c_nation": _key("nation", "c_nationkey")}, {"c_name": "c_name", "c_segment": "c_mktsegment", "c_acctbal": "c_acctbal"}),
        table("supplier", _key("supplier", "s_suppkey"), {"s_nation": _key("nation", "s_nationkey")}, {"s_name": "s_name", "s_acctbal": "s_acctbal"}),
        table("part", _key("part", "p_partkey"), {}, {"p_name": "p_name", "p_brand": "p_brand", "p_type": "p_type", "p_size": "p_size"}),
        table("orders", _key("orders", "o_orderkey"), {"o_cust": _key("customer", "o_custkey")}, {"o_status": "o_orderstatus", "o_priority": "o_orderpriority", "o_totalprice": "o_totalprice", "o_date": "o_orderdate"}),
        table("lineitem", _key("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", quantity), {"l_order": _key("orders", "l_orderkey"), "l_part": _key("part", "l_partkey"), "l_supp": _key("supplier", "l_suppkey")}, {"l_quantity": "l_quantity", "l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus"}),
        table("events", _key("events", "event_id"), {"e_user": _key("customer", "user_id")}, {"e_type": "event_type", "e_value": "value", "e_ts": "ts"}),
        table("documents", _key("documents", "doc_id"), {}, {"d_lang": "lang", "d_source": "source"}),
        table("labels", _key("documents", "doc_id"), {}, {"d_quality": "quality", "d_toxic": "toxic"}, of="documents"),
        table("conversations", _key("conversations", "conv_id", "turn"), {"t_conv": _key("conversation", "conv_id")}, {"t_role": "role"}),
    ]
