"""Connected components by label propagation with pointer jumping, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b): component is the smallest id reachable.

    Each round takes the smallest label among an id and its neighbours, then the
    label of that label, so long chains shrink geometrically. A hub is a hot join key
    only, which adaptive execution splits; minima are combined before the shuffle.
    """
    both = checkpoint(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels.id == near.a).select("id", F.least("component", "m").alias("c"), F.col("component").alias("old"))
        up = labels.select(F.col("id").alias("up"), F.col("component").alias("top"))
        new = checkpoint(step.join(up, step.c == up.up, "left").select("id", F.least("c", F.coalesce("top", "c")).alias("component"), "old"))
        changed = not new.filter("component <> old").isEmpty()
        labels = new.select("id", "component")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
