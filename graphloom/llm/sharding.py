"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of the ring, a key belongs to the next point
clockwise. A shard accepts keys up to its capacity; the keys that a full shard
can't take go on clockwise to the next point whose shard has room. With exact
capacities (floor or ceil of rows / shards) all counts are at most one apart
(law ``rows``); without capacities it is the plain ring (law ``key``).

What happens to a key depends on its arc (the stretch before a point) and its
rank in the arc alone. So Spark sorts narrow rows by range in ring order, keeps
that order in a checkpoint and counts keys per arc; the driver lets the counts
of ``shards * vnodes`` arcs flow - a table whose size depends on the two
parameters only - and the resulting segments (arc, range of places -> shard,
first slot) are joined back. One shuffle, no Python on executors, and an arc or
a key with most of the rows is spread over as many tasks as any other rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint

RING_BITS = 40


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """Sorted (place, shard). A shard's points don't depend on the number of shards."""
    points: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            place = int.from_bytes(hashlib.sha256(f"{shard}/{v}".encode()).digest()[:8], "big") >> (64 - RING_BITS)
            points.setdefault(place, shard)
    return sorted(points.items())


def flow(counts: list[int], owners: list[int], capacity: list[int]) -> list[list[tuple[int, int]]]:
    """For each arc, its segments (shard, keys) in rank order.

    Round d offers what is left of each arc, arcs in ring order, to the d-th point
    clockwise of it. Stops when nothing is left; capacities must suffice.
    """
    room, left, n = list(capacity), list(counts), len(owners)
    out: list[list[tuple[int, int]]] = [[] for _ in counts]
    waiting = [i for i in range(n) if left[i]]
    for d in range(n):
        for i in waiting:
            shard = owners[(i + d) % n]
            if take := min(left[i], room[shard]):
                room[shard] -= take
                left[i] -= take
                out[i].append((shard, take))
        waiting = [i for i in waiting if left[i]]
        if not waiting:
            break
    if waiting:
        raise ValueError("capacities are smaller than the number of keys")
    return out


def _arc_of(place: Column, points: list[tuple[int, int]]) -> Column:
    """Index of the first point at or clockwise of a place.

    The ring is cut into equal cells; a cell lists the points in it, so a look-up
    is an array access and a scan of a few points.
    """
    places = [p for p, _ in points]
    bits = max(0, min(RING_BITS, (len(places)).bit_length()))
    width = 1 << (RING_BITS - bits)
    firsts = [bisect_left(places, c * width) for c in range(1 << bits)]
    inside = [places[firsts[c] : bisect_left(places, (c + 1) * width)] for c in range(1 << bits)]
    as_array = lambda xs, kind: F.from_json(F.lit(str(xs)), F.lit(kind))
    cell = F.shiftright(place, RING_BITS - bits).cast("int")
    first = F.get(as_array(firsts, "array<int>"), cell)
    behind = F.aggregate(F.get(as_array(inside, "array<array<bigint>>"), cell), F.lit(0), lambda n, p: n + F.when(p < place, 1).otherwise(0))
    return F.pmod(first + behind, F.lit(len(places))).cast("int")


def shard_rows(df: DataFrame, key: str, size: Column, shards: int = 40, vnodes: int = 64, law: str = "rows", tie: list[Column] | None = None) -> DataFrame:
    """Adds (size long, law, shard int, slot long, grown_shard int) to ``df``'s rows.

    law ``rows``: shard counts are at most one apart. law ``key``: key and shard
    count alone decide, ``grown_shard`` is the place on a ring with one more shard.
    Slots run gaplessly from 0 in every shard, in ring order. A null key has a
    place of its own on the ring; rows with equal keys are ordered by ``tie`` and
    are interchangeable beyond it. An empty table gives an empty result.
    """
    if law not in ("rows", "key"):
        raise ValueError(f"unknown law {law}")
    spark = df.sparkSession
    points = ring_points(shards, vnodes)
    place = F.shiftrightunsigned(F.xxhash64(F.lit("ring"), F.col(key)), 64 - RING_BITS)
    rows = df.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), size.cast("bigint").alias("_size"), F.array(*[c.cast("string") for c in tie or []]).cast("array<string>").alias("_tie"), place.alias("_place"), F.monotonically_increasing_id().alias("_nth"))
    rows = rows.withColumn("_arc", _arc_of(F.col("_place"), points))
    # Sorted over all tasks by range, so rows of one arc, or of one key, may lie in many of them.
    order = ["_arc", "_place", "_key", "_tie", "_nth"]
    at = F.monotonically_increasing_id()
    numbered = checkpoint(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_row", "_size", "_place", "_arc", F.shiftright(at, 33).cast("int").alias("_part"), at.bitwiseAND((1 << 33) - 1).alias("_nth")))
    # A row per task and arc in it: at most tasks + arcs, as both are sorted.
    found = numbered.groupBy("_part", "_arc").agg(F.count("*").alias("n")).collect()
    count_by_arc, count_by_part = Counter(), Counter()
    for r in found:
        count_by_arc[r["_arc"]] += r["n"]
        count_by_part[r["_part"]] += r["n"]
    counts = [count_by_arc[i] for i in range(len(points))]
    total, owners = sum(counts), [s for _, s in points]
    capacity = [total // shards + (s < total % shards) for s in range(shards)] if law == "rows" else [total] * shards
    # Segments by place in the order of all rows: arc, from, to, shard, what turns that place into the slot.
    segments, used, first = [], [0] * shards, 0
    for arc, parts in enumerate(flow(counts, owners, capacity)):
        for shard, n in parts:
            segments.append((arc, first, first + n, shard, used[shard] - first))
            used[shard] += n
            first += n
    # At most shards * vnodes + shards segments (each shard fills up once), and a row per task: safe to send to every executor.
    table = spark.createDataFrame(segments, "_a int, _from bigint, _to bigint, _shard int, _shift bigint")
    tasks = sorted(count_by_part)
    before = spark.createDataFrame(list(zip(tasks, accumulate((count_by_part[t] for t in tasks[:-1]), initial=0), strict=True)) if tasks else [], "_part int, _before bigint")
    ranked = numbered.join(F.broadcast(before), "_part").withColumn("_rank", F.col("_before") + F.col("_nth"))
    placed = ranked.join(F.broadcast(table), (F.col("_arc") == F.col("_a")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    if law == "key":
        bigger = ring_points(shards + 1, vnodes)
        grown = F.get(F.from_json(F.lit(str([s for _, s in bigger])), F.lit("array<int>")), _arc_of(F.col("_place"), bigger))
    else:
        grown = F.lit(None).cast("int")
    return placed.select(F.col("_row"), F.col("_size").alias("size"), F.lit(law).alias("law"), F.col("_shard").alias("shard"), (F.col("_rank") + F.col("_shift")).alias("slot"), grown.alias("grown_shard"))


def op8_documents(documents: DataFrame, shards: int = 40, vnodes: int = 64, law: str = "rows") -> DataFrame:
    """The contract's columns; the text itself never enters the shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("bytes"), F.crc32(text).alias("text_crc32"))
    out = shard_rows(narrow, "doc_id", F.col("bytes"), shards, vnodes, law, [F.col("text_crc32"), F.col("bytes")])
    return out.select("_row.doc_id", "size", "_row.text_crc32", "law", "shard", "slot", "grown_shard")
