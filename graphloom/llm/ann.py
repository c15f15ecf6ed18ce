"""Approximate nearest neighbours: NN-descent in Spark joins, and greedy search on the graph.

Start: random projection trees cut the vectors into small leaves; within a block
of a leaf all distances are computed, which gives every vector its first list.
Descent: every round each vector meets its neighbours and those that have it as a
neighbour, all of them are compared with each other, and what is nearer than the
worst of a list goes to its owner. All steps are joins and groups by a bucket of
vector ids; no list is longer than ``k`` (or ``2 k`` with reverse neighbours), so
no task's share depends on how popular a vector is. Search: every query keeps a
beam, expands its nearest unexpanded members by joins with the graph, and ends
when none is left. Distances of results are exact, in double precision.

Trees are cut at medians of a bounded sample (``SAMPLE`` rows); every vector is
indexed. Up to ``LEAF`` vectors the result is exact: one leaf holds them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint, written

#: Neighbours per vector, trees, members of a leaf block, what a meeting sends to a member.
K, TREES, LEAF, SEND = 30, 4, 600, 5
#: Rows that the trees are cut on: the bound of the driver's share.
SAMPLE = 20_000
#: Rows that the centre is the mean of.
CENTRE = 2_000
#: Beam of a search, and members that it expands in a round.
BEAM, EXPAND = 320, 80
#: Vectors whose lists are worked on in one group.
GROUP = 2_000
_STATE = "id bigint, near array<bigint>, far array<float>"
_TOLD = "bucket int, owner array<bigint>, near array<bigint>, far array<float>"


def usable(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, vec array<double>): not null, not zero, all components finite; of rows with one id the first by value."""
    values = F.col(vector).cast("array<double>")
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), values.alias("vec")).filter("id is not null and vec is not null")
    ok = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    return rows.filter(ok).groupBy("id").agg(F.min("vec").alias("vec"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of little-endian floats as a matrix."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), "<f4").reshape(len(parts), -1)


def centre_of(rows: DataFrame, n: int) -> np.ndarray:
    """About the mean of all vectors: distances don't change by it, but short vectors keep them precise in single precision."""
    drawn = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) <= int(1_000_003 * min(1.0, CENTRE / max(1, n)))).limit(2 * CENTRE)
    sample = sorted(((r.id, r.vec) for r in drawn.select("id", "vec").collect()), key=lambda x: x[0])
    return np.mean(np.array([v for _, v in sample], "<f8"), axis=0) if sample else np.zeros(1)


def _as_bytes(centre: np.ndarray):
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            exact = [np.array(v, "<f8") + 0.0 for v in part.column(1).to_pylist()]  # -0.0 equals 0.0
            classes = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in exact]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(classes, pa.binary()), pa.array([(v - centre).astype("<f4").tobytes() for v in exact], pa.binary())], names=["id", "class", "raw"])

    return run


def plant(sample: np.ndarray, leaves: int, trees: int, seed: int = 5) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Per tree and level: directions and medians by node. A tree halves the sample until there are enough leaves."""
    rng = np.random.default_rng(seed)
    levels = max(0, (leaves - 1).bit_length())
    out = []
    for _ in range(trees):
        node, tree = np.zeros(len(sample), np.int64), []
        for level in range(levels):
            ways = rng.standard_normal((1 << level, sample.shape[1])).astype(np.float32)
            # The direction between two members of the node separates better than a random one.
            for n in range(1 << level):
                if len(own := np.flatnonzero(node == n)) > 1:
                    a, b = rng.choice(own, 2, replace=False)
                    if (gap := sample[a] - sample[b]).any():
                        ways[n] = gap
            at = np.einsum("ij,ij->i", sample, ways[node])
            cuts = np.zeros(1 << level, np.float32)
            for n in range(1 << level):
                own = at[node == n]
                cuts[n] = np.median(own) if len(own) else 0
            tree.append((ways, cuts))
            node = 2 * node + (at > cuts[node])
        out.append(tree)
    return out


def descend(tree: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    for ways, cuts in tree:
        node = 2 * node + (np.einsum("ij,ij->i", x, ways[node]) > cuts[node])
    return node


def _leaves(forest):
    planted = forest

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = _matrix(part.column(1))
            for t, tree in enumerate(planted):
                leaf = descend(tree, x) if len(x) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(leaf), part.column(0), part.column(1)], names=["tree", "leaf", "id", "raw"])

    return run


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of x (..., n, d) and y (..., m, d) all squared distances. Taken from their own middle, so that norms don't drown them."""
    middle = x.mean(-2, keepdims=True)
    x, y = x - middle, y - middle
    d = (x * x).sum(-1)[..., :, None] + (y * y).sum(-1)[..., None, :] - 2 * (x @ np.swapaxes(y, -1, -2))
    return np.maximum(d, 0)


def _lists(ids: np.ndarray, near: np.ndarray, far: np.ndarray) -> pa.Table:
    """Lists of equal length as a table."""
    n, k = near.shape
    edges = pa.array(np.arange(n + 1, dtype=np.int32) * k)
    return pa.table({"id": pa.array(ids, pa.int64()), "near": pa.ListArray.from_arrays(edges, pa.array(near.ravel(), pa.int64())), "far": pa.ListArray.from_arrays(edges, pa.array(far.ravel(), pa.float32()))})


def _first(k: int):
    def run(table: pa.Table) -> pa.Table:
        ids, x = table.column("id").to_numpy(), _matrix(table.column("raw"))
        d = _squared(x, x)
        np.fill_diagonal(d, np.inf)
        k_ = min(k, len(ids) - 1)
        best = np.argpartition(d, k_ - 1, axis=1)[:, :k_] if k_ else np.zeros((len(ids), 0), np.int64)
        return _lists(ids, ids[best], np.take_along_axis(d, best, axis=1))

    return run


def _flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, neighbour, distance) of lists."""
    near, far = table.column("near").combine_chunks(), table.column("far").combine_chunks()
    return np.repeat(table.column("id").to_numpy(), near.value_lengths().to_numpy(zero_copy_only=False)), near.flatten().to_numpy(), far.flatten().to_numpy()


def best_lists(owner: np.ndarray, other: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per owner the k nearest distinct others, ties to smaller ids: flat, sorted."""
    order = np.lexsort((far, other, owner))
    owner, other, far = owner[order], other[order], far[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
    owner, other, far = owner[fresh], other[fresh], far[fresh]
    order = np.lexsort((other, far, owner))
    owner, other, far = owner[order], other[order], far[order]
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    rank = np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))
    return owner[rank < k], other[rank < k], far[rank < k]


def _ragged(owner: np.ndarray, other: np.ndarray, far: np.ndarray) -> pa.Table:
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    edges = pa.array(np.append(starts, len(owner)).astype(np.int32))
    return pa.table({"id": pa.array(owner[starts], pa.int64()), "near": pa.ListArray.from_arrays(edges, pa.array(other, pa.int64())), "far": pa.ListArray.from_arrays(edges, pa.array(far, pa.float32()))})


def _merge(k: int):
    def run(table: pa.Table) -> pa.Table:
        return _ragged(*best_lists(*_flat(table), k))

    return run


def _improve(k: int):
    """Lists of a bucket and what meetings told it -> its lists."""

    def run(lists: pa.Table, told: pa.Table) -> pa.Table:
        news = [told.column(c).combine_chunks().flatten().to_numpy() for c in ("owner", "near", "far")]
        return _ragged(*best_lists(*(np.concatenate(pair) for pair in zip(_flat(lists), news, strict=True)), k))

    return run


def _meet(send: int, buckets: int):
    """Members (v, id, raw, worst) that met at v -> the nearest others of a member that beat its worst.

    One row per bucket of owners, however many owners it holds.
    """

    def run(table: pa.Table) -> pa.Table:
        v, ids, worst = (table.column(c).to_numpy() for c in ("v", "id", "worst"))
        order = np.argsort(v, kind="stable")
        v, ids, worst, x = v[order], ids[order], worst[order], _matrix(table.column("raw"))[order]
        starts = np.append(np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])), len(v))
        out: list[list[np.ndarray]] = [[], [], []]
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            d = _squared(x[a:b], x[a:b])
            np.fill_diagonal(d, np.inf)
            n = min(send, b - a - 1)
            best = np.argpartition(d, n - 1, axis=1)[:, :n]
            far = np.take_along_axis(d, best, axis=1)
            p, q = np.nonzero(far < worst[a:b][:, None])
            out[0].append(ids[a + p]), out[1].append(ids[a + best[p, q]]), out[2].append(far[p, q])
        owner, other, far = best_lists(*(np.concatenate(c) if c else np.zeros(0, kind) for c, kind in zip(out, (np.int64, np.int64, np.float32), strict=True)), 1 << 30)
        at = (owner ^ (owner >> 16)) % buckets
        order = np.argsort(at, kind="stable")
        at = at[order]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        edges = pa.array(np.append(starts, len(at)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(edges, pa.array(c[order], kind)) for c, kind in ((owner, pa.int64()), (other, pa.int64()), (far, pa.float32()))]
        return pa.table([pa.array(at[starts], pa.int32()), *lists], names=["bucket", "owner", "near", "far"])

    return run


def buckets_for(n: int) -> int:
    return -(-n // GROUP) | 1


def _bucket(column: str, n: int) -> Column:
    """The same rule as in ``_meet``."""
    return F.pmod(F.col(column).bitwiseXOR(F.shiftright(column, 16)), F.lit(buckets_for(n))).cast("int")


def rounds_for(n: int, leaf: int = LEAF) -> int:
    """Lists improve from leaf to leaf, so rounds follow the depth of the trees."""
    return max(4, (-(-n // leaf)).bit_length())


def reverse_lists(graph: DataFrame, k: int) -> DataFrame:
    """(v, u): for every v the first ``k`` by a hash of those that name v, so its popularity doesn't widen its meeting."""
    turned = graph.select(F.explode("near").alias("v"), F.col("id").alias("u"))
    # One of 16 salts holds a share of a popular v's namers; each share is cut to k before they meet.
    salted = turned.withColumns({"salt": F.pmod(F.xxhash64("u"), F.lit(16)), "x": F.struct(F.xxhash64("v", "u").alias("h"), "u")})
    first = salted.groupBy("v", "salt").agg(F.slice(F.sort_array(F.collect_list("x")), 1, k).alias("x"))
    return first.groupBy("v").agg(F.slice(F.sort_array(F.flatten(F.collect_list("x"))), 1, k).alias("x")).select("v", F.explode("x.u").alias("u"))


def both_ways(graph: DataFrame, k: int) -> DataFrame:
    """Distinct (v, u): lists and reverse lists."""
    return graph.select(F.col("id").alias("v"), F.explode("near").alias("u")).union(reverse_lists(graph, k)).distinct()


def build_graph(vectors: DataFrame, k: int = K, trees: int = TREES, leaf: int = LEAF, rounds: int | None = None) -> DataFrame:
    """(id, near, far): every vector's nearest neighbours by squared distance, nearest first. ``vectors``: (id, raw floats), distinct ids."""
    n = vectors.count()
    if n == 0:
        return vectors.sparkSession.createDataFrame([], _STATE)
    sample = np.zeros((1, 1), np.float32)
    if n > leaf:
        # A hash of the id is a fair draw that any run repeats.
        drawn = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) <= int(1_000_003 * min(1.0, SAMPLE / n))).limit(2 * SAMPLE)
        sample = np.stack([np.frombuffer(r.raw, "<f4") for r in drawn.select("raw").collect()])
    # Leaves hold about half a block, so few of them need two. Not more leaves than the sample can cut.
    wanted = min(-(-2 * n // leaf), max(1, len(sample) // 8))
    forest = plant(sample, 1 if n <= leaf else wanted, trees if n > leaf else 1)
    placed = vectors.mapInArrow(_leaves(forest), "tree int, leaf bigint, id bigint, raw binary")
    # A leaf of more members than a block (copies fall together) is cut by a hash of the id.
    # A row per tree and leaf, of which there are at most trees * SAMPLE / 4.
    sizes = checkpoint(placed.groupBy("tree", "leaf").agg(F.count("*").alias("m")))
    blocks = placed.join(F.broadcast(sizes), ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("id", "tree"), F.ceil(F.col("m") / leaf)).cast("int"))
    first = blocks.groupBy("tree", "leaf", "block").applyInArrow(_first(k), _STATE)
    graph = written(first.groupBy(_bucket("id", n)).applyInArrow(_merge(k), _STATE), "graph")
    for _ in range(0 if n <= leaf else rounds_for(n, leaf) if rounds is None else rounds):
        guests = vectors.select("id", "raw").join(graph.select("id", F.element_at("far", -1).alias("worst")), "id")
        met = both_ways(graph, k).join(guests, F.col("u") == F.col("id")).select("v", "id", "raw", "worst")
        told = met.groupBy(_bucket("v", n)).applyInArrow(_meet(SEND, buckets_for(n)), _TOLD)
        graph = written(graph.groupBy(_bucket("id", n)).cogroup(told.groupBy("bucket")).applyInArrow(_improve(k), _STATE), "graph")
    return graph


_BEAM = "q bigint, raw binary, near array<bigint>, far array<float>, done array<boolean>"


def _distances(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
    """Rows (q, raw, worst, near) and the vectors of a bucket -> (id = q, near, far), what beats q's worst."""
    ids = vectors.column("id").to_numpy()
    order = np.argsort(ids)
    ids, x = ids[order], _matrix(vectors.column("raw"))[order] if len(ids) else np.zeros((0, 0), np.float32)
    out: list[list[np.ndarray]] = [[], [], []]
    for q, raw, worst, near in zip(pairs.column("q").to_pylist(), pairs.column("raw"), pairs.column("worst").to_pylist(), pairs.column("near").combine_chunks(), strict=True):
        some = near.values.to_numpy()
        own = x[np.searchsorted(ids, some)] - np.frombuffer(raw.as_py(), "<f4")
        far = np.einsum("ij,ij->i", own, own)
        ok = far < worst
        out[0].append(np.full(int(ok.sum()), q)), out[1].append(some[ok]), out[2].append(far[ok])
    return _ragged(*(np.concatenate(c) if c else np.zeros(0, kind) for c, kind in zip(out, (np.int64, np.int64, np.float32), strict=True)))


def _advance(beam: int, expand: int):
    """Beams of a bucket of queries and what was found -> beams: the expanded ones are done, the nearest stay."""

    def run(old: pa.Table, found: pa.Table) -> pa.Table:
        news: dict[int, list] = {}
        for q, near, far in zip(found.column("id").to_pylist(), found.column("near").combine_chunks(), found.column("far").combine_chunks(), strict=True):
            news.setdefault(q, []).append((near.values.to_numpy(), far.values.to_numpy()))
        out: tuple[list, ...] = ([], [], [], [], [])
        for q, raw, near, far, done in zip(*(old.column(c).to_pylist() for c in ("q", "raw", "near", "far", "done")), strict=True):
            near, far, done = np.array(near, np.int64), np.array(far, np.float32), np.array(done, bool)
            done[np.flatnonzero(~done)[:expand]] = True
            more = news.get(q, [])
            ids = np.concatenate([near, *(m[0] for m in more)])
            every, which = np.unique(ids, return_index=True)  # a known one keeps its state
            far = np.concatenate([far, *(m[1] for m in more)])[which]
            done = np.concatenate([done, np.zeros(len(ids) - len(near), bool)])[which]
            keep = np.lexsort((every, far))
            keep = keep[every[keep] != q][:beam]
            for column, value in zip(out, (q, raw, every[keep], far[keep], done[keep]), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_()))
        return pa.table({name: pa.array(c, kind) for name, c, kind in zip(("q", "raw", "near", "far", "done"), out, kinds, strict=True)})

    return run


def search(graph: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = K, beam: int = BEAM, expand: int = EXPAND) -> DataFrame:
    """(q, near): up to ``beam`` nearest found per query, nearest first. ``queries``: (q, raw floats); q never finds the id q.

    A query whose id is in the graph starts from its own list, any other from a few dozen vectors.
    Ends when no beam has a member left to expand: what leaves a beam never comes back, so it does end.
    """
    n, m = vectors.count(), queries.count()
    entries = [r.id for r in graph.select("id").orderBy(F.xxhash64("id")).limit(48).collect()]
    around = both_ways(graph, k).groupBy("v").agg(F.collect_list("u").alias("near"))
    around = written(around, "around")
    none = F.expr("cast(array() as array<boolean>)")
    start = F.coalesce("near", F.array(*[F.lit(e) for e in entries]).cast("array<bigint>"))
    far = F.coalesce("far", F.array(*[F.lit(float("inf"))] * len(entries)).cast("array<float>"))
    state = queries.join(graph, F.col("q") == F.col("id"), "left").select("q", "raw", start.alias("near"), far.alias("far"))
    state = written(state.select("*", F.coalesce(F.transform("near", lambda x: F.lit(False)), none).alias("done")), "beam")
    while True:
        todo = F.slice(F.filter(F.arrays_zip("near", "done"), lambda x: ~x["done"]), 1, expand)
        nodes = state.select("q", F.explode(todo).alias("x")).select("q", F.col("x.near").alias("v"))
        reached = nodes.join(around, "v").select("q", F.explode("near").alias("u")).filter("u <> q")
        packed = reached.groupBy("q", _bucket("u", n).alias("bucket")).agg(F.collect_set("u").alias("near"))
        worst = F.when(F.size("far") < beam, F.lit(float("inf"))).otherwise(F.element_at("far", -1)).cast("float")
        asked = packed.join(state.select("q", "raw", worst.alias("worst")), "q")
        found = asked.groupBy("bucket").cogroup(vectors.select("id", "raw").groupBy(_bucket("id", n))).applyInArrow(_distances, _STATE)
        state = written(state.groupBy(_bucket("q", m)).cogroup(found.groupBy(_bucket("id", m))).applyInArrow(_advance(beam, expand), _BEAM), "beam")
        if state.filter(F.exists("done", lambda d: ~d)).isEmpty():
            return state.select("q", "near")


def first_members(members: DataFrame, count: int) -> DataFrame:
    """(class, ids): the ``count`` smallest ids of every class (id, class), smallest first."""
    first = lambda ids: F.slice(F.sort_array(ids), 1, count)
    # One of 64 salts holds a share of a large class; each share is cut to what the class can need of it.
    salted = members.groupBy("class", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(first(F.collect_list("id")).alias("ids"))
    return salted.groupBy("class").agg(first(F.flatten(F.collect_list("ids"))).alias("ids"))


def nearest(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", every: int = 100, count: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``, against all other rows.

    Rows whose vector is null, zero or holds null or non-finite components take no
    part, nor do rows with a null id. Ties go to the smaller id. Vectors of several
    lengths raise an error, as no distance is defined. An empty table gives no rows.
    """
    rows = written(usable(df, id_column, vector), "vectors")
    raw = written(rows.mapInArrow(_as_bytes(centre_of(rows, rows.count())), "id bigint, class binary, raw binary"), "raw")
    # One more than a query needs, as it may be one of them.
    classes = written(first_members(raw.select("id", "class"), count + 1).select("class", F.element_at("ids", 1).alias("rep"), "ids"), "classes")
    single = written(raw.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "raw"), "representatives")
    graph = build_graph(single)
    queries = raw.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "class")
    asked = written(classes.join(queries.select("class").distinct(), "class", "left_semi"), "asked")
    # A class of more than ``count`` members answers its queries alone.
    short = asked.filter(F.size("ids") <= count).select(F.col("rep").alias("q"))
    found = search(graph, single, single.join(short, F.col("id") == F.col("q"), "left_semi").select(F.col("id").alias("q"), "raw"))
    # Scores of the best few are taken again, exactly.
    pairs = found.select("q", F.explode(F.slice("near", 1, 4 * count)).alias("id"))
    ends = pairs.join(rows, "id").join(rows.select(F.col("id").alias("q"), F.col("vec").alias("own")), "q")
    score = F.sqrt(F.aggregate(F.zip_with("vec", "own", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    scored = ends.select("q", "id", score.alias("score")).join(classes.select(F.col("rep").alias("id"), "ids"), "id")
    as_found = lambda score: F.transform("ids", lambda x: F.struct(score.alias("score"), x.alias("id")))
    others = scored.select("q", as_found(F.col("score")).alias("x")).groupBy("q").agg(F.flatten(F.collect_list("x")).alias("others"))
    best = asked.join(others, F.col("rep") == F.col("q"), "left").select("class", F.concat(as_found(F.lit(0.0)), F.coalesce("others", F.array())).alias("x"))
    best = best.select("class", F.slice(F.sort_array("x"), 1, count + 1).alias("x"))
    answers = queries.join(best, "class").select("query_id", F.posexplode(F.slice(F.filter("x", lambda x: x["id"] != F.col("query_id")), 1, count)).alias("at", "x"))
    return answers.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
