"""MinHash near-duplicates with odd sketches.

1. Every document gets the set of its word shingles (64-bit hashes), MinHash
   values, a key per band, and an odd sketch: the parity bitmap of its (position,
   MinHash value) pairs. Equal sets form classes; one representative goes on.
2. In every band bucket all members are compared with one pivot, on full sets:
   linear in the bucket. The links give first components.
3. What is left are pairs of different components in a bucket. Buckets are cut
   into blocks; the XOR population counts of two blocks' sketches leave the pairs
   that may reach the similarity, each in the first band that holds it, and those
   are confirmed on full sets in the block. No pair becomes a row.
4. Components of all links; class members follow their representative.

24 bands of 5 values (from a similarity of 0.85), or 30 of 4, miss a pair at the
similarity itself with probability 1e-6. The sketch filter misses one with 6e-8 at
0.85 and 1e-6 at 0.80 (computed from its distribution). Both vanish above it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint, written
from graphloom.llm.components import connected

VALUES, SKETCH_BITS = 120, 512
#: Sketch estimates that are lower than the similarity by more are taken as dissimilar: as rarely wrong as the bands.
SLACK = 0.22
BLOCK = 1024
_U = np.uint64


def shingle_set(text: str | None, size: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; A-Z lower-cased, ASCII white space between words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, _U)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    mixed = np.zeros(len(words) - size + 1, _U)
    for k in range(size):  # the order of words counts
        mixed = (mixed ^ h[k : k + len(mixed)]) * _U(0x9E3779B97F4A7C15)
        mixed ^= mixed >> _U(29)
    return np.unique(mixed)


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    k = VALUES
    return rng.integers(1, 1 << 63, k, dtype=_U) * _U(2) + _U(1), rng.integers(0, 1 << 63, k, dtype=_U)


def minhashes(shingles: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    best = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(shingles), 2048):  # a slice stays in cache
        x = shingles[at : at + 2048]
        np.minimum(best, ((x[:, None] * a + c) >> _U(32)).astype(np.uint32).min(axis=0), out=best)
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def bands_for(percent: int) -> int:
    return 24 if percent >= 85 else 30


def band_keys(values: np.ndarray, bands: int) -> np.ndarray:
    rows, keys = values.reshape(bands, -1).astype(_U), np.arange(1, bands + 1, dtype=_U)
    for k in range(rows.shape[1]):
        keys = _mix(keys * _U(0x9E3779B97F4A7C15) + rows[:, k])
    return keys


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """Bits that an odd number of (position, value) pairs hash to."""
    at = _mix(values.astype(_U) | (np.arange(len(values), dtype=_U) << _U(32))) % _U(SKETCH_BITS)
    odd = (np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(_U)


def estimate(differing_bits: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the population count of two sketches' XOR."""
    inside = np.maximum(1 - 2 * differing_bits / SKETCH_BITS, 1e-9)
    return 1 + SKETCH_BITS / (4 * VALUES) * np.log(inside)


_FEATURES = "doc_id bigint, n_shingles bigint, class binary, keys binary, sketch binary"


def _features(size: int, bands: int):
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        a, c = _constants()
        for part in parts:
            counts, classes, keys, sketches = [], [], [], []
            for text in part.column(1):
                s = shingle_set(text.as_py(), size)
                counts.append(len(s))
                if len(s):
                    values = minhashes(s, a, c)
                    classes.append(xxhash.xxh3_128_digest(s.tobytes()))
                    keys.append(band_keys(values, bands).tobytes())
                    sketches.append(odd_sketch(values).tobytes())
                else:
                    classes.append(None), keys.append(None), sketches.append(None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), *(pa.array(x, pa.binary()) for x in (classes, keys, sketches))], names=["doc_id", "n_shingles", "class", "keys", "sketch"])

    return run


def _sets(size: int):
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 256):
                some = part.slice(at, 256)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([shingle_set(t.as_py(), size).tobytes() for t in some.column(1)], pa.binary())], names=["rep", "shingles"])

    return run


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    """Rows (a, b, x, y) with both sets -> linked (a, b)."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ok = [_alike(np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U), percent) for x, y in zip(part.column(2), part.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(part.select([0, 1]).columns, names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


_BLOCK_KEY = ["band", "key", "i", "j"]
_PAIRS = "band int, key bigint, i int, j int, xs array<bigint>, ys array<bigint>"


def _screen(least: float, bands: int):
    """Members of one block pair -> one row with the pairs whose sketches allow the similarity."""

    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        band, i, j = (table.column(c)[0].as_py() for c in ("band", "i", "j"))
        rep, comp, block = (table.column(c).to_numpy() for c in ("rep", "component", "block"))
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), _U).reshape(n, bands)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), _U).reshape(n, -1)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        xs, ys = [], []
        for at in range(0, len(left), 128):
            rows = left[at : at + 128]
            bits = np.zeros((len(rows), len(right)), np.int64)
            for w in range(sketch.shape[1]):
                bits += np.bitwise_count(sketch[rows, w][:, None] ^ sketch[right, w][None, :])
            ok = (estimate(bits) >= least) & (comp[rows][:, None] != comp[right][None, :])
            if i == j:
                ok &= rep[rows][:, None] < rep[right][None, :]
            p, q = np.nonzero(ok)
            p, q = rows[p], right[q]
            first = (keys[p, :band] != keys[q, :band]).all(axis=1)  # no earlier band holds the pair
            xs.append(rep[p[first]]), ys.append(rep[q[first]])
        xs, ys = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys))
        one = table.slice(0, 1 if len(xs) else 0)
        return pa.table({**{c: one.column(c) for c in _BLOCK_KEY}, "xs": pa.array([xs] * one.num_rows, pa.list_(pa.int64())), "ys": pa.array([ys] * one.num_rows, pa.list_(pa.int64()))})

    return run


def _settle(percent: int):
    """One block's pairs and its members' sets -> links, as many as join the block's components."""

    def run(pairs: pa.Table, members: pa.Table) -> pa.Table:
        held = {r: np.frombuffer(s, _U) for r, s in zip(members.column("rep").to_pylist(), members.column("shingles").to_pylist(), strict=True)}
        top: dict[int, int] = {r: r for r in held}

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        out = ([], [])
        for xs, ys in zip(pairs.column("xs"), pairs.column("ys"), strict=True):
            xs, ys = xs.values.to_numpy(), ys.values.to_numpy()
            order = np.argsort(xs, kind="stable")
            xs, ys = xs[order], ys[order]
            for x, at, n in zip(*np.unique(xs, return_index=True, return_counts=True), strict=True):
                own, partners = held[int(x)], ys[at : at + n].tolist()
                sizes = np.array([len(held[y]) for y in partners])
                # Whole-set counts of one document against all its partners at once.
                whole = np.concatenate([held[y] for y in partners])
                spot = np.minimum(np.searchsorted(own, whole), len(own) - 1)
                both = np.add.reduceat((own[spot] == whole).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                for y in np.flatnonzero(100 * both >= percent * (len(own) + sizes - both)).tolist():
                    u, v = find(int(x)), find(partners[y])
                    if u != v:
                        top[u] = v
                        out[0].append(int(x)), out[1].append(partners[y])
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per input row; links are pairs with Jaccard similarity of at least ``percent`` / 100.

    Documents without words (null and empty texts too) have no shingles and are
    their own components. Rows that share an id are one document. Rows with a null
    id take no part: component null, kept.
    """
    bands = bands_for(percent)
    docs = df.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    seen = written(docs.mapInArrow(_features(size, bands), _FEATURES), "features")
    real = seen.filter("class is not null and doc_id is not null")
    reps = written(real.groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "classes")
    # Band keys, eight bytes each, out of the binary column.
    key = lambda b: F.conv(F.hex(F.substring("keys", 8 * b + 1, 8)), 16, -10).cast("bigint")
    members = reps.select("rep", F.posexplode(F.array(*[key(b) for b in range(bands)])).alias("band", "key"))
    buckets = members.groupBy("band", "key").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("rep", "band").alias("h"), F.col("rep").alias("pivot"))).alias("p")).filter("m > 1")
    crowded = written(members.join(buckets.select("band", "key", "m", "p.pivot"), ["band", "key"]), "crowded")
    stars = crowded.filter("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    needed = crowded.select(F.col("rep").alias("doc_id")).distinct()
    sets = written(docs.join(needed, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_sets(size), "rep bigint, shingles binary"), "sets")
    pairs = stars.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
    links = written(pairs.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a bigint, b bigint"), "links")
    first = connected(links)
    # Buckets that still hold several components. The largest component's members need no partners among themselves:
    # the others are cut into blocks that meet each other and its blocks, so one stranger in a large bucket costs it one row a member.
    placed = crowded.select("band", "key", "m", "rep").join(first.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    parts = placed.groupBy("band", "key", "component").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("band", "key").agg(F.count("*").alias("parts"), F.max(F.struct("n", F.col("component").alias("main"))).alias("top")).filter("parts > 1").select("band", "key", "top.n", "top.main")
    own, theirs = F.ceil((F.col("m") - F.col("n")) / BLOCK).cast("int"), F.ceil(F.col("n") / BLOCK).cast("int")
    rows = placed.join(mixed, ["band", "key"]).withColumns({"inside": F.col("component") == F.col("main"), "own": own, "theirs": theirs})
    block = F.when(F.col("inside"), F.col("own") + F.pmod(F.xxhash64("rep"), F.col("theirs"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("own"))).cast("int")
    rows = rows.withColumn("block", block).join(reps.select("rep", "keys", "sketch"), "rep")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("inside"), F.col("own")).otherwise(F.col("own") + F.col("theirs")) - 1)))
    rows = rows.select("band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "component", "keys", "sketch")
    # Work goes with the square of a block, bytes don't: tasks are not to be joined by bytes.
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *_BLOCK_KEY)
    open_pairs = written(rows.groupBy(*_BLOCK_KEY).applyInArrow(_screen(percent / 100 - SLACK, bands), _PAIRS), "pairs")
    wanted = open_pairs.select(*[F.col(c).alias(f"_{c}") for c in _BLOCK_KEY], F.explode(F.array_distinct(F.concat("xs", "ys"))).alias("rep")).join(sets, "rep")
    more = open_pairs.groupBy(*_BLOCK_KEY).cogroup(wanted.groupBy(*[f"_{c}" for c in _BLOCK_KEY])).applyInArrow(_settle(percent), "a bigint, b bigint")
    # Only what joins first components is left to connect; their members follow.
    label = lambda side: F.coalesce(F.col(f"{side}_c"), F.col(side))
    lifted = written(more, "more_links")
    for side in ("a", "b"):
        lifted = lifted.join(first.select(F.col("id").alias(f"{side}_id"), F.col("component").alias(f"{side}_c")), F.col(side) == F.col(f"{side}_id"), "left")
    second = connected(lifted.select(label("a").alias("a"), label("b").alias("b"))).select(F.col("id").alias("own"), F.col("component").alias("joined"))
    home = reps.select("class", "rep").join(first.withColumnRenamed("id", "rep"), "rep", "left").withColumn("own", F.coalesce("component", "rep"))
    home = home.join(second, "own", "left").select("class", F.coalesce("joined", "own").alias("component_id"))
    # Copies follow their class; the class of a hot group is split by adaptive execution.
    out = seen.select("doc_id", "n_shingles", "class").join(home, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


#: Ids of dropped documents that every executor may hold, at 8 bytes each; beyond that the join is shuffled.
BROADCAST_IDS = 4_000_000


def keep_one(df: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The input rows without all but the first document of every group, all columns kept."""
    gone = checkpoint(near_duplicates(df, id_column, text, size, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    # The column of that frame, whatever the input's own columns are called.
    return df.join(gone, df[id_column] == gone["_gone"], "left_anti")
