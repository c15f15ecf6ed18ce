"""Byte-level BPE through a global shuffle of distinct words.

Each chunk of documents is exploded into pre-tokens: a list of its distinct words
and, per document, the words' positions as indices into that list. The words are
shuffled by hash bucket, so every distinct word of the whole input is encoded
once, where all chunks' copies meet; the ids are joined back to their chunk, and
documents are put together by position. Decoding joins the token-byte table,
whose size is the vocabulary's.

A chunk sends the words of one bucket as one compressed block: what is shuffled is
a few bytes per chunk and distinct word, and less than two per pre-token. A
frequent word comes once per chunk, a group of copies adds positions only, so
neither can fill a task. There are as many buckets as shuffle partitions, or as the input's size asks for.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import written

#: Bytes of text per chunk; a longer document is a chunk of its own.
CHUNK = 36_000_000
#: Bytes of input, as they lie on disk, per bucket of distinct words.
BUCKET = 16_000_000
_PARTS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("block", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64()))])
_PARTS_SQL = "chunk bigint, bucket int, block binary, doc_ids array<bigint>, n_words array<bigint>"
_CODED_SQL = "chunk bigint, bucket int, block binary"


def _pack(raw: bytes) -> bytes:
    """Long windows, so that copies of a document within a chunk cost next to nothing."""
    return zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(9, window_log=25, enable_ldm=True)).compress(raw)


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers as one compressed block, byte plane by byte plane."""
    planes = [np.array([len(arrays), *map(len, arrays)], "<u8").tobytes()]
    for a in arrays:
        planes.append(np.ascontiguousarray(a.astype("<u4").view("u1").reshape(-1, 4).T).tobytes())
    return _pack(b"".join(planes))


def _expand(block: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), "u1")
    n = int(raw[:8].view("<u8")[0])
    sizes, at, out = raw[8 : 8 + 8 * n].view("<u8"), 8 + 8 * n, []
    for size in map(int, sizes):
        out.append(np.ascontiguousarray(raw[at : at + 4 * size].reshape(4, size).T).view("<u4").ravel())
        at += 4 * size
    return out


@cache
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@cache
def encoding_of(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})


@cache
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: bytes by id."""
    ranks = ranks_of(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def explode_words(pattern: str, buckets: int, chunk_chars: int):
    """Documents -> per chunk one row of positions (bucket null), and a row of words for each bucket."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        from graphloom.llm import tokens

        split, chunk, cuttable = regex.compile(pattern).findall, TaskContext.get().partitionId() << 32, pattern == tokens.PATTERN
        for part in parts:
            ids = part.column(0).to_pylist()
            for first, last in tokens.slices(part.column(1), chunk_chars):
                # Pieces between sure boundaries repeat: only distinct ones are split.
                which, pieces, before = tokens.distinct_pieces(part.column(1).slice(first, last - first), cuttable)
                words: dict[str, int] = {}
                place = words.setdefault
                split_pieces = [np.array([place(w, len(words)) for w in split(p.decode())], "<u4").tobytes() for p in pieces]
                positions, n_words = tokens.laid_out(which, before, split_pieces)
                del pieces, split_pieces, which
                # Frequent words first: their indices have zero high bytes.
                by_use = np.argsort(-np.bincount(positions, minlength=len(words)), kind="stable")
                rank = np.empty(len(words), "<u4")
                rank[by_use] = np.arange(len(words))
                listed = [w.encode() for w in words]
                coded = [listed[k] for k in by_use]
                positions = rank[positions]
                bucket = np.fromiter((zlib.crc32(w) % buckets for w in coded), "<u4", len(coded))
                rows = [(chunk, None, _squeeze(bucket, positions), ids[first:last], n_words.tolist())]
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in range(buckets):
                    if edges[b] < edges[b + 1]:
                        some = [coded[k] for k in order[edges[b] : edges[b + 1]]]
                        block = np.array([len(some), *map(len, some)], "<u4").tobytes() + b"".join(some)
                        rows.append((chunk, b, _pack(block), None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PARTS, strict=True)], schema=_PARTS)
                chunk += 1

    return run


def encode_bucket(path: str, pattern: str):
    """All chunks' words of one bucket -> their ids; a distinct word is encoded once."""

    def run(table: pa.Table) -> pa.Table:
        single, memo = encoding_of(path, pattern)._core_bpe.encode_single_piece, {}
        out = []
        for block in table.column("block"):
            raw = zstandard.ZstdDecompressor().decompress(block.as_py())
            n = int.from_bytes(raw[:4], "little")
            lengths, at, ids, counts = np.frombuffer(raw, "<u4", n, 4).tolist(), 4 + 4 * n, [], []
            for length in lengths:
                word = raw[at : at + length]
                at += length
                found = memo.get(word)
                if found is None:
                    found = memo[word] = single(word)
                ids += found
                counts.append(len(found))
            out.append(_squeeze(np.array(counts, "<u4"), np.array(ids, "<u4")))
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "block": pa.array(out, pa.binary())})

    return run


def assemble(path: str, slice_tokens: int = 2_000_000):
    """Of one chunk its positions and its words' ids: (doc_id, ids, decoded) per document."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        ids_out, bytes_out, doc_ids = [], [], []
        look = token_bytes(path).__getitem__
        blocks = dict(zip(words.column("bucket").to_pylist(), words.column("block").to_pylist(), strict=True))
        for block, names, n_words in zip(*(docs.column(c).to_pylist() for c in ("block", "doc_ids", "n_words")), strict=True):
            bucket, positions = _expand(block)
            coded = [_expand(blocks[b]) for b in np.unique(bucket).tolist()]
            flat = np.concatenate([c[1] for c in coded]) if coded else np.zeros(0, "<u4")
            order = np.argsort(bucket, kind="stable")
            counts = np.zeros(len(bucket), np.int64)
            if coded:
                counts[order] = np.concatenate([c[0] for c in coded])
            starts = np.zeros(len(bucket), np.int64)
            starts[order] = np.cumsum(counts[order]) - counts[order]
            edges = np.concatenate([[0], np.cumsum(np.array(n_words, np.int64))])
            first = 0
            while first < len(n_words):  # slices of whole documents bound the index arrays
                last = max(first + 1, int(np.searchsorted(edges, edges[first] + slice_tokens)) - 1)
                at = positions[edges[first] : edges[last]]
                c = counts[at]
                ends = np.cumsum(c)
                ids = flat[np.repeat(starts[at] - (ends - c), c) + np.arange(int(ends[-1]) if len(ends) else 0)]
                whole = np.concatenate([[0], ends])[edges[first : last + 1] - edges[first]]
                for k in range(last - first):
                    own = ids[whole[k] : whole[k + 1]]
                    ids_out.append(own.tobytes())
                    bytes_out.append(b"".join(map(look, own.tolist())))
                first = last
            doc_ids += names
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(ids_out, pa.binary()), "decoded": pa.array(bytes_out, pa.binary())})

    return run


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK) -> DataFrame:
    """One row per input row: doc_id, ids (little-endian unsigned 32-bit), decoded (bytes).

    A null or empty text has no ids; repeated rows come out as often as they went
    in. The exploded chunks are written before the shuffle, so a lost executor
    can't renumber them.
    """
    # The plan's own estimate of the input's bytes: no pass over the texts. Without one it is huge, and the partitions decide.
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    buckets = max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET) if size < 1 << 60 else 0)
    docs = df.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    parts = written(docs.mapInArrow(explode_words(pattern, buckets, chunk_chars), _PARTS_SQL), "words")
    words = parts.filter(F.col("bucket").isNotNull()).select("chunk", "bucket", "block")
    coded = words.groupBy("bucket").applyInArrow(encode_bucket(ranks_path, pattern), _CODED_SQL)
    chunks = parts.filter(F.col("bucket").isNull()).select("chunk", "block", "doc_ids", "n_words")
    return chunks.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(assemble(ranks_path), "doc_id bigint, ids binary, decoded binary")


def op3_documents(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    out = encode_decode(documents, ranks_path, pattern)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
