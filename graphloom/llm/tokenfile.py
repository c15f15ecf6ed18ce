"""Token-id files: documents in ascending id order, range-coded blocks, read back with checks.

A file holds frames, each followed by a mark. A frame is one batch of whole
documents: a header, the table of documents (id, number of ids) and the payload of
``TokenCoder``: blocks that can each be decoded alone. Frames are cut by characters
and files by frames, so neither grows with the data. Files are written by Spark's
committer, so a lost or repeated task leaves no half file, and they are found and
read by Spark's readers, wherever the folder lies.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import scratch_path, written
from graphloom.llm.rangecoder import decode_ids, encode_ids
from graphloom.llm.tokens import binary_column, shared_encoder, slices

MAGIC, MARK = b"GLTOKEN2", "\n--frame--\n"
#: Magic, shard, frame, documents, ids before it in its shard, bytes and checksum of the table.
HEADER = struct.Struct("<8sIIQQQI")
END = 2
#: Bytes of text per frame, a longer document is a frame of its own; frames per file.
FRAME, FRAMES = 2_000_000, 64
_FRAME_SQL = "head binary, ids binary"


def head_of(shard: int, number: int, before: int, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """Header and table of a frame; a null document id has a flag of its own."""
    null = np.array([d is None for d in doc_ids], "u1")
    table = zlib.compress(b"".join([null.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), lengths.astype("<u8").tobytes()]))
    return HEADER.pack(MAGIC, shard, number, len(doc_ids), before, len(table), zlib.crc32(table)) + table


def table_of(head: bytes) -> tuple[int, int, int, list[int | None], np.ndarray]:
    """(shard, frame, ids before it, document ids, lengths); damage raises ValueError."""
    _, shard, number, n, before, _, crc = HEADER.unpack_from(head)
    if zlib.crc32(packed := head[HEADER.size :]) != crc:
        raise ValueError("damaged table")
    raw = zlib.decompress(packed)
    null, docs, lengths = np.frombuffer(raw, "u1", n), np.frombuffer(raw, "<i8", n, n), np.frombuffer(raw, "<u8", n, 9 * n)
    return shard, number, before, [None if k else d for k, d in zip(null.tolist(), docs.tolist(), strict=True)], lengths.astype(np.int64)


def frames_of(content: bytes | memoryview) -> Iterator[tuple[bytes, bytes]]:
    """(header with table, payload) of each frame of a file; damage raises ValueError."""
    view, at, mark = memoryview(content), 0, MARK.encode()
    while at < len(view):
        if len(view) - at < HEADER.size:
            raise ValueError("truncated frame")
        magic, *_, size, _ = HEADER.unpack_from(view, at)
        if magic != MAGIC:
            raise ValueError("not a token file")
        body = at + HEADER.size + size
        if len(view) - body < 4:
            raise ValueError("truncated frame")
        end = body + int.from_bytes(view[body : body + 4], "little")
        if end <= body or bytes(view[end : end + len(mark)]) != mark:
            raise ValueError("damaged frame")
        yield bytes(view[at:body]), bytes(view[body:end])
        at = end + len(mark)


def tokens_of_documents(tokenizer_path: str, end_id: int, frame_bytes: int):
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, number, before = shared_encoder(tokenizer_path), TaskContext.get().partitionId(), 0, 0
        names, lengths, ids, size = [], [], [], 0

        def frame() -> pa.RecordBatch:
            nonlocal names, lengths, ids, size, number, before
            flat, n = np.concatenate(ids), np.concatenate(lengths)
            head = head_of(shard, number, before, names, n)
            number, before, names, lengths, ids, size = number + 1, before + len(flat), [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([head], pa.binary()), binary_column(flat, np.array([len(flat)]))], names=["head", "ids"])

        for part in parts:
            for at, to in slices(part.column(1), frame_bytes):
                texts = part.column(1).slice(at, to - at)
                coded, n = encoder.encode_ending(texts, end_id)
                names += part.column(0).slice(at, to - at).to_pylist()
                lengths.append(n)
                ids.append(coded)
                size += texts.nbytes
                if size >= frame_bytes // 2:
                    yield frame()
        if names:
            yield frame()

    return run


def write_tokens(df: DataFrame, path: str, tokenizer_path: str, id_column: str = "doc_id", text: str = "text", end_id: int = END, frame_bytes: int = FRAME) -> None:
    """Writes every row's ids and ``end_id``, rows in ascending id order over the files (nulls first, equal ids in input order).

    A null or empty text is its end id alone. Equal ids don't crowd one task: the
    order among them is part of the range key. An empty table gives no files with frames.
    """
    rows = df.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("nth"))
    ranged = rows.repartitionByRange("doc_id", "nth").sortWithinPartitions("doc_id", "nth")
    frames = ranged.select("doc_id", "text").mapInArrow(tokens_of_documents(tokenizer_path, end_id, frame_bytes), _FRAME_SQL)
    # Spark's text writer puts bytes down as they are, each row with the mark behind it.
    framed = F.concat(F.col("head"), encode_ids(df.sparkSession, "ids")).cast("string")
    frames.select(framed.alias("value")).write.option("lineSep", MARK).option("maxRecordsPerFile", FRAMES).text(path)


def _split(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for content in part.column(0):
            for head, payload in frames_of(content.as_buffer()):
                yield pa.RecordBatch.from_arrays([pa.array([head], pa.binary()), pa.array([payload], pa.binary())], names=["head", "payload"])


_READ_SQL = "shard int, frame int, row int, doc_id bigint, before bigint, n_tokens bigint, ids binary"


def _documents(keep_ids: bool):
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for head, raw in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                shard, number, before, docs, lengths = table_of(head)
                ids = np.frombuffer(raw.as_buffer(), "<u4")
                if len(ids) != int(lengths.sum()):
                    raise ValueError("damaged frame")
                ends = np.cumsum(lengths)
                columns = {
                    "shard": pa.array([shard] * len(docs), pa.int32()), "frame": pa.array([number] * len(docs), pa.int32()), "row": pa.array(range(len(docs)), pa.int32()),
                    "doc_id": pa.array(docs, pa.int64()), "before": pa.array(before + ends - lengths), "n_tokens": pa.array(lengths),
                }
                if keep_ids:
                    columns["ids"] = binary_column(ids, ends)
                else:
                    columns["ids_crc32"] = pa.array([zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)], pa.int64())
                yield pa.RecordBatch.from_pydict(columns)

    return run


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """Per document of the files: shard, frame, row, doc_id, before (ids before it in its shard), n_tokens, and ids or ids_crc32."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").select("content")
    frames = files.mapInArrow(_split, "head binary, payload binary").select("head", decode_ids(spark, "payload").alias("ids"))
    return frames.mapInArrow(_documents(keep_ids), _READ_SQL if keep_ids else _READ_SQL.replace("ids binary", "ids_crc32 bigint"))


def op1_documents(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes the files, reads them back; starts are sums over shards, never over rows."""
    spark = documents.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(documents, path, tokenizer_path)
    seen = written(read_tokens(spark, path, keep_ids=False), "read_back")
    shards = seen.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # A row per shard: as many as the write had tasks.
    first = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("first"))
    return seen.join(F.broadcast(first), "shard").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "shard", "frame", "row")
