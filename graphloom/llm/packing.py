"""Packing by power-of-two decomposition.

A document of n ids (its end id included) is cut into pieces of the binary
lengths of n, whole sequences of ``limit`` first. Pieces of equal length fill the
bucket of that length; each is a sequence of its own, so no sequence crosses
documents and none is padded. A batch takes sequences of one bucket.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint, written
from graphloom.llm.tokens import binary_column, shared_encoder, slices

END = 0
#: Of 20 bytes each; beyond that the numbering is a shuffled join.
BROADCAST_ROWS = 500_000
PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, task int, nth bigint"


def pieces_of(n: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(document's index, length) of the pieces of documents of n ids, in order: as many of ``limit`` as fit, then the binary digits of the rest."""
    every, whole, rest = np.arange(len(n)), n // limit, n % limit
    bits = np.arange(limit.bit_length() - 2, -1, -1)
    # Row by row, so a document's digits stand together, the highest first.
    owner, bit = np.nonzero(rest[:, None] >> bits & 1)
    doc = np.concatenate([np.repeat(every, whole), owner])
    length = np.concatenate([np.full(int(whole.sum()), limit, np.int64), np.int64(1) << bits[bit]])
    order = np.argsort(doc, kind="stable")
    return doc[order], length[order]


def cut_documents(tokenizer_path: str, limit: int, end_id: int):
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = shared_encoder(tokenizer_path), TaskContext.get().partitionId(), Counter()
        for part in parts:
            names, texts = part.column(0), part.column(1)
            for at, to in slices(texts):
                ids, n = encoder.encode_ending(texts.slice(at, to - at), end_id)
                doc, length = pieces_of(n, limit)
                ends = np.cumsum(length)
                nth = np.empty(len(length), np.int64)
                for value, count in zip(*np.unique(length, return_counts=True), strict=True):
                    nth[length == value] = np.arange(seen[value], seen[value] + count)
                    seen[value] += count
                columns = {
                    "doc_id": names.slice(at, to - at).take(pa.array(doc)), "start": pa.array(ends - length - (np.cumsum(n) - n)[doc]), "length": pa.array(length), "doc_tokens": pa.array(n[doc]),
                    "ids": binary_column(ids, ends), "task": pa.array(np.full(len(doc), task, np.int32)), "nth": pa.array(nth),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return run


def pack(df: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text: str = "text", limit: int = 1024, end_id: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), sequence_id, offset.

    Each piece is one sequence of its length; sequence ids run from 0, longest
    bucket first, and within a bucket in input order. A null or empty text is its
    end id alone; repeated rows are packed each. Documents are encoded once: the
    pieces are written before they are numbered.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    docs = df.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    pieces = written(docs.mapInArrow(cut_documents(tokenizer_path, limit, end_id), PIECES), "pieces")
    # A count per task and length: numbering needs sums over tasks, never over rows.
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).drop("n")
    totals = pieces.groupBy("length").agg(F.count("*").alias("n"))
    # One row per power of two up to the limit.
    base = totals.withColumn("base", F.sum("n").over(Window.orderBy(F.desc("length"))) - F.col("n")).drop("n")
    firsts = checkpoint(before.join(F.broadcast(base), "length").select("length", "task", (F.col("base") + F.col("before")).alias("first")))
    # Without a shuffle of ids while the table of firsts (a row per task and length) is small.
    small = firsts.count() <= BROADCAST_ROWS
    numbered = pieces.join(F.broadcast(firsts) if small else firsts, ["length", "task"])
    return numbered.select("doc_id", "start", "length", "doc_tokens", "ids", (F.col("first") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))


def op10_documents(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    out = pack(documents, tokenizer_path)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
