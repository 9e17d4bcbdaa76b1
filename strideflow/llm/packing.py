"""Packing token ids: concatenate all documents and cut at fixed lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, mapped, starts_of_parts, steps, store
from .tokens import encoder

LENGTH = 4096
#: Ids in one stored row; a longer document is stored as several rows.
ROW_IDS = 16 * LENGTH
_TOKENS = "part int, before long, doc_id long, start long, n long, doc_tokens long, ids binary"


def token_rows(documents: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Ids of every document in rows of at most ``ROW_IDS``, with the running count inside the task."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, before = encoder(tokenizer_path, True, end_id), TaskContext.get().partitionId(), 0
        for batch in steps(batches, "text"):
            ids, bounds = coder.encode(batch.column(1))
            sizes = np.diff(bounds)
            rows = -(-sizes // ROW_IDS)
            owner = np.repeat(np.arange(len(sizes)), rows)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows)
            start = piece * ROW_IDS
            n = np.minimum(sizes[owner] - start, ROW_IDS)
            edges = np.concatenate([[0], np.cumsum(n)]) * 4
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(edges), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(n), part, np.int32)), pa.array(before + edges[:-1] // 4), batch.column(0).take(pa.array(owner)),
                    pa.array(start), pa.array(n), pa.array(sizes[owner]), data.cast(pa.binary()),
                ],
                ["part", "before", "doc_id", "start", "n", "doc_tokens", "ids"],
            )
            before += len(ids)

    return mapped(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), encode, _TOKENS)


def pack(documents: DataFrame, tokenizer_path: str, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """Cut the ids of all documents, laid end to end, into sequences of ``length`` ids.

    Pass one encodes every document once into a table and keeps the running count inside each task.  Pass
    two adds the totals of the tasks before and cuts each row at the multiples of ``length``, so only the
    last sequence can be short: it is padded to ``length`` unless its own length is a power of two
    (``padded_length``).  Nothing is sorted and no document is held by more than one task.

    One row per piece: ``doc_id``, ``start`` (ids of its document before it), ``length``, ``ids``
    (little-endian unsigned 32-bit), ``doc_tokens`` (with the end id), ``sequence_id``, ``offset`` and
    ``padded_length``.  A null or empty text is its end id alone.  Equal rows and null doc_ids are
    separate documents.  An empty table gives no rows; other columns are not read.
    """
    table = store(token_rows(documents, tokenizer_path, end_id), "pack-ids")
    bases = starts_of_parts(table, "n")
    total = table.agg(F.sum("n")).first()[0] or 0
    tail = total % length
    short = tail if tail & (tail - 1) == 0 else length
    at = F.col("base") + F.col("before")
    cut = table.join(bounded(bases), "part").select(
        "doc_id", "start", "n", "doc_tokens", "ids", at.alias("at"),
        F.explode(F.sequence(F.expr(f"(base + before) div {length}"), F.expr(f"(base + before + n - 1) div {length}"))).alias("sequence_id"),
    )
    low = F.greatest(F.col("at"), F.col("sequence_id") * length)
    high = F.least(F.col("at") + F.col("n"), (F.col("sequence_id") + 1) * length)
    skip = (low - F.col("at")).cast("int")
    return cut.select(
        "doc_id", (F.col("start") + low - F.col("at")).alias("start"), (high - low).alias("length"),
        F.substring("ids", skip * 4 + 1, (high - low).cast("int") * 4).alias("ids"), "doc_tokens", "sequence_id",
        (low - F.col("sequence_id") * length).alias("offset"),
        F.when(F.col("sequence_id") == total // length, short).otherwise(length).cast("int").alias("padded_length"),
    )
