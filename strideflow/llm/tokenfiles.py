"""Token files: ids of all documents in ascending doc_id order, in range-coded blocks that stand alone."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rangecoder
from .common import bounded, mapped, starts_of_parts, steps
from .tokens import encoder

#: Stands between blocks; a block that would hold it is written under a mask.
MARK = "\n--token-block-1--\n"
#: part, ids before the block in its part, ids, documents, ids of the first document before the block,
#: whether the last document goes on (1) or ends here (0), vocabulary, lanes, bytes of the document table, crc32 of the ids, crc32 of the rest of the body
_HEAD = "<qqqqqqqqqII"
_HEAD_BYTES = struct.calcsize(_HEAD)
_PIECES = "part int, before long, doc_id long, skipped long, whole boolean, n_tokens long, ids binary"


class CorruptBlock(ValueError):
    """A block whose checksum does not fit its content."""


def pack_block(part: int, before: int, skipped: int, goes_on: bool, doc_ids: list, counts: np.ndarray, ids: np.ndarray, vocabulary: int) -> bytes:
    """One block: mask byte, header, document table, words a lane, words."""
    words, used = rangecoder.encode(ids, vocabulary)
    null = np.array([d is None for d in doc_ids], np.uint8)
    table = zlib.compress(null.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + counts.astype("<i8").tobytes(), 1)
    body = table + used.astype("<u4").tobytes() + words.astype("<u2").tobytes()
    head = struct.pack(_HEAD, part, before, len(ids), len(doc_ids), skipped, int(goes_on), vocabulary, len(used), len(table), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body))
    plain = np.frombuffer(head + body, np.uint8)
    for mask in range(256):
        block = bytes([mask]) + (plain ^ np.uint8(mask)).tobytes()
        if MARK.encode() not in block and not block.endswith(MARK[:1].encode()):
            return block
    raise ValueError("no mask hides the mark")


def block_head(block: bytes) -> tuple:
    plain = (np.frombuffer(block[1 : 1 + _HEAD_BYTES], np.uint8) ^ np.uint8(block[0])).tobytes()
    return struct.unpack(_HEAD, plain)


def unpack_block(block: bytes) -> tuple[int, int, int, bool, list, np.ndarray, np.ndarray]:
    """part, before, skipped, goes_on, doc_ids, counts and ids of a block; raises :class:`CorruptBlock`."""
    if len(block) <= _HEAD_BYTES:
        raise CorruptBlock("short block")
    plain = (np.frombuffer(block[1:], np.uint8) ^ np.uint8(block[0])).tobytes()
    part, before, n, docs, skipped, goes_on, vocabulary, lanes, table_size, ids_crc, body_crc = struct.unpack_from(_HEAD, plain)
    body = plain[_HEAD_BYTES :]
    if zlib.crc32(body) != body_crc:
        raise CorruptBlock("checksum of the block")
    table = zlib.decompress(body[:table_size])
    null, known, counts = np.frombuffer(table, np.uint8, docs), np.frombuffer(table, "<i8", docs, docs), np.frombuffer(table, "<i8", docs, 9 * docs)
    used = np.frombuffer(body, "<u4", lanes, table_size).astype(np.int64)
    ids = rangecoder.decode(np.frombuffer(body, "<u2", -1, table_size + 4 * lanes), used, n, vocabulary).astype("<u4")
    if zlib.crc32(ids.tobytes()) != ids_crc:
        raise CorruptBlock("checksum of the ids")
    return part, before, skipped, bool(goes_on), [None if z else int(d) for z, d in zip(null, known)], counts, ids


class _Blocks:
    """Collects documents and gives out full blocks."""

    def __init__(self, part: int, vocabulary: int):
        self.part, self.vocabulary, self.before, self.held = part, vocabulary, 0, 0
        self.docs: list[tuple[int | None, int, np.ndarray]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[bytes]:
        first = 0
        while first < len(ids):
            take = min(len(ids) - first, rangecoder.BLOCK - self.held)
            self.docs.append((doc_id, first, ids[first : first + take]))
            self.held += take
            first += take
            if self.held == rangecoder.BLOCK:
                yield self.close(first < len(ids))

    def close(self, goes_on: bool = False) -> bytes:
        ids = np.concatenate([d[2] for d in self.docs]).astype(np.int64)
        counts = np.array([len(d[2]) for d in self.docs])
        block = pack_block(self.part, self.before, self.docs[0][1], goes_on, [d[0] for d in self.docs], counts, ids, self.vocabulary)
        self.before += len(ids)
        self.docs, self.held = [], 0
        return block


def write_tokens(documents: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Encode the whole text of every row of (doc_id, text), add ``end_id`` to each and write files of blocks.

    Rows are range-sorted by doc_id (null first, rows that repeat an id by text), one file a task.  A block
    holds at most ``rangecoder.BLOCK`` ids; a longer document goes over several.  Null text is empty.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path, False, end_id)
        blocks = _Blocks(TaskContext.get().partitionId(), coder.tokenizer.get_vocab_size())
        for batch in steps(batches, "text"):
            ids, bounds = coder.encode(batch.column(1))
            for doc_id, first, last in zip(batch.column(0).to_pylist(), bounds, bounds[1:]):
                for block in blocks.add(doc_id, ids[first:last]):
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["value"])
        if blocks.held:
            yield pa.RecordBatch.from_arrays([pa.array([blocks.close()], pa.binary())], ["value"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    mapped(rows, coded, "value binary").select(F.col("value").cast("string")).write.option("lineSep", MARK).text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document and block: ``doc_id``, ``doc_start`` (ids of all documents before it), ``skipped`` (ids of the document before this piece), ``whole`` (the piece is all of the document), ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit).

    Blocks are decoded apart from each other and checked; a damaged one raises.  Where a part begins comes
    from the totals of the parts before, which are read from the headers.
    """
    blocks = spark.read.option("lineSep", MARK).text(path).filter("octet_length(value) > 0")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [block_head(b) for b in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in found], pa.int32()), pa.array([h[2] for h in found], pa.int64())], ["part", "n_tokens"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                part, before, skipped, goes_on, doc_ids, counts, ids = unpack_block(block.as_py())
                edges = np.concatenate([[0], np.cumsum(counts)])
                skips = np.zeros(len(counts), np.int64)
                skips[0] = skipped
                whole = skips == 0
                whole[-1] &= not goes_on
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(edges * 4), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(counts), part, np.int32)), pa.array(before + edges[:-1]), pa.array(doc_ids, pa.int64()), pa.array(skips),
                        pa.array(whole), pa.array(counts), data.cast(pa.binary()),
                    ],
                    [f.split()[0] for f in _PIECES.split(", ")],
                )

    value = F.col("value").cast("binary")
    bases = starts_of_parts(blocks.select(F.substring(value, 1, 1 + _HEAD_BYTES).alias("value")).mapInArrow(heads, "part int, n_tokens long"), "n_tokens")
    found = blocks.select(value.alias("value")).mapInArrow(pieces, _PIECES).join(bounded(bases), "part")
    return found.select("doc_id", (F.col("base") + F.col("before") - F.col("skipped")).alias("doc_start"), "skipped", "whole", "n_tokens", "ids")


def document_digests(pieces: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` per document; only documents that go over a block's border are put together."""
    own = pieces.select("doc_id", "doc_start", "skipped", "n_tokens", F.crc32("ids").alias("_crc"), F.when(~F.col("whole"), F.col("ids")).alias("ids"))
    docs = own.groupBy("doc_id", "doc_start").agg(F.sum("n_tokens").alias("n_tokens"), F.first("_crc").alias("_crc"), F.sort_array(F.collect_list(F.struct("skipped", "ids"))).alias("_parts"))
    joined = F.array_join(F.transform("_parts", lambda x: x["ids"].cast("string")), "").cast("binary")
    return docs.select("doc_id", F.col("doc_start").alias("start"), "n_tokens", F.when(F.size("_parts") > 1, F.crc32(joined)).otherwise(F.col("_crc")).alias("ids_crc32"))
