"""Packing whole documents into few sequences: best-fit in tasks, then best-fit of what is left, merged as a tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, steps, store
from .tokens import encoder

LENGTH = 4096
#: Items that a task fits at once, about; tasks whose open bins meet in the next round.
TASK_ITEMS, FAN = 50_000, 8
#: A bin filled to this share is closed; others go on to the next round.
NEARLY = 0.98
#: A round that saves less than this share of its bins is the last one.
WORTH = 0.002

_PIECES = "key long, doc_id long, piece int, start long, length int, ids binary"
_PLACED = "key long, size int, bin long, offset int, fill int"


def piece_rows(documents: DataFrame, tokenizer_path: str, end_id: int, length: int) -> DataFrame:
    """Ids of every document in pieces of ``length``, the last one maybe shorter; ``key`` is unique."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, key = encoder(tokenizer_path, True, end_id), TaskContext.get().partitionId() << 36
        for batch in steps(batches, "text"):
            ids, bounds = coder.encode(batch.column(1))
            sizes = np.diff(bounds)
            rows = -(-sizes // length)
            owner = np.repeat(np.arange(len(sizes)), rows)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows)
            n = np.minimum(sizes[owner] - piece * length, length)
            edges = np.concatenate([[0], np.cumsum(n)]) * 4
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(edges), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key + np.arange(len(n))), batch.column(0).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(piece * length), pa.array(n.astype(np.int32)), data.cast(pa.binary())],
                ["key", "doc_id", "piece", "start", "length", "ids"],
            )
            key += len(n)

    return mapped(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), encode, _PIECES)


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin of every item and its place there: each item goes to the fullest bin that still takes it, else to a new one.

    Bins wait in a stack for each room they have left; a bit per room says which stacks are not empty.
    """
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, places, count, rooms = [], [], 0, 0
    for size in sizes:
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            stack = waiting[room]
            at = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            at, room, count = count, capacity, count + 1
        bins.append(at)
        places.append(capacity - room)
        left = room - size
        if left:
            rooms |= 1 << left
            waiting[left].append(at)
    return bins, places


def fitted(items: DataFrame, parts: int, turn: int, capacity: int) -> DataFrame:
    """One round: items (key, size) dealt to ``parts`` tasks by a hash, each packed by falling size.

    A bin is named after its first item, so names stay unique and a bin that nothing joins keeps its own.
    """

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        keys, sizes = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (0, 1))
        order = np.lexsort((keys, -sizes))  # the same whatever order a repeated task gets its rows in
        keys, sizes = keys[order], sizes[order]
        bins, places = (np.array(x) for x in best_fit(sizes.tolist(), capacity))
        fill = np.bincount(bins, weights=sizes).astype(np.int32)
        first = np.zeros(len(fill), np.int64)
        first[bins[::-1]] = keys[::-1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(sizes.astype(np.int32)), pa.array(first[bins]), pa.array(places.astype(np.int32)), pa.array(fill[bins])], ["key", "size", "bin", "offset", "fill"]
        )

    return mapped(items.repartition(parts, F.xxhash64("key", F.lit(turn))), fit, _PLACED)


def place(items: DataFrame, capacity: int, task_items: int = TASK_ITEMS, fan: int = FAN) -> DataFrame:
    """``key``, ``bin``, ``offset`` of items (``key`` unique, ``size`` from 1 to ``capacity``), in few bins.

    Round one packs the items of each task.  Nearly full bins are done; the others are items of the next round,
    in which ``fan`` tasks' bins meet in one.  So it goes up a tree until one task is left or a round saves
    hardly anything; a task gets about ``task_items`` items at most.  Rounds only move whole bins, so an item's
    place is its place in its first bin plus those of the bins on the way.
    """
    parts = max(1, -(-items.count() // task_items))
    first = store(fitted(items, parts, 0, capacity), "bestfit-0")
    moved, last, turn = None, first, 0
    while parts > 1:
        turn += 1
        heads = last.filter((F.col("key") == F.col("bin")) & (F.col("fill") < int(NEARLY * capacity))).select("key", F.col("fill").alias("size"))
        open_bins = heads.count()
        parts = max(-(-parts // fan), -(-open_bins // task_items))
        last = store(fitted(heads, max(1, parts), turn, capacity), f"bestfit-{turn}")
        joined = last.filter(F.col("key") != F.col("bin")).select(F.col("key").alias("_from"), F.col("bin").alias("_to"), F.col("offset").alias("_by"))
        saved = joined.count()
        if saved:
            moved = joined if moved is None else store(_onward(moved, "_to", joined).unionByName(joined), f"bestfit-moved-{turn}")
        if open_bins <= task_items and parts <= 1 or saved < WORTH * open_bins:
            break
    placed = first.select("key", "bin", "offset")
    if moved is None:
        return placed
    step = placed.join(moved, F.col("bin") == F.col("_from"), "left")
    return step.select("key", F.coalesce("_to", "bin").alias("bin"), (F.col("offset") + F.coalesce("_by", F.lit(0))).alias("offset"))


def _onward(moved: DataFrame, name: str, joined: DataFrame) -> DataFrame:
    """Earlier moves carried on by those of the next round."""
    later = joined.select(F.col("_from").alias("_at"), F.col("_to").alias("_next"), F.col("_by").alias("_more"))
    step = moved.join(later, F.col(name) == F.col("_at"), "left")
    return step.select("_from", F.coalesce("_next", "_to").alias("_to"), (F.col("_by") + F.coalesce("_more", F.lit(0))).alias("_by"))


def pack_whole(documents: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """Pack the ids of all documents into as few sequences of at most ``length`` ids as best-fit finds.

    Only documents longer than ``length`` are cut, into pieces of ``length`` ids of which the last may be
    shorter; full pieces are sequences of their own.  The other pieces are packed by :func:`place`, which reads
    only their sizes; the ids are written once and met again by key.

    One row per piece: ``doc_id``, ``piece`` (from 0), ``start`` (ids of its document before it), ``length``,
    ``ids`` (little-endian unsigned 32-bit), ``sequence_id`` and ``offset`` (place there, gapless from 0).
    A null or empty text is its end id alone; a very long text is many pieces.  Equal rows, repeated and null
    doc_ids are documents of their own.  Pieces of equal length are packed in the order of their keys.  An empty
    table gives no rows; other columns are not read.
    """
    pieces = store(piece_rows(documents, tokenizer_path, end_id, length), "bestfit-pieces")
    short = pieces.filter(F.col("length") < length).select("key", F.col("length").alias("size"))
    placed = place(short, length).select("key", F.col("bin").alias("_bin"), F.col("offset").alias("_offset"))
    return pieces.join(placed, "key", "left").select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids",
        F.coalesce("_bin", "key").alias("sequence_id"), F.coalesce("_offset", F.lit(0)).cast("long").alias("offset"),
    )
