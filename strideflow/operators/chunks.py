"""Runs of sorted rows inside Arrow batches: the pieces that ordered operators work on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T


def framed(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Sorted rows with the edges of their groups by the first ``keys`` columns; a batch's last group waits for the next batch."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = batch if held is None else pa.concat_batches([held, batch])
        codes = [rows.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for i in range(keys)]
        cuts = [0, *(1 + np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], axis=0))).tolist()]
        if len(cuts) > 1:
            yield rows.slice(0, cuts[-1]), cuts
        held = rows.slice(cuts[-1])
    if held is not None:
        yield held, [0, held.num_rows]


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Sorted rows cut where one of the first ``keys`` columns changes; a list per batch, the last run waits for the next batch."""
    for rows, edges in framed(batches, keys):
        yield [rows.slice(a, b - a) for a, b in zip(edges, edges[1:])]


#: Rows that a step handles at a time, padded to those of its fullest group.
STEP = 1 << 12


def side_by_side(edges: np.ndarray, line: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Steps of (lines, first rows, numbers of rows): the first group of every line, then the second one, and so on.

    ``edges`` are the borders of the groups, ``line`` the ascending number of each group's line.
    """
    first = np.flatnonzero(np.r_[True, np.diff(line) != 0])
    turn = np.arange(len(line)) - first[line]
    sizes = np.diff(edges)
    order = np.lexsort((sizes, turn))
    for groups in np.split(order, np.flatnonzero(np.diff(turn[order])) + 1):
        while len(groups):
            some = groups[-max(1, STEP // int(sizes[groups[-1]])) :]
            yield line[some], edges[some], sizes[some]
            groups = groups[: -len(some)]


def lines_of(codes: list[np.ndarray], edges: np.ndarray) -> np.ndarray:
    """Number of each group's line: groups in a row with equal ``codes`` (by row) are one line."""
    starts = edges[:-1]
    return np.cumsum(np.r_[False, np.any([np.diff(c[starts]) != 0 for c in codes], axis=0)])


def padded(start: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of groups as a table (first row where a group has fewer) and which of its places are real."""
    place = np.arange(many.max())
    real = place < many[:, None]
    return np.where(real, start[:, None] + place, start[:, None]), real


def nullable(schema: T.StructType) -> T.StructType:
    """The same columns, all of which may be null."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
