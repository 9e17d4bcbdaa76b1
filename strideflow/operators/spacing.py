"""Greedy spacing in long sequences: chunks as tables over what may be kept just beyond their borders."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .chunks import arrow_schema, nullable, runs

CHUNK = 4096
#: Stands for no row.
NONE = -(1 << 62)


class Chunk:
    """Rows of one chunk with the rows of its neighbours that lie closer than ``gap`` to its border.

    Two kept rows are ``gap`` apart, so of the neighbour's rows within reach at most one is kept: what lies
    beyond a border is one of a few states.  Rows whose fate no state can change are settled at once.
    """

    def __init__(self, number: int, size: int, gap: int, frames: np.ndarray, scores: np.ndarray):
        self.low, self.high, self.gap = number * size, (number + 1) * size, gap
        self.frames, self.scores = frames, scores
        own = (frames >= self.low) & (frames < self.high)
        self.left, self.right = np.unique(frames[frames < self.low]).tolist(), np.unique(frames[frames >= self.high]).tolist()
        self.order = np.lexsort((frames, -scores)).tolist()
        self.own = own
        kept, open_ = [], []
        sure, maybe = self._ground(), self._ground()
        for i in self.order:
            at = slice(*self._reach(frames[i]))
            place = int(frames[i]) - self.low + 2 * gap
            if not own[i]:
                maybe[at] = True
            elif sure[place]:
                continue
            elif maybe[place]:
                open_.append(i)
                maybe[at] = True
            else:
                kept.append(i)
                sure[at] = True
        self.kept, self.open = kept, open_

    def _ground(self) -> np.ndarray:
        return np.zeros(self.high - self.low + 4 * self.gap, bool)

    def _reach(self, frame: int) -> tuple[int, int]:
        place = int(frame) - self.low + 2 * self.gap
        return place - self.gap + 1, place + self.gap

    def settle(self, rows: list[int], left: int, right: int) -> list[int]:
        """Which of the open ``rows`` (best first) are kept if ``left`` and ``right`` are kept beyond the borders."""
        taken, out = self._ground(), []
        beyond = {f for f in (left, right) if f != NONE}
        best = {f: max((self.scores[i], -i) for i in np.flatnonzero(self.frames == f).tolist()) for f in beyond}
        waiting = sorted(((-s, f) for f, (s, _) in best.items()))
        for i in rows:
            key = (-self.scores[i], self.frames[i])
            while waiting and waiting[0] < key:
                taken[slice(*self._reach(waiting.pop(0)[1]))] = True
            if not taken[int(self.frames[i]) - self.low + 2 * self.gap]:
                out.append(i)
                taken[slice(*self._reach(self.frames[i]))] = True
        return out

    def table(self) -> tuple[list[int], list[int]]:
        """For each state on the left and right: the kept row within reach of the left and of the right border."""
        lefts, rights = [NONE, *self.left], [NONE, *self.right]
        first, last = np.full((len(lefts), len(rights)), NONE), np.full((len(lefts), len(rights)), NONE)

        def enter(rows: list[int], where) -> None:
            for i in rows:
                frame = int(self.frames[i])
                if frame < self.low + self.gap - 1:
                    first[where] = frame
                if frame > self.high - self.gap:
                    last[where] = frame

        enter(self.kept, np.s_[:, :])
        for island in self._islands():
            frames = self.frames[island]
            near_left, near_right = bool(self.left) and frames.min() - self.left[-1] < self.gap, bool(self.right) and self.right[0] - frames.max() < self.gap
            for i, left in enumerate(lefts if near_left else [NONE]):
                for j, right in enumerate(rights if near_right else [NONE]):
                    enter(self.settle(island, left, right), np.s_[i if near_left else slice(None), j if near_right else slice(None)])
        return first.reshape(-1).tolist(), last.reshape(-1).tolist()

    def _islands(self) -> list[list[int]]:
        """Open rows, best first, in groups that are ``gap`` apart."""
        by_frame = sorted(self.open, key=lambda i: self.frames[i])
        group, name = {}, 0
        for before, i in zip([None, *by_frame], by_frame):
            name += before is not None and self.frames[i] - self.frames[before] >= self.gap
            group[i] = name
        out: dict[int, list[int]] = {}
        for i in self.open:
            out.setdefault(group[i], []).append(i)
        return list(out.values())


def _composed(chunks: list[tuple[int, list[int], list[int], list[int], list[int]]]) -> list[tuple[int, int, int]]:
    """(chunk, left, right): what is kept beyond the borders of every chunk of a key, given all tables in order.

    Forward, each chunk is joined to all before it: for each state on its right the one state on its left that
    agrees with both sides.  Backward, the states are read off from the end, beyond which nothing is kept.
    """
    agreed, reached, before = [], {}, None
    for number, left, right, first, last in chunks:
        lefts, rights = [NONE, *left], [NONE, *right]
        first, last = (np.array(x).reshape(len(lefts), len(rights)) for x in (first, last))
        touching = before == number - 1
        solved, ahead = {}, {}
        for j, r in enumerate(rights):
            for i, l in enumerate(lefts):
                seen = reached.get(int(first[i, j]), reached.get(NONE, NONE)) if touching else NONE
                if (seen if seen in lefts else NONE) == l:
                    solved[r], ahead[r] = (l, int(first[i, j])), int(last[i, j])
                    break
        agreed.append((number, solved))
        reached, before = ahead, number
    out, right, after = [], NONE, None
    for number, solved in reversed(agreed):
        if after != number + 1 or right not in solved:
            right = NONE
        left, first = solved[right]
        out.append((number, left, right))
        right, after = first, number
    return out


def min_gap_filter(
    df: DataFrame, score: str, gap: int, keys: Sequence[str] = ("video_id",), frame: str = "frame_idx", *, chunk: int = CHUNK
) -> DataFrame:
    """Keep the best rows so that kept rows of a key are at least ``gap`` apart.

    Same result as going through the rows from the best score down (the earlier frame first on equal scores) and
    dropping every row closer than ``gap`` to a kept one; null scores come last.  Rows are shuffled once, to
    their chunks, with a copy of what lies within reach of a border.  Where the borders decide, a chunk hands on
    a table over the few states beyond them; tables are composed along the key, one row a chunk, and only the
    open rows are settled from their chunk's own states.
    """
    keys, size = list(keys), max(chunk, 2 * gap)
    place, number = F.col(frame).cast("long"), F.floor(F.col(frame) / size)
    reach = F.array_distinct(F.array(number, F.floor((place - (gap - 1)) / size), F.floor((place + (gap - 1)) / size)))
    rows = df.select(*keys, F.explode(reach).alias("_chunk"), place.alias("_frame"), F.col(score).cast("double").alias("_score"), *[c for c in df.columns if c not in keys])
    shape = nullable(rows.schema)
    payload = shape.fields[len(keys) + 3 :]
    tables = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("_left", "_right", "_first", "_last")]
    schema = T.StructType([*shape.fields[: len(keys) + 3], T.StructField("_kind", T.StringType()), *payload, *tables])
    kinds, at = arrow_schema(schema), len(keys)

    def opened(run: pa.RecordBatch) -> Chunk:
        scores = run.column(at + 2).to_numpy(zero_copy_only=False)
        missing = run.column(at + 2).is_null().to_numpy(zero_copy_only=False)
        return Chunk(run.column(at)[0].as_py(), size, gap, run.column(at + 1).to_numpy(zero_copy_only=False), np.where(missing, -np.inf, np.where(np.isnan(scores), np.inf, scores)))

    def marked(run: pa.RecordBatch, picked: list[int], kind: list[str]) -> pa.RecordBatch:
        some = run.take(pa.array(picked, pa.int64()))
        columns = [*some.columns[: at + 3], pa.array(kind, pa.string()), *some.columns[at + 3 : at + 3 + len(payload)], *[pa.nulls(len(picked), k.type) for k in list(kinds)[-4:]]]
        return pa.RecordBatch.from_arrays(columns, schema=kinds)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in runs(batches, at + 1):
            out = []
            for run in some:
                c = opened(run)
                if not c.own.any():
                    continue
                beyond = np.flatnonzero(~c.own).tolist() if c.open else []  # the open rows' neighbours go along
                out.append(marked(run, [*c.kept, *c.open, *beyond], ["kept"] * len(c.kept) + ["open"] * (len(c.open) + len(beyond))))
                if c.left or c.right:
                    lists = [c.left, c.right, *c.table()]
                    columns = [*run.slice(0, 1).columns[: at + 3], pa.array(["table"]), *[pa.nulls(1, k.type) for k in list(kinds)[at + 4 : -4]], *[pa.array([x], k.type) for x, k in zip(lists, list(kinds)[-4:])]]
                    out.append(pa.RecordBatch.from_arrays(columns, schema=kinds))
            yield from out

    block = [*keys, "_chunk"]
    settled = cut_lineage(rows.repartition(*block).sortWithinPartitions(*block, "_frame").mapInArrow(settle, schema))
    back = [F.col(c) for c in df.columns]
    kept = settled.filter("_kind = 'kept'").select(*back)
    if settled.filter("_kind = 'open'").isEmpty():
        return kept
    states = T.StructType([*shape.fields[: at + 1], T.StructField("_beyond_left", T.LongType()), T.StructField("_beyond_right", T.LongType())])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in runs(batches, at):
            for run in some:
                made = _composed(list(zip(*(run.column(i).to_pylist() for i in range(at, at + 5)))))
                names = [pa.repeat(run.column(i)[0], len(made)) for i in range(at)]
                yield pa.RecordBatch.from_arrays([*names, *[pa.array(list(x), pa.int64()) for x in zip(*made)]], states.names)

    known = settled.filter("_kind = 'table'").select(*block, "_left", "_right", "_first", "_last")
    known = known.repartition(*keys).sortWithinPartitions(*block).mapInArrow(compose, states)
    still = settled.filter("_kind = 'open'").select(*rows.columns).join(known, block)

    whole = arrow_schema(shape)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in runs(batches, at + 1):
            for run in some:
                c = opened(run)
                own = [i for i in c.order if c.own[i]]
                picked = c.settle(own, *(run.column(run.num_columns - 2 + k)[0].as_py() for k in (0, 1)))
                yield pa.RecordBatch.from_arrays([x for x in run.take(pa.array(picked, pa.int64())).columns[: at + 3 + len(payload)]], schema=whole)

    last = still.repartition(*block).sortWithinPartitions(*block, "_frame").mapInArrow(finish, shape)
    return kept.unionByName(last.select(*back))
