"""Exact top-k by inner product: a pivot-distance index searched with triangle-inequality bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

SCALE = 256
K = 5
#: Vectors read to choose pivots, and pivots; both bounds hold at every size.
PIVOT_SAMPLE, PIVOTS = 2000, 32
#: Vectors in a block of an annulus, and queries that are compared with a block at once.
BLOCK, QUERY_BLOCK = 1024, 256
#: Vectors with integer components beyond this are compared one by one with whole numbers of any size.
LARGEST = 1 << 24

_BLOCKS = "block long, pivot int, low double, high double, ids binary, data binary"
_ASK = "chunk long, ids binary, data binary, bounds binary, from_pivot array<double>, to_pivot array<double>"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component; vectors null or empty, with null or non-finite components, or without an id are left out."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double") * scale)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.filter(F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))
    # doubles from 2^53 on have no fraction
    return rows.withColumn("v", F.transform("v", lambda c: F.when(F.abs(c) < float(1 << 53), F.floor(c).cast("double")).otherwise(c)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products: floats are exact below 2**53, beyond that integers are used."""
    reach = max(1.0, np.abs(queries).max(initial=0)) * max(1.0, np.abs(rows).max(initial=0)) * queries.shape[1]
    if reach < 2**52:
        return (queries @ rows.T).astype(np.int64)
    return queries.astype(np.int64) @ rows.astype(np.int64).T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k best of each row of scores: highest first, ties to the smaller id; and how many are valid."""
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
    return order, np.take_along_axis(scores, order, axis=1)


#: Stands for no score; its negative is still a 64-bit number.
NONE = -np.iinfo(np.int64).max
TOP = np.iinfo(np.int64).max - 1


def top_k(vectors: DataFrame, k: int = K, every: int = 50, scale: int = SCALE) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k best inner products of each query with all other vectors.

    Queries are the vectors whose id is divisible by ``every``.  Each vector gets one more component that
    brings all to the same length, so the largest inner product is the nearest vector.  The index keys
    every vector by its nearest pivot and the distance to it, sorts by that key and cuts the order into
    blocks: parts of an annulus.  A query first meets the block it lies in, which bounds its k-th score
    from below; then annuli around it matter only as far as the triangle inequality allows a better one.

    Vectors with components beyond 2^24 after scaling would blur all distances.  They stay outside the index: all
    queries are compared with them, and the queries among them with all vectors, in blocks and with whole numbers of
    any size.  A score beyond a long counts as the nearest long.

    Ties go to the smaller id.  Repeated ids are separate vectors (a query never meets its own id).
    Shorter vectors count as padded with zeros.  Queries without candidates and empty tables give no rows;
    other columns are not read.
    """
    spark = vectors.sparkSession
    every_row = store(quantised(vectors, scale), "topk-vectors")
    wide = F.exists("v", lambda c: F.abs(c) > LARGEST)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = _indexed(every_row.filter(~wide), k, every)
    beyond = every_row.filter(wide)
    if not beyond.isEmpty():
        asking = F.col("vec_id") % every == 0
        found = found.union(_by_blocks(every_row.filter(asking), beyond, k)).union(_by_blocks(beyond.filter(asking), every_row.filter(~wide), k))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_blocks(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The k best of ``rows`` for each query, a block of queries against a block of rows at a time, exact at any size."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(first, QUERY_BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()]), pa.array([part.column(1).to_pylist()])], ["ids", "rows"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_rows, ids, data in zip(*(c.to_pylist() for c in batch.columns)):
                data = [[int(x) for x in row] for row in data]
                out = []
                for q_id, q_row in zip(q_ids, q_rows):
                    q_row = [int(x) for x in q_row]
                    scores = [(max(-TOP, min(TOP, sum(a * b for a, b in zip(q_row, row)))), i) for i, row in zip(ids, data) if i != q_id]
                    out += [(q_id, i, score) for score, i in sorted(scores, key=lambda s: (-s[0], s[1]))[:k]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], ["query_id", "vec_id", "score"])

    kinds = "ids array<long>, rows array<array<double>>"
    asked, held = queries.mapInArrow(packed, kinds), rows.mapInArrow(packed, kinds)
    # the stated queries against all rows, in blocks
    met = asked.crossJoin(held.select(F.col("ids").alias("to"), F.col("rows").alias("others")))
    return met.mapInArrow(compare, "query_id long, vec_id long, score long")


def _indexed(rows: DataFrame, k: int, every: int) -> DataFrame:
    """``query_id``, ``vec_id``, ``score``: the k best of each query and maybe some more, by the index."""
    spark = rows.sparkSession
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    top = rows.agg(F.max(norm).alias("most"), F.max(F.size("v")).alias("width")).first()
    out = "query_id long, vec_id long, score long"
    if top["most"] is None:
        return spark.createDataFrame([], out)
    most, width = float(top["most"]), int(top["width"])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("v").toArrow().column(0).combine_chunks()
    pivots = _spread(_lifted(_matrix(sample, width), most), PIVOTS)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = _distances(_lifted(_matrix(batch.column(1), width), most), pivots)
            near = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(near)), near])], ["vec_id", "v", "pivot", "far"]
            )

    index = rows.mapInArrow(keyed, "vec_id long, v array<double>, pivot int, far double")
    index = index.repartitionByRange("pivot", "far", "vec_id").sortWithinPartitions("pivot", "far", "vec_id")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            pivot, far = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
            ids, data = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), width)
            cuts = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]
            made = []
            for first, last in zip(cuts, cuts[1:]):
                for a in range(first, last, BLOCK):
                    b = min(a + BLOCK, last)
                    made.append((number, pivot[a], far[a], far[b - 1], ids[a:b].tobytes(), data[a:b].tobytes()))
                    number += 1
            if made:
                kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*made), kinds)], [f.split()[0] for f in _BLOCKS.split(", ")])

    index = store(index.mapInArrow(blocks, _BLOCKS), "topk-index")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with the k-th best score of their own block, and which distances from each pivot can matter."""
        for batch in batches:
            made = []
            for number, raw_ids, raw in zip(*(batch.column(i).to_pylist() for i in (0, 4, 5))):
                ids, data = np.frombuffer(raw_ids, np.int64), np.frombuffer(raw).reshape(-1, width)
                mine = np.flatnonzero(ids % every == 0)
                for first in range(0, len(mine), QUERY_BLOCK):
                    q = mine[first : first + QUERY_BLOCK]
                    scores = _scores(data[q], data)
                    scores[ids[q][:, None] == ids[None, :]] = NONE
                    _, best = _best(scores, ids, k)
                    bound = best[:, k - 1] if best.shape[1] >= k else np.full(len(q), NONE)
                    lifted = np.concatenate([data[q], np.zeros((len(q), 1))], axis=1)
                    far = _distances(lifted, pivots)
                    length = (data[q] ** 2).sum(axis=1)
                    # |q - x|^2 = |q|^2 + most - 2 <q, x>; slack for rounding, which is worst for small distances of long vectors
                    reach = np.where(bound == NONE, np.inf, np.sqrt(np.maximum(0, length + most - 2.0 * bound)) * (1 + 1e-9) + 1e-6 + 1e-7 * np.sqrt(most))
                    low, high = (far - reach[:, None]).min(axis=0), (far + reach[:, None]).max(axis=0)
                    made.append((number << 16 | first, ids[q].tobytes(), data[q].tobytes(), bound.tobytes(), low.tolist(), high.tolist()))
            if made:
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*made), kinds)], [f.split()[0] for f in _ASK.split(", ")])

    asked = store(index.mapInArrow(ask, _ASK), "topk-queries")
    rings = asked.select("chunk", F.posexplode(F.arrays_zip("from_pivot", "to_pivot"))).select(
        "chunk", F.col("pos").alias("_pivot"), F.col("col.from_pivot").alias("_low"), F.col("col.to_pivot").alias("_high")
    )
    keys = index.select("block", "pivot", "low", "high")
    met = keys.join(rings, (F.col("pivot") == F.col("_pivot")) & (F.col("high") >= F.col("_low")) & (F.col("low") <= F.col("_high"))).select("block", "chunk")
    met = met.join(asked.select("chunk", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), "bounds"), "chunk")
    met = met.join(index.select("block", "ids", "data"), "block").select("q_ids", "q_data", "bounds", "ids", "data")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_data, bounds, ids, data in zip(*(c.to_pylist() for c in batch.columns)):
                q_ids, ids, bounds = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(bounds, np.int64)
                scores = _scores(np.frombuffer(q_data).reshape(-1, width), np.frombuffer(data).reshape(-1, width))
                scores[(q_ids[:, None] == ids[None, :]) | (scores < bounds[:, None])] = NONE
                order, best = _best(scores, ids, k)
                row, column = np.nonzero(best > NONE)
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q_ids[row]), pa.array(ids[order[row, column]]), pa.array(best[row, column])], ["query_id", "vec_id", "score"]
                    )

    return met.mapInArrow(compare, out)


def _lifted(rows: np.ndarray, most: float) -> np.ndarray:
    """Vectors with one more component, so that all have the squared length ``most``."""
    return np.concatenate([rows, np.sqrt(np.maximum(0, most - (rows**2).sum(axis=1)))[:, None]], axis=1)


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (rows**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(0, square))


def _spread(rows: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from each other: each next one is the row farthest from those chosen."""
    chosen = [0]
    near = _distances(rows, rows[:1])[:, 0]
    while len(chosen) < min(count, len(rows)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(rows, rows[chosen[-1]][None, :])[:, 0])
    return rows[chosen]
