"""Helpers of the text operators: byte views of Arrow columns, word tables, shared tables, prefix sums."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder

#: Bytes that separate words: ``[\x20\x09-\x0D]``.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Text bytes that one step inside a task works on; a longer text is a step of its own.
STEP_BYTES = 8 << 20
#: Rows that Spark passes to Python at once.
BATCH_ROWS = 2000
#: Rows of a side that may be broadcast; every side is counted before.
BROADCAST_ROWS = 200_000
WORD = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count shows at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def keyed(documents: DataFrame) -> DataFrame:
    """``row`` (all columns) and ``_key``, a long that no other row has: the doc_id where it is that, else a number of its own.

    Rows with a repeated or null doc_id are documents of their own and are numbered behind the largest doc_id, in no
    order that means anything.  They are written to a table first, so that a repeated task finds the same numbers.
    """
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col("doc_id").cast("long").alias("_key"))
    counts = documents.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    seen = counts.agg(F.max("_n"), F.max("_id"), F.count(F.when(F.col("_id").isNull(), 1))).first()
    if (seen[0] or 1) == 1 and not seen[2]:
        return rows
    several = counts.filter("_n > 1 and _id is not null").select("_id")
    alone = rows.filter("_key is not null").join(several, F.col("_key") == F.col("_id"), "left_anti")
    rest = rows.join(several, F.col("_key") == F.col("_id"), "left_semi").union(rows.filter("_key is null"))
    numbered = rest.select("row", (F.lit((seen[1] or 0) + 1) + F.monotonically_increasing_id()).alias("_key"))
    return alone.unionByName(store(numbered, "keyed-rows"))


def starts_of_parts(table: DataFrame, size: str) -> DataFrame:
    """``part`` and ``base``: the sum of ``size`` over all parts before it; one row per written task."""
    totals = table.groupBy("part").agg(F.sum(size).alias("_total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("_total").over(before), F.lit(0).cast("long")).alias("base"))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and where each row starts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    column = column.cast(kind)
    _, starts, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    starts = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs that hold about ``limit`` bytes of ``column``; a longer text is a run of its own."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, starts = column_bytes(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(starts, starts[first] + limit - size, "right")) - 1
            last = min(max(last, first if held else first + 1), batch.num_rows)
            if last > first:
                held.append(batch.slice(first, last - first))
                size += int(starts[last] - starts[first])
                first = last
            if first < batch.num_rows or size >= limit:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Batches of narrow rows put together to about ``rows`` rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield _joined(held)
            held, size = [], 0
    if size:
        yield _joined(held)


def mapped(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of few rows, as rows hold whole texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


@dataclass
class Words:
    """Words of a run of texts: ``codes`` index ``vocabulary``; text i owns ``codes[bounds[i]:bounds[i + 1]]``."""

    codes: np.ndarray
    bounds: np.ndarray
    vocabulary: pa.Array

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of every word."""
        import xxhash

        known = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.vocabulary.to_pylist()), np.uint64, len(self.vocabulary))
        return known[self.codes] if len(known) else np.zeros(0, np.uint64)


def word_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; no word crosses the start of a text."""
    inside = ~SPACE[data]
    opens, ends = np.zeros(len(data), bool), np.zeros(len(data), bool)
    if len(data):
        inner = starts[1:-1][starts[1:-1] < len(data)]
        opens[1:], ends[:-1] = ~inside[:-1], ~inside[1:]
        opens[0] = ends[-1] = True
        opens[inner[inner < len(data)]] = True
        ends[inner[inner > 0] - 1] = True
    return np.flatnonzero(inside & opens), np.flatnonzero(inside & ends) + 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def pick_bytes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The byte ranges ``[first, last)`` (ascending, disjoint) as an Arrow binary column."""
    offsets = np.zeros(len(first) + 1, np.int64)
    np.cumsum(last - first, out=offsets[1:])
    if offsets[-1] < len(data):
        mark = np.zeros(len(data) + 1, np.int8)
        mark[first] += 1
        mark[last] -= 1
        kept = data[np.cumsum(mark[:-1], dtype=np.int8).view(bool)]
    else:
        kept = np.ascontiguousarray(data)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])


def words_of(column: pa.Array, lower: bool = False) -> Words:
    """Split texts at ASCII white space."""
    data, starts = column_bytes(column)
    if lower:
        data = lower_ascii(data)
    first, last = word_bounds(data, starts)
    coded = pick_bytes(data, first, last).dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), np.searchsorted(first, starts), coded.dictionary)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words inside each text, and the bounds of the texts in them."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    edges = np.zeros(len(bounds), np.int64)
    np.cumsum(counts, out=edges[1:])
    total = int(edges[-1])
    at = np.arange(total) - np.repeat(edges[:-1], counts) + np.repeat(bounds[:-1], counts)
    out = np.full(total, 0x9E3779B97F4A7C15, np.uint64)
    for i in range(size):
        out = mixed(out * np.uint64(0x2545F4914F6CDD1D) + words[at + i])
    return out, edges


def widened(df: DataFrame, **kinds: T.DataType) -> T.StructType:
    """The schema of ``df`` with further columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(name, kind) for name, kind in kinds.items())])


def of_session(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A provided table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
