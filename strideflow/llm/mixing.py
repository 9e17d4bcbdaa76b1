"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, bounded, gathered, mapped, starts_of_parts, store, widened

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = 17


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from rows of (source, source_size), one per source.

    The budget is ``share`` of all sizes.  Sources in code-point order (null last) take the weights in
    turn.  A target never exceeds ``max_epochs`` times the source; what it would get beyond that goes to
    the others by weight.  That is one water level L with target = min(cap, L * weight): sources sorted by
    cap / weight are full up to the first whose cap / weight reaches the level of those left (from there on the level only falls).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.alias("_w")).withColumn("_cap", F.col("source_size") * float(max_epochs))
    everything = Window.partitionBy(F.lit(0))
    rising = Window.orderBy("_fill", F.col("source").asc_nulls_last())
    rows = rows.withColumn("_fill", F.col("_cap") / F.col("_w"))
    rows = (
        rows.withColumn("_budget", share * F.sum("source_size").over(everything))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_budget") - F.col("_full")) / F.col("_left"))
        .withColumn("_water", F.max(F.when(F.col("_level") <= F.col("_fill"), F.col("_level"))).over(everything))
    )
    target = F.when(F.col("_water").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_water") * F.col("_w")))
    return rows.select("source", "source_size", target.alias("target"))


def _queue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task and the running size inside (task, source); rows arrive sorted by source."""
    part, last, total = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = batch.column(batch.schema.get_field_index("size")).to_numpy(zero_copy_only=False)
        source = batch.column(batch.schema.get_field_index("source"))
        known, codes = _runs(source)
        before = np.zeros(len(size), np.int64)
        edges = np.flatnonzero(np.diff(codes)) + 1
        for begin, end in zip([0, *edges], [*edges, len(size)]):
            if last is None or last[0] != known[codes[begin]]:
                last, total = (known[codes[begin]],), 0
            run = np.cumsum(size[begin:end])
            before[begin:end] = total + run - size[begin:end]
            total += int(run[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(size), part, np.int32)), pa.array(before)], [*batch.schema.names, "part", "before"]
        )


def _runs(source: pa.Array) -> tuple[list, np.ndarray]:
    coded = pc.dictionary_encode(source, null_encoding="encode")
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task and the running size inside the task."""
    part, total = TaskContext.get().partitionId(), 0
    for batch in gathered(batches):
        if batch.num_rows == 0:
            continue
        size = batch.column(batch.schema.get_field_index("size")).to_numpy(zero_copy_only=False)
        run = np.cumsum(size) + total
        total = int(run[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(size), part, np.int32)), pa.array(run)], [*batch.schema.names, "part", "upto"]
        )


def mix(
    documents: DataFrame, carry: list[str] = ("doc_id",), weights: tuple[float, ...] = WEIGHTS, share: float = 1.0,
    max_epochs: int = MAX_EPOCHS, seed: int = SEED,
) -> DataFrame:
    """Choose how often each document enters a mix of sources by target weights.

    Every source is a queue of its documents in a seeded random order, repeated up to ``max_epochs``
    times.  The e-th copy of a document has the virtual finish time (words of its queue up to its end) /
    target.  All copies are range-sorted by that time and cut where the running sum passes the budget.
    No window holds a source: both running sums are sums inside a sorted task plus the totals of the
    tasks before it.

    Returns one row per input row: ``row`` (a struct of the ``carry`` columns), ``size``, ``source``,
    ``source_size``, ``target``, ``copies`` and ``taken`` (size times copies).  Size counts words; a null
    text has size 0.  Null ``source`` is a source of its own, last in order.  Empty documents cost nothing
    and enter once.  Equal rows are separate documents.  An empty table gives no rows.  The order depends
    on seed, doc_id and text alone, so reruns agree.
    """
    text = F.coalesce("text", F.lit(""))
    sized = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", text).alias("shuffled"),
    )
    ordered = sized.repartitionByRange("source", "shuffled").sortWithinPartitions("source", "shuffled")
    table = store(mapped(ordered, _queue, widened(ordered, part=T.IntegerType(), before=T.LongType())), "mix-queues")

    parts = store(table.groupBy("part", "source").agg(F.sum("size").alias("_size")), "mix-parts")
    targets = source_targets(parts.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, share, max_epochs)
    by_source = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", "source", F.coalesce(F.sum("_size").over(by_source), F.lit(0)).alias("base")).alias("p")
    places = store(
        bases.join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
        .select("part", F.col("p.source").alias("_source"), "base", "source_size", "target"), "mix-places",
    )
    placed = table.join(bounded(places.withColumnRenamed("part", "_part")), (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))

    epochs = F.sequence(F.lit(0), F.lit(max_epochs - 1))
    finish = lambda e: F.when(F.col("target") > 0, (e * F.col("source_size") + F.col("base") + F.col("before") + F.col("size")) / F.col("target")).otherwise(F.lit(0.0))
    begun = lambda e: (e == 0) | ((F.col("size") > 0) & (e * F.col("source_size") < F.col("target")))
    copies = placed.select("source", "shuffled", "size", F.explode(F.filter(epochs, begun)).alias("epoch"), "base", "before", "source_size", "target")
    copies = copies.select(finish(F.col("epoch")).alias("finish"), "source", "shuffled", "epoch", "size")
    line = copies.repartitionByRange("finish", "source", "shuffled").sortWithinPartitions("finish", "source", "shuffled", "epoch")
    line = store(line.mapInArrow(_running, widened(line, part=T.IntegerType(), upto=T.LongType())), "mix-line")
    bases = starts_of_parts(line, "size")
    budget = table.agg((share * F.sum("size")).alias("b")).first()["b"] or 0.0
    over = line.join(bounded(bases), "part").filter((F.col("base") + F.col("upto") > F.lit(float(budget))) & (F.col("size") > 0))
    key = F.struct("finish", "source", "shuffled", "epoch")
    cut = over.agg(F.min(key).alias("k")).first()["k"]

    def within(e):
        if cut is None:
            return begun(e)
        at = F.struct(finish(e).alias("finish"), F.col("source"), F.col("shuffled"), e.alias("epoch"))
        limit = F.struct(
            F.lit(cut["finish"]).alias("finish"), F.lit(cut["source"]).cast("string").alias("source"),
            F.lit(cut["shuffled"]).cast("long").alias("shuffled"), F.lit(cut["epoch"]).cast("int").alias("epoch"),
        )
        return begun(e) & ((at < limit) | (F.col("size") == 0))

    taken = placed.withColumn("copies", F.size(F.filter(epochs, within)))
    return taken.select("row", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
