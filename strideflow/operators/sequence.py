"""Ordered work over long sequences that never needs a whole key in one task.

A key (a video, a source) may hold a large share of all rows.  A plain window
``partitionBy(key)`` would put that share in one task, so everything ordered is
done in two levels here: rows are cut into chunks of their order column, window
functions run inside a chunk, and a summary row per chunk carries values over
the chunk borders.  The summaries are smaller by the chunk size and come from
an ordinary hash aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .chunks import arrow_schema, nullable, runs
from .prominence import peaks  # noqa: F401  (both are sequence operators)
from .spacing import min_gap_filter  # noqa: F401

CHUNK = 4096


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def lay_out(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, chunk: int = CHUNK) -> DataFrame:
    """The rows dealt by key and chunk, for several scans: they keep ``_chunk``, so the rows are not shuffled again."""
    return df.withColumn("_chunk", F.floor(F.col(order[0]) / chunk)).repartition(*keys, "_chunk")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    before: Mapping[str, Column] | None = None,
    through: Mapping[str, Column] | None = None,
    after: Mapping[str, Column] | None = None,
    running: Mapping[str, Column] | None = None,
    totals: Mapping[str, tuple[str, Column]] | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Add ordered columns per key.

    ``before`` / ``through``: last non-null value strictly before / up to the row.
    ``after``: first non-null value strictly after the row.
    ``running``: cumulative sum up to the row.
    ``totals``: ``(sum | min | max, column)`` over the whole key.

    ``order`` must be unique per key; its first column is numeric and is what
    the chunks are cut on.  Rows that are laid out already (:func:`lay_out`, same
    keys, order and chunk) stay where they are.
    """
    before, through, after = dict(before or {}), dict(through or {}), dict(after or {})
    running, totals = dict(running or {}), dict(totals or {})
    laid = "_chunk" in df.columns
    original = list(df.columns)
    back = {**before, **through}
    values = {**back, **after, **running, **{n: c for n, (_, c) in totals.items()}}
    base = df.select(
        "*",
        *([] if laid else [F.floor(F.col(order[0]) / chunk).alias("_chunk")]),
        *[c.alias(f"_v_{n}") for n, c in values.items()],
    )
    block = [*keys, "_chunk"]
    position = F.struct(*_cols(order))

    def val(name):
        return F.col(f"_v_{name}")

    def edge(pick, name):
        return pick(val(name), F.when(val(name).isNotNull(), position)).alias(f"_e_{name}")

    how = {"sum": F.sum, "min": F.min, "max": F.max}
    summary = base.groupBy(*block).agg(
        *[edge(F.max_by, n) for n in back],
        *[edge(F.min_by, n) for n in after],
        *[F.sum(val(n)).alias(f"_e_{n}") for n in running],
        *[how[k](val(n)).alias(f"_e_{n}") for n, (k, _) in totals.items()],
        F.count(F.lit(1)).alias("_rows"),
    )
    up = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    down = (
        Window.partitionBy(*keys)
        .orderBy(F.col("_chunk").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy(*keys)
    carried = summary.select(
        *block,
        *[F.last(f"_e_{n}", True).over(up).alias(f"_k_{n}") for n in back],
        *[F.last(f"_e_{n}", True).over(down).alias(f"_k_{n}") for n in after],
        *[F.coalesce(F.sum(f"_e_{n}").over(up), F.lit(0)).alias(f"_k_{n}") for n in running],
        *[how[k](f"_e_{n}").over(whole).alias(f"_k_{n}") for n, (k, _) in totals.items()],
    )
    asc = Window.partitionBy(*block).orderBy(*order)
    desc = Window.partitionBy(*block).orderBy(*[F.col(o).desc() for o in order])
    past = asc.rowsBetween(Window.unboundedPreceding, -1)
    now = asc.rowsBetween(Window.unboundedPreceding, 0)
    later = desc.rowsBetween(Window.unboundedPreceding, -1)
    local = base.select(
        *original,
        *([] if laid else ["_chunk"]),
        *[F.last(val(n), True).over(past).alias(f"_l_{n}") for n in before],
        *[F.last(val(n), True).over(now).alias(f"_l_{n}") for n in through],
        *[F.coalesce(F.sum(val(n)).over(now), F.lit(0)).alias(f"_l_{n}") for n in running],
        *[F.last(val(n), True).over(later).alias(f"_l_{n}") for n in after],
    )
    joined = local.join(carried, block, "left")
    return joined.select(
        *original,
        *[F.coalesce(f"_l_{n}", f"_k_{n}").alias(n) for n in (*back, *after)],
        *[(F.col(f"_l_{n}") + F.col(f"_k_{n}")).alias(n) for n in running],
        *[F.col(f"_k_{n}").alias(n) for n in totals],
    )


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, pos: str = "pos",
    count: str = "n_rows", chunk: int = CHUNK,
) -> DataFrame:
    """Add the 1-based row number per key and the number of rows of the key."""
    one = F.lit(1).cast("long")
    return scan(df, keys, order, running={pos: one}, totals={count: ("sum", one)}, chunk=chunk)


def progress(df: DataFrame, keys=("video_id",), order=("frame_idx",), *, out: str = "progress",
             chunk: int = CHUNK) -> DataFrame:
    """Add the position of a row in its key as 0..1; 0.5 for a single row."""
    placed = positions(df, keys, order, pos="_pos", count="_n", chunk=chunk)
    return placed.withColumn(out, share(F.col("_pos"), F.col("_n"))).drop("_pos", "_n")


def share(pos: Column, n: Column) -> Column:
    """A row number of ``n`` as 0..1; 0.5 for a single row."""
    return F.when(n <= 1, F.lit(0.5)).otherwise((pos - 1) / (n - 1))


def local_maxima(
    df: DataFrame, value: str, min_val: float, keys=("video_id",), order=("frame_idx",), *,
    out: str = "is_max", chunk: int = CHUNK,
) -> DataFrame:
    """Flag rows >= both neighbours and > one of them; both ends are never maxima.

    A neighbour without a value counts as -1.
    """
    flat = F.struct(F.col(value).alias("v"))
    seen = scan(df, keys, order, before={"_prev": flat}, after={"_next": flat}, chunk=chunk)
    v = F.col(value)
    left, right = F.coalesce(F.col("_prev.v"), F.lit(-1.0)), F.coalesce(F.col("_next.v"), F.lit(-1.0))
    inner = F.col("_prev").isNotNull() & F.col("_next").isNotNull()
    peak = (v >= min_val) & (v >= left) & (v >= right) & ((v > left) | (v > right))
    return seen.withColumn(out, inner & F.coalesce(peak, F.lit(False))).drop("_prev", "_next")


# --------------------------------------------------------------- smoothing

def fit_matrix(window: int, degree: int) -> np.ndarray:
    """Row r: weights that give the fitted polynomial's value at sample r.

    The middle row is the smoothing filter; the other rows serve the ends of the
    series, where the polynomial of the outermost full window is used.
    """
    x = np.arange(window, dtype=float) - window // 2
    basis = np.vander(x, degree + 1, increasing=True)
    return basis @ np.linalg.pinv(basis)


def _weights_table(df: DataFrame, largest: int, degree: int, prefix: str) -> DataFrame:
    rows = [(w, fit_matrix(w, degree).tolist()) for w in range(5, largest + 1, 2)]
    schema = f"{prefix}_win int, {prefix}_weights array<array<double>>"
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))  # at most nine rows


def contact_signal(
    df: DataFrame, value: str = "foot_y", keys=("video_id",), order=("frame_idx",), *,
    out: str = "signal", chunk: int = CHUNK,
) -> DataFrame:
    """Short polynomial smoothing minus a long one, over the rows with a value.

    Windows are 11 (degree 2) and 21 (degree 3), shortened to the largest odd
    number of values available; with fewer than five values they pass unchanged.
    Rows without a value have no signal and are not returned.
    """
    keys = list(keys)
    largest_short, largest_long = 11, 21
    have = df.filter(F.col(value).isNotNull())
    placed = positions(have, keys, list(order), pos="_pos", count="_n", chunk=chunk)

    def odd(limit):
        n = F.least(F.col("_n"), F.lit(limit)).cast("int")
        return n - (1 - n % 2)

    placed = placed.withColumn("_short_win", odd(largest_short)).withColumn(
        "_long_win", odd(largest_long)
    )
    # Chunk on the dense row number, each row copied to the chunks it is needed in.
    reach = largest_long - 1
    spread = placed.select(
        "*",
        F.floor(F.col("_pos") / chunk).alias("_own"),
        F.explode(
            F.sequence(
                F.floor((F.col("_pos") - reach) / chunk), F.floor((F.col("_pos") + reach) / chunk)
            )
        ).alias("_chunk"),
    )
    near = Window.partitionBy(*keys, "_chunk").orderBy("_pos")
    around = near.rangeBetween(-reach, reach)
    rows = (
        spread.withColumn("_vals", F.collect_list(value).over(around))
        .withColumn("_first", F.min("_pos").over(around))
        .filter(F.col("_own") == F.col("_chunk"))
    )
    rows = rows.join(_weights_table(df, largest_short, 2, "_short"), "_short_win", "left").join(
        _weights_table(df, largest_long, 3, "_long"), "_long_win", "left"
    )

    def fitted(win: str, weights: str) -> Column:
        w = F.col(win)
        start = F.greatest(
            F.lit(1).cast("long"), F.least(F.col("_pos") - F.floor(w / 2), F.col("_n") - w + 1)
        )
        row = F.get(F.col(weights), (F.col("_pos") - start).cast("int"))
        samples = F.slice(F.col("_vals"), (start - F.col("_first") + 1).cast("int"), w)
        return F.aggregate(
            F.zip_with(samples, row, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v
        )

    smooth = F.when(
        F.col("_n") >= 5,
        fitted("_short_win", "_short_weights") - fitted("_long_win", "_long_weights"),
    ).otherwise(F.col(value))
    return rows.select(*df.columns, smooth.alias(out))


# --------------------------------------------------------------- finite state

def run_state_machine(
    df: DataFrame, table: np.ndarray, symbol: str, keys=("video_id",), order=("frame_idx",), *,
    start: int = 0, out: str = "state", chunk: int = 2048,
) -> DataFrame:
    """Run a finite state machine along each key, exactly, without one long fold.

    ``table[symbol, state]`` is the next state.  A chunk follows all entry states at once; as soon as they meet,
    its rows are settled whatever came before.  Rows in front of that keep their state by entry state, and the
    chunk hands on one row, its map from entry to exit.  A pass over these rows, chunk by chunk, gives each chunk
    its entry state.  Rows are shuffled once; nothing is gathered by key.
    """
    keys, table = list(keys), np.asarray(table)
    n_states = table.shape[1]
    steps = dict(enumerate(row.tolist() for row in table)) | {None: list(range(n_states))}  # no symbol: no change
    rows = df.select(*keys, F.floor(F.col(order[0]) / chunk).alias("_chunk"), F.col(symbol).cast("int").alias("_sym"), *[c for c in df.columns if c not in keys])
    shape = nullable(rows.schema)
    added = [T.StructField(out, T.IntegerType()), T.StructField("_options", T.ArrayType(T.IntegerType())), T.StructField("_map", T.BooleanType())]
    schema = T.StructType([*shape.fields, *added])
    kinds, at = arrow_schema(schema), len(keys)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in runs(batches, at + 1):
            made = []
            for run in some:
                states, options, now, one = [], [], list(range(n_states)), None
                for symbol_ in run.column(at + 1).to_pylist():
                    step = steps[symbol_]
                    if one is None:
                        now = [step[s] for s in now]
                        if now.count(now[0]) == n_states:
                            one = now[0]
                    else:
                        one = step[one]
                    states.append(one)
                    options.append(now if one is None else None)
                ended = now if one is None else [one] * n_states
                columns = [*run.columns, pa.array(states, pa.int32()), pa.array(options, kinds.field("_options").type), pa.array([False] * len(states))]
                made.append(pa.RecordBatch.from_arrays(columns, schema=kinds))
                head = [*run.slice(0, 1).columns[: at + 1], *[pa.nulls(1, k.type) for k in list(kinds)[at + 1 : -2]], pa.array([ended], kinds.field("_options").type), pa.array([True])]
                made.append(pa.RecordBatch.from_arrays(head, schema=kinds))
            yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    block = [*keys, "_chunk"]
    followed = cut_lineage(rows.repartition(*block).sortWithinPartitions(*block, *order).mapInArrow(follow, schema))
    entry = T.StructType([*shape.fields[: at + 1], T.StructField("_entry", T.IntegerType())])

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in runs(batches, at):
            for run in some:
                state, found = start, []
                for exits in run.column(at + 1).to_pylist():
                    found.append(state)
                    state = exits[state]
                yield pa.RecordBatch.from_arrays([*run.columns[: at + 1], pa.array(found, pa.int32())], entry.names)

    maps = followed.filter("_map").select(*block, "_options")
    entries = maps.repartition(*keys).sortWithinPartitions(*block).mapInArrow(enter, entry)
    real = followed.filter("not _map")
    waiting = real.filter(F.col("_options").isNotNull()).join(entries, block).withColumn(out, F.get("_options", F.col("_entry")))
    columns = [*df.columns, out]
    return real.filter(F.col("_options").isNull()).select(*columns).unionByName(waiting.select(*columns))
