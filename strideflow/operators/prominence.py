"""Peaks with prominence in long sequences, without a task that sees more than a chunk of one key.

A chunk settles the peaks that meet higher samples on both sides inside it.  What is left asks for the next
higher sample beyond the border: a tree of (highest, lowest) per chunk and per span of chunks says in which chunk
it lies and how low it gets on the way, and the records of that chunk (its monotone stack) give the rest.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .chunks import arrow_schema, nullable, runs

CHUNK = 4096
#: Children of a node of the tree.
FAN = 256

_D, _L, _B = T.DoubleType(), T.LongType(), T.BooleanType()
#: What a chunk hands on besides its settled peaks: asking peaks, its extremes, its border levels and its records.
_FIELDS = [
    ("_kind", T.StringType()), ("_pos", _L), ("_v", _D), ("_prom", _D),
    ("_left_base", _D), ("_left_done", _B), ("_right_base", _D), ("_right_done", _B),
    ("_high", _D), ("_low", _D), ("_side", T.IntegerType()), ("_before", _D), ("_after", _D), ("_level", T.ArrayType(_L)),
    ("_up", T.ArrayType(_D)), ("_up_low", T.ArrayType(_D)), ("_down", T.ArrayType(_D)), ("_down_low", T.ArrayType(_D)),
]


def _walk(heights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each sample the lowest one back to the last higher sample, and whether there is a higher one."""
    base, done = np.empty(len(heights)), np.zeros(len(heights), bool)
    stack: list[tuple[float, float]] = []  # (height, lowest from the entry below up to this one)
    for i, v in enumerate(heights.tolist()):
        low = v
        while stack and stack[-1][0] <= v:
            low = min(low, stack.pop()[1])
        base[i], done[i] = low, bool(stack)
        stack.append((v, low))
    return base, done


def _records(heights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples higher than all before them, and the lowest sample before each."""
    before = np.concatenate([[-np.inf], np.maximum.accumulate(heights)[:-1]])
    at = np.flatnonzero(heights > before)
    low = np.concatenate([[np.inf], np.minimum.accumulate(heights)[:-1]])
    return heights[at], low[at]


def _settle(pos: np.ndarray, v: np.ndarray) -> list[dict]:
    """Rows that one chunk hands on.  Equal neighbours are one level; those at a border are settled later."""
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    last = np.concatenate([first[1:], [len(v)]])
    h = v[first]
    (left, left_done), (right, right_done) = _walk(h), tuple(x[::-1] for x in _walk(h[::-1]))
    peak = np.zeros(len(h), bool)
    peak[1:-1] = (h[1:-1] > h[:-2]) & (h[1:-1] > h[2:])
    middle = pos[(first + last - 1) // 2]
    done = peak & left_done & right_done
    out = [{"_kind": "peak", "_pos": p, "_v": x, "_prom": x - max(a, b)} for p, x, a, b in zip(middle[done].tolist(), h[done].tolist(), left[done].tolist(), right[done].tolist())]
    for k in np.flatnonzero(peak & ~done).tolist():
        out.append({"_kind": "ask", "_pos": int(middle[k]), "_v": float(h[k]), "_left_base": left[k], "_left_done": bool(left_done[k]), "_right_base": right[k], "_right_done": bool(right_done[k])})
    for side, k in ((0, 0), (1, len(h) - 1)):
        if side and not k:
            break
        out.append({
            "_kind": "border", "_side": side, "_v": float(h[k]), "_level": pos[first[k] : last[k]].tolist(), "_before": float(h[k - 1]) if k else None, "_after": float(h[k + 1]) if k + 1 < len(h) else None,
            "_left_base": left[k], "_left_done": bool(left_done[k]), "_right_base": right[k], "_right_done": bool(right_done[k]),
        })
    (up, up_low), (down, down_low) = _records(h), _records(h[::-1])
    out.append({"_kind": "chunk", "_high": float(h.max()), "_low": float(h.min()), "_up": up.tolist(), "_up_low": up_low.tolist(), "_down": down.tolist(), "_down_low": down_low.tolist()})
    return out


def peaks(
    df: DataFrame, value: str = "signal", keys: Sequence[str] = ("video_id",), order: Sequence[str] = ("frame_idx",), *,
    min_prominence: Column | None = None, out: str = "prominence", chunk: int = CHUNK, fan: int = FAN,
) -> DataFrame:
    """Local maxima (centre of a level top) of the non-null series with prominence.

    Prominence is the height above the higher of the two lowest points reached walking left and right until a
    higher sample.  Both ends of a series are never maxima.  Rows are shuffled once, to their chunks; what
    chunks hand on is a row a chunk and the peaks that see beyond a border, however the series runs.
    """
    keys, pos = list(keys), order[0]
    rows = df.filter(F.col(value).isNotNull()).select(
        *keys, F.floor(F.col(pos) / chunk).alias("_chunk"), F.col(pos).cast("long").alias("_pos"), F.col(value).cast("double").alias("_v")
    )
    schema = nullable(T.StructType([*rows.schema.fields[: len(keys) + 1], *(T.StructField(n, k) for n, k in _FIELDS)]))
    kinds = arrow_schema(schema)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in runs(batches, len(keys) + 1):
            held: list[dict] = []
            for run in some:
                name = {n: run.column(i)[0].as_py() for i, n in enumerate((*keys, "_chunk"))}
                held += [name | r for r in _settle(run.column(len(keys) + 1).to_numpy(), run.column(len(keys) + 2).to_numpy())]
            yield pa.RecordBatch.from_pylist(held, kinds)

    block = [*keys, "_chunk"]
    settled = cut_lineage(rows.repartition(*block).sortWithinPartitions(*block, "_pos").mapInArrow(settle, schema))
    done = settled.filter("_kind = 'peak'").select(*keys, "_pos", "_v", "_prom")
    ask = settled.filter("_kind = 'ask'").select(
        *keys, "_pos", "_v", "_left_base", "_left_done", F.col("_chunk").alias("_left_at"), "_right_base", "_right_done", F.col("_chunk").alias("_right_at")
    )
    ask = ask.unionByName(_border_peaks(settled.filter("_kind = 'border'"), keys))
    chunks = settled.filter("_kind = 'chunk'")
    edge = chunks.agg(F.max("_chunk") - F.min("_chunk"), F.min("_chunk")).first()
    if edge[0]:
        depth = 1
        while fan**depth <= edge[0]:
            depth += 1
        base = chunks.select(*keys, (F.col("_chunk") - edge[1]).alias("_node"), "_high", "_low", "_up", "_up_low", "_down", "_down_low")
        for side in ("left", "right"):
            ask = _reach(ask.withColumn(f"_{side}_at", F.col(f"_{side}_at") - edge[1]), base, keys, side, fan, depth)
    ended = ask.select(*keys, "_pos", "_v", (F.col("_v") - F.greatest("_left_base", "_right_base")).alias("_prom"))
    found = done.unionByName(ended).select(
        *keys, F.col("_pos").cast(df.schema[pos].dataType).alias(pos), F.col("_v").alias(value), F.col("_prom").alias(out)
    )
    return found if min_prominence is None else found.filter(F.col(out) >= min_prominence)


def _border_peaks(border: DataFrame, keys: list[str]) -> DataFrame:
    """Levels that touch a chunk border, joined across borders: those that are maxima, as asking peaks.

    At most two rows a chunk, so a window over a key's rows stays small.
    """
    line = Window.partitionBy(*keys).orderBy("_chunk", "_side")
    rows = border.withColumns({"_prev": F.lag("_v").over(line), "_next": F.lead("_v").over(line)})
    opens = F.col("_before").isNotNull() | F.col("_prev").isNull() | (F.col("_prev") != F.col("_v"))
    closes = F.col("_after").isNotNull() | F.col("_next").isNull() | (F.col("_next") != F.col("_v"))
    rows = rows.withColumns({"_opens": opens, "_closes": closes}).withColumn("_run", F.sum(F.col("_opens").cast("int")).over(line))
    inside = Window.partitionBy(*keys, "_run").orderBy("_chunk", "_side")
    whole = Window.partitionBy(*keys, "_run")
    size = F.size("_level")
    rows = rows.withColumns({"_before_rows": F.sum(size).over(inside) - size, "_all": F.sum(size).over(whole)})
    centre = F.floor((F.col("_all") - 1) / 2) - F.col("_before_rows")
    middle = F.when((centre >= 0) & (centre < size), F.get("_level", centre.cast("int")))
    # of a level over several chunks the first knows the left side, the last the right one
    first, last = F.col("_opens"), F.col("_closes")
    levels = rows.groupBy(*keys, "_run").agg(
        F.max(middle).alias("_pos"), F.first("_v").alias("_v"),
        *[F.max(F.when(end, F.col(c))).alias(n) for end, c, n in (
            (first, "_left_base", "_left_base"), (first, "_left_done", "_left_done"), (first, "_chunk", "_left_at"), (last, "_right_base", "_right_base"), (last, "_right_done", "_right_done"), (last, "_chunk", "_right_at"),
        )],
        F.max(F.when(first, F.coalesce("_before", "_prev"))).alias("_under_left"), F.max(F.when(last, F.coalesce("_after", "_next"))).alias("_under_right"),
    )
    return levels.filter((F.col("_under_left") < F.col("_v")) & (F.col("_under_right") < F.col("_v"))).drop("_run", "_under_left", "_under_right")


def _reach(ask: DataFrame, chunks: DataFrame, keys: list[str], side: str, fan: int, depth: int) -> DataFrame:
    """``_{side}_base`` of the peaks that are not done on that side, carried on to the next higher sample or the end.

    Up the tree until a sibling on that side is higher, down to its first child that is, then into that chunk.
    """
    base, done, at = f"_{side}_base", f"_{side}_done", f"_{side}_at"
    right = side == "right"
    levels = [chunks.select(*keys, "_node", "_high", "_low")]
    for _ in range(depth - 1):
        parent = F.floor(F.col("_node") / fan).alias("_node")
        levels.append(levels[-1].groupBy(*keys, parent).agg(F.max("_high").alias("_high"), F.min("_low").alias("_low")))
    # one row a node: its children, nearest first for the side that is searched
    sign = 1 if right else -1
    nodes = [
        level.groupBy(*keys, F.floor(F.col("_node") / fan).alias("_parent")).agg(
            F.array_sort(F.collect_list(F.struct((sign * F.col("_node")).alias("n"), F.col("_high").alias("h"), F.col("_low").alias("l")))).alias("_children")
        )
        for level in levels
    ]
    rest = ask.filter(~F.col(done)).withColumns({"_to": F.lit(None).cast("long"), "_lev": F.lit(-1), "_here": F.col(at)})

    def look(rows: DataFrame, level: int, parent: Column, beyond: Column, wanted: Column) -> DataFrame:
        """The first child behind ``beyond`` that is higher than the peak, and the lowest child in front of it."""
        joined = rows.withColumn("_parent", F.when(wanted, parent)).join(nodes[level], [*keys, "_parent"], "left")
        after = F.filter("_children", lambda c: c["n"] > sign * beyond)
        joined = joined.withColumn("_after", after)
        hit = F.get(F.filter("_after", lambda c: c["h"] > F.col("_v")), F.lit(0))["n"]
        joined = joined.withColumn("_hit", hit)
        lows = F.transform(F.filter("_after", lambda c: F.col("_hit").isNull() | (c["n"] < F.col("_hit"))), lambda c: c["l"])
        return joined.withColumns({
            base: F.when(wanted, F.least(F.col(base), F.array_min(lows))).otherwise(F.col(base)),
            "_to": F.coalesce(F.when(wanted, sign * F.col("_hit")), F.col("_to")),
            "_lev": F.when(wanted & F.col("_hit").isNotNull(), F.lit(level)).otherwise(F.col("_lev")),
        }).drop("_parent", "_children", "_after", "_hit")

    for level in range(depth):
        rest = look(rest, level, F.floor(F.col("_here") / fan), F.col("_here"), F.col("_lev") < 0)
        rest = rest.withColumn("_here", F.floor(F.col("_here") / fan))
    for level in range(depth - 2, -1, -1):
        rest = look(rest, level, F.col("_to"), F.lit(-sign).cast("long") * (1 << 62), F.col("_lev") == level + 1)
    rest = _into_records(rest, chunks, keys, base, at, "_up" if right else "_down")
    columns = ask.columns
    return ask.filter(F.col(done)).unionByName(rest.select(*columns))


def _into_records(rest: DataFrame, chunks: DataFrame, keys: list[str], base: str, at: str, records: str) -> DataFrame:
    """The last step: peaks meet the records of the chunk they look into.

    Peaks of one chunk that look into the same chunk are a run that begins with a copy of its records, so
    many chunks that look into one are spread over tasks.
    """
    names = [c for c in rest.columns if c not in (*keys, "_to", "_lev", "_here")]
    run = [*keys, "_to", at]
    asking = rest.filter(F.col("_to").isNotNull()).select(*run, *[c for c in names if c != at], F.lit(None).cast("array<double>").alias("_heights"), F.lit(None).cast("array<double>").alias("_lows"))
    known = asking.select(*run).distinct().join(
        chunks.select(*keys, F.col("_node").alias("_to"), F.col(records).alias("_heights"), F.col(f"{records}_low").alias("_lows")), [*keys, "_to"]
    )
    both = known.unionByName(asking, allowMissingColumns=True).select(asking.columns)
    slots = {n: both.columns.index(n) for n in (base, "_v", "_heights", "_lows")}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in runs(batches, len(run)):
            for rows in some:
                heights, lows = (np.asarray(rows.column(slots[n])[0].values) for n in ("_heights", "_lows"))
                v, low = (rows.column(slots[n]).slice(1).to_numpy(zero_copy_only=False) for n in ("_v", base))
                met = lows[np.searchsorted(heights, v, "right")]  # the first record that is higher
                rest_of = rows.slice(1)
                yield rest_of.set_column(slots[base], rest_of.schema.field(slots[base]), pa.array(np.minimum(low, met)))

    joined = both.repartition(*run).sortWithinPartitions(*run, F.col("_heights").isNull()).mapInArrow(meet, both.schema)
    open_end = rest.filter(F.col("_to").isNull())
    return joined.select(*keys, *names).unionByName(open_end.select(*keys, *names))
