"""Chat formatting: conversations rendered turn by turn through a compiled template, and read back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, mapped, store, widened
from .templates import Template

END = "</turn>"
#: Every turn opens with its role and ends with ``END``; both are escaped inside roles and texts.
TEMPLATE = Template(
    "{% for message in messages %}### {{ message.role | escape }}: "
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}" + END + "\n{% endfor %}",
    ("### ", END, ": "),
)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task, the row's place in its conversation inside the task, and whether it is the last there."""
    part, last, place, held = TaskContext.get().partitionId(), None, 0, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ids = batch.column(0).to_pylist()
        places, finals = [], []
        for i, conv in enumerate(ids):
            place = place + 1 if last == (conv,) else 0
            last = (conv,)
            places.append(place)
            finals.append(i + 1 < len(ids) and ids[i + 1] != conv)
        if held is not None:
            held[1][-1] = held[0].column(0)[-1].as_py() != ids[0]
            yield _placed(part, *held)
        held = (batch, finals, places)
    if held is not None:
        held[1][-1] = True
        yield _placed(part, *held)


def _placed(part: int, batch: pa.RecordBatch, finals: list[bool], places: list[int]) -> pa.RecordBatch:
    more = [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(places, pa.int64()), pa.array(finals, pa.bool_())]
    return pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "part", "place", "final"])


def format_conversations(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """One piece of formatted text per row of (conv_id, turn, role, text).

    ``conv_id``, ``place`` (from 0), ``piece`` and ``spans`` (code points of the piece under generation
    marks, as (first, end)).  The pieces of a conversation in the order of ``place`` are its formatted text.
    Rows are range-sorted, so the turns of one long conversation are rendered by many tasks; only the few
    conversations that go over a task's border get their places from a second pass.

    Order: turn (null last); rows of one turn by a hash of role and text.  Null role or text is empty, a null conv_id is a
    conversation of its own, repeated rows are separate turns.  An empty table gives no rows.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    rows = rows.repartitionByRange(*order[:2], F.xxhash64("role", "text")).sortWithinPartitions(*order[:2], F.xxhash64("role", "text"), *order[2:])
    table = store(mapped(rows, _places, widened(rows, part=T.IntegerType(), place=T.LongType(), final=T.BooleanType())), "chat-turns")
    counts = table.groupBy("conv_id", "part").agg(F.count("*").alias("_n"))
    by_part = Window.partitionBy("conv_id").orderBy("part")
    counts = counts.select(
        F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.lead("part").over(by_part).isNotNull().alias("_more"),
    )
    spread = store(counts.filter("_base > 0 or _more"), "chat-borders")
    joined = table.join(bounded(spread), (F.col("part") == F.col("_part")) & F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    placed = joined.select(
        "conv_id", (F.col("place") + F.coalesce("_base", F.lit(0))).alias("place"), (F.col("final") & ~F.coalesce("_more", F.lit(False))).alias("last"), "role", "text"
    )

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            pieces, spans = [], []
            for place, last, role, text in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                piece, marked = template.turn({"role": role, "text": text}, place, last)
                pieces.append(piece)
                spans.append([{"first": a, "end": b} for a, b in marked])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.string()), pa.array(spans, kind)], ["conv_id", "place", "piece", "spans"])

    return mapped(placed, render, "conv_id long, place long, piece string, spans array<struct<first:long,end:long>>")


class Reader:
    """Reads the turns of one conversation back from its formatted text, as it arrives."""

    def __init__(self, template: Template = TEMPLATE):
        self.show, self.rest = template.escapes.show, ""
        self.turns, self.chars, self.loss = 0, 0, 0
        self.said, self.masked = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str, spans: list[dict]) -> None:
        self.chars += len(piece)
        for span in spans:
            text = self.show(piece[span["first"] : span["end"]])
            self.loss += len(text)
            self.masked.update(text.encode())
        *whole, self.rest = (self.rest + piece).split(END + "\n")
        for turn in whole:
            role, _, text = turn.removeprefix("### ").partition(": ")
            self.turns += 1
            self.said.update(f"{self.show(role)}\n{self.show(text)}\n".encode())

    def result(self) -> list:
        return [self.turns, self.said.hexdigest(), self.loss, self.masked.hexdigest(), self.chars]


def read_back(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Digests of every conversation, from its formatted pieces alone: one row per conv_id.

    A digest is one running hash over the turns in order, so a conversation is read by one task, as a
    stream that holds one piece at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reader, done = None, None, []
        for batch in batches:
            for conv, piece, spans in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if key != (conv,):
                    if reader is not None:
                        done.append([key[0], *reader.result()])
                    key, reader = (conv,), Reader(template)
                reader.feed(piece, spans)
            if len(done) >= 1000:
                yield out(done)
                done = []
        if reader is not None:
            done.append([key[0], *reader.result()])
        if done:
            yield out(done)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def out(done: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return mapped(rows, read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
