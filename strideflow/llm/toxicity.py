"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, SPACE, column_bytes, lower_ascii, mapped, mixed, pick_bytes, steps

BITS = 20
#: Text bytes whose features are made at once.
FEATURE_BYTES = 2 << 20
#: Learning reads at most so many labelled documents of each class: the first by a hash of their id.
SAMPLE = {1: 4000, 0: 8000}
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.1
#: Bytes of a word's stems, which count as words of their own.
STEMS = (7,)
#: Log-odds of a document without any weighted feature.
PRIOR = -2.0

_BREAK = SPACE.copy()
for _a, _b in ((33, 39), (40, 48), (58, 65), (91, 97), (123, 127)):
    _BREAK[_a:_b] = True


@dataclass
class Weights:
    """Nonzero weights by feature, at most ``2 ** BITS``."""

    at: np.ndarray
    value: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.at] = self.value
        return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, stems, pairs of neighbours and pairs that skip a word, each once a text; and the bounds of the texts."""
    import xxhash

    data, starts = column_bytes(texts)
    data = lower_ascii(data)
    inside = ~_BREAK[data]
    opens, ends = inside.copy(), inside.copy()
    if len(data):
        opens[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = starts[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        opens[edge] |= inside[edge]
        ends[edge - 1] |= inside[edge - 1]
    first, last = np.flatnonzero(opens), np.flatnonzero(ends) + 1
    coded = pick_bytes(data, first, last).dictionary_encode()
    vocabulary, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)

    def hashed(size: int | None) -> np.ndarray:
        known = np.fromiter((xxhash.xxh64_intdigest(w[:size], size or 0) for w in vocabulary), np.uint64, len(vocabulary))
        return known[codes] if len(known) else np.zeros(0, np.uint64)

    word = hashed(None)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(np.searchsorted(first, starts)))
    grams, owners = [mixed(word), *(mixed(hashed(size)) for size in STEMS)], [owner] * (1 + len(STEMS))
    for gap in (1, 2):
        inner = owner[gap:] == owner[:-gap]
        grams.append(mixed(word[:-gap] * np.uint64(0x9E3779B97F4A7C15) + mixed(word[gap:]) + np.uint64(gap))[inner])
        owners.append(owner[gap:][inner])
    at = np.concatenate(grams) >> np.uint64(64 - BITS)
    keys = np.unique((np.concatenate(owners).astype(np.uint64) << np.uint64(BITS)) | at)
    bounds = np.searchsorted(keys, np.arange(len(starts), dtype=np.uint64) << np.uint64(BITS))
    return (keys & np.uint64((1 << BITS) - 1)).astype(np.int64), bounds


class Learner:
    """Per-coordinate learning rates; a weight stays zero until its gradients outweigh ``L1``."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = 1 / (1 + np.exp(-np.clip(PRIOR + w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += error - (np.sqrt(n + error * error) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + error * error


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    learner = Learner()
    for batch in steps(batches, "text", FEATURE_BYTES):
        at, bounds = features(batch.column(batch.schema.get_field_index("text")))
        labels = batch.column(batch.schema.get_field_index("toxic")).to_pylist()
        for i, label in enumerate(labels):
            learner.learn(at[bounds[i] : bounds[i + 1]], label)
    w = learner.weights(slice(None)).astype(np.float32)
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()]), pa.array([w[at].tobytes()])], ["at", "value"])


def held_out(doc_id) -> F.Column:
    """Documents that learning never sees: crc32 of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> Weights:
    """Weights from the labelled documents that are not held out.

    A document with several labels counts as toxic if one says so; null labels and ids are left out.  At
    most ``sample`` documents a class are read, so one task can learn from them in a fixed order, row by
    row, ``EPOCHS`` times; its result is one row of nonzero weights.
    """
    sample = sample or SAMPLE
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id")
    chosen = [known.filter(F.col("toxic") == k).orderBy(order, "doc_id").limit(n) for k, n in sample.items()]
    chosen = chosen[0].union(chosen[1]).withColumnRenamed("doc_id", "_id")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"), F.explode(F.array(*[F.lit(e) for e in range(EPOCHS)])).alias("epoch"))
    rows = rows.repartition(1).sortWithinPartitions("epoch", F.xxhash64("epoch", "doc_id"), "doc_id", "text")
    got = mapped(rows, _train, "at binary, value binary").collect()
    at, value = (b"".join(bytes(r[k]) for r in got) for k in ("at", "value"))
    return Weights(np.frombuffer(at, np.int32), np.frombuffer(value, np.float32))


def score(documents: DataFrame, weights: Weights, carry: list[str] = ("doc_id",)) -> DataFrame:
    """``row`` (struct of the ``carry`` columns) and ``score`` between 0 and 1 of every whole text.

    A null or empty text scores the prior.  Repeated rows stay, an empty table gives no rows.
    """
    sent = documents.sparkSession.sparkContext.broadcast(weights)
    documents.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    @F.arrow_udf("double")
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        dense = sent.value.dense()
        for column in columns:
            found = [np.zeros(0)]
            for part in steps(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text", FEATURE_BYTES):
                at, bounds = features(part.column(0))
                sums = np.append(0.0, np.cumsum(dense[at], dtype=np.float64))
                found.append(1 / (1 + np.exp(-np.clip(PRIOR + sums[bounds[1:]] - sums[bounds[:-1]], -35, 35))))
            yield pa.array(np.concatenate(found))

    return documents.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), scored(F.col("text").cast("string")).alias("score"))
