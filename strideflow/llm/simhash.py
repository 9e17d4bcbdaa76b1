"""SimHash near-duplicates: fingerprints meet in the middle of their Hamming balls."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, keyed, mapped, steps, store
from .components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints that share a bucket's own prefix, about; the prefix grows with the table to keep it.
BUCKET_PRINTS = 1 << 12
LEAST_PREFIX = 8
#: Variants that one step inside a bucket sorts.
STEP_VARIANTS = 3_000_000

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of one UTF-8 text, unsigned."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.lower().split()  # bytes: lowers A-Z and splits at ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(begins[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())
        hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in spans), np.uint64, len(words) - SHINGLE + 1)
    planes = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(planes[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text"):
        data, starts = column_bytes(batch.column(1))
        raw, edges = data.tobytes(), starts.tolist()
        prints = np.fromiter((fingerprint(raw[i:j]) for i, j in zip(edges, edges[1:])), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])


def flips(bits: int, most: int) -> np.ndarray:
    """All masks with at most ``most`` of the lowest ``bits`` bits set."""
    masks = [sum(1 << i for i in chosen) for n in range(most + 1) for chosen in combinations(range(bits), n)]
    return np.array(masks, np.uint64)


def _star(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[new])
        if np.array_equal(new, label):
            return label
        label = new


def meet(prints: np.ndarray, bucket: int, prefix: int, half: int = RADIUS // 2) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indices of distinct ``prints`` that share a variant within ``half`` flips whose first ``prefix`` bits are ``bucket``."""
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    todo = [(bucket, prefix)]
    while todo:
        bucket, prefix = todo.pop()
        low = 64 - prefix
        left = half - np.bitwise_count((prints >> np.uint64(low)) ^ np.uint64(bucket)).astype(np.int64)
        masks = [flips(low, n) for n in range(half + 1)]
        if prefix < 60 and sum(int((left == n).sum()) * len(m) for n, m in enumerate(masks)) > STEP_VARIANTS:
            todo += [(bucket << 2 | v, prefix + 2) for v in range(4)]
            continue
        variants, owners = [], []
        for n, mask in enumerate(masks):
            own = np.flatnonzero(left == n)
            variants.append((prints[own][:, None] & np.uint64((1 << low) - 1) ^ mask).ravel())
            owners.append(np.repeat(own, len(mask)))
        variants, owners = np.concatenate(variants), np.concatenate(owners)
        order = np.argsort(variants)
        variants = variants[order]
        same = np.flatnonzero(variants[1:] == variants[:-1])
        found_a.append(owners[order[same]])
        found_b.append(owners[order[same + 1]])
    pairs = np.unique(np.stack([np.concatenate(found_a), np.concatenate(found_b)], axis=1), axis=0)
    a, b = pairs[:, 0], pairs[:, 1]
    close = np.bitwise_count(prints[a] ^ prints[b]) <= 2 * half
    return a[close], b[close]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``print``) that connect all at most ``radius`` (even) bits apart.

    Every fingerprint stands for all its variants within half the radius.  They are dealt out by their
    first bits: a row goes to each prefix that a variant can have (1 + p + p(p-1)/2 of them), and the
    variants with that prefix are written out, sorted and compared there.  Two fingerprints within the
    radius share a variant, so they meet in its bucket.  A bucket gives a star per group, not pairs.
    """
    half = radius // 2
    count = prints.count()
    prefix = LEAST_PREFIX
    while count >> prefix > BUCKET_PRINTS:
        prefix += 1
    masks = F.array(*[F.lit(int(m)) for m in flips(prefix, half)])
    dealt = prints.select("print", F.explode(masks).alias("_mask")).select(
        F.shiftrightunsigned("print", 64 - prefix).bitwiseXOR(F.col("_mask")).alias("bucket"), "print"
    )

    def bucket_links(key: tuple, table: pa.Table) -> pa.Table:
        held = np.sort(table.column("print").combine_chunks().to_numpy().view(np.uint64))
        a, b = meet(held, key[0].as_py(), prefix, half)
        label = _star(len(held), a, b)
        own = np.flatnonzero(label != np.arange(len(held)))
        return pa.table({"a": pa.array(held[own].view(np.int64)), "b": pa.array(held[label[own]].view(np.int64))})

    return dealt.groupBy("bucket").applyInArrow(bucket_links, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` for every row of (doc_id, text).

    Texts are lower-cased (A-Z), split at ASCII white space and hashed as 4-word shingles with repeats; a
    shorter text is one shingle; a null or wordless text has fingerprint zero.  Fingerprints at most
    ``radius`` bits apart are linked, and ``component_id`` is the smallest doc_id reachable (null doc_ids
    count only if nothing else is there).  Equal fingerprints meet before the search, so copies cost one
    entry.  Repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    prints = store(mapped(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _prints, "doc_id long, print long"), "simhash-prints")
    distinct = store(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    groups = components(links(distinct.select("print"), radius))
    first = distinct.join(groups, F.col("print") == F.col("node"), "left").select("print", F.coalesce("label", "print").alias("label"), "first")
    least = first.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = store(first.join(least, "label").select(F.col("print").alias("_print"), "component_id"), "simhash-classes")
    return prints.join(classes, F.col("print") == F.col("_print")).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each near-duplicate group of ``documents``: that with the smallest doc_id, all columns kept.

    Rows that repeat a doc_id and rows without one are documents of their own, behind all others: of equal copies one
    row stays, whatever their ids.  Null, empty and very long texts are compared like any other; an empty table stays
    empty; columns of any name are kept as they are.
    """
    rows = keyed(documents)
    groups = near_duplicates(rows.select(F.col("_key").alias("doc_id"), F.col("row.text").alias("text")), radius)
    gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("_drop"))
    return rows.join(gone, F.col("_key") == F.col("_drop"), "left_anti").select("row.*")
