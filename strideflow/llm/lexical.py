"""Ranked lexical search: an FP-tree over documents, searched depth-first with bounds from subtree maxima."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_bytes, mapped, pick_bytes, starts_of_parts, steps, store, word_bounds

K = 20
#: Terms of all items that are searched at once; an item's own terms are never parted.
BLOCK_TERMS = 200_000
#: Documents and their entries that share a tree, and documents of a bucket, which is scored as a whole.
TREE_DOCUMENTS, TREE_ENTRIES, BUCKET = 16_384, 4_000_000, 128
#: Stands for a null id, behind all others.
LAST = np.iinfo(np.int64).max

#: Bytes of a term stand for themselves, but A-Z for a-z; all other ASCII parts terms.  Beyond ASCII all is term.
_FOLD = np.full(256, 32, np.uint8)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _FOLD[_low:_high] = np.arange(_low, _high)
_FOLD[65:91] += 32


# ------------------------------------------------------------ terms

def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Terms of texts: codes into a dictionary, bounds of the texts in them, the dictionary."""
    data, starts = column_bytes(column)
    folded = _FOLD[data]
    first, last = word_bounds(folded, starts)
    coded = pick_bytes(folded, first, last).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(first, starts), coded.dictionary


def _counted(owner: np.ndarray, term: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, term) in order, and how often each occurs."""
    pairs, counts = np.unique(owner * max(1, kinds) + term, return_counts=True)
    return pairs // max(1, kinds), pairs % max(1, kinds), counts


def _lists(owner: np.ndarray, count: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    edges = np.searchsorted(owner, np.arange(count + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(values).cast(kind))


def item_terms(items: DataFrame) -> DataFrame:
    """``part``, ``number``, ``before``, ``item_id``, ``terms``, ``repeats`` of items with a term; ``before`` counts terms in the task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = TaskContext.get().partitionId(), 0, 0
        for batch in steps(batches, "text"):
            codes, bounds, words = terms_of(batch.column(1))
            owner, term, repeats = _counted(np.repeat(np.arange(batch.num_rows), np.diff(bounds)), codes, len(words))
            sizes = np.bincount(owner, minlength=batch.num_rows)
            rows = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(batch.num_rows, part, np.int32)), pa.array((part << 36) + number + np.arange(batch.num_rows)), pa.array(before + np.cumsum(sizes) - sizes), batch.column(0),
                    _lists(owner, batch.num_rows, words.take(pa.array(term)), pa.binary()), _lists(owner, batch.num_rows, repeats, pa.int64()), pa.array(sizes),
                ],
                ["part", "number", "before", "item_id", "terms", "repeats", "size"],
            )
            yield rows.filter(pa.array(sizes > 0))
            number, before = number + batch.num_rows, before + int(sizes.sum())

    kinds = "part int, number long, before long, item_id long, terms array<binary>, repeats array<long>, size long"
    return mapped(items.select(F.col("item_id").cast("long"), F.col("text").cast("string")), read, kinds)


def restricted_vectors(documents: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id``, ``n`` (terms with repeats) and the vocabulary's terms in it (``terms``: indices, ``tf``); documents without any term are left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(vocabulary, pa.large_binary())
        for batch in steps(batches, "text"):
            codes, bounds, words = terms_of(batch.column(1))
            n = np.diff(bounds)
            known = pc.index_in(words, value_set=wanted).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            term = known[codes] if len(codes) else codes
            owner, term, tf = _counted(np.repeat(np.arange(batch.num_rows), n)[term >= 0], term[term >= 0], len(vocabulary))
            rows = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), _lists(owner, batch.num_rows, term, pa.int32()), _lists(owner, batch.num_rows, tf, pa.int64())], ["doc_id", "n", "terms", "tf"]
            )
            yield rows.filter(pa.array(n > 0))

    return mapped(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), read, "doc_id long, n long, terms array<int>, tf array<long>")


# ------------------------------------------------------------ tree

def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one unit of weight brings: grows with ``tf``, falls with ``m``."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


@dataclass
class Children:
    """The children of a node, side by side: each is a bucket of documents or a node, with its bounds.

    ``terms`` and ``most`` list what each child's documents hold at best: its largest tf of a term, saturated
    with its smallest m.  ``nodes`` is -1 for buckets, whose documents are ``low`` to ``high``.
    """

    low: np.ndarray
    high: np.ndarray
    nodes: np.ndarray
    terms: np.ndarray | None = None
    most: np.ndarray | None = None
    starts: np.ndarray | None = None


class Tree:
    """Documents as paths of terms, the most frequent first, so documents with equal beginnings share them.

    Sorting the paths lays the trie out in depth-first order: a node is a run of documents with a common
    beginning, and a chain without branches is one node.  Neighbouring branches of few documents share a bucket.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, bounds: np.ndarray, terms: np.ndarray, tf: np.ndarray, bucket: int = BUCKET):
        sizes = np.diff(bounds)
        inner = np.lexsort((terms, np.repeat(np.arange(len(ids)), sizes)))
        terms, tf = terms[inner], tf[inner]
        raw, edges = terms.astype(">u4").tobytes(), (bounds * 4).tolist()
        paths = [raw[a:b] for a, b in zip(edges, edges[1:])]
        order = np.array(sorted(range(len(ids)), key=paths.__getitem__), np.int64)
        self.paths = [paths[i] for i in order]
        self.ids, self.m, sizes = ids[order], m[order], sizes[order]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        moved = np.repeat(bounds[:-1][order] - self.starts[:-1], sizes) + np.arange(len(terms))
        self.terms, self.tf = terms[moved], tf[moved]
        self.value = saturated(self.tf, np.repeat(self.m, sizes))
        self.nodes: list[Children] = []
        self._grow(bucket)
        self._bound()

    def _grow(self, bucket: int) -> None:
        todo = [(0, len(self.ids))]
        while todo:
            low, high = todo.pop()
            depth = _shared(self.paths[low], self.paths[high - 1])
            length = np.diff(self.starts[low : high + 1])
            branch = np.full(high - low, -1, np.int64)  # -1: the path ends at this node
            on = length > depth
            branch[on] = self.terms[self.starts[low:high][on] + depth]
            cuts = [low, *(low + 1 + np.flatnonzero(np.diff(branch))).tolist(), high]
            runs: list[list[int]] = []
            for a, b in zip(cuts, cuts[1:]):
                deeper = b - a > bucket and branch[a - low] >= 0
                if not deeper and runs and not runs[-1][2] and b - runs[-1][0] <= bucket:
                    runs[-1][1] = b
                else:
                    runs.append([a, b, deeper])
            nodes = np.full(len(runs), -1, np.int64)
            for i, (a, b, deeper) in enumerate(runs):
                if deeper:
                    nodes[i] = len(self.nodes) + len(todo) + 1
                    todo.insert(0, (a, b))
            self.nodes.append(Children(np.array([r[0] for r in runs]), np.array([r[1] for r in runs]), nodes))

    def _bound(self) -> None:
        """Largest tf of each term and smallest m below every child; nodes take theirs from their own children."""
        summary: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        for at in range(len(self.nodes) - 1, -1, -1):
            node, found = self.nodes[at], []
            for low, high, below in zip(node.low.tolist(), node.high.tolist(), node.nodes.tolist()):
                if below >= 0:
                    found.append(summary.pop(below))
                else:
                    a, b = self.starts[low], self.starts[high]
                    found.append((*_maxima(self.terms[a:b], self.tf[a:b]), int(self.m[low:high].min())))
            sizes = [len(f[0]) for f in found]
            node.terms = np.concatenate([f[0] for f in found])
            tf, least = np.concatenate([f[1] for f in found]), np.array([f[2] for f in found])
            node.most = saturated(tf, np.repeat(least, sizes))
            node.starts = np.cumsum([0, *sizes[:-1]])
            summary[at] = (*_maxima(node.terms, tf), int(least.min()))

    def search(self, weight: np.ndarray, best: "Best") -> int:
        """Depth-first from the root, the most promising child first; returns the number of documents scored.

        A child is left out when even its bound stays below the k-th score found so far.
        """
        scored, todo = 0, [(np.iinfo(np.int64).max, 0, 0, 0)]
        while todo:
            bound, below, low, high = todo.pop()
            if bound < best.least:
                continue
            if below < 0:
                a, b = self.starts[low], self.starts[high]
                best.add(np.add.reduceat(weight[self.terms[a:b]] * self.value[a:b], self.starts[low:high] - a), self.ids[low:high])
                scored += high - low
                continue
            node = self.nodes[below]
            bounds = np.add.reduceat(weight[node.terms] * node.most, node.starts)
            some = np.flatnonzero(bounds >= best.least)
            some = some[np.argsort(bounds[some], kind="stable")]
            todo += zip(bounds[some].tolist(), node.nodes[some].tolist(), node.low[some].tolist(), node.high[some].tolist())
        return scored


def _shared(first: bytes, last: bytes) -> int:
    """Length of the common beginning of two paths, in terms."""
    a, b = np.frombuffer(first, ">u4"), np.frombuffer(last, ">u4")
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    return int(apart[0]) if len(apart) else n


def _maxima(terms: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(terms, kind="stable")
    terms, tf = terms[order], tf[order]
    first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
    return terms[first], np.maximum.reduceat(tf, first)


class Best:
    """The k best documents of an item so far: highest score first, equal ones by id."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        some = scores >= self.least
        if not some.any():
            return
        scores, ids = np.concatenate([self.scores, scores[some]]), np.concatenate([self.ids, ids[some]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


def weight_of(documents: int, df: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * df + 1)))


def _trees(batches: Iterator[pa.RecordBatch], ranks: np.ndarray, documents: int, terms: int) -> Iterator[Tree]:
    """Trees over the restricted vectors of a task."""
    held: list[tuple[np.ndarray, ...]] = []
    rows = entries = 0

    def grown() -> Tree:
        ids, n, sizes, term, tf = (np.concatenate(c) for c in zip(*held))
        m = 75 + (25 * n * documents) // terms
        return Tree(ids, m, np.concatenate([[0], np.cumsum(sizes)]), ranks[term], tf)

    for batch in batches:
        lists = batch.column(2)
        edges = lists.offsets.to_numpy()
        sizes = np.diff(edges)
        some = np.flatnonzero(sizes)
        term, tf = lists.flatten().to_numpy(zero_copy_only=False), batch.column(3).flatten().to_numpy(zero_copy_only=False)
        ids, n = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        if len(some):
            held.append((ids[some], n[some], sizes[some], term, tf))
            rows, entries = rows + len(some), entries + len(term)
        if rows >= TREE_DOCUMENTS or entries >= TREE_ENTRIES:
            yield grown()
            held, rows, entries = [], 0, 0
    if held:
        yield grown()


def _search_block(items: list, documents: DataFrame, k: int) -> DataFrame | None:
    """The best documents of every item of a block; None if there is no document with a term."""
    vocabulary = sorted({bytes(t) for r in items for t in r["terms"]})
    vectors = store(restricted_vectors(documents, vocabulary), "lexical-vectors")
    count, length = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not count:
        return None
    df = dict(vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # one row a term of the block
    order = sorted(range(len(vocabulary)), key=lambda t: (-df.get(t, 0), t))
    ranks = np.zeros(len(vocabulary), np.int64)
    ranks[order] = np.arange(len(vocabulary))
    place = {word: int(ranks[t]) for t, word in enumerate(vocabulary)}
    weights = np.array([weight_of(count, df.get(t, 0)) for t in order], np.int64)
    wanted = []
    for r in items:
        at = np.array([place[bytes(t)] for t in r["terms"]], np.int64)
        wanted.append((r["number"], r["item_id"], at, weights[at] * np.array(r["repeats"], np.int64)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in wanted]
        weight = np.zeros(len(vocabulary), np.int64)
        for tree in _trees(batches, ranks, count, length):
            for (_, _, at, w), found in zip(wanted, best):
                weight[at] = w
                tree.search(weight, found)
                weight[at] = 0
        for (number, item_id, _, _), found in zip(wanted, best):
            if len(found.ids):
                ids = pa.array(found.ids, mask=found.ids == LAST)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(ids), pa.int64()), pa.array([item_id] * len(ids), pa.int64()), ids, pa.array(found.scores)], ["number", "item_id", "doc_id", "score"]
                )

    return mapped(vectors, search, "number long, item_id long, doc_id long, score long")


def ranked_search(items: DataFrame, documents: DataFrame, k: int = K) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score``: the k best documents of each item, scores above 0 only.

    ``items``: item_id, text; ``documents``: doc_id, text.  Texts are read whole; terms are runs of ASCII letters
    and digits and all characters beyond ASCII, A-Z lower-cased.  Documents keep only terms that items ask for.
    Tasks put some 16 thousand documents into an FP-tree, each child with the largest tf and smallest m below it,
    and search it item by item, keeping one list of the k best a task and item.  Items are asked in blocks of about
    200 thousand terms (driver memory), each against all documents.

    Null and empty texts have no terms: such items give no rows, such documents do not count.  Rows with equal
    or null item_ids are items of their own; rows with equal doc_ids are documents of their own, and null doc_ids
    come last among equal scores.  Empty tables give no rows.  Other columns are not read.
    """
    spark = documents.sparkSession
    table = store(item_terms(items), "lexical-items")
    block = F.floor((F.col("base") + F.col("before")) / BLOCK_TERMS)
    asked = table.join(starts_of_parts(table, "size"), "part").withColumn("block", block)
    found = None
    for (number,) in sorted(asked.select("block").distinct().collect()):
        part = _search_block(asked.filter(F.col("block") == number).orderBy("number").collect(), documents, k)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
