"""Quality rules as weak supervision: rules vote or abstain, and how far to trust each comes from how they agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, column_bytes, mapped, mixed, pick_bytes, shingle_hashes, steps, word_bounds

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent
ROUNDS = 50
#: Rates of the votes bad, abstain and good before any data, and what share of all documents they weigh.
START_BAD, START_GOOD, BELIEF = (0.30, 0.30, 0.40), (0.02, 0.18, 0.80), 0.01
START_SHARE, SHARE = 0.8, (0.05, 0.95)
#: A document is kept if its posterior probability of good quality is at least this.
KEEP = 0.5

_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_letters long, n_digits long, n_marks long, n_punctuation long, n_symbol_words long"
_NAMES = [part.split()[0] for part in _MEASURES.split(", ")]


def _table(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_SYMBOL = _table(SYMBOLS)
_UPPER = _table(bytes(range(65, 91)))
_LETTER = _table(bytes([*range(65, 91), *range(97, 123)]))
_DIGIT = _table(bytes(range(48, 58)))
_MARK = _table(b"!?")
_PUNCTUATION = _table(bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def _earlier(owner: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which entries equal an earlier entry of the same owner."""
    order = np.lexsort((key, owner))
    same = (owner[order][1:] == owner[order][:-1]) & (key[order][1:] == key[order][:-1])
    out = np.zeros(len(owner), bool)
    out[order[1:][same]] = True
    return out


def measures(texts: pa.Array) -> list[np.ndarray]:
    """The columns of ``_MEASURES`` of whole texts."""
    data, starts = column_bytes(texts)
    texts_n = len(starts) - 1

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[starts[1:]] - total[starts[:-1]]

    first, last = word_bounds(data, starts)
    bounds = np.searchsorted(first, starts)
    coded = pick_bytes(data, first, last).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.uint64)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    sizes = np.concatenate([[0], np.cumsum(chars[last] - chars[first])])

    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data], dtype=np.int64)])
    odd = np.concatenate([[0], np.cumsum(symbols[last] > symbols[first])])

    # lines: each text is cut at its line feeds; only lines with a word count
    ends_line = data == 10
    line_first = np.sort(np.concatenate([starts[:-1], np.flatnonzero(ends_line) + 1]))
    # a feed at the end of a text opens an empty line whose place is the start of the next text
    line_last = np.sort(np.concatenate([starts[1:], np.flatnonzero(ends_line)]))
    with_word = np.searchsorted(first, line_last) > np.searchsorted(first, line_first)
    line_first, line_last = line_first[with_word], line_last[with_word]
    lines = pick_bytes(data, line_first, line_last).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    line_owner = np.searchsorted(starts, line_first, "right") - 1
    duplicate = np.bincount(line_owner[_earlier(line_owner, lines)], minlength=texts_n)

    windows, edges = shingle_hashes(mixed(codes), bounds, WINDOW)
    counts = np.diff(edges)
    owner = np.repeat(np.arange(texts_n), counts)
    key = mixed(windows ^ mixed(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(twice) + np.repeat(bounds[:-1] - edges[:-1], counts)[twice]
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    repeated = inside[bounds[1:]] - inside[bounds[:-1]]
    return [
        np.diff(bounds), sizes[bounds[1:]] - sizes[bounds[:-1]], per_text(_SYMBOL[data]), duplicate, repeated,
        per_text(_UPPER[data]), per_text(_LETTER[data]), per_text(_DIGIT[data]), per_text(_MARK[data]),
        per_text(_PUNCTUATION[data]), odd[bounds[1:]] - odd[bounds[:-1]],
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text"):
        columns = [pa.array(x.astype(np.int64)) for x in measures(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *_NAMES])


def votes() -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains."""
    words = F.greatest(F.col("n_words"), F.lit(1))

    def share(part: str, whole: Column, good: float, bad: float, percent: int = 100) -> Column:
        x = percent * F.col(part) / whole
        return F.when(x <= good, 1).when(x > bad, -1).otherwise(0)

    length = F.col("word_chars") / words
    letters = F.greatest(F.col("n_letters"), F.lit(1))
    return {
        "symbols": share("n_symbols", words, 2, 10),
        "word_length": F.when(length.between(3, 12), 1).when(~length.between(2, 16), -1).otherwise(0),
        "lines": share("n_dup_lines", words, 0.5, 3),
        "repeats": share("n_repeat_words", words, 2, 15),
        "capitals": F.when(F.col("n_letters") < 20, 0).otherwise(share("n_upper", letters, 15, 40)),
        "digits": share("n_digits", F.greatest(F.col("word_chars"), F.lit(1)), 5, 20),
        "marks": share("n_marks", words, 5, 25),
        "punctuation": F.when(F.col("n_words") < 30, 0).otherwise(share("n_punctuation", F.greatest(F.col("word_chars"), F.lit(1)), 8, 14)),
        "symbol_words": share("n_symbol_words", words, 2, 10),
        "size": F.when(F.col("n_words") >= 30, 1).when(F.col("n_words") < 15, -1).otherwise(0),
    }


def agreement(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """How often each rule votes each way on good and on bad documents, and the share of good ones.

    Expectation-maximisation over vote patterns: posteriors from the current rates, then rates from the
    posteriors.  The result is indexed by [good or bad, rule, vote + 1].  A vote for bad is never allowed to
    be likelier on good documents than on bad ones, so no rule is turned round.
    """
    rates = np.repeat(np.array([START_BAD, START_GOOD])[:, None, :], patterns.shape[1], axis=1)
    good = START_SHARE
    for _ in range(ROUNDS):
        p = posterior(patterns, rates, good)
        for k, weight in enumerate((counts * (1 - p), counts * p)):
            seen = np.stack([weight @ (patterns == v) for v in (-1, 0, 1)], axis=1)
            start = np.array((START_BAD, START_GOOD)[k]) * BELIEF * counts.sum()
            rates[k] = (seen + start + 1e-6) / (seen.sum(axis=1, keepdims=True) + start.sum() + 3e-6)
        turned = rates[1, :, 0] > rates[0, :, 0]
        rates[:, turned, 0] = rates[:, turned, 0].mean(axis=0)
        good = float(np.clip(counts @ p / max(counts.sum(), 1e-9), *SHARE))
    return rates, good


def posterior(patterns: np.ndarray, rates: np.ndarray, good: float) -> np.ndarray:
    """Probability of good quality for each vote pattern."""
    ratio = np.log(rates[1]) - np.log(rates[0])
    odds = np.log(good / (1 - good)) + ratio[np.arange(patterns.shape[1]), patterns + 1].sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(odds, -35, 35)))


def judge(documents: DataFrame) -> DataFrame:
    """Measures, ``base_failed``, ``quality`` (posterior) and ``kept`` of every row of (doc_id, text).

    Rules vote on whole-text measures.  The votes of all documents are counted by pattern (at most three to
    the number of rules), the driver fits the rates on those counts, and every document gets the posterior
    of its pattern.  ``base_failed``: under ten words, or over a fifth of the words in repeated five-word
    windows.  Null text has no words.  Repeated rows stay; an empty table gives no rows.
    """
    measured = mapped(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _measured, f"doc_id long, {_MEASURES}")
    rules = votes()
    pattern = F.concat_ws(",", *[v.cast("string") for v in rules.values()])
    voted = measured.withColumn("pattern", pattern)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    voted = voted.withColumn("base_failed", failed)
    found = voted.groupBy("pattern").count().collect()
    patterns = np.array([[int(v) for v in r["pattern"].split(",")] for r in found], int).reshape(-1, len(rules))
    rates, good = agreement(patterns, np.array([r["count"] for r in found], float))
    quality = posterior(patterns, rates, good)
    spark = documents.sparkSession
    table = spark.createDataFrame([(r["pattern"], float(q)) for r, q in zip(found, quality)], "_pattern string, quality double")
    out = voted.join(bounded(table), F.col("pattern") == F.col("_pattern"), "left").drop("_pattern", "pattern")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP))
