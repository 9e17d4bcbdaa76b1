import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import SMALL
from tokenizers import Tokenizer

from strideflow.llm.bestfit import best_fit, fitted, pack_whole, place
from strideflow.llm.queries import QUERIES, vocabulary

PATH = vocabulary("word_bpe_49k.json")


def check_sequences(rows, length):
    """Sequences are gapless from 0 and hold at most ``length``; returns their number."""
    sequences = defaultdict(list)
    for sequence, offset, n in rows:
        sequences[sequence].append((offset, n))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
    return len(sequences)


def plain_best_fit(sizes, capacity):
    """Fullest bin that takes the item, by search through all bins."""
    rooms = []
    for size in sizes:
        fits = [r for r in rooms if r >= size]
        if fits:
            rooms[rooms.index(min(fits))] -= size
        else:
            rooms.append(capacity - size)
    return sorted(rooms)


@given(st.lists(st.integers(1, 30), max_size=60))
@settings(max_examples=200, deadline=None)
def test_best_fit_against_search(sizes):
    bins, places = best_fit(sizes, 30)
    check_sequences(zip(bins, places, sizes), 30)
    fills = np.bincount(bins, weights=sizes) if sizes else []
    assert sorted(30 - int(f) for f in fills) == plain_best_fit(sizes, 30)


def test_whole_documents(table, small):
    coder = Tokenizer.from_file(PATH)
    rows = [(r["doc_id"], r["text"]) for r in small("documents").collect()]
    rows += [(90_000, None), (90_001, ""), (90_002, "\n"), (90_003, "Déjà <|endoftext|> VU"), (90_004, "word " * 150_000), (90_005, "word " * 4095), (90_006, "word " * 4096)]
    got = pack_whole(table(rows, 5), PATH).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    total = 0
    for doc_id, text in rows:
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted(by[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(-(-len(ids) // 4096)))
        assert [r["length"] for r in pieces[:-1]] == [4096] * (len(pieces) - 1)
        assert all(r["start"] == 4096 * r["piece"] and bytes(r["ids"]) == ids[r["start"] : r["start"] + r["length"]].tobytes() for r in pieces)
        assert sum(r["length"] for r in pieces) == len(ids)
        total += len(ids)
    n = check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in got], 4096)
    assert -(-total // 4096) <= n <= 1.01 * total / 4096 + 1


def test_query(spark, small):
    got = QUERIES["op12_bestfit"](spark, SMALL).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in small("documents").select("doc_id").collect()}
    coder, texts = Tokenizer.from_file(PATH), {r["doc_id"]: r["text"] for r in small("documents").collect()}
    for r in got[:50]:
        ids = np.array([*coder.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1], "<u4")
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())


def test_rounds_of_a_tree(spark):
    draw = np.random.default_rng(3)
    sizes = np.concatenate([draw.integers(1, 4096, 6000), draw.integers(1, 200, 3000)])
    items = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "key long, size int").repartition(7)
    got = place(items, 4096, task_items=100, fan=3).collect()
    assert sorted(r["key"] for r in got) == list(range(len(sizes)))
    n = check_sequences([(r["bin"], r["offset"], int(sizes[r["key"]])) for r in got], 4096)
    alone = fitted(items, 90, 0, 4096).select("bin").distinct().count()
    assert n <= 1.035 * sizes.sum() / 4096 and n < alone
    again = place(items.repartition(3), 4096, task_items=100, fan=3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_items_that_never_fit_together(spark):
    items = spark.createDataFrame([(i, 2100) for i in range(500)], "key long, size int")
    got = place(items, 4096, task_items=50, fan=2).collect()
    assert len({r["bin"] for r in got}) == 500 and all(r["offset"] == 0 for r in got)


def test_repeats_nulls_and_nothing(table):
    assert pack_whole(table([]), PATH).collect() == []
    got = pack_whole(table([(1, "a"), (1, "a"), (None, "b"), (None, None)]), PATH).collect()
    assert sorted((r["doc_id"] is None, r["length"]) for r in got) == [(False, 2), (False, 2), (True, 1), (True, 2)]
    assert sorted(r["offset"] for r in got) == [0, 2, 4, 6] and len({r["sequence_id"] for r in got}) == 1
