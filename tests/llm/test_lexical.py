import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from strideflow.llm import lexical
from strideflow.llm.lexical import Best, Tree, ranked_search, saturated

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(items, documents, k=20):
    """All scores, by the definition."""
    docs = [(doc_id, Counter(terms(text))) for doc_id, text in documents]
    docs = [(doc_id, c, sum(c.values())) for doc_id, c in docs if c]
    total, df = sum(n for *_, n in docs), Counter(t for _, c, _ in docs for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c, n in docs:
            m = 100 - 25 + (25 * n * len(docs)) // total
            score = sum(floor(1000 * log((2 * len(docs) + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id, score))
        out += [(item_id, rank, doc_id, score) for rank, (_, _, doc_id, score) in enumerate(sorted(scored, key=lambda x: x[:3] if not x[1] else (*x[:2], 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id long, text string, terms string, n long").repartition(3)


def found(items, documents):
    return sorted((tuple(r) for r in ranked_search(items, documents).collect()), key=str)


def test_words_and_ties(items, table):
    documents = [
        (1, "The cat sat"), (2, "the CAT sat"), (3, "dog-dog, dog"), (4, "Éclair éclair cat\x7fcat"), (5, "the the the"), (6, None), (7, ""), (8, "-- !!"),
        (9, "naïve\u0085x naïve"), (None, "the cat sat"), (9, "cat " * 50), (9, "cat " * 50), (10, "zebra " * 100_000 + "cat"),
    ]
    asked = [(1, "The cat"), (2, "dog dog zebra"), (3, None), (4, "éclair"), (5, "nothing here"), (6, ""), (7, "cat cat cat the"), (8, "naïve\u0085x"), (None, "sat")]
    assert found(items(asked), table(documents)) == plain(asked, documents)


def test_more_than_twenty_and_equal_rows(items, table):
    documents = [(i % 40, f"common word{i % 7} text") for i in range(200)]
    asked = [(1, "common"), (2, "word3 text text"), (3, "word1 word2"), (3, "word4")]
    got, want = found(items(asked), table(documents)), plain(asked, documents)
    assert got == want and len(got) == 80


def test_nothing(items, table):
    assert found(items([]), table([(1, "a")])) == [] == found(items([(1, "a")]), table([])) == found(items([(1, "a")]), table([(1, "-"), (2, None)]))
    assert found(items([(1, "b")]), table([(1, "a")])) == []


def test_blocks_of_items(items, table, monkeypatch):
    documents = [(i, f"w{i % 3} w{i % 5} w{i % 11}") for i in range(60)]
    asked = [(i, f"w{i} w{i + 1} w{i + 4}") for i in range(9)]
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 5)
    assert found(items(asked), table(documents)) == plain(asked, documents)


def _tree(rows, bucket):
    """A tree from (id, m, {term: tf})."""
    sizes = [len(v) for *_, v in rows]
    return Tree(
        np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.concatenate([[0], np.cumsum(sizes)]),
        np.array([t for *_, v in rows for t in v]), np.array([c for *_, v in rows for c in v.values()]), bucket,
    )


@pytest.mark.parametrize("bucket", [1, 3, 50])
def test_tree_against_all_scores(bucket):
    draw = np.random.default_rng(bucket)
    rows = []
    for i in range(400):
        held = draw.choice(30, draw.integers(1, 12), replace=False, p=np.arange(30, 0, -1) / 465)
        rows.append((i, int(draw.integers(76, 200)), {int(t): int(draw.integers(1, 9)) for t in held}))
    rows += [(1000 + i, 90, {2: 1, 5: 1}) for i in range(120)]  # one path that many share
    tree = _tree(rows, bucket)
    assert sorted(tree.ids.tolist()) == sorted(r[0] for r in rows)
    for _ in range(30):
        weight = np.zeros(30, np.int64)
        weight[draw.choice(30, 4, replace=False)] = draw.integers(1, 9000, 4)
        best = Best(20)
        tree.search(weight, best)
        scores = sorted((-sum(int(weight[t]) * int(saturated(c, m)) for t, c in v.items()), i) for i, m, v in rows)
        want = [(-s, i) for s, i in scores if s < 0][:20]
        assert list(zip(best.scores.tolist(), best.ids.tolist())) == want


def test_bounds_leave_documents_out():
    # a few documents hold rare terms that an item asks for: most buckets are never scored
    draw = np.random.default_rng(9)
    rows = []
    for i in range(5000):
        held = {int(t): int(draw.integers(1, 4)) for t in draw.choice(20, 6, replace=False)}
        if i % 200 == 0:
            held |= {100 + i // 200 % 3: 2, 103: 1}
        rows.append((i, 100, held))
    tree, weight, best = _tree(rows, 64), np.zeros(200, np.int64), Best(20)
    weight[[1, 2, 100, 101, 102, 103]] = 300, 300, 8000, 8000, 8000, 8000
    assert tree.search(weight, best) < 0.5 * len(rows) and len(best.ids) == 20
    assert all(i % 200 == 0 for i in best.ids.tolist())
