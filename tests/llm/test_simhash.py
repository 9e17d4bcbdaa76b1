import re

import numpy as np
import xxhash
from llm_cases import SMALL, words

from strideflow.llm.simhash import fingerprint, keep_first, links, meet, near_duplicates


def plain(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints):
    """Smallest id reachable over fingerprints at most four bits apart."""
    ids = sorted(i for i in prints if i is not None)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_edge_texts():
    for text in ("", " \n", "One", "one two three", "A b C d", "É é\x0bx y z", "a " * 50_000):
        assert fingerprint(text.encode()) == plain(text)


def test_meeting_in_the_middle_loses_no_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64) * np.uint64(2)
    near = [b ^ np.uint64(sum(1 << int(i) for i in rng.choice(64, n, replace=False))) for b in base for n in (1, 3, 4, 5)]
    prints = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    found = set()
    for bucket in range(16):
        found |= {(int(x), int(y)) for x, y in zip(*meet(prints, bucket, 4))}
    reach = {i: i for i in range(len(prints))}

    def find(i):
        while reach[i] != i:
            i = reach[i]
        return i

    for a, b in found:
        reach[max(find(a), find(b))] = min(find(a), find(b))
    apart = np.bitwise_count(prints[:, None] ^ prints[None, :])
    assert all(apart[a, b] <= 4 for a, b in found)
    for i, j in zip(*np.nonzero(apart <= 4)):
        assert find(i) == find(j)


def test_links_of_a_chain(spark):
    rows = [((1 << (4 * i)) - 1 if i < 16 else -1,) for i in range(17)]  # each four bits from the next
    df = spark.createDataFrame(rows, "print long")
    found = links(df).collect()
    assert {x for r in found for x in r} == {r[0] for r in rows}


def test_against_plain_version(spark, table):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = list(texts.items()) + [(90001, None), (90002, ""), (90003, " \n"), (90004, "one"), (90005, "ONE"), (90006, "one two"), (90007, "w " * 30_000)]
    prints = {i: plain(t) for i, t in rows}
    want = groups(prints)
    got = near_duplicates(table(rows + [(90004, "one")])).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert r["fingerprint"] == format(prints[r["doc_id"]], "016x") and r["component_id"] == want[r["doc_id"]]
    kept = keep_first(table(rows))
    assert "score" in kept.columns and {r["doc_id"] for r in kept.collect()} == set(want.values())


def test_empty(table):
    assert near_duplicates(table([])).collect() == []
    assert [tuple(r) for r in near_duplicates(table([(None, "a b c d e")])).select("doc_id", "component_id").collect()] == [(None, None)]
