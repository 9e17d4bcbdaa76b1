import random
from collections import defaultdict

import pytest
from llm_cases import words

from strideflow.llm.mixing import mix, source_targets
from strideflow.llm.stages import source_mix


def plain_targets(sizes, weights=(5, 2, 1), epochs=3):
    """Share out the budget by weight, again and again, until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(sizes)
    left = float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > epochs * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = epochs * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5000}, {"a": 0, None: 7, "é": 100, "Z": 3, "z": 900}, {"only": 4}, {"a": 0}):
        got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got == pytest.approx(plain_targets(sizes))


def test_mix(spark, table):
    rng = random.Random(10)
    rows = [(i, "w " * rng.randint(1, 60), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    rows += [(5000, None, "s1"), (5001, "", None), (5002, "x y", None), (None, "x", "s2"), (5003, "q " * 7, "s1"), (5003, "q " * 7, "s1"), (5004, "", "empty")]
    docs = table(rows, 6)
    got = mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(words(text))
        most[source] = max(most[source], len(words(text)))
    want = plain_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["size"] * r["copies"] and r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    assert sum(taken.values()) <= sum(sizes.values())
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 2 * most[source]
    again = mix(docs.repartition(3)).collect()
    key = lambda r: (r["row"]["doc_id"] or -1, r["source"] or "", r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    staged = source_mix(spark, docs, "")
    assert staged.columns == docs.columns and staged.count() == sum(r["copies"] for r in got)


def test_empty(table):
    assert mix(table([])).collect() == []
