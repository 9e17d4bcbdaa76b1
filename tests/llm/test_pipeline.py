from collections import defaultdict

import corpus_pipeline
from llm_cases import SMALL, words
from test_substrings import shared_words

from strideflow.llm.common import store


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert names == ["toxicity", "near_duplicates", "repeated_passages", "source_mix", "packing"]
    kept = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = kept[name] = store(stage(spark, docs, SMALL), f"test-{name}")
        assert name == "packing" or docs.columns == columns
    text = {n: {r["doc_id"]: r["text"] for r in d.collect()} for n, d in kept.items() if n != "packing"}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    gone = set(text["documents"]) - set(text["toxicity"])
    assert gone and all(labels.get(i, 1) == 1 for i in gone)
    from test_simhash import groups, plain

    roots = set(groups({i: plain(t) for i, t in text["toxicity"].items()}).values())
    assert set(text["near_duplicates"]) == roots
    before, after = text["near_duplicates"], text["repeated_passages"]
    touched = {i for i, t in before.items() if after.get(i) != t}
    assert set(shared_words(before)) <= touched and not shared_words(after)
    assert set(text["source_mix"]) <= set(after)
    words_in, copies = sum(len(words(t)) for t in after.values()), [len(words(r["text"])) for r in kept["source_mix"].collect()]
    assert 0.8 * words_in < sum(copies) <= words_in
    spans = defaultdict(int)
    for r in kept["packing"].collect():
        spans[r["doc_id"]] += r["length"]
    assert set(spans) == set(text["source_mix"])
