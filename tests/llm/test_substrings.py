from collections import defaultdict

import numpy as np
import pytest
from llm_cases import SMALL, words

from strideflow.llm import substrings
from strideflow.llm.simhash import keep_first
from strideflow.llm.substrings import compact_windows, cut_repeats, repeated_passages

RUN = 51


def shared_words(texts):
    """Words of each document inside runs of 51 words that a document with a smaller id has too."""
    first = {}
    for i in sorted(texts):
        w = words(texts[i])
        for k in range(len(w) - RUN + 1):
            first.setdefault(tuple(w[k : k + RUN]), i)
    out = defaultdict(set)
    for i, t in texts.items():
        w = words(t)
        for k in range(len(w) - RUN + 1):
            if first[tuple(w[k : k + RUN])] < i:
                out[i].update(range(k, k + RUN))
    return out


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(n))


def test_windows_cover_every_run_once():
    rng = np.random.default_rng(2)
    values, bounds = rng.integers(0, 30, 400).astype(np.uint64) << np.uint64(40), np.array([0, 150, 150, 155, 400])
    first, centre, last = compact_windows(values, bounds, 10)
    for low, high in zip(bounds, bounds[1:]):
        for i in range(low, high):
            for j in range(i + 9, high):
                held = (first <= i) & (i <= centre) & (centre <= j) & (j <= last)
                assert held.sum() == 1 and centre[held][0] == i + values[i : j + 1].argmin()


def test_planted_passages(spark, table):
    rng = np.random.default_rng(3)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    passage, long = prose(rng, 55), prose(rng, 400)
    for i in range(40):  # one passage in many documents
        texts[50_000 + i] = f"{prose(rng, 60)} {passage}\n{prose(rng, 60)}"
    texts[51_000], texts[51_001] = f"{long} {prose(rng, 30)}", f"{prose(rng, 80)} {long}"
    texts[51_002], texts[51_003], texts[51_004] = "é " * 500, "é " * 500, None
    texts[51_005], clean = "", prose(rng, 3000)
    texts[51_006] = clean
    rows = list(texts.items()) + [(51_007, prose(rng, 49)), (51_008, "x"), (None, passage), (51_006, clean)]
    found = repeated_passages(table(rows, 4)).collect()
    covered = defaultdict(set)
    for r in found:
        assert r["ref_doc_id"] < r["doc_id"] and r["similarity"] >= 0.8 and r["n_words"] >= 50
        covered[r["doc_id"]].update(range(r["first_word"], r["first_word"] + r["n_words"]))
    want = shared_words({i: t for i, t in texts.items() if t})
    assert all(want[i] <= covered[i] for i in want)
    assert 51_006 not in covered and set(covered) <= set(want) | {i for i in covered if i < 50_000}

    cut = {r["doc_id"]: r for r in cut_repeats(table(rows, 4)).collect()}
    assert cut[51_006]["text"] == clean and cut[51_006]["n_chars"] == len(clean) and cut[51_006]["score"] == "x"
    assert cut[51_004]["text"] is None and cut[51_000]["text"] == texts[51_000]
    left = {i: r["text"] for i, r in cut.items() if r["text"]}
    assert sum(passage in t for i, t in left.items() if i is not None) == 1 and sum(long in t for t in left.values()) == 1
    assert set(words(texts[50_001])) - set(words(passage)) <= set(words(left[50_001]))


def lost_words(table, texts, parts=4):
    covered = defaultdict(set)
    for r in repeated_passages(table(list(texts.items()), parts)).collect():
        covered[r["doc_id"]].update(range(r["first_word"], r["first_word"] + r["n_words"]))
    return {i: w - covered[i] for i, w in shared_words(texts).items() if w - covered[i]}


def test_first_holder_is_not_alike(table):
    """An earlier partial variant, the first 49 words or a frequent line do not hide a passage."""
    rng = np.random.default_rng(11)
    texts, line = {}, prose(rng, 12)
    for i in range(60):
        texts[i] = f"{prose(rng, 40)} {line} {prose(rng, 40)}"
    for case in range(30):
        i = 1000 + 10 * case
        passage = f"{prose(rng, 25)} {line} {prose(rng, 23)}" if case % 3 == 2 else prose(rng, 60 if case % 3 == 0 else 55)
        w = passage.split()
        changed = [x if k not in (20, 40) else "changed" for k, x in enumerate(w)]
        texts[i] = f"{prose(rng, 30)} {' '.join(changed if case % 3 == 0 else w[:49])} {prose(rng, 30)}"
        for k in range(1, 4):
            texts[i + k] = f"{prose(rng, 30)} {passage} {prose(rng, 30)}"
    assert lost_words(table, texts, 1) == {} and lost_words(table, texts, 7) == {}


def test_passage_twice_in_one_document(spark):
    """Both places of a passage, word for word or nearly so, lead to its source in another partition."""
    rng = np.random.default_rng(12)
    texts, spots = {}, {}
    for case in range(12):
        w = prose(rng, 90).split()
        near = " ".join("changed" if k == 45 else x for k, x in enumerate(w)) if case % 2 else " ".join(w)
        texts[2 * case] = f"{prose(rng, 20)} {' '.join(w)} {prose(rng, 20)}"
        texts[2 * case + 1] = f"{prose(rng, 70)} {near} {prose(rng, 70)} {near} {prose(rng, 20)}"
        spots[2 * case + 1] = ({*range(75, 155)}, {*range(235, 315)})
    rows = spark.sparkContext.parallelize(sorted(texts.items(), key=lambda x: x[0] % 2), 2)
    covered = defaultdict(set)
    for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        covered[r["doc_id"]].update(range(r["first_word"], r["first_word"] + r["n_words"]))
    both = {i: (a <= covered[i], b <= covered[i]) for i, (a, b) in spots.items()}
    assert all(a == b for a, b in both.values()) and all(a for i, (a, _) in both.items() if i % 4 == 1), both
    assert any(a for i, (a, _) in both.items() if i % 4 == 3)


def near_copy(rng, kind, w):
    """(source, copy, words of the copy that are alike) of a near copy of ``w``."""
    def changed(words, places):
        return ["other%d" % rng.integers(1e6) if k in places else x for k, x in enumerate(words)]

    half = len(w) // 2
    if kind == "changed":  # single words
        return w, changed(w, set(rng.choice(np.arange(5, len(w) - 5), len(w) // 60, replace=False).tolist())), len(w)
    if kind == "put in":  # text in the middle of the source, a word changed in each half
        return [*w[:half], *prose(rng, 30).split(), *w[half:]], changed(w, {half // 2, half + half // 2}), len(w)
    if kind == "left out":  # text that the source lacks
        return w, changed([*w[:half], *prose(rng, 25).split(), *w[half:]], {half // 2, half + 25 + half // 2}), len(w)
    if kind == "moved":  # the halves change places
        return w, changed([*w[half:], *w[:half]], {half // 2, half + half // 2}), len(w)
    return w, changed(w[: half + 10], {half // 2}), half + 10  # only a part


@pytest.mark.parametrize("kind", ["changed", "put in", "left out", "moved", "part"])
def test_near_copies_are_found(table, kind):
    rng = np.random.default_rng(len(kind))
    texts, spots = {}, {}
    for case in range(40):
        source, copy, _ = near_copy(rng, kind, prose(rng, 120).split())
        texts[2 * case] = f"{prose(rng, 30)} {' '.join(source)} {prose(rng, 30)}"
        texts[2 * case + 1] = f"{prose(rng, 40)} {' '.join(copy)} {prose(rng, 20)}"
        spots[2 * case + 1] = {40 + k for k, x in enumerate(copy) if x in set(source)}
    covered = defaultdict(set)
    for r in repeated_passages(table(list(texts.items()))).collect():
        covered[r["doc_id"]].update(range(r["first_word"], r["first_word"] + r["n_words"]))
    share = [len(spot & covered[i]) / len(spot) >= 0.8 for i, spot in spots.items()]
    assert np.mean(share) >= 0.9, np.mean(share)
    assert not any(covered[2 * case] for case in range(40))


def test_more_shingles_than_places(monkeypatch, table):
    """Texts with more shingles than a value can number are ranked, with the same windows."""
    rng = np.random.default_rng(8)
    values = rng.integers(0, 1 << 60, 5000).astype(np.uint64)
    values[::7] = values[3]
    bounds = np.array([0, 2000, 2100, 5000])
    want = compact_windows(values, bounds, 40)
    # the same order where the low bits are cut, whichever way it is found
    monkeypatch.setattr(substrings, "PLACE_BITS", 12)
    got = compact_windows(values, bounds, 40)
    assert all((a == b).all() for a, b in zip(want, got)) and len(want[0]) > 10


def test_repeated_and_null_ids_are_documents_of_their_own(table):
    rng = np.random.default_rng(9)
    passage, clean, other = prose(rng, 60), prose(rng, 200), prose(rng, 90)
    rows = [(1, f"{prose(rng, 50)} {passage} {prose(rng, 50)}"), (2, f"{prose(rng, 50)} {passage} {prose(rng, 50)}"), (2, clean), (2, None), (None, other), (None, None), (3, "x")]
    cut = [(r["doc_id"], r["text"]) for r in cut_repeats(table(rows)).collect()]
    assert len(cut) == 7 and (2, clean) in cut and (2, None) in cut and (None, other) in cut and (None, None) in cut and rows[0] in cut
    assert all(passage not in (t or "") for i, t in cut if i == 2) and sum(passage in (t or "") for _, t in cut) == 1
    kept = [(r["doc_id"], r["text"]) for r in keep_first(table([(5, clean), (5, clean), (5, clean), (None, clean), (None, clean), (7, other), (7, passage)])).collect()]
    assert sorted(kept, key=str) == sorted([(5, clean), (7, other), (7, passage)], key=str) or sorted(kept, key=str) == sorted([(None, clean), (7, other), (7, passage)], key=str)


def test_empty(table):
    assert repeated_passages(table([])).collect() == [] and cut_repeats(table([])).collect() == []
