import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from llm_cases import words

from strideflow.llm.rules import agreement, judge, measures, posterior


def plain(text):
    text = text or ""
    w, seen, again = words(text), set(), 0
    for line in text.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(5)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)]


def test_measures_against_plain_version(small):
    rng = random.Random(8)
    texts = ["", None, "\n", "a\na", "a b\na b\n\na b", " x \n x \nx", "#*$ é\r\nZ", "w " * 50_000]
    texts += ["".join(rng.choice("ab \n\n#é\x0b") for _ in range(rng.randint(0, 80))) for _ in range(800)]
    texts += [r["text"] for r in small("documents").collect()]
    got = np.stack(measures(pa.array(texts, pa.string()))[:5]).T.tolist()
    assert got == [plain(t) for t in texts]


def test_agreement_finds_the_reliable_rules():
    rng = np.random.default_rng(9)
    good = rng.random(20_000) < 0.8
    votes = np.stack([np.where(rng.random(20_000) < a, 1, -1) * np.where(good, 1, -1) for a in (0.95, 0.9, 0.9, 0.8)] + [rng.choice([-1, 0, 1], 20_000)], axis=1)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    rates, share = agreement(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.1
    assert np.mean((posterior(patterns, rates, share)[inverse] >= 0.5) == good) > 0.93


def test_verdicts(spark, small, table):
    rows = [(r["doc_id"], r["text"]) for r in small("documents").collect()]
    rows += [(90_000, None), (90_001, ""), (90_002, "one two"), (90_003, "same five words again now " * 40), (90_004, "a%% b## c$$ d&& e** f|| g<< h>> i!! j?? k## " * 3), (1, rows[1][1])]
    got = {}
    for r in judge(table(rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for doc_id, text in rows:
        r, p = got[doc_id][0], plain(text)
        failed = p[0] < 10 or 100 * p[4] > 20 * p[0]
        assert [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == p and r["base_failed"] == failed
        assert not (failed and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in small("labels").collect()}
    fair = [got[i][0]["kept"] for i, q in labels.items() if q == 1 and not got[i][0]["base_failed"]]
    junk = [got[i][0]["kept"] for i, q in labels.items() if q == 0]
    assert np.mean(fair) > 0.97 and np.mean(junk) < 0.2


def test_empty(table):
    assert judge(table([])).collect() == []
