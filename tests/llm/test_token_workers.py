import os

import numpy as np
import pyarrow as pa
import pytest

from strideflow.llm import tokens
from strideflow.llm.queries import vocabulary


def test_worker_keeps_its_encoder_between_tasks(spark):
    path = vocabulary("byte_bpe_50k.json")

    def told(batches):
        coder = tokens.encoder(path, False, 5)
        before = len(coder.known) - 1  # without the id behind each text
        coder.encode(pa.array(["one two three"]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()], pa.int64()), pa.array([before], pa.int64())], ["pid", "before"])

    rows = [r for _ in range(2) for r in spark.range(0, 32, 1, 32).mapInArrow(told, "pid long, before long").collect()]
    # a process learns the units once
    assert len({r.pid for r in rows}) < len(rows)
    assert sum(r.before == 0 for r in rows) == len({r.pid for r in rows})


@pytest.mark.parametrize("name, drops_space", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_known_units_do_not_force_a_reset(monkeypatch, name, drops_space):
    monkeypatch.setattr(tokens, "REMEMBERED", 60)
    coder = tokens.UnitEncoder(vocabulary(name), drops_space, 7)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    resets = []
    reset = coder._reset
    monkeypatch.setattr(coder, "_reset", lambda: (resets.append(1), reset()))
    for some in (words[:50], words[:50], words[40:55]):
        coder.encode(pa.array([" ".join(some)]))
    assert not resets
    # more units than are remembered, in one step and over several
    for some in (words, words[30:80], words[::-1]):
        text = " ".join(some) + " 1234 \u6f22"
        ids, bounds = coder.encode(pa.array([text, None]))
        whole = coder.tokenizer.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == [*whole, 7, 7] and bounds.tolist() == [0, len(whole) + 1, len(whole) + 2]
    assert resets and np.all(np.diff(coder.edges[: len(coder.known) + 1]) >= 0)
