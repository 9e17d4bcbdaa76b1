import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strideflow.llm import rangecoder, tokenfiles
from strideflow.llm.common import shared_path
from strideflow.llm.queries import vocabulary
from strideflow.llm.tokens import UnitEncoder

FILES = [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)]


@pytest.mark.parametrize("name, drops_space", FILES)
def test_ids_equal_those_of_the_library(name, drops_space):
    rng = random.Random(6)
    letters = "ab éÈç'.,!  \n\t\xa0 　\x1c\x851²-_ZΣσ<>×÷̸́漢"
    texts = ["", None, "don't  stop 'tis", "x<|endoftext|>y", "\n\n a  b \n", "a\r\nb"] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    coder, own = Tokenizer.from_file(vocabulary(name)), UnitEncoder(vocabulary(name), drops_space, 7)
    for some in (texts, texts[6:]):
        ids, bounds = own.encode(pa.array(some, pa.string()))
        for i, text in enumerate(some):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == [*coder.encode(text or "", add_special_tokens=False).ids, 7]


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 999), max_size=1500), st.integers(1000, 5000))
def test_coder_round_trip(ids, vocabulary_size):
    words, used = rangecoder.encode(np.array(ids, np.int64), vocabulary_size)
    assert rangecoder.decode(words, used, len(ids), vocabulary_size).tolist() == ids


def test_coder_gains_from_each_order():
    rng = np.random.default_rng(7)
    n = 60_000
    flat = rng.integers(0, 50_000, n)
    skewed = np.minimum(rng.geometric(0.05, n), 49_999)
    chained = np.tile(rng.integers(0, 50_000, 500), n // 500)
    bits = [len(rangecoder.encode(x, 50_257)[0]) * 16 / n for x in (flat, skewed, chained)]
    assert bits[0] < 21 and bits[1] < 10 and bits[2] < 2


def test_blocks_are_checked():
    ids = np.arange(3000) % 70
    block = tokenfiles.pack_block(3, 10, 5, True, [None, 9], np.array([1000, 2000]), ids, 100)
    part, before, skipped, goes_on, docs, counts, back = tokenfiles.unpack_block(block)
    assert (part, before, skipped, goes_on, docs, counts.tolist()) == (3, 10, 5, True, [None, 9], [1000, 2000]) and back.tolist() == ids.tolist()
    for at in (len(block) - 3, len(block) // 2):
        with pytest.raises(tokenfiles.CorruptBlock):
            tokenfiles.unpack_block(block[:at] + bytes([block[at] ^ 1]) + block[at + 1 :])
    with pytest.raises(tokenfiles.CorruptBlock):
        tokenfiles.unpack_block(b"short")


def test_files_round_trip(spark, small, table):
    path, name = shared_path(spark, "tokens-test"), vocabulary("byte_bpe_50k.json")
    rows = [(r["doc_id"], r["text"]) for r in small("documents").collect()] + [(-5, None), (90_001, ""), (90_002, "word é\n" * 300_000), (None, "no id"), (90_003, "a"), (90_003, "a")]
    tokenfiles.write_tokens(table(rows, 4), path, name)
    got = sorted(tuple(r) for r in tokenfiles.document_digests(tokenfiles.read_tokens(spark, path)).collect() if r["doc_id"] is not None)
    coder, want, at = Tokenizer.from_file(name), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(w for w in want if w[0] is not None)


def test_empty(spark, table):
    path = shared_path(spark, "tokens-test")
    tokenfiles.write_tokens(table([]), path, vocabulary("byte_bpe_50k.json"))
    assert tokenfiles.document_digests(tokenfiles.read_tokens(spark, path)).collect() == []
