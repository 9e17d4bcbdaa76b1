import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from strideflow.llm.packing import pack
from strideflow.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")


def test_pieces_and_sequences(spark, small, table):
    coder = Tokenizer.from_file(PATH)
    rows = [(r["doc_id"], r["text"]) for r in small("documents").collect()]
    rows += [(90_000, None), (90_001, ""), (90_002, "\n"), (90_003, "Déjà <|endoftext|> VU"), (90_004, "word " * 150_000)]
    got = pack(table(rows, 5), PATH).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for doc_id, text in rows:
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and bytes(r["ids"]) == ids[at : at + r["length"]].tobytes()
            at += r["length"]
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["padded_length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for n, pieces in sequences.items():
        at = 0
        for offset, length, padded in sorted(pieces):
            assert offset == at and padded == (4096 if at + length != at or n else padded)
            at += length
        assert at == 4096 or n == len(sequences) - 1


def test_repeats_nulls_and_nothing(table):
    assert pack(table([]), PATH).collect() == []
    got = pack(table([(1, "a"), (1, "a"), (None, "b")]), PATH).collect()
    assert sorted((r["doc_id"] is None, r["length"]) for r in got) == [(False, 2), (False, 2), (True, 2)]
    assert sorted(r["offset"] for r in got) == [0, 2, 4] and zlib.crc32(bytes(got[0]["ids"]))
