import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from letterlens.llm import token_planes
from letterlens.scale import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(texts):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


ODD = [
    "It's we'll I'D don't.", "a,,b ...,x; (yes)!? é, É. É. J̌, ǰ", "x<|endoftext|>y <|ENDOFTEXT|>. <|startoftext|>",
    " a b\u0085c\x1cd\x0be", "12,5% 3.14 ½ ²", "İstanbul ΣΑΣ. ß,", "…, “quote”. näivé, ́. á̂,", "日本語、テスト。 ,", "👍🏽, 👩‍👩‍👧.",
    "﻿word ​, zero‍width.", "ab̸, ≮ ≠.", "", " ", "''s 's. 'LL",
]


def test_encoder_equals_whole_texts():
    rng = random.Random(2)
    alphabet = list("aAbzé É.,'!?*<|>1 \n\t́ßΣİ-_#ü ")
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    encoder = token_planes.WordEncoder(PATH)
    for _ in range(2):
        got = [np.frombuffer(x, encoder.width).tolist() for x in encoder.encode([t.encode() for t in texts])]
        wrong = [(t, a, b) for t, a, b in zip(texts, got, whole(texts)) if a != b]
        assert not wrong[:3]


def test_plain_words_need_no_pattern(monkeypatch):
    monkeypatch.setattr(token_planes, "SIMPLE", None)
    monkeypatch.setattr(token_planes, "SIGNS_BEHIND", None)
    encoder = token_planes.WordEncoder(PATH)
    encoder.update({sign: np.array(ids, encoder.width).tobytes() for sign, ids in zip((b",", b"!?"), whole([",", "!?"]))})
    text = "The house, old HOUSE!? x"
    assert [np.frombuffer(x, encoder.width).tolist() for x in encoder.encode([text.encode()])] == whole([text])


def test_planes_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 65_536, 1000):
        ids = rng.integers(0, 49_408, n).astype(np.uint16)
        assert (token_planes.from_planes(token_planes.to_planes(ids), n) == ids).all()
    assert token_planes.to_planes(np.zeros(9, np.uint16)) == []


def test_joined_checksums():
    data = bytes(random.Random(1).randrange(256) for _ in range(5000))
    for cut in ([], [1], [17, 17, 4000], [5000]):
        parts = [data[a:b] for a, b in zip([0, *cut], [*cut, len(data)])]
        assert token_planes.crc32_of_joined([(len(p), zlib.crc32(p)) for p in parts]) == zlib.crc32(data)


def test_files(spark, table):
    rng = random.Random(4)
    rows = [(rng.randrange(10_000), " ".join(rng.choice(("the", "House,", "zürich")) for _ in range(rng.randint(0, 30)))) for _ in range(80)]
    rows += [(3, "long text " * 90_000), (4, None), (5, ""), (-7, "first"), (None, "no id"), (6, "same"), (6, "same")]
    path = scratch_path(spark, "test-planes")
    token_planes.write_tokens(table(rows), path, PATH, 2)
    got = token_planes.read_digests(spark, path).collect()
    ids = dict(zip({t or "" for _, t in rows}, whole({t or "" for _, t in rows})))
    expected = sorted(((i, len(ids[t or ""]) + 1, zlib.crc32(np.array([*ids[t or ""], 2], "<u4").tobytes())) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == expected
    at = 0
    previous = None
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        assert previous is None or r.doc_id >= previous
        previous = r.doc_id
    for r in token_planes.read_documents(spark, path).collect():
        if r.doc_id == 3:
            assert r.ids == [*ids["long text " * 90_000], 2]


def test_empty_table(spark, table):
    path = scratch_path(spark, "test-planes")
    token_planes.write_tokens(table([]), path, PATH, 2)
    assert token_planes.read_digests(spark, path).count() == 0


@pytest.mark.parametrize("n", [1, 65_535, 65_536, 65_537])
def test_chunk_borders(spark, table, n):
    path = scratch_path(spark, "test-planes")
    token_planes.write_tokens(table([(1, "a " * (n - 1)), (2, "b")]), path, PATH, 2)
    assert [(r.doc_id, r.start, r.n_tokens) for r in token_planes.read_digests(spark, path).orderBy("doc_id").collect()] == [(1, 0, n), (2, n, 2)]
