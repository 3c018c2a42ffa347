import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from letterlens.llm.bpe_automaton import SETTLED, Automaton, check, decode, encode, encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def slow(word, rank, spelled):
    """Merges by rank, leftmost first."""
    parts = [bytes([b]) for b in word]
    while True:
        found = [(rank[pair], i) for i, pair in enumerate(zip(parts, parts[1:])) if pair in rank]
        if not found:
            return [spelled[p] for p in parts]
        at = min(found)[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


@pytest.mark.parametrize("seed", range(60))
def test_automaton_against_merging(seed):
    r = random.Random(seed)
    labels = [bytes([c]) for c in b"abc"]
    merges = []
    for _ in range(r.randint(1, 25)):
        u, v = r.choice(labels), r.choice(labels)
        if u + v not in labels and len(u + v) < 9:
            labels.append(u + v)
            merges.append((u, v))
    number = {x: i for i, x in enumerate(labels)}
    automaton = Automaton(labels, [(number[u], number[v], number[u + v]) for u, v in merges])
    rank = {pair: i for i, pair in enumerate(merges)}
    for _ in range(300):
        word = bytes(r.choice(b"abc" if r.random() < 0.7 else b"aab") for _ in range(r.randint(0, 14)))
        assert automaton.encode(word) == slow(word, rank, number), (merges, word)


def test_every_settled_code_point_is_split_alike():
    tool = encoder(PATH)
    for c in map(chr, SETTLED):
        text = f"a{c}1 {c}! {c}{c} x '{c}"
        assert tool.words(text) == [text[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)], hex(ord(c))


def test_odd_texts_against_the_library():
    r, tool = random.Random(5), encoder(PATH)
    parts = ["a", "aa", " ", "\n", "é", "the", "ing", "10", "!", "'s", "\x1c", "中", "😀", "<|endoftext|>", "<|end", "=", "\t", "́", "՘", "\0"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    texts += ["".join(chr(r.choice([r.randint(32, 126), r.randint(0, 0x24FF), r.randint(0x3000, 0xD7FF)])) for _ in range(20)) for _ in range(2000)]
    texts += ["=" * 3000, "ab" * 5000, "a" * 9999 + " ", "".join(r.choice("abcdef") for _ in range(30_000))]
    for text in texts:
        ids = tool.encode(text)
        assert ids == LIBRARY.encode(text, add_special_tokens=False).ids, text[:99]
        assert tool.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False) == text


def test_decode_of_any_ids():
    r, tool = random.Random(6), encoder(PATH)
    for _ in range(3000):
        ids = [r.randrange(50_257) for _ in range(r.randint(0, 9))]
        assert tool.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_encode_and_decode(spark, table):
    rows = [(1, None), (2, ""), (3, "The same"), (3, "The same"), (None, "x <|endoftext|> y"), (5, "wörd " * 30_000)]
    docs = table(rows).withColumnRenamed("n", "ids").withColumnRenamed("key", "decoded")
    found = encode(docs, PATH, decode_too=True)
    assert set(found.columns) == {*docs.columns} - {"text"}
    got = sorted((r.doc_id or 0, r.ids, r.decoded) for r in found.collect())
    assert got == sorted((k or 0, LIBRARY.encode(t or "", add_special_tokens=False).ids, t or "") for k, t in rows)
    again = decode(encode(table(rows), PATH), PATH)
    assert sorted((r.doc_id or 0, r.decoded) for r in again.collect()) == sorted((k or 0, t or "") for k, t in rows)
    assert encode(table([]), PATH).count() == 0


def test_all_documents_against_the_library(spark):
    from letterlens.llm.queries import op12_tokenization_automaton
    import hashlib

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op12_tokenization_automaton(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = LIBRARY.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_other_vocabularies_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file, pytest.raises(ValueError):
        check(json.load(file))
