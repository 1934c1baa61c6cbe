import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from linkscape.llm import bpe as B

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["the", "Ciónmente", "é", "é", "İ", "'s", "'re", "!!!", "…", "日本語", "한국", "한", "😀", "👩‍👩‍👧", "́", "123", "<|endoftext|>", "<|startoftext|>", "<|endof", "ſ", "Σ", "ß", "&nbsp;", "a" * 50, "\x1c", "\x00", "~~"]
SPACE = [" ", "\n", "\t\t", " ", " ", "​", "　", ""]


def texts(seed, n, most):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) + (r.choice(SPACE) if r.random() < 0.6 else "") for _ in range(r.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_words_one_by_one(tokenizer):
    codec = B.Codec(PATH)
    for text in texts(1, 300, 40):
        ids = np.frombuffer(codec.encode_words(text), np.int32)
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert codec.decoded(ids) == tokenizer.decode(want, skip_special_tokens=False)


def test_forgotten_words_are_encoded_again(tokenizer, monkeypatch):
    monkeypatch.setattr(B, "MEMO_WORDS", 12)
    codec = B.Codec(PATH)
    plain = ["THE Cat", "don't <|STARTOFTEXT|> X", "A\x1cB C", "Don'T <|endoftext|>STOP", "ÀB Cd"]
    for text in (texts(5, 60, 12) + plain) * 2:
        assert np.frombuffer(codec.encode_words(text), np.int32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(codec.memo) + len(codec.older) < 60


def test_tree_concatenation(tokenizer):
    codec = B.Codec(PATH)
    r = random.Random(7)
    letters = ["".join(r.choices("abcdefghijklmnopqrstuvwxyzé", k=3000)), "a" * 3000, "!?" * 1500, "ab" * 1500 + " " + "日本" * 800]
    for text in texts(2, 60, 400) + letters:
        edges = [0, *B.tree_cuts(codec, text, 40), len(text)]
        parts = [B.encode_leaf(codec, text[a:z]) for a, z in zip(edges, edges[1:])]
        assert B.part_ids(B.tree(codec, parts)).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_rows(spark, tokenizer):
    r = random.Random(9)
    rows = [(k, t) for k, t in enumerate(texts(3, 40, 60))] + [(100, None), (101, ""), (None, "a b"), (5, "again"), (5, "again"), (102, "".join(r.choices("abcdefgh", k=5000))), (103, "word and " * 900), (103, "word and " * 900), (None, "xyz" * 2000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int")
    got = sorted(((x.doc_id, list(x.ids), x.decoded) for x in B.bpe_encode_decode(df, PATH, leaf_chars=300).collect()), key=str)
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, tokenizer.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str)
    assert B.bpe_encode_decode(df.limit(0), PATH).collect() == []
