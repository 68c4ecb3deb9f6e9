"""Long texts that pass in blocks."""

import json
import random

import numpy as np
import pytest

from tallyspark.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("by_library", [False, True])
def test_blocks_encode_as_the_library_does(by_library):
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(PATH)
    with open(PATH, "rb") as f:
        content = f.read()
    own = bpe.Encoder(json.loads(content), bpe._library(content) if by_library else None)
    own.REMEMBERED = 30
    rnd = random.Random(5)
    pick = lambda: rnd.choice(["it's ", "we'll", "  ", "\n\n ", "a" * rnd.randrange(90), " 12345", "!?'re", "数é", "<|endoftext|>", " the", "." * rnd.randrange(60), "'"])
    texts = ["".join(pick() for _ in range(rnd.randrange(60))) for _ in range(120)] + ["a" * 5000, " " * 300 + "b", "", None, "ab" * 700 + " ." * 9]
    got = [[] for _ in texts]
    for at, ids, each, _ in own.batches(texts, 48):
        for k, part in enumerate(np.split(ids, np.cumsum(each)[:-1])):
            got[at + k] += part.tolist()
    assert got == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_a_text_of_megabytes(spark):
    tokenizers = pytest.importorskip("tokenizers")
    text = "It's a long, long text of many words 数 and 12 numbers.\n" * 60_000 + "x" * 1000
    tok = tokenizers.Tokenizer.from_file(PATH)
    ids = tok.encode(text, add_special_tokens=False).ids
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert len(text) > 3_000_000
    assert [r["n_tokens"] for r in bpe.token_digests(frame, PATH).collect()] == [len(ids)]
    assert bpe.encode_ids(frame, PATH).first()["ids"] == ids


def test_equal_hashes_of_different_words_are_told_apart(monkeypatch):
    with open(PATH, "rb") as f:
        spec = json.load(f)
    text = "one two three four one two six"
    want = np.concatenate([i for _, i, _, _ in bpe.Encoder(spec).batches([text])])
    monkeypatch.setattr(bpe, "_powers", lambda n: (np.zeros(n, np.uint64), np.zeros(n, np.uint64)))
    assert (np.concatenate([i for _, i, _, _ in bpe.Encoder(spec).batches([text])]) == want).all()


def test_key_table():
    rnd = np.random.default_rng(2)
    keys = rnd.integers(0, 1 << 63, 5000, dtype=np.uint64)
    table = bpe.KeyTable()
    for part in np.array_split(keys[:4000], 9):
        table.add(part)
    assert (table.find(keys[:4000]) == np.arange(4000)).all() and (table.find(keys[4000:]) == -1).all()
    again = bpe.KeyTable()
    again.add(np.array([5, 7, 5], np.uint64))
    assert again.find(np.array([5, 7, 9], np.uint64)).tolist() == [0, 1, -1]
