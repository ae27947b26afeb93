"""Chunked encoding against the library on whole texts."""

import random

import numpy as np
import pytest

from errbound.llm.encoders import ChunkEncoder, counter, public_path, version_digest



def library(own, texts):
    return [np.array(x.ids, "<u4").tobytes() for x in own.tokenizer.encode_batch(texts, add_special_tokens=False)]


FIXED = ["", " ", "\n\n", "a  b   c", "it's  we'll''s 'tis ''s .'s", "x<|endoftext|>y <|endof text|> (<|endoftext|>)", "éá é", "İstanbul ſs",
         "tab\there\x1cthere\x1d\x1e", "²³x½1 12,345.6", "你好，世界 \U0001f600\U0001f600", "a b c\x85d", "A" * 500, "\r\n mixed \r\n\t x", "_a_1_ªº",
         "ends with space ", " 's", "'", "'S don'T"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_same_ids_as_library(name):
    own = ChunkEncoder(public_path(name))
    assert own.cuts is not None
    rng = random.Random(3)
    alphabet = list("ab \n\t'.s1<|>éß²́\x1c世") + ["<|endoftext|>", " the", "ing", "'ll", "  "]
    texts = FIXED + ["".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(4000)]
    assert own.encode(texts) == library(own, texts)
    assert own.count(texts) == [len(x) // 4 for x in library(own, texts)]


def test_memo_bound(monkeypatch):
    monkeypatch.setattr("errbound.llm.encoders.MEMO_CHARS", 20)
    own = ChunkEncoder(public_path("byte_bpe_50k.json"))
    texts = [f"one two three w{i}" for i in range(30)]
    for t in texts:
        assert own.encode([t]) == library(own, [t])


def test_piece_counter():
    import sentencepiece
    path = public_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert counter(path).count(["Hello world", ""]) == [len(model.encode("Hello world")), 0]


def test_version_digest():
    a, b = version_digest(public_path("byte_bpe_50k.json")), version_digest(public_path("piece_bpe_32k.model"))
    assert a != b and a == version_digest(public_path("byte_bpe_50k.json"))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_new_chunks_share_calls(name, monkeypatch):
    own, rng, given = ChunkEncoder(public_path(name)), random.Random(4), []
    words = ["".join(rng.choices("abcdeghilnorstuß", k=9)) for _ in range(3000)]
    plain = own._library
    monkeypatch.setattr(own, "_library", lambda texts: given.extend(texts) or plain(texts))
    text = " ".join(words)
    assert own.encode([text]) == library(own, [text]) and len(given) < 20


def test_memo_keeps_what_came_back(monkeypatch):
    monkeypatch.setattr("errbound.llm.encoders.MEMO_CHARS", 4000)
    own, rng = ChunkEncoder(public_path("word_bpe_49k.json")), random.Random(6)
    common = ["".join(rng.choices("abcde", k=8)) for _ in range(100)]
    for _ in range(40):
        text = " ".join(rng.choices(common, k=200) + ["".join(rng.choices("fghij", k=9)) for _ in range(100)])
        assert own.encode([text]) == library(own, [text]) and own.held <= 4000
    assert len(set(common) & own.number.keys()) > 90
