"""Texts without spaces, and how much is remembered of them."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marginalia.llm import pieces

PATHS = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def long_texts(rng):
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) if rng.random() < 0.95 else rng.choice("、。!1a") for _ in range(6000))
    base64 = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=200_000))
    code = "".join(rng.choice(["var", "x1", "=", "{", "}", ";", "'s", "don't", "İ", "é", "é", "Σ", "²", "3", "\t", "\n", "한", "글", "¼", "_", "a⃝"]) for _ in range(20_000))
    special = "".join(rng.choice(["ab1", "<|endoftext|>", "<|", "|>", "endoftext", "。"]) for _ in range(3000))
    return [cjk, base64, code, special, f"x {code[:5000]} y {base64[:3000]}", "a" * 5000, "1" * 5000, "é" * 5000]


@pytest.mark.parametrize("name", PATHS)
def test_texts_without_spaces(name):
    some = long_texts(random.Random(12))
    want = [x.ids for x in Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(some, add_special_tokens=False)]
    coder = pieces.PieceEncoder(public_tokenizers.path(name))
    for text, ids in zip(some, want, strict=True):
        assert coder.encode([text])[0].tolist() == ids and coder.count([text]).tolist() == [len(ids)]


@pytest.mark.parametrize("name", PATHS)
def test_remembered_bytes(name):
    """Many long pieces: what is held stays within the bound and one batch, and ids stay right."""
    rng = random.Random(13)
    path = public_tokenizers.path(name)
    coder, library, most = pieces.PieceEncoder(path, held_bytes=4 << 20), Tokenizer.from_file(path), 0
    for _ in range(30):
        some = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(500)) + " the same words again" for _ in range(100)]
        ids, bounds = coder.encode(some)
        most = max(most, coder.held())
        assert ids[bounds[7] : bounds[8]].tolist() == library.encode(some[7], add_special_tokens=False).ids
    assert most <= (4 << 20) + 30 * 100 * 500 * 3
    coder.held_bytes = 0
    coder.encode(["the same words again"])
    assert coder.held() < 1 << 20 and all(len(x) <= pieces.REMEMBERED for x in coder.memo)


def test_plain_words_need_no_pattern(monkeypatch):
    """Words of Latin letters, with a sign after them or not, are not searched for words again; ids stay the library's."""
    path = public_tokenizers.path("word_bpe_49k.json")
    some = ["Plain words, größer. Straße: ÀÉÎ! ªº µm; x?", "end", "ÿ, b!", "words plain, more"]
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]
    coder = pieces.PieceEncoder(path)
    monkeypatch.setattr(pieces, "_WORDS", object())
    ids, bounds = coder.encode(some)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == want
