"""Ids piece by piece are those of whole texts."""

import random

import pytest

from bugloom.llm.tokens import Encoder

BITS = [
    " ", " ", "  ", "a", "B", "the", "12", "!", ".", ",", "'s", "'", "\n", "\t", "\r", "\x0b",
    "é", "ß", "'ll", "'T", "&&&", "$", "x1y", "-", "http://a.b/c?d=1", "don't", "́", "中", "😀", "\x85", "\x1c", "\xa0", "​", "᠎", " ", "　",
    "<|endoftext|>", " x", "_", "ª", "²", "ℵ", "\x00",
]


@pytest.mark.parametrize("cache", [10, 100_000])
def test_random_texts(cache):
    encoder, rng = Encoder(cache_pieces=cache), random.Random(3)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 12))) for _ in range(8000)]
    for k in range(0, len(texts), 500):
        part = texts[k:k + 500]
        assert encoder.encode(part) == encoder.direct(part)


def test_null_empty_and_long():
    encoder = Encoder()
    long = "word, another word. " * 20_000 + "end"
    assert encoder.encode([None, "", long]) == [b"", b"", encoder.direct([long])[0]]
    assert encoder.encode([]) == []
