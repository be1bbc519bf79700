"""What the token encoder encodes."""

import random

import pytest

from tidewire.llm import tokens
from tidewire.llm.queries import vocabulary


@pytest.fixture(scope="module")
def path():
    return vocabulary("word_bpe_49k.json")


def test_a_word_is_encoded_once_whatever_follows_it(path):
    code = tokens.PieceEncoder(path)
    asked, real = [], code.tokenizer

    class Counted:
        def encode_batch_fast(self, pieces, **options):
            asked.extend(pieces)
            return real.encode_batch_fast(pieces, **options)

    texts = ["enaute enaute, enaute. Enaute!!", "(enaute enaute,", "it's it's. 's 's, ,"]
    code.tokenizer = Counted()
    got = [code.encode(t) for t in texts]
    assert sum("enaute" in p.lower() for p in asked) == 2  # alone, and behind the bracket
    code.tokenizer = real
    assert got == [code.whole(t) for t in texts]


def test_pieces_equal_whole_texts(path):
    rng, code = random.Random(4), tokens.PieceEncoder(path)
    letters = "aB'İß.,!#é×ÀÿŒ́x1²Ⅷ日sS't\n\t  -&*ŉﬁÅΩ̸<>="
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    assert code.encode_all(texts) == [code.whole(t) for t in texts]


def test_memory_full(path, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 8)
    code = tokens.PieceEncoder(path)
    texts = [f"w{i}, x{i}. same" for i in range(10)]
    assert [code.encode(t) for t in texts] == [code.whole(t) for t in texts]
