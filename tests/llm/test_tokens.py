"""The encoder and the prefix counter of batches of texts against the library, and how much work they take."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import tokens
from quern.llm.token_counts import PrefixCounter, prefix_counts
from quern.llm.tokens import Encoder, tokenizer_path

PARTS = ["a", "The", "é", "ß", "ª", "²", "23", "  ", " ", " ", " ", "\n", "\t", "\xa0", "\x85", "\x1c", ".", ",", "'s", "'re", "<|endoftext|>", "漢字", "ɏ", "ɐ", "🙂", "$$$", "_", "　"]


@pytest.mark.parametrize("memory", [5, 500_000])
def test_batches_equal_the_library(memory):
    by, rng = Encoder(tokenizer_path(), memory), random.Random(memory)
    for _ in range(8):
        texts = [None if rng.random() < 0.1 else "".join(rng.choices(PARTS, k=rng.randrange(40))) for _ in range(50)]
        want = [np.array(by.library.encode(t or "", add_special_tokens=False).ids, by.dtype).tobytes() for t in texts]
        assert by.ids_of(texts) == want
    assert by.ids_of([]) == [] and by.ids_of([None, ""]) == [b"", b""]


def test_words_of_pieces_are_encoded_once():
    """Pieces such as ``one.\\nTwo`` seldom repeat, but their words do."""

    class Counted:
        def __init__(self, own):
            self.own, self.letters = own, 0

        def encode(self, text, **more):
            self.letters += len(text)
            return self.own.encode(text, **more)

        def encode_batch_fast(self, texts, **more):
            self.letters += sum(map(len, texts))
            return self.own.encode_batch_fast(texts, **more)

        def tokenize(self, word):
            self.letters += len(word)
            return self.own.tokenize(word)

    by = Encoder(tokenizer_path())
    words = [f"w{chr(97 + i)}rd{chr(97 + j)}" for i in range(6) for j in range(5)]
    text = " ".join(["start", *(f"{a}.\n{b}" for a in words for b in words)])
    want = np.array(by.library.encode(text, add_special_tokens=False).ids, by.dtype).tobytes()
    by.library = library = Counted(by.library)
    by.model = model = Counted(getattr(by, "model", None))
    assert by.ids_of([text]) == [want]
    assert library.letters + model.letters < len(text) / 10


@pytest.mark.parametrize("memory", [5, 500_000])
def test_prefixes_of_batches_equal_the_library(memory, monkeypatch):
    monkeypatch.setattr(tokens, "PLACED", 7)
    rng = random.Random(memory)
    by = PrefixCounter(Encoder(tokenizer_path()), memory)
    for _ in range(4):
        texts = [None if rng.random() < 0.1 else "".join(rng.choices(PARTS, k=rng.randrange(25))) for _ in range(15)]
        deltas, bounds = by.batch(pa.array(texts, pa.string()))
        for t, a, b in zip(texts, bounds, bounds[1:]):
            prefixes = [(t or "")[:k] for k in range(len(t or "") + 1)]
            assert prefix_counts(deltas[a:b].tobytes()).tolist() == [len(e.ids) for e in by.source.library.encode_batch(prefixes, add_special_tokens=False)]


def test_beginnings_of_words_are_counted_once():
    class Counted(dict):
        asked = 0

        def __contains__(self, key):
            self.asked += 1
            return super().__contains__(key)

    by = PrefixCounter(Encoder(tokenizer_path()))
    by.tokens = Counted(by.tokens)
    text = " ".join(["start", *(f"unquestionableness{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20))])
    assert prefix_counts(by.deltas(text))[-1] == len(by.source.library.encode(text, add_special_tokens=False).ids)
    assert by.tokens.asked < len(text) / 2
