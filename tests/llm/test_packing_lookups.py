"""A batch looks up each of its words once, however often it comes, and gives the ids of a plain call."""

import random

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from chatloom.llm import packing
from chatloom.llm.queries import tokenizer_path


class Counting(dict):
    looked = 0

    def get(self, *key):
        self.looked += 1
        return super().get(*key)

    def __getitem__(self, key):
        self.looked += 1
        return super().__getitem__(key)


def test_each_word_is_looked_up_once():
    model = packing.WordTokens(tokenizer_path(), special=True)
    model.known = Counting()
    model.batch(["first " + "one two three " * 5_000 + "end"] * 3)
    assert model.known.looked <= 10


def odd_texts(seed: int, many: int) -> list[str]:
    draw = random.Random(seed)
    parts = ["word", "Wörter", "12", "don't", "###", "Ġ", "日本", "é", "<|endoftext|>", "😀", ".", "x" * 40]
    gaps = [" "] * 12 + ["", "  ", "\n", "\n\n", "\n\n\n", " \n", "\n ", "\t", " ", "\x1c", "　"]
    out = []
    for _ in range(many):
        text = "".join(draw.choice(parts) + draw.choice(gaps if draw.random() < 0.3 else [" "]) for _ in range(draw.randrange(12)))
        out.append(draw.choice([text, text.strip(" "), " " + text, text + "\n"]))
    return out


def test_ids_of_odd_texts(monkeypatch):
    plain = Tokenizer.from_file(tokenizer_path())
    monkeypatch.setattr(packing, "REMEMBERED", 20)  # most words are forgotten
    model = packing.WordTokens(tokenizer_path(), special=True)
    for seed in range(8):
        texts = ["", *odd_texts(seed, 120)]
        expected = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        got = model.batch(texts if seed % 2 else pa.array([None, *texts[1:], "cut off"]).slice(0, len(texts)))
        assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == expected
        assert model.batch(pa.array([None, "", *texts])[2:]) == got
    assert model.batch([]) == model.batch(pa.array([], pa.string())) == [] and model.batch([""]) == [b""]
