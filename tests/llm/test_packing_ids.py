"""Ids are those of a plain call of the tokenizer, special strings included."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from chatloom.llm import packing
from chatloom.llm.queries import tokenizer_path

TEXTS = [
    "<|endoftext|> z",
    "one two<|endoftext|>three four",
    "one <|endoftext|> two  <|endoftext|>",
    "<|endoftext|><|endoftext|>",
    "<|endoftext| > plain words only",
    "Ġ a Ġb <|endoftext|>\n c",
]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_of_special_strings(text):
    plain = Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids
    got = packing.WordTokens(tokenizer_path(), special=True).batch(["other words here", text])[1]
    assert np.frombuffer(got, "<u4").tolist() == plain


def test_special_string_is_one_id():
    got = packing.WordTokens(tokenizer_path(), special=True).batch(["<|endoftext|> z"])[0]
    assert np.frombuffer(got, "<u4").tolist() == [50256, 1976]


def test_packed_ids(spark):
    plain = Tokenizer.from_file(tokenizer_path())
    rows = list(enumerate(TEXTS))
    for r in packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path(), special=True).collect():
        ids = np.array([*plain.encode(TEXTS[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
