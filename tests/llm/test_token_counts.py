import random

import pytest
from helpers import documents
from tokenizers import Tokenizer

from eventbook.llm import bpe, packing, token_counts
from eventbook.llm.catalog import VOCABULARY

PARTS = ["a", "b", " ", "  ", "\n", " \n", "\t", "é", "ß", "漢", "😀", "1", "23", "'s", "'ll", "!", "?!", "<|endoftext|>", "\x1c", "\x85", " ", "the", "ing", "aaaa", "٣", "Ⅷ", "​", "\r\n", "_", "."]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def texts():
    rnd = random.Random(5)
    made = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 30))) for _ in range(4000)]
    return [None, "", " ", "  ", " a", "a ", "aaaaaaaaa" * 50, "x" * 3000, "ab" * 2000, "word, word. word!", *made]


def test_counts_and_ids_are_the_library_s(library):
    v = bpe.vocabulary(VOCABULARY)
    want = [e.ids for e in library.encode_batch([t or "" for t in texts()], add_special_tokens=False)]
    assert token_counts.Counter(v).count(texts()) == [len(x) for x in want]
    encoder = packing.Encoder(v)
    import numpy as np

    assert [np.frombuffer(encoder.ids(t or ""), "<u4").tolist() for t in texts()] == want


def test_table(spark, library):
    rows = [(1, "some words here"), (1, "some words here"), (None, None), (2, ""), (3, "tok " * 2000)]
    got = sorted(map(tuple, token_counts.count_tokens(documents(spark, rows), VOCABULARY).collect()), key=repr)
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert got == sorted([(*w, w[2] > 1024) for w in want], key=repr)


def test_empty_table(spark):
    assert token_counts.count_tokens(documents(spark, []), VOCABULARY).count() == 0
