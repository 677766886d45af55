import hashlib
import random
import re

import numpy as np
import pytest
from helpers import connect, difference, documents

from eventbook.llm import decontamination as decon

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(10, len(w))
        if item is not None and size:
            for s in range(len(w) - size + 1):
                windows.setdefault(tuple(w[s : s + size]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w, places, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for s in range(len(w) - size + 1):
                if tuple(w[s : s + size]) in windows:
                    places |= set(range(s, s + size))
                    found |= windows[tuple(w[s : s + size])]
        out.append((doc_id, len(w), len(places), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(places)))
    return sorted(out, key=repr)


def compare(spark, docs, items, kind="long", sql=True):
    d, b = documents(spark, docs), spark.createDataFrame(items, f"item_id {kind}, text string")
    found = decon.find(d, b).by_document()
    assert found.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, found.collect()), key=repr) == by_hand(docs, items)
    if sql:
        assert difference(found, connect(documents=d, benchmark=b), decon.ORACLE.format(documents="documents", benchmark="benchmark")) is None


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it"), (2, "what is two plus two"), (3, "short"), (4, ""), (5, None), (6, "?! ..."),
    (7, "the quick brown fox jumps over the lazy dog and sleeps"), (8, "aa aa aa aa aa aa aa aa aa aa aa aa aa"), (None, "an item without any id takes no part at all here"),
    (9, "Ünïted wörds 42 ärgern sich über żółć und 😀 sehr gern"), (10, "a b c d e f g h i"), (1, "second text of the first item which is long enough to have windows"),
    (11, "what is two plus two"),
]


def test_odd_rows(spark):
    docs = [
        (1, "x The QUICK brown-fox jumps over the lazy dog, and runs y"), (2, None), (3, ""), (4, "..."), (5, "so: What is two plus two?"), (6, "SHORT"), (6, "short short"),
        (7, "quick brown fox jumps over the lazy dog and"), (8, "aa " * 9), (9, "aa " * 40), (9, "aa " * 40), (None, "an item without any id takes no part at all here"), (10, "no hit"),
        (11, "ünïted WÖRDS 42 ärgern sich über żółć und 😀 sehr gern"), (11, "Ünïted wörds 42 ärgern sich über żółć und 😀 sehr gern"), (12, "a b c d e f g h i j a b c d e f g h"),
        (None, "short"), (13, "what is two plus two short the quick brown fox jumps over the lazy dog and sleeps or runs"),
    ]
    compare(spark, docs, ITEMS)
    compare(spark, docs, [(f"q-{i}", t) for i, t in ITEMS if i], "string")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_words(spark, seed):
    # Few different words: equal k-grams, ties in windows and repeats everywhere.
    rng = random.Random(seed)
    text = lambda most, kinds: " ".join(rng.choice("abcdef"[:kinds]) for _ in range(rng.randrange(most)))
    items = [(k, text(30, rng.choice([1, 2, 3]))) for k in range(12)]
    docs = [(k, text(200, rng.choice([1, 2, 3, 6])) + " " + rng.choice(items)[1]) for k in range(60)]
    compare(spark, docs, items)


def test_hot_passage_in_documents_and_items(spark):
    # A third of the documents and of the items hold one passage.
    passage = " ".join(f"w{k}" for k in range(60))
    docs = [(k, f"lead {k} {passage if k % 3 == 0 else 'nothing'} end {k % 5}") for k in range(300)]
    compare(spark, docs, [(k, f"{passage if k % 3 == 0 else ''} own {k} words of this item are here and no where else") for k in range(60)])


def test_empty_tables_and_long_texts(spark):
    docs = [(1, "one two three"), (2, None)]
    compare(spark, docs, [])
    compare(spark, docs, [(None, "one two three"), (4, "--")])
    none = documents(spark, docs).where("doc_id > 5")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decon.find(none, items).by_document().collect() == []
    compare(spark, [(1, "word " * 300_000 + ITEMS[0][1]), (2, "x" * 2_000_000), (3, "short " * 100_000)], ITEMS, sql=False)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "what is two plus two", 5, "a", 3, True)], "doc_id long, text string, n_hit long, item string, row long, contaminated boolean")
    found = decon.find(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), columns=tuple(docs.columns)).by_document()
    assert found.columns == ["doc_id", "text", "item", "row", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert tuple(found.first())[:6] == (1, "what is two plus two", "a", 3, 5, 5)


def test_every_long_span_shares_a_fingerprint():
    rng = np.random.default_rng(5)
    for _ in range(200):
        kinds = int(rng.integers(1, 50))
        span = " ".join(f"v{x}" for x in rng.integers(0, kinds, 10))
        sides = [" ".join(f"v{x}" for x in rng.integers(0, 50, int(rng.integers(0, 30)))) for _ in range(4)]
        kept = []
        for left, right in (sides[:2], sides[2:]):
            grams, at = decon.selected(decon.Words([f"{left} {span} {right}"]), 10)
            begin = len(words(left))
            kept.append({(int(p) - begin, int(grams[p])) for p in at})
        assert kept[0] & kept[1]


def test_fingerprints_are_sparse():
    grams, at = decon.selected(decon.Words([" ".join(f"v{k * 7919 % 5003}" for k in range(5000))]), 10)
    assert 0.25 < len(at) / len(grams) < 0.32
