import math
import random
from collections import Counter

import numpy as np
import pyspark.sql.functions as F
from helpers import documents

from eventbook.llm import language
from eventbook.llm.common import held_out, table


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where(held_out(F.col("doc_id"))).select("lang", "lang_pred", "score", "rejected").collect()
    assert len(got) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got) and not any(r["rejected"] for r in got)


def test_odd_rows(spark):
    rows = [(i, "the cat and the dog were here with the other cat", "en") for i in range(9)] + [(20 + i, "le chat et le chien sont ici avec un autre chien", "fr") for i in range(9)]
    rows += [(None, None, None), (50, "", "en"), (51, "123 !!", None), (52, "the dog", None), (52, "the dog", None), (53, "le chien " * 40_000, None), (54, "漢字" * 50, None)]
    got = {(r["doc_id"], r["lang_pred"], r["rejected"]): r["score"] for r in language.identify(documents(spark, rows)).collect()}
    assert got[None, "und", True] == got[50, "und", True] == got[51, "und", True] == 0.0
    assert (52, "en", False) in got and (53, "fr", False) in got
    assert any(k[0] == 54 and k[2] for k in got)


def test_nothing_to_learn(spark):
    got = language.identify(documents(spark, [(1, "text", None), (2, None, "en")])).collect()
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in got} == {("und", 0.0, True)}
    assert language.identify(documents(spark, [])).count() == 0


def test_probabilities_sum_to_one():
    counts = {}
    for lang, words in {"a": ["abc", "abd", "bca", "ab"], "b": ["xyz", "zzy", "abz"]}.items():
        counts[lang] = Counter(g for w in words for g in language.word_grams(w))
    model = language.kneser_ney(counts)
    alphabet = sorted({g[-1] for c in counts.values() for g in c})
    for context in ("\x02" * 4, "\x02\x02ab", "zzzz", "\x02xyz"):
        grams = [context + c for c in alphabet]
        p = np.exp(model.log_probabilities(language.codes_of(grams))).sum(axis=0)
        # What is left is the share of characters that were never met.
        assert (p < 1 + 1e-5).all() and (p > 0.7).all()


def test_words_by_array_and_by_hand():
    counts = {"a": Counter(language.word_grams("abcab")), "b": Counter(language.word_grams("xyzab"))}
    model = language.kneser_ney(counts)
    words = ["ab", "xyz", "qqq"]
    got = model.of_words(words)
    for row, word in zip(got, words, strict=True):
        want = -model.log_probabilities(language.codes_of(language.word_grams(word))).sum(axis=0)
        assert np.allclose(row[:-1], want, atol=1e-4) and row[-1] == len(word) + 1
        assert not math.isnan(row[0])


def test_made_up_words_are_rejected(spark):
    rnd = random.Random(2)
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    given = [r["text"] for r in docs.where("lang IS NOT NULL AND n_chars > 300 AND doc_id % 20 = 0").select("text").limit(200).collect()]
    shuffled = [" ".join("".join(rnd.sample(w, len(w))) for w in text.split()) for text in given]
    made = [" ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n)) for n in (30, 60, 300)]
    rows = [(k, t) for k, t in enumerate(given + shuffled + made)]
    got = {r["doc_id"]: r["rejected"] for r in language.identify(documents(spark, rows), learn_from=docs).collect()}
    n = len(given)
    assert not any(got[k] for k in range(n))
    assert sum(got[k] for k in range(n, 2 * n)) > 0.95 * n and all(got[k] for k in range(2 * n, 2 * n + 3))


def kneser_ney_by_hand(words, alphabet):
    """Log probability of a character after a context, from the definition, by plain dictionaries."""
    full = Counter(g for w in words for g in language.word_grams(w))
    levels = [dict(full)]
    for _ in range(language.ORDER - 1):
        levels.insert(0, dict(Counter(g[1:] for g in levels[0])))

    def p(gram):
        if not gram:
            return 1 / alphabet
        level = levels[len(gram) - 1]
        once, twice = sum(c == 1 for c in level.values()), sum(c == 2 for c in level.values())
        discount = min(0.95, max(0.05, once / (once + 2 * twice) if once + twice else 0.5))
        after = [c for g, c in level.items() if g[:-1] == gram[:-1]]
        if not after:
            return p(gram[1:])
        return max(level.get(gram, 0) - discount, 0) / sum(after) + discount * len(after) / sum(after) * p(gram[1:])

    return p


def test_against_kneser_ney_by_hand():
    rnd = random.Random(3)
    corpora = {lang: ["".join(rnd.choices(letters, k=rnd.randint(1, 6))) for _ in range(40)] for lang, letters in {"a": "aab", "b": "abbc", "c": "ccb"}.items()}
    model = language.kneser_ney({lang: Counter(g for w in words for g in language.word_grams(w)) for lang, words in corpora.items()})
    alphabet = len({g[-1] for words in corpora.values() for w in words for g in language.word_grams(w)}) + 1
    grams = sorted({g for words in corpora.values() for w in words for g in language.word_grams(w)})
    got = model.log_probabilities(language.codes_of(grams))
    for k, lang in enumerate(model.languages):
        p = kneser_ney_by_hand(corpora[lang], alphabet)
        assert np.allclose(got[:, k], [math.log(p(g)) for g in grams], atol=1e-4)


def test_bound_between_texts_and_shuffled_letters():
    rng = np.random.default_rng(1)
    chars = rng.integers(40, 5000, 400).astype(float)
    h = 1.4 + rng.normal(0, 2, 400) / np.sqrt(chars)
    bounds = language.bound_of(np.r_[h, 3.9], np.r_[h + 3, 6.0], np.r_[chars, 900.0])
    model = language.Model(["x"], [], [], 0.0, bounds=bounds[None])
    assert (h < model.highest(np.zeros(400, int), chars)).all()
    near, far = model.highest(np.zeros(2, int), np.array([5000.0, 50.0]))
    assert 3.1 < near < 3.5 and near < far < 4.6
    assert language.shuffled("abc def\ng") == language.shuffled("abc def\ng") and sorted(language.shuffled("abc")) == list("abc")
