import pickle
import random

import pyspark.sql.functions as F
from helpers import documents

from eventbook.llm import toxicity
from eventbook.llm.common import held_out, table

LABELS = "doc_id long, quality int, toxic int"


def distance(a, b):
    """Edits, a swap of neighbours being one (no letter is edited twice)."""
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_and_trie_find_all_within_their_edits():
    rnd = random.Random(9)
    terms = list({"".join(rnd.choices("ab", k=rnd.randint(3, 13))) for _ in range(120)})
    trie = toxicity.Trie([t for t in terms if toxicity.edits_of(t)])
    hits = 0
    for _ in range(1500):
        word = "".join(rnd.choices("abc", [4, 4, 1], k=rnd.randint(2, 14)))
        want = sorted(t for t in terms if toxicity.edits_of(t) and distance(word, t) <= toxicity.edits_of(t))
        assert sorted(trie.near(word)) == want
        assert trie.possible(word) or not want
        hits += bool(want)
    assert hits > 300


def test_common_misspellings():
    trie = toxicity.Trie(["idiot", "horrible", "disrespectful"])
    words = ("idoit", "idot", "horribel", "horirbel", "horible", "ids", "disrepsecftul", "disrespetfulll", "disresfulll")
    assert [trie.near(w) for w in words] == [["idiot"], ["idiot"], ["horrible"], [], ["horrible"], [], ["disrespectful"], [], []]
    assert trie.near("disrespetfull") == ["disrespectful"]


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rows = toxicity.score(docs, labels).join(labels, "doc_id").where(held_out(F.col("doc_id"))).select("score", "predicted", "toxic").collect()
    right = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in rows)
    assert right / sum(r["predicted"] for r in rows) > 0.95
    assert right / sum(r["toxic"] for r in rows) > 0.85
    assert all(0 <= r["score"] <= 1 for r in rows)


def made(spark):
    rnd = random.Random(4)
    words = [f"plain{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        text = rnd.choices(words, k=40)
        toxic = i % 3 == 0
        if toxic:
            text[5:5] = ["you", "horrible", "creature"]
            text[20:20] = ["you", "dreadful", "horrible", "thing"]
        elif i % 3 == 1:
            text[10:10] = ["“they", "wrote", "horrible", "here”"]
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_misspelled_and_quoted(spark):
    rows, labels = made(spark)
    more = [(1000, "plain1 you horible craeture plain2 you dredful horrbile plain3"), (1001, "plain1 “they wrote horrible here” plain2 plain3 plain4 plain5"), (1002, "")]
    more += [(None, None), (1003, "plain4"), (1003, "plain4"), (1004, "plain5 " * 30_000)]
    labels += [(None, 1, 1), (1, None, None), (77_777, 0, 1)]
    got = toxicity.score(documents(spark, rows + more), spark.createDataFrame(labels, LABELS))
    by_id = {r["doc_id"]: r for r in got.where("doc_id IS NULL OR doc_id >= 1000").collect()}
    assert by_id[1000]["predicted"] == 1
    assert all(by_id[i]["predicted"] == 0 for i in (None, 1001, 1002, 1003, 1004))
    assert got.count() == len(rows) + len(more)


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], LABELS)
    assert [r["score"] for r in toxicity.score(documents(spark, [(1, "a")]), none).collect()] == [0.0]
    assert toxicity.score(documents(spark, []), none).count() == 0
    one = spark.createDataFrame([(i, 0, 1) for i in range(9)], LABELS)
    assert {r["score"] for r in toxicity.score(documents(spark, [(i, "a b") for i in range(9)]), one).collect()} == {1.0}


def test_long_terms_are_found_by_their_pieces():
    rng = random.Random(5)

    def edited(word, n):
        for _ in range(n):
            i, kind = rng.randrange(len(word) - 1), rng.randrange(4)
            if kind == 0:
                word = word[:i] + word[i + 1 :]
            elif kind == 1:
                word = word[:i] + rng.choice("abc") + word[i:]
            elif kind == 2:
                word = word[:i] + rng.choice("abc") + word[i + 1 :]
            else:
                word = word[:i] + word[i + 1] + word[i] + word[i + 2 :]
        return word

    terms = ["".join(rng.choices("abc", k=n)) for n in (22, 23, 24, 25, 26, 27, 40, 400, 3_000)]
    trie = toxicity.Trie(terms)
    for term in terms:
        for n in (0, 1, 2):
            for _ in range(60):
                word = edited(term, n)
                # Edits of one place may cancel the rule against editing a swap again; what the automaton takes counts.
                assert trie.possible(word) or not trie.near(word)
    assert not trie.possible("d" * 400) and not trie.possible("d" * 25)


def test_words_met_are_known_to_the_next_task():
    model = toxicity.Model({"horrible": 2.0})
    toxicity.scorer_of(model).figures(["horible words"])
    assert set(toxicity.scorer_of(model).kind) == {"horible", "words"}
    # What a worker has met stays there.
    assert pickle.loads(pickle.dumps(model)).scorer is None


def test_only_terms_of_like_letters_are_walked(monkeypatch):
    """A walk through a large lexicon steps along few branches, and finds what is near."""
    rnd = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    terms = list({"".join(rnd.choices(letters, k=rnd.randint(11, 14))) for _ in range(1_000)})
    trie, walked, step = toxicity.Trie(terms), [], toxicity.Automaton.step
    monkeypatch.setattr(toxicity.Automaton, "step", lambda *a: (walked.append(1), step(*a))[1])
    for term in terms[:50]:
        assert trie.near(term[:4] + term[5:7] + "q" + term[7:]) == [term]
    assert len(walked) < 50 * 100, len(walked)
