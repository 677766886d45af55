"""Operator 6: toxicity by a lexicon that also matches misspelled terms, and by the terms' context.

The lexicon is learned: words that occur in far more toxic than other texts of a bounded labelled sample.
It is held as a trie.  A word of a text that is no term itself meets the trie with the word's Levenshtein
automaton, walked along the branches of those terms whose length and letters differ little enough; a swap of
neighbouring letters is one edit.  Terms of at least
``MIN_FUZZY`` letters are found with one edit, those of at least ``MIN_TWO`` with two.  A term and a word so many
edits apart are alike once as many letters are left out of one or both, so words without such a likeness need no
walk.  Words near a term that the sample's other texts use are no misspellings.

A hit's context is the window of words around it: a hit between an opening and a closing quotation mark
counts as quoted, not as abuse; hits close together count as more than the same number apart.  A
logistic model weighs these figures; it learns from the same sample.

Cases: null and empty texts have no hit and get the score of such texts; a label that is null or of an
unknown document does not count; several labels of a document count as toxic if one is; without both
classes to learn from every score is the share of toxic labels, 0 if there are none; repeated rows get
repeated results, an empty table an empty one; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventbook.llm.common import held_out, portion, steps
from eventbook.session import cut_lineage

#: Bound: labelled texts that are learned from (expected).  It bounds the lexicon as well.
MAX_LABELLED = 20_000
#: A term occurs in that many toxic texts and by that factor more often in toxic texts.
MIN_TOXIC, MIN_RATIO = 3, 15.0
#: Words on each side of a hit that are its context; fewest letters of terms matched with one edit and with two.
WINDOW, MIN_FUZZY, MIN_TWO = 8, 5, 11
#: Terms of more letters are looked for by their pieces, since the ways to leave out two letters grow with the square.
LONG = 24
THRESHOLD = 0.7
CACHE_WORDS, CACHE_CHARS = 600_000, 48
OPENING, CLOSING = frozenset("\"“«„‹"), frozenset("\"”»“›")


def letters(word: str) -> str:
    word = word.lower()
    return word if word.isalpha() else "".join(filter(str.isalnum, word))


def edits_of(term: str) -> int:
    return 0 if len(term) < MIN_FUZZY else 1 if len(term) < MIN_TWO else 2


def without(word: str, letters_: int) -> set[str]:
    """The word with up to so many letters left out."""
    found = last = {word}
    for _ in range(letters_):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        found = found | last
    return found


def pieces(length: int, edits: int) -> list[tuple[int, int]]:
    """Parts of a term of so many letters: an edit touches at most two (a swap), so that one stays whole."""
    n = 2 * edits + 1
    return [(length * j // n, length * (j + 1) // n) for j in range(n)]


class Automaton:
    """Levenshtein automaton of a word in which a swap of neighbours is one edit.

    A state has the fewest edits for each reachable place: 2 i stands before letter i, 2 i + 1 in the
    middle of a swap of letters i and i + 1, of which the second has been read.
    """

    def __init__(self, word: str, edits: int = 1):
        self.word, self.edits = word, edits

    def closed(self, state: dict[int, int]) -> tuple[tuple[int, int], ...]:
        """With the places that leaving letters of the word out reaches."""
        for place in sorted(p for p in state if not p & 1):
            while place < 2 * len(self.word) and state[place] < self.edits and state.get(place + 2, self.edits + 1) > state[place] + 1:
                state[place + 2] = state[place] + 1
                place += 2
        return tuple(sorted(state.items()))

    def start(self) -> tuple[tuple[int, int], ...]:
        return self.closed({0: 0})

    def step(self, state: tuple[tuple[int, int], ...], char: str) -> tuple[tuple[int, int], ...]:
        new: dict[int, int] = {}
        for place, e in state:
            i = place >> 1
            if place & 1:
                moves = [(place + 3, e)] if self.word[i] == char else []
            else:
                moves = [(place, e + 1)]  # a letter too many
                if i < len(self.word):
                    moves.append((place + 2, e if self.word[i] == char else e + 1))
                if i + 1 < len(self.word) and self.word[i + 1] == char:
                    moves.append((place + 1, e + 1))
            for to, f in moves:
                if f <= self.edits and f < new.get(to, self.edits + 1):
                    new[to] = f
        return self.closed(new)

    def distance(self, state: tuple[tuple[int, int], ...]) -> int | None:
        """Edits to the word, None if they are too many."""
        return next((e for place, e in state if place == 2 * len(self.word)), None)


def letter_bits(word: str) -> int:
    """The word's letters as bits; letters that share one only hide a difference."""
    bits = 0
    for char in word:
        bits |= 1 << (ord(char) & 63)
    return bits


def branches(terms: Iterable[str]) -> dict:
    """Nodes by letters; a node has its branches and the term that ends there."""
    root: dict = {}
    for term in terms:
        node = root
        for char in term:
            node = node.setdefault(char, {})
        node[""] = term
    return root


class Trie:
    """Terms by length, of which those that may be near a word are walked by branches."""

    def __init__(self, terms: list[str]):
        self.terms = sorted(terms, key=len)
        self.lengths = np.array([len(t) for t in self.terms], np.int64)
        self.edits = np.array([edits_of(t) for t in self.terms], np.int64)
        self.bits = np.array([letter_bits(t) for t in self.terms], np.uint64)
        #: Terms with as many letters left out as they allow edits: of one edit and more, and of two.
        self.one: set[str] = set()
        self.two: set[str] = set()
        #: By length of long terms: the texts of each of their pieces.
        self.long: dict[int, list[set[str]]] = {}
        for term in terms:
            if len(term) > LONG:
                parts = pieces(len(term), 2)
                found = self.long.setdefault(len(term), [set() for _ in parts])
                for texts, (a, b) in zip(found, parts, strict=True):
                    texts.add(term[a:b])
                continue
            if edits_of(term):
                self.one |= without(term, 1)
            if edits_of(term) == 2:
                self.two |= without(term, 2)

    def possible(self, word: str) -> bool:
        """False only if no term is near enough."""
        if len(word) > LONG - 2 and self.has_piece(word):
            return True
        if len(word) > LONG + 2:
            return False
        n = len(word)
        cut = [word[:i] + word[i + 1 :] for i in range(n)]
        if word in self.one or not self.one.isdisjoint(cut):
            return True
        if n < MIN_TWO - 2 or not self.two:
            return False
        if word in self.two or not self.two.isdisjoint(cut):
            return True
        # Each pair of letters once.
        return not self.two.isdisjoint([w[:i] + w[i + 1 :] for j, w in enumerate(cut) for i in range(j)])

    def has_piece(self, word: str) -> bool:
        """Whether a piece of a long term stands in the word within two letters of its place."""
        for length in range(len(word) - 2, len(word) + 3):
            for texts, (a, b) in zip(self.long.get(length, ()), pieces(length, 2), strict=False):
                if any(word[a + shift : b + shift] in texts for shift in range(max(-2, -a), 3)):
                    return True
        return False

    def alike(self, word: str, edits: int) -> list[str]:
        """Terms that so many edits may reach: an edit takes away one letter and adds one at most."""
        a, b = np.searchsorted(self.lengths, [len(word) - edits, len(word) + edits + 1])
        most, bits, own = np.minimum(self.edits[a:b], edits), self.bits[a:b], np.uint64(letter_bits(word))
        good = (np.bitwise_count(bits & ~own) <= most) & (np.bitwise_count(own & ~bits) <= most)
        return [self.terms[a + i] for i in np.flatnonzero(good).tolist()]

    def near(self, word: str) -> list[str]:
        """All terms that the word's automaton accepts with no more edits than the term allows."""
        automaton, found = Automaton(word, 2 if len(word) >= MIN_TWO - 2 else 1), []
        stack, steps_ = [(branches(self.alike(word, automaton.edits)), automaton.start())], {}
        while stack:
            node, state = stack.pop()
            for char, below in node.items():
                if not char:
                    distance = automaton.distance(state)
                    if distance is not None and distance <= edits_of(below):
                        found.append(below)
                else:
                    # Branches share most of their states.
                    if (after := steps_.get((state, char))) is None:
                        after = steps_[state, char] = automaton.step(state, char)
                    if after:
                        stack.append((below, after))
        return found


@functools.lru_cache(maxsize=1)
def trie_of(terms: tuple[str, ...]) -> Trie:
    """The trie of a lexicon, built once by each worker and never sent."""
    return Trie([t for t in terms if edits_of(t)])


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    clean: set[str] = field(default_factory=set)
    weights: np.ndarray | None = None
    constant: float = 0.0
    scorer: Scorer | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"scorer": None}


FEATURES = 8


class Scorer:
    """Figures of texts' hits, with the words met before."""

    def __init__(self, model: Model):
        self.model = model
        self.trie = trie_of(tuple(model.terms))
        self.longest = max(map(len, model.terms), default=0)
        self.clear()

    def clear(self) -> None:
        self.kind: dict[str, int] = {}
        #: By kind: weight and whether the word is a misspelling; 0 is no hit.
        self.weight, self.fuzzy, self.term, self.known = [0.0], [False], [""], {("", False): 0}

    def hit(self, term: str, fuzzy: bool) -> int:
        if (term, fuzzy) not in self.known:
            self.known[term, fuzzy] = len(self.weight)
            self.weight.append(self.model.terms[term])
            self.fuzzy.append(fuzzy)
            self.term.append(term)
        return self.known[term, fuzzy]

    def kind_of(self, raw: str) -> int:
        word = letters(raw)
        if word in self.model.terms:
            return self.hit(word, False)
        if not MIN_FUZZY - 1 <= len(word) <= self.longest + 2 or word in self.model.clean or not self.trie.possible(word):
            return 0
        near = self.trie.near(word)
        return self.hit(max(near, key=lambda t: (self.model.terms[t], t)), True) if near else 0

    def figures(self, texts: list[str | None]) -> np.ndarray:
        if len(self.kind) > CACHE_WORDS:
            self.clear()
        out = np.zeros((len(texts), FEATURES))
        for row, text in enumerate(texts):
            words = text.split() if text else []
            kinds = list(map(self.kind.get, words))
            if None in kinds:
                for i, k in enumerate(kinds):
                    if k is None:
                        if (k := self.kind.get(words[i])) is None:
                            k = self.kind_of(words[i])
                            if len(words[i]) <= CACHE_CHARS:
                                self.kind[words[i]] = k
                        kinds[i] = k
            if any(kinds):
                out[row] = self.of_hits(words, kinds)
        return out

    def of_hits(self, words: list[str], kinds: list[int]) -> np.ndarray:
        places = np.flatnonzero(kinds)
        weight = np.array([self.weight[kinds[i]] for i in places])
        fuzzy = np.array([self.fuzzy[kinds[i]] for i in places])
        quoted = np.array([self.quoted(words, i) for i in places.tolist()])
        abuse = ~quoted
        near = np.searchsorted(places, places + 2 * WINDOW, side="right") - np.arange(len(places))
        return np.array([
            1.0,
            np.log1p(weight[abuse & ~fuzzy].sum()),
            np.log1p(weight[abuse & fuzzy].sum()),
            np.log1p(quoted.sum()),
            np.log1p(len({self.term[kinds[i]] for i in places[abuse]})),
            np.log1p(near[abuse].max(initial=0)),
            np.log1p(100 * abuse.sum() / len(words)),
            float(abuse.sum() >= 2),
        ])

    @staticmethod
    def quoted(words: list[str], i: int) -> bool:
        """Whether a quotation opens in the window before the word and closes in the one after it."""
        before = next((w for w in reversed(words[max(0, i - WINDOW) : i + 1]) if OPENING & set(w[:2])), None)
        after = next((w for w in words[i : i + WINDOW + 1] if CLOSING & set(w[-2:])), None)
        return before is not None and after is not None


def scorer_of(model: Model) -> Scorer:
    """The model's scorer in this worker: the words that one task has met are known to the next."""
    if model.scorer is None:
        model.scorer = Scorer(model)
    return model.scorer


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, toxic, other``: numbers of texts of each class that hold a word."""
    for batch in steps(batches, "text"):
        seen = (Counter(), Counter())
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
            seen[toxic].update(set(map(letters, text.split())))
        words = [w for w in {**seen[0], **seen[1]} if w]
        counts = [pa.array([s[w] for w in words], pa.int64()) for s in (seen[1], seen[0])]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *counts], ["word", "toxic", "other"])


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and constant of a logistic model, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.diag(np.r_[np.full(x.shape[1] - 1, ridge), 1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (p - y) + penalty @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """A model from ``doc_id, text`` and ``doc_id, toxic``, without held-out rows."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = known.count()
    if not n:
        return Model()
    # Not more than the bound: small enough for every task, and no text is shuffled.
    sample = F.broadcast(known.where(portion(F.col("doc_id")) < most / n))
    texts = cut_lineage(docs.where(F.col("text").isNotNull()).join(sample, "doc_id").select("toxic", "text"))
    by_class = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, other = by_class.get(1, 0), by_class.get(0, 0)
    if not toxic or not other:
        share = toxic / max(1, toxic + other)
        return Model(constant=share)
    words = cut_lineage(texts.mapInArrow(count_words, "word string, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")))
    ratio = (F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("other") + 0.5) / (other + 1))
    found = words.where((F.col("toxic") >= MIN_TOXIC) & (ratio >= MIN_RATIO)).select("word", F.log(ratio).alias("w"))
    terms = {r["word"]: r["w"] for r in found.orderBy("word").collect()}
    model = Model(terms)
    if terms:

        def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = trie_of(tuple(terms))
            for batch in batches:
                near = [w for w in batch.column("word").to_pylist() if w not in terms and trie.possible(w) and trie.near(w)]
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.string())], ["word"])

        usual = words.where("other > 0").select("word").mapInArrow(close, "word string")
        model.clean = {r["word"] for r in usual.collect()}
    rows = texts.mapInArrow(_figures_of(model, ["toxic"]), "toxic int, x array<double>").groupBy("toxic", "x").agg(F.count("*").alias("n")).collect()
    x = np.repeat(np.array([r["x"] for r in rows]), [r["n"] for r in rows], axis=0)
    y = np.repeat(np.array([r["toxic"] for r in rows], float), [r["n"] for r in rows])
    model.weights, model.constant = fitted(x, y)
    return model


def _figures_of(model: Model, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in steps(batches, "text"):
            figures = pa.array(list(scorer.figures(batch.column("text").to_pylist())), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), figures], [*columns, "x"])

    return run


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text", most: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, score, predicted, hits`` for every document; labels are learned from, never looked up."""
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(learn(texts, labels, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = scorer_of(model)
        for batch in steps(batches, "text"):
            if model.weights is None:
                scores, any_hit = np.full(len(batch), model.constant), np.zeros(len(batch))
            else:
                x = scorer.figures(batch.column("text").to_pylist())
                scores, any_hit = 1 / (1 + np.exp(-(x @ model.weights + model.constant))), x[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array(any_hit > 0)], ["doc_id", "score", "any_hit"])

    rows = texts.mapInArrow(run, "doc_id long, score double, any_hit boolean")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
