"""Operator 4: language of a text by interpolated Kneser-Ney character models.

Each language has a model of characters within words (up to ``ORDER``; a word begins with a mark and
ends with one).  Its probabilities, with lower orders by the number of distinct predecessors, are worked
out for all n-grams met in any language and kept in sorted arrays of their hashes, one for each order
with a column for each language; so are the weights that a context leaves to the lower order.  A text
has, in each language, a cross-entropy for each character; the lowest one wins.  The score is the share of
the winner among exp(-b * cross-entropy), with b fitted on texts that the models have not seen.  The same texts
show where cross-entropies of a language lie, and, with the letters of each word shuffled, where those of texts
lie that are no language.  A text is marked as rejected if its lowest cross-entropy is nearer to the latter: above the
language's middle by more than ``PART`` of the way, and a margin that short texts need.

Learning takes a bounded sample: about ``DOCS_PER_LANGUAGE`` whole texts and ``BYTES_PER_LANGUAGE`` bytes of each
language, by a hash of id and text, without held-out rows.  A part of it, ``HELD_BACK``, is for the calibration alone.
n-grams are counted in tasks; the driver gets the counts of the sample.

Cases: null texts and texts without a letter are ``und`` with score 0, and rejected; so is every text if
there is nothing to learn from; ties go to the language that sorts first; repeated rows get repeated
results, an empty table an empty one; other columns are carried where asked for.
"""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventbook.llm.common import held_out, portion, steps

ORDER = 5
#: Bounds of the sample (expected whole texts and bytes of each language), and the part that calibrates.
DOCS_PER_LANGUAGE, BYTES_PER_LANGUAGE, HELD_BACK = 1250, 8 << 20, 0.2
BEGIN, END = "\x02", "\x03"
#: Part of the way from a language to shuffled letters, and standard deviations of chance in short texts, up to
#: which a text is kept.
PART, CHANCE = 0.6, 4.0
#: Fewest held-back texts that show where a language lies; with fewer, texts are rejected that are further above the
#: highest of the learning texts than a margin (nats a character).
ENOUGH, MARGIN = 20, 1.0
#: Fewest characters of a text that counts for the calibration.
CALIBRATION_CHARS = 40
CACHE_WORDS, CACHE_CHARS = 600_000, 48
UNKNOWN = "und"


def letters(word: str) -> str:
    """The letters of a word in lower case."""
    word = word.lower()
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def word_grams(word: str) -> list[str]:
    """The n-gram of the highest order that ends at each letter and at the end."""
    padded = BEGIN * (ORDER - 1) + word + END
    return [padded[i : i + ORDER] for i in range(len(word) + 1)]


_POWERS = np.multiply.accumulate(np.full(ORDER, 0xD6E8FEB86659FD93, np.uint64))


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of n-grams given as rows of code points."""
    x = (codes.astype(np.uint64) + np.uint64(7)) * _POWERS[: codes.shape[1]]
    x = np.bitwise_xor.reduce((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), axis=1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codes_of(grams: list[str]) -> np.ndarray:
    width = len(grams[0]) if grams else 1
    return np.array("".join(grams), f"U{max(1, width * len(grams))}").reshape(1).view(np.uint32)[: width * len(grams)].reshape(-1, width)


@dataclass
class Table:
    """Sorted hashes and a row of values for each."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, entries: dict[str, np.ndarray]) -> Table:
        keys = gram_hashes(codes_of(list(entries)))
        order = np.argsort(keys)
        return cls(keys[order], np.array(list(entries.values()), np.float32)[order])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions, and whether the key is there."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


@dataclass
class Model:
    languages: list[str]
    #: By order from 1: log probabilities of n-grams; logs of what contexts leave to the lower order.
    grams: list[Table]
    contexts: list[Table]
    unseen: float
    sharpness: float = 1.0
    #: For each language the highest cross-entropy that is kept, and the standard deviation of one character.
    bounds: np.ndarray | None = None

    def highest(self, language: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The highest cross-entropy of texts of some length that is not rejected."""
        bound, of_char = self.bounds[language].T
        return bound + CHANCE * of_char / np.sqrt(np.maximum(chars, 1))

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """For n-grams of the highest order (rows of code points), a column for each language."""
        out = np.zeros((len(codes), len(self.languages)), np.float32)
        open_ = np.arange(len(codes))
        for order in range(ORDER, 0, -1):
            at, there = self.grams[order - 1].find(gram_hashes(codes[open_, ORDER - order :]))
            out[open_[there]] += self.grams[order - 1].values[at[there]]
            open_ = open_[~there]
            if not len(open_):
                return out
            if order > 1:
                at, there = self.contexts[order - 2].find(gram_hashes(codes[open_, ORDER - order : ORDER - 1]))
                out[open_[there]] += self.contexts[order - 2].values[at[there]]
        out[open_] += self.unseen
        return out

    def of_words(self, words: list[str]) -> np.ndarray:
        """Sums of negative log probabilities, and the number of characters, of words of letters."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        codes = codes_of([BEGIN * (ORDER - 1) + "".join(w + END + BEGIN * (ORDER - 1) for w in words)])[0]
        ends = np.cumsum(lengths + ORDER - 1)
        starts = np.repeat(ends - lengths - ORDER + 1, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        rows = np.lib.stride_tricks.sliding_window_view(codes, ORDER)[starts]
        sums = np.add.reduceat(-self.log_probabilities(rows), np.cumsum(lengths) - lengths, axis=0)
        return np.c_[sums, lengths].astype(np.float32)


def kneser_ney(counts: dict[str, Counter]) -> Model:
    """A model from the counts of highest-order n-grams of each language."""
    languages = sorted(counts)
    by_order: list[list[dict[str, int]]] = [[] for _ in range(ORDER)]
    for language in languages:
        level = dict(counts[language])
        for order in range(ORDER, 0, -1):
            by_order[order - 1].append(level)
            lower: dict[str, int] = defaultdict(int)
            for gram in level:
                lower[gram[1:]] += 1
            level = dict(lower)
    alphabet = len({g for level in by_order[0] for g in level}) + 1
    n = len(languages)
    probability: dict[str, np.ndarray] = {"": np.full(n, 1 / alphabet)}
    grams, contexts = [], []
    for order in range(1, ORDER + 1):
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros((2, n)))
        discounts = np.zeros(n)
        for k, level in enumerate(by_order[order - 1]):
            once, twice = sum(c == 1 for c in level.values()), sum(c == 2 for c in level.values())
            discounts[k] = min(0.95, max(0.05, once / (once + 2 * twice) if once + twice else 0.5))
            for gram, c in level.items():
                sums[gram[:-1]][:, k] += c, 1
        left = {}
        for context, (totals, kinds) in sums.items():
            left[context] = np.where(totals > 0, discounts * kinds / np.maximum(totals, 1), 1.0)
        found = {}
        for gram in {g for level in by_order[order - 1] for g in level}:
            own = np.array([level.get(gram, 0) for level in by_order[order - 1]])
            totals = sums[gram[:-1]][0]
            direct = np.where(totals > 0, np.maximum(own - discounts, 0) / np.maximum(totals, 1), 0)
            found[gram] = direct + left[gram[:-1]] * probability[gram[1:]]
        grams.append(Table.of({g: np.log(np.maximum(p, 1e-12)) for g, p in found.items()}))
        if order > 1:
            contexts.append(Table.of({c: np.log(np.maximum(w, 1e-12)) for c, w in left.items()}))
        else:
            floor = float(np.log(np.maximum((left[""] / alphabet).mean(), 1e-12)))
        probability = found
    return Model(languages, grams, contexts, floor)


class Scorer:
    """Sums of texts from sums of words, with the words met before."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.rows = np.zeros((1, len(self.model.languages) + 1), np.float32)
        self.place: dict[str, int] = {}

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """For each text the sum of each language and, last, the number of characters."""
        if len(self.place) > CACHE_WORDS:
            self.clear()
        split = [t.split() if t else [] for t in texts]
        new = list({w for words in split for w in words if w not in self.place})
        clean = list(map(letters, new))
        kept = [(w, c) for w, c in zip(new, clean, strict=True) if c]
        self.place.update((w, 0) for w, c in zip(new, clean, strict=True) if not c)
        if kept:
            begin = len(self.rows)
            self.rows = np.r_[self.rows, self.model.of_words([c for _, c in kept])]
            self.place.update((w, begin + i) for i, (w, _) in enumerate(kept))
        out = np.zeros((len(texts), self.rows.shape[1]))
        for i, words in enumerate(split):
            if words:
                out[i] = self.rows[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
        for w in new:
            if len(w) > CACHE_CHARS:
                del self.place[w]
        return out


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, gram, n`` of a step's texts."""
    for batch in steps(batches, "text"):
        words: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words[lang].update(text.split())
        rows = []
        for lang, counted in words.items():
            grams: Counter = Counter()
            for word, n in counted.items():
                clean = letters(word)
                if clean:
                    for gram in word_grams(clean):
                        grams[gram] += n
            rows += [(lang, gram, n) for gram, n in grams.items()]
        lang, gram, n = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(gram, pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def learn(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> Model | None:
    """A model from ``doc_id, text, lang``; None if there is nothing to learn from."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    if not found:
        return None
    shares = {r["lang"]: min(1.0, per_language / r["n"], BYTES_PER_LANGUAGE / max(1, r["bytes"])) for r in found}
    share = F.element_at(F.create_map(*(F.lit(x) for pair in shares.items() for x in pair)), F.col("lang"))
    # Dealt by id and text: rows of one id are not taken or left together.
    chance = lambda seed: portion(F.concat_ws(":", F.lit(seed), F.col("doc_id"), F.xxhash64("text")))
    sample = rows.where(chance("sample") < share).select("lang", "text", (chance("part") < HELD_BACK).alias("back"))
    counts: dict[str, Counter] = defaultdict(Counter)
    # A language of a few texts needs them all.
    few = F.col("lang").isin([r["lang"] for r in found if r["n"] * HELD_BACK < ENOUGH])
    learned = sample.where(~F.col("back") | few)
    counted = learned.select("lang", "text").mapInArrow(count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    for r in counted.toLocalIterator():
        counts[r["lang"]][r["gram"]] = r["n"]
    if not counts:
        return None
    model = kneser_ney(counts)
    calibrate(model, sample.where(F.col("back") | few).select("lang", "text"))
    return model


def calibrate(model: Model, sample: DataFrame) -> None:
    """Sharpness of the score, and the highest cross-entropies that are kept."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in steps(batches, "text"):
            texts = batch.column("text").to_pylist()
            sums, mixed = scorer.sums(texts), scorer.sums(list(map(shuffled, texts)))
            chars = sums[:, -1]
            h, none = (x[:, :-1] / np.maximum(x[:, -1], 1)[:, None] for x in (sums, mixed))
            arrays = [batch.column("lang"), pa.array(list(h), pa.list_(pa.float64())), pa.array(none.min(axis=1)), pa.array(chars)]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "h", "none", "chars"])

    rows = sample.mapInArrow(run, "lang string, h array<double>, none double, chars double").where(F.col("chars") >= CALIBRATION_CHARS).collect()
    shared.unpersist()
    model.bounds = np.tile([np.inf, 0.0], (len(model.languages), 1))
    rows = [r for r in rows if r["lang"] in model.languages]
    if not rows:
        return
    h, none, chars = (np.array([r[c] for r in rows]) for c in ("h", "none", "chars"))
    own = np.array([model.languages.index(r["lang"]) for r in rows])
    right = h.argmin(axis=1) == own
    for k in range(len(model.languages)):
        here = right & (own == k)
        if here.sum() >= ENOUGH:
            model.bounds[k] = bound_of(h[here, k], none[here], chars[here])
        elif here.any():
            model.bounds[k, 0] = h[here, k].max() + MARGIN
    best = (np.inf, 1.0)
    for b in 2.0 ** np.arange(-3, 8):
        x = -b * (h - h.min(axis=1, keepdims=True))
        loss = -(x[np.arange(len(own)), own] - np.log(np.exp(x).sum(axis=1))).mean()
        best = min(best, (loss, b))
    model.sharpness = best[1]


def shuffled(text: str) -> str:
    """The text with the letters of each word in another order, always the same."""
    chance = random.Random(text)
    return " ".join("".join(chance.sample(word, len(word))) for word in text.split())


def bound_of(h: np.ndarray, none: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """The bound and a character's standard deviation, by medians: a few odd texts do not move them."""
    middle = np.median(h)
    return np.array([middle + PART * max(0.0, np.median(none) - middle), 1.4826 * np.median(np.abs(h - middle) * np.sqrt(chars))])


RESULT = "lang_pred string, score double, cross_entropy double, rejected boolean"


def predicted(model: Model | None, sums: np.ndarray) -> list[pa.Array]:
    """The result columns for sums of texts."""
    n = len(sums)
    if model is None:
        return [pa.array([UNKNOWN] * n), pa.array(np.zeros(n)), pa.array([None] * n, pa.float64()), pa.array([True] * n)]
    chars = sums[:, -1]
    h = sums[:, :-1] / np.maximum(chars, 1)[:, None]
    best = h.argmin(axis=1)
    lowest = h[np.arange(n), best]
    score = 1 / np.exp(-model.sharpness * (h - lowest[:, None])).sum(axis=1)
    none = chars == 0
    names = np.where(none, UNKNOWN, np.array(model.languages, object)[best])
    return [pa.array(names.tolist(), pa.string()), pa.array(np.where(none, 0.0, score)), pa.array(lowest, mask=none), pa.array(none | (lowest > model.highest(best, chars)))]


def identify(docs: DataFrame, learn_from: DataFrame | None = None, columns: tuple[str, ...] = ("doc_id",), per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """The asked columns of every document with ``lang_pred, score, cross_entropy, rejected``.

    ``docs`` needs ``text``; ``learn_from`` (``docs`` itself if not given) ``doc_id, text, lang``.  Asked columns
    named like a result column are replaced by it.
    """
    results = [c.split()[0] for c in RESULT.split(", ")]
    columns = tuple(c for c in columns if c.lower() not in results)
    model = learn((docs if learn_from is None else learn_from).select("doc_id", "text", "lang"), per_language)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model) if model else None
        for batch in steps(batches, "lang_text_"):
            texts = batch.column("lang_text_").to_pylist()
            sums = scorer.sums(texts) if scorer else np.zeros((len(texts), 1))
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, *predicted(model, sums)], [*columns, *results])

    rows = docs.select(*(F.col(f"`{c}`") for c in columns), F.col("text").alias("lang_text_"))
    kinds = "".join(f"`{n}` {t}, " for n, t in rows.dtypes if n != "lang_text_")
    return rows.mapInArrow(run, f"{kinds}{RESULT}")
