"""Operator 5: token counts by rank-synchronous merging of ragged arrays.

A batch's pre-tokens that were not met before stand in one flat array of symbols with the start of
each sequence.  A round finds the lowest-rank pair of every sequence and merges it in all sequences at
once, everywhere in the sequence from left to right; sequences without a pair to merge leave with the
number of symbols that survive.  A later pair of a merged symbol always has a higher rank, so a round
gives what one merge at a time gives.  Counts of pieces are kept in a bounded cache of the task.

Cases: null and empty texts have 0 bytes and 0 tokens; special strings inside a text count one token
each; repeated rows give repeated results; an empty table an empty result; other columns are ignored.
One long text is one step of its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventbook.llm import bpe
from eventbook.llm.common import steps

#: Marks that are pre-tokens of their own after a letter and before a space.
MARKS = tuple(".,;:!?")
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def surviving_symbols(v: bpe.Vocabulary, tokens: list[bytes]) -> np.ndarray:
    """Number of symbols left of each pre-token (none is empty) when no merge applies any more."""
    counts = np.zeros(len(tokens), np.int64)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    symbols = v.byte_ids[np.frombuffer(b"".join(tokens), np.uint8)]
    owner = np.repeat(np.arange(len(tokens)), lengths)
    ranks = np.full(len(symbols), bpe.NO_RANK)
    inside = np.flatnonzero(owner[:-1] == owner[1:])
    ranks[inside] = v.merged(symbols[inside], symbols[inside + 1])
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[starts, len(symbols)])
        lowest = np.repeat(np.minimum.reduceat(ranks, starts), sizes)
        going = lowest < bpe.NO_RANK
        if not going.all():
            ended = ~going[starts]
            counts[owner[starts[ended]]] = sizes[ended]
            symbols, owner, ranks, lowest = symbols[going], owner[going], ranks[going], lowest[going]
            if not len(symbols):
                break
        merge = ranks == lowest
        # In a run of one symbol pairs overlap: every second one of neighbouring marks is merged.
        place = np.arange(len(merge))
        merge &= (place - np.maximum.accumulate(np.where(merge, -1, place))) % 2 == 1
        at = np.flatnonzero(merge)
        symbols[at] = lowest[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        new = np.cumsum(keep)[at] - 1
        symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
        changed = np.zeros(len(symbols), bool)
        changed[new] = changed[new[new > 0] - 1] = True
        ranks[changed] = bpe.NO_RANK
        touched = np.flatnonzero(changed[:-1] & (owner[:-1] == owner[1:]))
        ranks[touched] = v.merged(symbols[touched], symbols[touched + 1])
    return counts


class Counter:
    """Token counts of texts, with the counts of pieces met before.

    A piece is what stands between two spaces, counted with the space before it, or a pre-token of a
    text that may not be cut at spaces; the latter and the first piece of a text begin with a mark.
    """

    def __init__(self, v: bpe.Vocabulary):
        self.v, self.known = v, {}

    def pieces(self, text: str) -> list[str]:
        if not text:
            return []
        if bpe.SPACES.search(text):
            return ["\0" + t for t in self.v.split.findall(text)]
        pieces = text.split(" ")
        pieces[0] = "\0" + pieces[0]
        return pieces

    def tokens(self, piece: str) -> list[str]:
        """The pre-tokens of a piece; the pattern is not needed for a word of letters and a mark after it."""
        if piece.isalpha():
            return [" " + piece]
        if piece[-1:] in MARKS and piece[:-1].isalpha():
            return [" " + piece[:-1], piece[-1]]
        return self.v.split.findall(piece[1:] if piece[:1] == "\0" else " " + piece)

    def learn(self, pieces: set[str], counts: dict[str, int]) -> None:
        """Put the counts of pieces into ``counts``."""
        split = list(map(self.tokens, pieces))
        tokens = list({t for s in split for t in s})
        found = dict(zip(tokens, surviving_symbols(self.v, [t.encode() for t in tokens]).tolist(), strict=True))
        counts.update(zip(pieces, (found[s[0]] if len(s) == 1 else sum(map(found.__getitem__, s)) for s in split), strict=True))

    def count(self, texts: list[str | None]) -> list[int]:
        if len(self.known) > bpe.CACHE_PIECES:
            self.known = {}
        totals, open_pieces, new = [], [], set()
        for i, text in enumerate(texts):
            ordinary, ids = bpe.texts_between_specials(self.v, text or "")
            totals.append(len(ids))
            for pieces in map(self.pieces, ordinary):
                found = list(map(self.known.get, pieces))
                totals[i] += sum(filter(None, found))
                if None in found:
                    missing = [p for p, n in zip(pieces, found, strict=True) if n is None]
                    new.update(missing)
                    open_pieces.append((i, missing))
        long = {p for p in new if len(p) > bpe.CACHE_CHARS}
        self.learn(new - long, self.known)
        rare: dict[str, int] = {}
        self.learn(long, rare)
        for i, missing in open_pieces:
            totals[i] += sum(self.known[p] if p in self.known else rare[p] for p in missing)
        return totals


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Bytes and tokens of every text; ``over_limit`` where there are more than ``limit`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.setdefault(path, Counter(bpe.vocabulary(path)))
        for batch in steps(batches, "text"):
            n = counter.count(batch.column("text").to_pylist())
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return texts.mapInArrow(run, SCHEMA).withColumn("over_limit", F.col("n_tokens") > limit)
