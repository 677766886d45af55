"""Byte-level BPE for tasks: the vocabulary file's merges, its split of texts, and word caches.

The file (``tokenizers`` format) is opened where a task runs; its path is a parameter.  A text is cut
at its special strings first, then by the split pattern.  Every space that follows a character other
than white space starts a new pre-token whatever stands before it, so a text without white space
before a space may be cut at its spaces and each piece looked up by itself; other texts are split by
the pattern as a whole.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import regex
import tiktoken

#: The split pattern of the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as Unicode has it (the separators 1C to 1F are no white space there).
SPLIT = SPLIT.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s+(?!\S)|\s+", r"\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Pieces that a task's cache holds before it starts anew, and the longest piece that it takes.
CACHE_PIECES, CACHE_CHARS = 1_000_000, 64
NO_RANK = np.int32(2**31 - 1)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the file, by the rule of the format."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """What a task needs of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        ids, merges = content["model"]["vocab"], content["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"] if t["special"]}
        symbol = byte_symbols()
        self.ranks = {bytes(symbol[c] for c in token): i for token, i in ids.items() if token not in self.special}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int32)
        if np.any(np.diff(made) <= 0):
            raise ValueError("merges do not make ids in their order")
        order = np.argsort(keys)
        self.pair_keys, self.pair_ids = keys[order], made[order]
        self.split = regex.compile(SPLIT)
        self.cut = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.encoding = tiktoken.Encoding("file", pat_str=SPLIT.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S"), mergeable_ranks=self.ranks, special_tokens={})

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id that each pair merges to (ids grow with the rank), NO_RANK where there is no merge."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ids[at], NO_RANK)


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def texts_between_specials(v: Vocabulary, text: str) -> tuple[list[str], list[int]]:
    """The ordinary texts around special strings, and the ids of those strings."""
    found = [v.special[m.group()] for m in v.cut.finditer(text)]
    return (v.cut.split(text), found) if found else ([text], found)


#: White space before a space: such a text may not be cut at its spaces.
SPACES = re.compile(r"[\s\x85] ")
