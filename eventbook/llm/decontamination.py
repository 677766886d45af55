"""Operator 13: documents that share passages with benchmark items, found by winnowing.

A window is ``WINDOW`` consecutive words of an item (an item of fewer words is one window).  Each window
of a text selects one fingerprint: of its k-gram hashes the smallest, the last one among equals.  Equal windows
select equal fingerprints at equal places, so that a span shared by a document and an item shares at least one,
and a long text keeps about two fingerprints of seven words.  Windows of each length have fingerprints
of their own.

1. The items' fingerprints are marked in bitmaps of a set size, which the tasks that read the documents hold:
   fingerprints that no item can have are left out where they are made.
2. What remains joins the items' fingerprints.  Every hit is extended to both sides over the words around
   it: the windows that selected the fingerprint are held, word by word as text, against the items' windows.
   Both joins are on equal values: a common fingerprint or a common passage costs as many rows as the
   documents have hits, never a row for each pair of a document and an item.
3. The extended hits of a document are spans, whose union counts its hit words.  Windows that occur in the same
   items form one class, and documents with the same classes share one list of items, so that a passage which
   thousands of documents and items hold is listed once.

Cases: null and empty texts and texts without a word have no words and hit nothing; an item without an id is an
item that no list names, so it takes no part; items that share an id are one item of several texts;
repeated rows and rows that share an id are documents of their own; an empty table of documents gives an empty
result, an empty table of items leaves all documents clean; columns named like a result column are replaced,
others are carried.  A document's list of items can hold all items there are: the hash of the joined list asks for it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from eventbook.llm.common import steps
from eventbook.llm.shingles import mix
from eventbook.session import cut_lineage

#: Words of a window; words of a k-gram at most.
WINDOW, GRAM = 10, 5
#: Bits of the bitmaps for each fingerprint of the items, and at most (32 MB): more would only let more pass.
BITS_EACH, MOST_BITS = 64, 1 << 28
#: Bits of one bitmap of Spark's ``bitmap_construct_agg``.
BITMAP = 1 << 15
#: Fixed by the contract: A to Z as lower case, words of these characters.
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(256, dtype=np.uint64), 131)
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)

ITEM_GRAMS = "length int, h long"
HIT = "array<struct<length int, h long, at int, words string>>"


def words_of(text: Column) -> Column:
    """The words of a text as an array."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPLIT), lambda w: w != "")


class Words:
    """Hashes and places of all words of some texts, in flat arrays."""

    def __init__(self, texts: list[str]):
        parts = [t.encode() for t in texts]
        self.flat = _LOWER[np.frombuffer(b" ".join(parts), np.uint8)]
        inside = _INSIDE[self.flat]
        before = np.r_[False, inside[:-1]]
        after = np.r_[inside[1:], False]
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        bounds = np.r_[0, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)]
        #: Texts' first words.
        self.first = np.searchsorted(self.starts, bounds)
        if not len(self.starts):
            self.hashes = np.zeros(0, np.uint64)
            return
        # A sum over a word's bytes of a random number times a power for its place.
        sizes = self.ends - self.starts
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        powers = np.multiply.accumulate(np.full(int(sizes.max()), _ODD))
        values = _BYTE[self.flat[inside]] * powers[place]
        self.hashes = mix(np.add.reduceat(values, np.cumsum(sizes) - sizes))

    def words(self, begin: int, end: int) -> str:
        """Words with one blank between them."""
        return b" ".join(self.flat[a:b].tobytes() for a, b in zip(self.starts[begin:end].tolist(), self.ends[begin:end].tolist(), strict=True)).decode()


def gram_of(length: int) -> int:
    return min(GRAM, length)


def selected(texts: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-grams at all words, and the words at which those begin that some text's windows of
    ``length`` words select."""
    k, total = gram_of(length), len(texts.hashes)
    w, n = length - k + 1, total - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = np.full(total - k + 1, np.uint64(length))
    for i in range(k):
        grams = mix(grams + texts.hashes[i : total - k + 1 + i], 7)
    best, least = np.arange(n), grams[:n].copy()
    for i in range(1, w):
        here = grams[i : i + n]
        new = here <= least
        least = np.where(new, here, least)
        best = np.where(new, np.arange(i, n + i), best)
    # Windows that end in the next text are none.
    ends = np.repeat(texts.first[1:], np.diff(texts.first))[:n]
    return grams, np.unique(best[np.arange(n) + length <= ends])


def item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fingerprints of distinct windows; each is given as its words."""
    for batch in batches:
        lengths = np.array(batch.column("length").to_pylist(), np.int64)
        for length in np.unique(lengths).tolist():
            grams, at = selected(Words(batch.column("window").filter(pa.array(lengths == length)).to_pylist()), length)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), length, np.int32)), pa.array(grams[at].view(np.int64))], ["length", "h"])


def finder(lengths: list[int], marks: np.ndarray, columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each document its number, its number of words, and its fingerprints that are marked, each with
    the words of all windows around it."""
    size = np.uint64(len(marks) * 8)
    hit_type = pa.list_(pa.struct([("length", pa.int32()), ("h", pa.int64()), ("at", pa.int32()), ("words", pa.string())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in steps(batches, "decon_text_", 2 << 20):
            texts = Words([t or "" for t in batch.column("decon_text_").to_pylist()])
            rows: list[list[dict]] = [[] for _ in range(len(batch))]
            for length in lengths:
                grams, at = selected(texts, length)
                bit = grams[at] % size
                at = at[(marks[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                around = length - gram_of(length)
                owners = np.searchsorted(texts.first, at, side="right") - 1
                for p, row, h in zip(at.tolist(), owners.tolist(), grams[at].view(np.int64).tolist(), strict=True):
                    begin, end = int(texts.first[row]), int(texts.first[row + 1])
                    low, high = max(begin, p - around), min(end, p + length)
                    rows[row].append({"length": length, "h": h, "at": low - begin, "words": texts.words(low, high)})
            own = np.arange(number, number + len(batch))
            number += len(batch)
            made = [pa.array(own), pa.array(np.diff(texts.first)), pa.array(rows, hit_type)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *made], [*columns, "decon_row_", "n_words", "decon_hits_"])

    return find


def item_windows(items: DataFrame) -> DataFrame:
    """``length, window, item``: the distinct windows of each item."""
    n = F.size("w")
    length = F.least(n, F.lit(WINDOW))
    starts = F.sequence(F.lit(0), n - length)
    windows = F.transform(starts, lambda s: F.array_join(F.slice("w", s + 1, length), " "))
    found = items.select("item", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    return found.select("item", length.alias("length"), F.explode(F.array_distinct(windows)).alias("window")).distinct()


def marked_bits(grams: DataFrame) -> np.ndarray:
    """Bitmaps of the fingerprints, of ``BITS_EACH`` bits each and ``MOST_BITS`` at most."""
    n = grams.count()
    bits = min(MOST_BITS, max(BITMAP, 1 << math.ceil(math.log2(max(1, n * BITS_EACH)))))
    # The remainder of the hash as an unsigned number.
    bit = F.pmod("h", F.lit(bits).cast("long"))
    parts = grams.select(F.floor(bit / BITMAP).cast("long").alias("part"), (bit % BITMAP).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    marks = np.zeros(bits // 8, np.uint8)
    for row in parts.toLocalIterator():
        begin = row.part * (BITMAP // 8)
        marks[begin : begin + BITMAP // 8] = np.frombuffer(row.bits, np.uint8)
    return marks


def set_name(value: Column) -> Column:
    """Names a group's set of distinct values, whatever their order."""
    spread = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), value))
    return F.struct(F.count(value).alias("size"), spread(1).alias("x"), spread(2).alias("y"))


class Contamination:
    """What documents share with items.

    ``found``: the documents with their number (``decon_row_``) and ``n_words``; ``spans``: ``row, start,
    length, class``, the windows of items that occur in them, at which word; ``members``: ``class, item``, the items
    of each class of windows.
    """

    def __init__(self, docs: DataFrame, items: DataFrame, columns: tuple[str, ...], text_column: str, item_id: str, item_text: str):
        named = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text")).where(F.col("item").isNotNull())
        windows = cut_lineage(item_windows(named))
        # Windows in the same items are one class.
        classed = cut_lineage(windows.groupBy("length", "window").agg(set_name(F.col("item")).alias("class")))
        self.members = windows.join(classed, ["length", "window"]).select("class", "item").distinct()
        grams = cut_lineage(classed.mapInArrow(item_grams, ITEM_GRAMS).distinct())
        lengths = sorted(r.length for r in grams.select("length").distinct().collect())

        self.columns = [c for c in columns if c.lower() not in RESULTS]
        carried = docs.select(*(F.col(f"`{c}`") for c in self.columns), F.col(f"`{text_column}`").cast("string").alias("decon_text_"))
        schema = StructType([*carried.schema.fields[:-1], *_parse_datatype_string(f"decon_row_ long, n_words long, decon_hits_ {HIT}").fields])
        self.found = cut_lineage(carried.mapInArrow(finder(lengths, marked_bits(grams), self.columns), schema))
        hits = self.found.where(F.size("decon_hits_") > 0).select(F.col("decon_row_").alias("row"), F.inline("decon_hits_"))
        hits = hits.join(grams, ["length", "h"], "left_semi")

        # Extension: the windows around a hit, as far as an item has them.
        around = hits.select("row", "length", "at", F.split("words", " ").alias("w"))
        starts = F.sequence(F.lit(0), F.size("w") - F.col("length"))
        each = F.transform(starts, lambda s: F.struct((F.col("at") + s).alias("start"), F.array_join(F.slice("w", s + 1, F.col("length")), " ").alias("window")))
        spans = around.select("row", "length", F.explode(each).alias("s")).select("row", "length", "s.start", "s.window").distinct()
        self.spans = cut_lineage(spans.join(classed, ["length", "window"]).select("row", "start", "length", "class"))

    def by_document(self) -> DataFrame:
        """The documents' columns with ``n_words, n_hit, n_items, items_sha256, contaminated``."""
        places = self.spans.select("row", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("place")).distinct()
        hit = places.groupBy("row").agg(F.count("*").alias("n_hit"))
        # Lists of items, once for each set of classes.
        classes = cut_lineage(self.spans.select("row", "class").distinct())
        sets = cut_lineage(classes.groupBy("row").agg(set_name(F.col("class")).alias("set")))
        one = sets.groupBy("set").agg(F.min("row").alias("row"))
        lists = one.join(classes, "row").join(self.members, "class").select("set", "item").distinct()
        joined = F.sha2(F.encode(F.array_join(F.array_sort(F.collect_list("item")), ","), "UTF-8"), 256)
        lists = lists.groupBy("set").agg(F.count("*").alias("n_items"), joined.alias("items_sha256"))
        told = sets.join(hit, "row").join(lists, "set").select(F.col("row").alias("decon_of_"), "n_hit", "n_items", "items_sha256")
        rows = self.found.drop("decon_hits_").join(told, F.col("decon_row_") == F.col("decon_of_"), "left")
        zero = F.lit(0).cast("long")
        return rows.select(
            *(F.col(f"`{c}`") for c in self.columns), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
        )


def find(docs: DataFrame, items: DataFrame, columns: tuple[str, ...] = ("doc_id",), text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> Contamination:
    """Documents (of which ``columns`` are carried) held against benchmark items."""
    return Contamination(docs, items, columns, text_column, item_id, item_text)


#: The same rows by all windows of all documents; for DuckDB.
ORACLE = r"""
WITH d AS (
  SELECT row_, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM (SELECT *, row_number() OVER () AS row_ FROM {documents})
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM {benchmark} WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)
), of_docs AS (
  SELECT row_, s, size, array_to_string(w[s:s + size - 1], ' ') AS win
  FROM (SELECT row_, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
), hits AS (
  SELECT row_, s, size, item_id FROM of_docs JOIN windows USING (size, win)
), places AS (
  SELECT row_, count(DISTINCT p) AS n_hit FROM (SELECT row_, unnest(range(s, s + size)) AS p FROM (SELECT DISTINCT row_, s, size FROM hits)) GROUP BY row_
), lists AS (
  SELECT row_, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM (SELECT DISTINCT row_, item_id FROM hits) GROUP BY row_
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (row_) LEFT JOIN lists USING (row_)
"""
