"""Operator 1: exact BM25 top-k by block-max pruning over a sharded inverted index.

A shard is a run of at most ``SHARD_DOCS`` documents of one task, which builds the shard's index where it
reads the texts: one row with the posting lists by term.  Document frequencies and the mean length are sums
over all shards, so that scores are those of one index.  Neighbouring shards form a group of about
``GROUP_POSTINGS`` postings, whose lists are joined and stored: the index travels once.

First every query is answered by one group, to which it travels.  Its k-th score there is a threshold that any
other answer has to reach.  Then the other groups are met in turns of 1, 4, 16, ... times as many as the first turn;
each starts from the k-th score so far, so that what a turn returns for a query does not grow with its groups.  In a
turn queries do not travel: they are packed into blocks of ``BLOCK_TERMS`` terms, stored once, and a task reads a
group and a block where they are stored.  Disk grows with the documents, not with queries times groups.

A group answers a query as WAND does, with the bounds of whole lists and of blocks of ``BLOCK`` documents.  Lists
whose bounds together do not pass the threshold cannot bring a document in by themselves: they are put off, the
most frequent words first.  The other lists give each of their documents a part of its score.  Only
documents whose part and the maxima of the put-off lists in their block together pass the threshold are scored in
full.  This holds for queries of any length; the more terms a query has, the more of the frequent ones are put off.

A query is all terms of a document (one that no other document has is of no use), or with ``terms`` only as
many as weigh most (frequency times inverse document frequency).  Scores are sums of whole millionths, so their
order does not depend on that of the sums.

Cases: null and empty texts are documents of length 0; rows without an id take no part; rows that share
an id are documents of their own and never an answer to that id's query, which has the terms of all of them;
equal scores go by the smaller id; a query without terms, or without a document that has one, has no rows; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventbook.llm.common import steps
from eventbook.session import cut_lineage, run_folder, setting, unsorted_writes

K1, B = 1.2, 0.75
NEAREST = 10
#: Documents and text bytes of a shard, postings of a group, documents of a block.
SHARD_DOCS, SHARD_BYTES, GROUP_POSTINGS, BLOCK = 8192, 24 << 20, 4_000_000, 16
#: A group's last shard begins before this document, so that places in a group take two bytes.
GROUP_DOCS = (1 << 16) - SHARD_DOCS
#: Terms of a block of queries.
BLOCK_TERMS = 2_000_000
#: Lists of fewer postings are gathered together.
SHORT = 256
#: Each turn has so many times the groups met before.
WIDENED = 3
#: Lists with at least this share of a group's documents have block maxima and are held by document.
FREQUENT = 1 / 6
#: Scores are whole numbers of this part.
UNIT = 1_000_000
WORDS = re.compile(r"[^\W_]+")
KNOWN_TERMS = 200_000
#: Lists that are moved at once into a group.
LISTS_MOVED = 16_384
BLOBS = {"ids": np.int64, "lengths": np.int32, "terms": np.int64, "dfs": np.int32, "docs": np.uint16, "tfs": np.uint8, "large": np.int32}
#: Frequencies from this one on are written as this one, and in full in ``large``, in the order of their postings.
LARGE = 255

#: What the first pass keeps: answers of queries (turn -1), and each group's joined index with the turn that meets it.
KEPT = "query_id long, doc_id long, score long, group long, n_docs long, " + "".join(f"{c} binary, " for c in BLOBS) + "turn int"
FOUND = "query_id long, doc_id long, score long"
#: A block's queries, their first groups, thresholds and numbers of terms; its terms in order with their frequencies; the queries' terms by their places there.
QUERY_BLOBS = {"queries": np.int64, "firsts": np.int64, "leasts": np.int64, "sizes": np.int32, "words": np.int64, "counts": np.int32, "places": np.int32}
BLOCKS = ", ".join(f"{c} binary" for c in QUERY_BLOBS)

INDEX = "shard long, n_docs long, n_words long, postings long, ids binary, lengths binary, terms binary, dfs binary, docs binary, tfs binary, large binary"


class Hashes(dict):
    def __missing__(self, term: str) -> int:
        number = xxhash.xxh3_64_intdigest(term)
        self[term] = number
        return number


def terms_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


class Shard:
    """Documents of a shard until they are enough."""

    def __init__(self):
        self.ids, self.lengths, self.sizes, self.terms, self.tfs = [], [], [], [], []
        self.bytes = 0

    def add(self, doc_id: int, words: list[str], size: int, hashes: Hashes) -> None:
        counts = Counter(words)
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.sizes.append(len(counts))
        self.terms.append(np.fromiter(map(hashes.__getitem__, counts), np.uint64, len(counts)))
        self.tfs.append(np.fromiter(counts.values(), np.int32, len(counts)))
        self.bytes += size

    def index(self, shard: int) -> pa.RecordBatch:
        """One row: ids and lengths by place; terms in order with their lists, each in order of places."""
        docs = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)
        terms, tfs = np.concatenate(self.terms).view(np.int64), np.concatenate(self.tfs)
        order = np.argsort(terms, kind="stable")
        found, dfs = np.unique(terms, return_counts=True)
        docs, tfs = docs[order].astype(np.uint16), tfs[order]
        short, large = np.minimum(tfs, LARGE).astype(np.uint8), tfs[tfs >= LARGE].astype(np.int32)
        blobs = (np.array(self.ids, np.int64), np.array(self.lengths, np.int32), found, dfs.astype(np.int32), docs, short, large)
        numbers = (shard, len(self.ids), sum(self.lengths), len(terms))
        arrays = [pa.array([x], pa.int64()) for x in numbers] + [pa.array([x.tobytes()], pa.binary()) for x in blobs]
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in INDEX.split(", ")])


def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, shard, number = Hashes(), Shard(), 0
    task = TaskContext.get().partitionId() << 24
    for batch in steps(batches, "text"):
        if len(hashes) > KNOWN_TERMS:
            hashes.clear()
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            shard.add(doc_id, terms_of(text), len(text or ""), hashes)
            if len(shard.ids) >= SHARD_DOCS or shard.bytes >= SHARD_BYTES:
                yield shard.index(task + number)
                shard, number = Shard(), number + 1
    if shard.ids:
        yield shard.index(task + number)


def query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``query_id, word, term, tf`` of the queries' texts."""
    for batch in steps(batches, "text"):
        rows = [(i, w, n) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for w, n in Counter(terms_of(t)).items()]
        ids, words, counts = zip(*rows, strict=True) if rows else ((), (), ())
        numbers = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string()), pa.array(numbers), pa.array(counts, pa.int64())], ["query_id", "word", "term", "tf"])


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``term, df`` of each shard."""
    for batch in batches:
        for terms, dfs in zip(batch.column("terms").to_pylist(), batch.column("dfs").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int64)), pa.array(np.frombuffer(dfs, np.int32).astype(np.int64))], ["term", "df"])


def rows_of(schema: str, n: int, **columns: object) -> pa.RecordBatch:
    """``n`` rows with these columns; others are null."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    named = [c.split() for c in schema.split(", ")]
    arrays = [pa.array(columns[c], kinds[kind]) if c in columns else pa.nulls(n, kinds[kind]) for c, kind in named]
    return pa.RecordBatch.from_arrays(arrays, [c for c, _ in named])


def answers(schema: str, out: list[tuple[int, int, int]], **columns: object) -> pa.RecordBatch:
    found = zip(*out, strict=True) if out else ((), (), ())
    return rows_of(schema, len(out), **dict(zip(("query_id", "doc_id", "score"), found, strict=True)), **columns)


def flat_ranges(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range behind the other."""
    sizes = ends - begins
    return np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class Group:
    """The joined index of some shards.  A list's scores, its bound and its block maxima are worked out when the
    first query asks for it."""

    def __init__(self, shards: list[dict], mean: float):
        of = lambda name: [s[name] for s in shards]
        self.ids, self.lengths = np.concatenate(of("ids")), np.concatenate(of("lengths"))
        self.n = len(self.ids)
        if len(shards) == 1:
            # The lists of one shard, or of a group that was stored, are in their places.
            self.terms, self.docs, self.tfs = shards[0]["terms"], shards[0]["docs"], self.full(shards[0])
            self.ends = np.cumsum(shards[0]["dfs"], dtype=np.int64)
            self.begins = self.ends - shards[0]["dfs"]
        else:
            self.join(shards, of)
        size = len(self.docs)
        self.slow = K1 * (1 - B + B * self.lengths / mean) if mean else np.full(self.n, K1)
        self.scores = np.zeros(size, np.int32)
        self.known = np.zeros(len(self.terms), bool)
        self.bounds = np.zeros(len(self.terms), np.int64)
        frequent = np.flatnonzero(self.ends - self.begins >= max(1, FREQUENT * self.n))
        self.row = np.full(len(self.terms), -1)
        self.row[frequent] = np.arange(len(frequent))
        blocks = -(-self.n // BLOCK)
        self.whole = np.zeros((len(frequent), blocks * BLOCK), np.int32)
        self.maxima = np.zeros((len(frequent), blocks), np.int32)
        by_id = np.argsort(self.ids, kind="stable")
        self.sorted_ids, self.by_id = self.ids[by_id], by_id
        #: Postings read so far and those of all lists asked for.
        self.read = self.asked = 0

    @staticmethod
    def full(shard: dict) -> np.ndarray:
        """The frequencies of a shard, large ones in full."""
        tfs = shard["tfs"]
        if len(shard["large"]):
            tfs = tfs.astype(np.int32)
            tfs[tfs == LARGE] = shard["large"]
        return tfs

    def join(self, shards: list[dict], of: Callable[[str], list]) -> None:
        first = np.cumsum([0, *of("n_docs")])
        lists, dfs = np.concatenate(of("terms")), np.concatenate(of("dfs")).astype(np.int64)
        # Lists of one term follow each other by shard, so that their places ascend.
        order = np.argsort(lists, kind="stable")
        ends = np.empty(len(lists), np.int64)
        ends[order] = np.cumsum(dfs[order])
        size = int(dfs.sum())
        self.docs = np.empty(size, np.uint16 if self.n <= 1 << 16 else np.int32)
        self.tfs = np.empty(size, np.int32 if any(map(len, of("large"))) else np.uint8)
        # Postings go straight to their places, some lists of a shard at a time.
        at = np.cumsum([0, *map(len, of("terms"))])
        for s, place, a, b in zip(shards, first, at[:-1], at[1:], strict=False):
            source, tfs = np.cumsum(dfs[a:b]), self.full(s)
            for x in range(a, b, LISTS_MOVED):
                y = min(b, x + LISTS_MOVED)
                to = flat_ranges(ends[x:y] - dfs[x:y], ends[x:y])
                part = slice(int(source[x - a] - dfs[x]), int(source[y - a - 1]))
                self.docs[to] = s["docs"][part] + self.docs.dtype.type(place)
                self.tfs[to] = tfs[part]
        self.terms, begins = np.unique(lists[order], return_index=True)
        self.begins = (ends - dfs)[order][begins]
        self.ends = np.r_[self.begins[1:], size].astype(np.int64)

    def stored(self, group: int, turn: int) -> pa.RecordBatch:
        """One row of ``KEPT``, from which the group is made again as from a shard."""
        dfs = (self.ends - self.begins).astype(np.int32)
        large = self.tfs[self.tfs >= LARGE].astype(np.int32)
        blobs = zip(BLOBS, (self.ids, self.lengths, self.terms, dfs, self.docs, np.minimum(self.tfs, LARGE).astype(np.uint8), large), strict=True)
        return rows_of(KEPT, 1, group=[group], turn=[turn], n_docs=[self.n], **{c: [np.ascontiguousarray(x, BLOBS[c]).tobytes()] for c, x in blobs})

    def places(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term's list, -1 without one."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def learn(self, lists: np.ndarray, idf: np.ndarray) -> None:
        sizes = self.ends[lists] - self.begins[lists]
        at = flat_ranges(self.begins[lists], self.ends[lists])
        tf = self.tfs[at].astype(np.float64)
        score = np.floor(UNIT * (np.repeat(idf, sizes) * (tf * (K1 + 1) / (tf + self.slow[self.docs[at]]))) + 0.5).astype(np.int32)
        self.scores[at] = score
        self.bounds[lists] = np.maximum.reduceat(score, np.cumsum(sizes) - sizes)
        for i in lists[self.row[lists] >= 0].tolist():
            row, a, b = self.row[i], self.begins[i], self.ends[i]
            self.whole[row, self.docs[a:b]] = self.scores[a:b]
            self.maxima[row] = self.whole[row].reshape(-1, BLOCK).max(axis=1)
        self.known[lists] = True

    def best(self, query_id: int, terms: np.ndarray, idf: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
        """(score, id) of at most ``k`` documents of more than ``least``, the best of the group."""
        at = self.places(terms)
        return self.best_of(query_id, at[at >= 0], idf[at >= 0], k, least)

    def best_of(self, query_id: int, lists: np.ndarray, idf: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
        if not len(lists):
            return []
        new = ~self.known[lists]
        if new.any():
            self.learn(lists[new], idf[new])
        self.asked += int((self.ends[lists] - self.begins[lists]).sum())
        bound = int(self.bounds[lists].sum())
        if bound <= least:
            return []
        # No sum of scores passes that of the bounds.
        kind, size = np.int32 if bound < 1 << 31 else np.int64, self.whole.shape[1]
        own = self.by_id[slice(*np.searchsorted(self.sorted_ids, [query_id, query_id + 1]))]
        rare, often = lists[self.row[lists] < 0], lists[self.row[lists] >= 0]
        part = np.zeros(size, kind)
        if len(rare):
            begins, ends = self.begins[rare], self.ends[rare]
            short = ends - begins < SHORT
            # Short lists are gathered together, others are copied one by one.
            at = [flat_ranges(begins[short], ends[short])]
            ranges = list(map(slice, begins[~short].tolist(), ends[~short].tolist()))
            docs = np.concatenate([self.docs[x] for x in at + ranges], dtype=np.intp)
            # Whole numbers below 2^53 are exact as weights.
            part = np.bincount(docs, np.concatenate([self.scores[x] for x in at + ranges], dtype=np.float64), size).astype(kind)
            self.read += len(docs)
        part[own] = 0
        if not least:
            least = self.raised(part, k, least)
        often = often[np.argsort(self.bounds[often], kind="stable")]
        off = int(np.searchsorted(np.cumsum(self.bounds[often]), least, side="right"))
        # Of the frequent lists those are put off whose bounds together do not pass the threshold.
        full, rows = often[off:], self.row[often[:off]]
        if len(full):
            for row in self.row[full].tolist():
                part += self.whole[row]
            part[own] = 0
            self.read += int((self.ends[full] - self.begins[full]).sum())
            least = self.raised(part, k, least)
        by_block = part.reshape(-1, BLOCK)
        good = np.flatnonzero((by_block > 0) & (by_block > least - self.maxima[rows].sum(axis=0, dtype=kind)[:, None]))
        scores = part[good].astype(np.int64)
        if len(rows) and len(good):
            rest = self.whole.ravel().take((rows * size)[:, None] + good)
            scores = scores + rest.sum(axis=0, dtype=np.int64)
            self.read += rest.size
            good, scores = good[scores > least], scores[scores > least]
        ids = self.ids[good]
        first = np.lexsort((ids, -scores))[:k]
        return list(zip(scores[first].tolist(), ids[first].tolist(), strict=True))

    @staticmethod
    def raised(part: np.ndarray, k: int, least: int) -> int:
        """``k`` documents have a score of this part at least: what is not above one less is none of the best."""
        above = part[part > least + 1]
        return int(np.partition(above, len(above) - k)[len(above) - k]) - 1 if len(above) >= k else least


def weight(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def turns_of(n_groups: int, least: int) -> list[int]:
    """Where the turns of groups begin, and where the last one ends; a turn has ``least`` groups or more."""
    ends = [0]
    while ends[-1] < n_groups:
        ends.append(min(n_groups, ends[-1] + max(least, WIDENED * ends[-1])))
    return ends


def answering(k: int, n_docs: int, mean: float, turns: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows sorted by group, the group's shards first, then its queries: what the group finds, and the group."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shards, group = None, [], None
        turn = lambda: int(np.searchsorted(turns, number, side="right")) - 1
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            terms, df = (batch.column(c).values.to_numpy(zero_copy_only=False) for c in ("terms_of", "dfs_of"))
            idf = weight(n_docs, df)
            offsets = batch.column("terms_of").offsets.to_numpy()
            ids = batch.column("query_id").to_pylist()
            for i, g in enumerate(batch.column("group").to_pylist()):
                if g != number:
                    if shards:
                        yield Group(shards, mean).stored(number, turn())
                    number, shards, group = g, [], None
                if ids[i] is None:
                    # Copied, so that no batch is held.
                    blobs = {c: np.frombuffer(batch.column(c)[i].as_buffer(), kind).copy() for c, kind in BLOBS.items()}
                    shards.append({**blobs, "n_docs": batch.column("n_docs")[i].as_py()})
                    continue
                if group is None:
                    group, shards = Group(shards, mean), []
                    yield group.stored(number, turn())
                a, b = offsets[i], offsets[i + 1]
                out += [(ids[i], d, s) for s, d in group.best(ids[i], terms[a:b], idf[a:b], k, 0)]
            yield answers(KEPT, out, turn=[-1] * len(out))
        if shards:
            yield Group(shards, mean).stored(number, turn())

    return answer


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block of queries; rows come sorted by block."""

    def row(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        of = lambda c: np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts])
        flat = lambda c: np.concatenate([p.column(c).flatten().to_numpy(zero_copy_only=False) for p in parts])
        sizes = np.concatenate([pc.list_value_length(p.column("terms_of")).to_numpy(zero_copy_only=False) for p in parts])
        words, where, places = np.unique(flat("terms_of"), return_index=True, return_inverse=True)
        blobs = zip(QUERY_BLOBS, (of("query_id"), of("first"), of("least"), sizes, words, flat("dfs_of")[where], places), strict=True)
        return rows_of(BLOCKS, 1, **{c: [np.ascontiguousarray(x, QUERY_BLOBS[c]).tobytes()] for c, x in blobs})

    number, parts = None, []
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for a, b in pairwise(cuts if len(blocks) else []):
            if parts and blocks[a] != number:
                yield row(parts)
                parts = []
            number = blocks[a]
            parts.append(batch.slice(a, b - a))
    if parts:
        yield row(parts)


def meeting(k: int, n_docs: int, mean: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows of a group and a block: what reaches the thresholds of the block's queries."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, group = None, None
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for i, g in enumerate(batch.column("group").to_pylist()):
                read = lambda kinds, i=i: {c: np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in kinds.items()}  # noqa: B023, E731
                if g != number:
                    number, group = g, None
                    group = Group([read(BLOBS)], mean)
                block = read(QUERY_BLOBS)
                at, idf = group.places(block["words"]), weight(n_docs, block["counts"])
                ends = np.cumsum(block["sizes"]).tolist()
                for query_id, first, least, a, b in zip(block["queries"].tolist(), block["firsts"].tolist(), block["leasts"].tolist(), [0, *ends], ends, strict=False):
                    if first != g:
                        places = block["places"][a:b]
                        lists = at[places]
                        out += [(query_id, d, s) for s, d in group.best_of(query_id, lists[lists >= 0], idf[places[lists >= 0]], k, least)]
            yield answers(FOUND, out)

    return meet


def grouped(index: DataFrame) -> DataFrame:
    """``shard, group``: neighbouring shards, numbered from 0.  One row for each shard is all that is ordered."""
    spark = index.sparkSession
    sizes = index.select("shard", "postings", "n_docs")
    total = sizes.agg(F.sum("postings")).first()[0] or 0
    # Small tables make a group for each task.
    size = max(1, min(GROUP_POSTINGS, total // spark.sparkContext.defaultParallelism))
    before = lambda c: F.coalesce(F.sum(c).over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = sizes.select("shard", F.struct(F.floor(before("postings") / size), F.floor(before("n_docs") / GROUP_DOCS)).alias("part"))
    return cut_lineage(found.select("shard", (F.dense_rank().over(Window.orderBy("part")) - 1).cast("long").alias("group")))


def search(docs: DataFrame, is_query: Column, k: int = NEAREST, terms: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``query_id, rank, doc_id, score`` for the queries that ``is_query`` (of ``doc_id``) chooses; a query is
    the whole document, or its heaviest ``terms``."""
    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).where(F.col("doc_id").isNotNull())
    index = cut_lineage(named.mapInArrow(build, INDEX))
    size = index.agg(F.sum("n_docs").alias("n"), F.sum("n_words").alias("words")).first()
    n, mean = size["n"] or 0, (size["words"] or 0) / max(1, size["n"] or 0)

    asked = named.where(is_query).mapInArrow(query_terms, "query_id long, word string, term long, tf long")
    asked = asked.groupBy("query_id", "word", "term").agg(F.max("tf").alias("tf"))
    df = index.select("terms", "dfs").mapInArrow(term_counts, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).where("df > 1")
    weighed = asked.join(df, "term")
    if terms is not None:
        weighed = weighed.withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        heaviest = Window.partitionBy("query_id").orderBy(F.desc(F.floor(F.col("tf") * F.col("idf") * UNIT + 0.5)), "word")
        weighed = weighed.withColumn("r", F.row_number().over(heaviest)).where(F.col("r") <= terms)
    pairs = F.array_sort(F.collect_set(F.struct("term", F.col("df").cast("int").alias("df"))))
    queries = weighed.groupBy("query_id").agg(pairs.alias("pairs"))
    groups = grouped(index)
    n_groups = (groups.agg(F.max("group")).first()[0] or 0) + 1
    first = F.pmod(F.xxhash64("query_id"), F.lit(n_groups)).cast("long")
    queries = cut_lineage(queries.select("query_id", F.col("pairs.term").alias("terms_of"), F.col("pairs.df").alias("dfs_of"), first.alias("first")))

    spark = docs.sparkSession
    turns = turns_of(n_groups, spark.sparkContext.defaultParallelism)
    rows = index.join(groups, "shard").drop("shard", "n_words", "postings")
    rows = rows.unionByName(queries.withColumnRenamed("first", "group"), allowMissingColumns=True)
    # A task for each group: by hashes several would meet in one, and a batch would hold the shards of all.
    rows = rows.repartitionById(n_groups, F.col("group").cast("int")).sortWithinPartitions("group", F.col("query_id").asc_nulls_first())
    folder = run_folder(spark, "groups")
    with unsorted_writes(spark, 2):
        rows.mapInArrow(answering(k, n, mean, turns), KEPT).write.partitionBy("turn").parquet(folder)
    kept = spark.read.schema(KEPT).parquet(folder)
    found = kept.where("turn = -1").select("query_id", "doc_id", "score")
    n_blocks = 1 + (queries.agg(F.sum(F.size("terms_of"))).first()[0] or 0) // BLOCK_TERMS
    block = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int").alias("block")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    for turn in range(len(turns) - 1) if n_groups > 1 else ():
        best = cut_lineage(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))
        # What comes from other groups has to reach the k-th score: equal ones are told apart by their ids.
        reached = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
        reached = reached.select("query_id", F.when(F.col("n") >= k, F.col("low") - 1).otherwise(0).alias("least"))
        told = queries.join(reached, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0).cast("long"))).withColumn("block", block)
        told = told.repartitionById(n_blocks, F.col("block")).sortWithinPartitions("block")
        blocks = cut_lineage(told.mapInArrow(packed, BLOCKS))
        # Read where they are stored, by a task for each group and block: neither is exchanged, sent or collected.
        pairs = kept.where(F.col("turn") == turn).select("group", "n_docs", *BLOBS).crossJoin(blocks.hint("shuffle_replicate_nl"))
        with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", 1):
            found = best.unionByName(cut_lineage(pairs.mapInArrow(meeting(k, n, mean), FOUND)))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "doc_id", (F.col("score") / F.lit(float(UNIT))).alias("score"))


#: For DuckDB: all scores of all documents.
ORACLE = r"""
WITH words AS (
  SELECT doc_id, row_, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS word
  FROM (SELECT doc_id, text, row_number() OVER () AS row_ FROM {documents} WHERE doc_id IS NOT NULL)
), tf AS (
  SELECT doc_id, row_, word, count(*) AS tf FROM words GROUP BY ALL
), lengths AS (
  SELECT row_, sum(tf) AS dl FROM tf GROUP BY row_
), size AS (
  SELECT (SELECT count(*) FROM {documents} WHERE doc_id IS NOT NULL) AS n, (SELECT sum(dl) FROM lengths)::DOUBLE / (SELECT count(*) FROM {documents} WHERE doc_id IS NOT NULL) AS mean
), df AS (
  SELECT word, ln(1 + (any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf, size GROUP BY word HAVING count(*) > 1
), asked AS (
  SELECT doc_id AS query_id, word, idf FROM (SELECT doc_id, word, max(tf) AS tf FROM tf WHERE doc_id % 100 = 0 GROUP BY ALL) JOIN df USING (word)
), scored AS (
  SELECT query_id, tf.doc_id, tf.row_, sum(floor(1000000 * (idf * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean)))) + 0.5::DOUBLE)::BIGINT)::BIGINT AS s
  FROM asked JOIN tf USING (word) JOIN lengths USING (row_), size WHERE tf.doc_id <> query_id GROUP BY ALL
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id)::INTEGER AS rank, doc_id, s / 1000000::DOUBLE AS score
FROM scored QUALIFY rank <= 10
"""
