"""Operator 10: packing documents into sequences by linear grouping.

Texts become ids (with the end id after each) and are cut where they pass the capacity.  What follows
works on lengths: at most ``capacity`` of them, whatever the number of documents.

1. Large pieces, longest first, form groups of equal cardinality; each counts as long as the longest of
   its group, which leaves few sizes.
2. Configurations of these sizes are made one after the other: the largest size left, with the fewest
   and largest others that fill the sequence best, used as often as the counts allow.
3. Actual pieces take the places of their group by rank; the room that is then really left in each
   sequence is counted.
4. Small pieces, longest first, go to the fullest sequences that still hold them (counts of sequences by
   room left), the rest to new sequences.

Ranks come from ``ranks.ranked``: no length is gathered in one task, however many pieces share it.  The
plan held by the driver has rows for lengths and configurations only.

Cases: a null text is an empty one and becomes the end id alone; repeated rows are packed once each; a
null id is carried; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import sys
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventbook.llm import bpe
from eventbook.llm.common import steps
from eventbook.llm.ranks import ranked
from eventbook.session import cut_lineage

CAPACITY, END_ID = 1024, 2
#: A piece is small up to this share of the capacity; number of groups of the others.
SMALL_SHARE, GROUPS = 16, 512
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder(dict):
    """Ids of a piece that follows a space, as little-endian 32-bit numbers; filled as pieces come."""

    def __init__(self, v: bpe.Vocabulary):
        super().__init__()
        self.v = v

    def ordinary(self, text: str) -> bytes:
        ids = self.v.encoding.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, piece: str) -> bytes:
        ids = self.ordinary(" " + piece)
        if len(piece) <= bpe.CACHE_CHARS:
            self[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        ordinary, special = bpe.texts_between_specials(self.v, text)
        out = []
        for i, part in enumerate(ordinary):
            if bpe.SPACES.search(part):
                out.append(self.ordinary(part))
            else:
                first, *rest = part.split(" ")
                out.append(self.ordinary(first))
                out.extend(map(self.__getitem__, rest))
            if i < len(special):
                out.append(struct.pack("<I", special[i]))
        if len(self) > bpe.CACHE_PIECES:
            self.clear()
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and end of the pieces of ``n`` ids; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
    return list(zip(edges, edges[1:], strict=False))


def pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(bpe.vocabulary(path)))
        for batch in steps(batches, "text"):
            rows, held = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encoder.ids(text or "") + end
                for k, (a, b) in enumerate(cut_points(len(ids) // 4, capacity)):
                    part = ids[4 * a : 4 * b]
                    rows.append((doc_id, k, a, b - a, zlib.crc32(part)))
                    if with_ids:
                        held.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(held, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def grouped(counts: dict[int, int], groups: int) -> list[tuple[int, int]]:
    """Size and number of pieces of each group, longest first; groups of equal size are one."""
    lengths = np.array(sorted(counts, reverse=True))
    ends = np.cumsum([counts[x] for x in lengths])
    edges = np.unique(np.linspace(0, ends[-1], groups + 1).astype(np.int64))
    sizes = lengths[np.searchsorted(ends, edges[:-1], side="right")]
    out: list[tuple[int, int]] = []
    for size, n in zip(sizes.tolist(), np.diff(edges).tolist(), strict=True):
        if out and out[-1][0] == size:
            out[-1] = (size, out[-1][1] + n)
        else:
            out.append((size, n))
    return out


def best_filling(sizes: list[int], room: int) -> list[int]:
    """Sizes (any of them again and again) that fill ``room`` best, as few and as large as can be."""
    mask = (1 << room + 1) - 1
    reached = [1]
    union = 1
    while True:
        level = 0
        for s in sizes:
            if s <= room:
                level |= reached[-1] << s
        level &= mask & ~union
        if not level:
            break
        reached.append(level)
        union |= level
        if level >> room & 1:
            break
    target = union.bit_length() - 1
    out: list[int] = []
    k = next(k for k, level in enumerate(reached) if level >> target & 1)
    while k:
        s = next(s for s in sizes if s <= target and reached[k - 1] >> target - s & 1)
        out.append(s)
        target, k = target - s, k - 1
    return out


def configurations(groups: list[tuple[int, int]], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """How often each configuration (size: how many) is used; together they hold every piece."""
    left = dict(groups)
    out = []
    while left:
        sizes = sorted(left, reverse=True)
        seed = sizes[0]
        usable = [s for s in sizes if s != seed or left[s] > 1]
        uses: dict[int, int] = defaultdict(int, {seed: 1})
        for s in best_filling(usable, capacity - seed):
            if uses[s] < left[s]:
                uses[s] += 1
        uses = {s: n for s, n in uses.items() if n}
        times = min(left[s] // n for s, n in uses.items())
        out.append((times, uses))
        for s, n in uses.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
    return out


def places(groups: list[tuple[int, int]], found: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, int]:
    """Intervals of ranks (longest piece: 0): first rank, first sequence, pieces in each; all sequences."""
    base, by_size = 0, defaultdict(list)
    for times, uses in found:
        for s, n in uses.items():
            by_size[s].append((base, n, times))
        base += times
    rows, rank = [], 0
    for s, total in groups:
        for first, n, times in by_size[s]:
            rows.append((rank, first, n))
            rank += n * times
    return np.array(rows, np.int64).reshape(-1, 3), base


def small_places(small: dict[int, int], room: dict[int, int], capacity: int) -> tuple[dict[int, np.ndarray], int]:
    """Where small pieces go, by length: first rank, room class (-1: new sequences), first sequence of
    that class, pieces in each.  Also the number of new sequences."""
    by_room: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for r, n in room.items():
        by_room[r].append((r, 0, n))
    out, new = {}, 0
    for length in sorted(small, reverse=True):
        left, rank, rows = small[length], 0, []
        for r in sorted(x for x in by_room if x >= length):
            kept = []
            for kind, first, n in by_room.pop(r):
                each = r // length
                full = min(n, left // each)
                if full:
                    rows.append((rank, kind, first, each))
                    rank, left = rank + full * each, left - full * each
                    by_room[r - each * length].append((kind, first, full))
                    first, n = first + full, n - full
                if n and 0 < left < each:
                    rows.append((rank, kind, first, left))
                    rank, by_room[r - left * length] = rank + left, [*by_room[r - left * length], (kind, first, 1)]
                    left, first, n = 0, first + 1, n - 1
                if n:
                    kept.append((kind, first, n))
            by_room[r].extend(kept)
            if not left:
                break
        if left:
            each = capacity // length
            full, over = divmod(left, each)
            rows.append((rank, -1, new, each))
            if full:
                by_room[capacity - each * length].append((-1, new, full))
            if over:
                by_room[capacity - over * length].append((-1, new + full, 1))
            new += full + bool(over)
        out[length] = np.array(rows, np.int64)
    return out, new


def pack(
    docs: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
    groups: int = GROUPS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row for each piece with its sequence and its place there; ``with_ids`` adds the ids."""
    if sys.byteorder != "little":
        raise RuntimeError("ids are held as the machine has them, which has to be little-endian")
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    schema = PIECES + ", ids array<int>" * with_ids
    rows, counted = ranked(texts, pieces(path, capacity, end_id, with_ids), schema, "length")
    # At most one row for each length up to the capacity.
    counts = {r["length"]: r["n_"] for r in counted.collect()}
    border = capacity // SMALL_SHARE
    large = {x: n for x, n in counts.items() if x > border}
    small = {x: n for x, n in counts.items() if x <= border}

    spread = grouped(large, groups) if large else []
    intervals, used = places(spread, configurations(spread, capacity))
    longer = np.zeros(capacity + 2, np.int64)  # pieces longer than a length
    for x in range(capacity, 0, -1):
        longer[x - 1] = longer[x] + large.get(x, 0)

    def put_large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank_"))
            rank = rank + longer[length]
            first, sequence, each = intervals[np.searchsorted(intervals[:, 0], rank, side="right") - 1].T
            yield batch.append_column("sequence_id", pa.array(sequence + (rank - first) // each))

    kept = [c for c in rows.columns if c != "ids"]
    out_schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n in kept) + ", sequence_id long"
    meta = rows.select(*kept)
    big = meta.where(F.col("length") > border).mapInArrow(put_large, out_schema) if large else None
    if big is not None:
        big = cut_lineage(big)
    parts = [big] if big is not None else []
    if small:
        parts.append(_put_small(meta.where(F.col("length") <= border), big, small, used, capacity))
    if not parts:
        parts = [meta.withColumn("sequence_id", F.lit(None).cast("long"))]
    placed = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # A sequence holds at most as many pieces as ids.
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "task_", "nth_").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    if with_ids:
        placed = placed.join(rows.select("task_", "nth_", "length", "ids"), ["task_", "nth_", "length"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return placed.select(*names, *["ids"] * with_ids)


def _put_small(rows: DataFrame, big: DataFrame | None, small: dict[int, int], used: int, capacity: int) -> DataFrame:
    room: dict[int, int] = {}
    numbered = None
    if big is not None:
        fills = big.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("room"))
        numbered, by_room = ranked(fills.where("room > 0"), lambda batches: batches, "sequence_id long, room long", "room")
        # At most one row for each length up to the capacity.
        room = {r["room"]: r["n_"] for r in by_room.collect()}
    where, _ = small_places(small, room, capacity)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank_"))
            kind, nth = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                of = length == x
                rows_ = where[int(x)]
                first, kinds, begin, each = rows_[np.searchsorted(rows_[:, 0], rank[of], side="right") - 1].T
                kind[of], nth[of] = kinds, begin + (rank[of] - first) // each
            yield batch.append_column("room", pa.array(kind)).append_column("in_room", pa.array(nth))

    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", room long, in_room long"
    put_rows = rows.mapInArrow(put, schema)
    if numbered is None:
        return put_rows.withColumn("sequence_id", F.col("in_room") + used).drop("room", "in_room")
    found = numbered.select("room", F.col("rank_").alias("in_room"), "sequence_id")
    joined = put_rows.join(found, ["room", "in_room"], "left")
    new = F.col("in_room") + used
    return joined.withColumn("sequence_id", F.coalesce("sequence_id", new)).drop("room", "in_room")
