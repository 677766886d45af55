"""Operator 7: near-duplicate groups by fast similarity sketching, banding and exact verification.

Documents with equal shingle sets are one node from the start.  Nodes that agree on all coordinates of a
band meet in a bucket.  A bucket does not emit its pairs: in a few rounds every node is held against one
node only, the most similar (by sketch) of its buckets' centres that belong to another component, and
the pair is verified on full sets.  Components grow, and buckets of one component need nothing more.  What
remains, nodes of different components in one bucket, is verified pair by pair if finer sketches leave a
chance (which takes a similarity of about 0.7), in the first bucket of each pair, so that no link is
lost for the sake of the rounds.

A pair at similarity 0.75 shares no band with probability (1 - 0.75^4)^32 < 6e-6; its fine sketches
differ in more than ``FINE_DIFFERENT`` coordinates' bits with probability 1e-6.

Cases: null and empty texts and texts of white space have no shingles and are linked with nothing; a null
id counts as larger than any other; rows that share an id are grouped by their texts like others;
repeated rows are in one group; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventbook.llm import shingles
from eventbook.llm.common import steps
from eventbook.session import cut_lineage

#: A link: PER_CENT of the union, at least, is shared.
PER_CENT = 75
ROWS = 4
#: Coordinates (of 128) whose two bits differ: 24 expected at the threshold, 4.4 standard deviation.
MOST_DIFFERENT = 47
#: The same for the fine sketches: 384 expected, 17.7 standard deviation.
FINE_BINS, FINE_DIFFERENT = 2048, 468
#: Texts of a step that makes fine sketches: 16 KB each while it does.
FINE_ROWS = 1024
ROUNDS = 4
SKETCHES = "doc_id long, k1 long, k2 long, n_shingles long, s1 long, s2 long, bits array<long>, bands array<long>"
LOW_BITS = 0x5555555555555555


def sketch_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text"):
        texts = [t.encode() if t else b"" for t in batch.column("text").to_pylist()]
        hashes, sizes = shingles.shingle_sets(texts)
        ends = np.cumsum(sizes)
        sums = []
        for seed in (101, 102):
            total = np.r_[np.uint64(0), np.add.accumulate(shingles.mix(hashes, seed))]
            sums.append(pa.array((total[ends] - total[ends - sizes]).view(np.int64)))
        sketch = shingles.sketches(hashes, sizes)
        arrays = [batch.column(c) for c in ("doc_id", "k1", "k2")] + [pa.array(sizes), *sums]
        for rows in (shingles.two_bits(sketch), shingles.bands(sketch, ROWS)):
            width = rows.shape[1]
            offsets = pa.array(np.arange(0, len(rows) * width + 1, width, dtype=np.int32))
            arrays.append(pa.ListArray.from_arrays(offsets, pa.array(rows.reshape(-1).view(np.int64))))
        yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in SKETCHES.split(", ")])


def fine_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes and texts with two bits of each coordinate of a fine sketch."""
    for batch in steps(batches, "text", 1 << 20, FINE_ROWS):
        hashes, sizes = shingles.shingle_sets([t.encode() for t in batch.column("text").to_pylist()])
        bits = shingles.two_bits(shingles.sketches(hashes, sizes, FINE_BINS))
        offsets = pa.array(np.arange(0, bits.size + 1, bits.shape[1], dtype=np.int32))
        fine = pa.ListArray.from_arrays(offsets, pa.array(bits.reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("text"), fine], ["node", "text", "fine"])


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (left, right) whose full sets are similar enough."""
    for batch in (s for b in steps(batches, "text_a", 2 << 20) for s in steps([b], "text_b", 2 << 20)):
        sets = []
        for side in ("text_a", "text_b"):
            hashes, sizes = shingles.shingle_sets([t.encode() for t in batch.column(side).to_pylist()])
            sets.append(np.split(hashes, np.cumsum(sizes)[:-1]))
        linked = []
        for a, b in zip(*sets, strict=True):
            both = shingles.shared(a, b)
            linked.append(100 * both >= PER_CENT * (len(a) + len(b) - both))
        yield batch.select(["left", "right"]).filter(pa.array(linked, pa.bool_()))


def different(a: Column, b: Column, bins: int = shingles.BINS) -> Column:
    """Coordinates whose two bits differ."""
    total = F.lit(0)
    for k in range(bins // 32):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(LOW_BITS)))
    return total


def sizes_allow(a: str, b: str) -> Column:
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return 100 * F.least(n, m) >= PER_CENT * F.greatest(n, m)


def may_link(a: str, b: str) -> Column:
    """What a pair of that similarity fulfils: sizes that allow it (surely) and sketches near enough."""
    return sizes_allow(a, b) & (different(F.col(f"{a}.bits"), F.col(f"{b}.bits")) <= MOST_DIFFERENT)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among ``left, right``; each text goes to its pairs in one join."""
    ends = pairs.select("left", "right", F.explode(F.array("left", "right")).alias("node"))
    with_text = ends.join(texts.select("node", "text"), "node").groupBy("left", "right")
    both = with_text.agg(*(F.max(F.when(F.col("node") == F.col(s), F.col("text"))).alias(f"text_{t}") for s, t in (("left", "a"), ("right", "b"))))
    return cut_lineage(both.mapInArrow(verify, "left long, right long"))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (``node, comp``) after the links; a component's label is its smallest node.

    Every component hangs itself under the smallest one that it is linked with, which makes trees; their
    roots are found by doubling.  Links that still lead to other components go round again.
    """
    while True:
        a = labels.select(F.col("node").alias("left"), F.col("comp").alias("x"))
        b = labels.select(F.col("node").alias("right"), F.col("comp").alias("y"))
        across = links.join(a, "left").join(b, "right").where("x <> y")
        up = cut_lineage(across.groupBy(F.greatest("x", "y").alias("comp")).agg(F.min(F.least("x", "y")).alias("up")))
        if up.isEmpty():
            return labels
        while True:
            above = up.select(F.col("comp").alias("up"), F.col("up").alias("top"))
            step = cut_lineage(up.join(above, "up", "left").select("comp", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
            up = step.select("comp", "up")
            if step.where("moved").isEmpty():
                break
        labels = cut_lineage(labels.join(up, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")))


def _open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components."""
    with_comp = members.join(labels, "node")
    open_ = with_comp.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    return cut_lineage(with_comp.join(open_.select("key"), "key", "left_semi"))


def text_keys(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text)


def _groups(docs: DataFrame, id_column: str, text_column: str, rounds: int) -> DataFrame:
    """``doc_id, k1, k2`` (of the text) and ``n_shingles`` of every document, with its group's smallest id and
    its group's first row (``component_id, first``; null without shingles)."""
    k1, k2 = text_keys(F.col("text"))
    base = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    keyed = base.select("doc_id", k1.alias("k1"), k2.alias("k2"), "text")
    rows = cut_lineage(keyed.mapInArrow(sketch_texts, SKETCHES))

    chosen = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")
    sets = rows.where("n_shingles > 0").groupBy("s1", "s2").agg(
        F.min("doc_id").alias("low"), F.min(chosen).alias("row"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands")
    )
    sets = cut_lineage(sets.withColumn("node", F.monotonically_increasing_id()))
    members = sets.select("node", "n", "bits", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    members = cut_lineage(members.join(shared, "key"))

    wanted = sets.join(members.select("node").distinct(), "node", "left_semi").select("node", "row.doc_id", "row.k1", "row.k2")
    same = F.col("w.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("w.k1") == F.col("t.k1")) & (F.col("w.k2") == F.col("t.k2"))
    texts = wanted.alias("w").join(keyed.alias("t"), same).select("w.node", "t.text")
    texts = cut_lineage(texts.mapInArrow(fine_sketches, "node long, text string, fine array<long>"))

    labels = cut_lineage(members.select("node").distinct().withColumn("comp", F.col("node")))
    for number in range(rounds + 1):
        left = _open_buckets(members, labels)
        if left.isEmpty():
            break
        if number < rounds:
            turn = F.col("node") if not number else F.xxhash64(F.col("node"), F.lit(number))
            centres = left.groupBy("key").agg(F.min(F.struct(turn.alias("turn"), "node", "comp", "n", "bits")).alias("c"))
            met = left.alias("l").join(centres.select("key", "c.*").alias("c"), "key").where((F.col("l.comp") != F.col("c.comp")) & may_link("l", "c"))
            best = F.min(F.struct(different(F.col("l.bits"), F.col("c.bits")), F.col("c.node").alias("right")))
            pairs = met.groupBy(F.col("l.node").alias("left")).agg(best.alias("b")).select("left", "b.right")
        else:
            left = cut_lineage(left.join(sets.select("node", "bands"), "node").join(texts.select("node", "fine"), "node"))
            first = F.get(F.filter(F.arrays_zip(F.col("l.bands").alias("x"), F.col("r.bands").alias("y")), lambda b: b["x"] == b["y"]), F.lit(0))["x"]
            near = different(F.col("l.fine"), F.col("r.fine"), FINE_BINS) <= FINE_DIFFERENT
            other = (F.col("l.key") == F.col("r.key")) & (F.col("l.comp") < F.col("r.comp")) & may_link("l", "r")
            pairs = left.alias("l").join(left.alias("r"), other & (first == F.col("l.key")) & near).select(F.col("l.node").alias("left"), F.col("r.node").alias("right"))
        labels = merged(labels, verified(pairs, texts))

    lows = labels.join(sets.select("node", "low", "row"), "node")
    lowest = lows.groupBy("comp").agg(F.min("low").alias("lowest"), F.min("row").alias("first"))
    of_node = labels.join(lowest, "comp").select("node", "lowest", "first")
    known = sets.select("s1", "s2", "node", "low", "row").join(of_node, "node", "left")
    known = cut_lineage(known.select("s1", "s2", F.coalesce("lowest", "low").alias("component_id"), F.coalesce("first", "row").alias("first")))
    return rows.select("doc_id", "k1", "k2", "n_shingles", "s1", "s2").join(known, ["s1", "s2"], "left").drop("s1", "s2")


def group_near(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document."""
    out = _groups(docs, id_column, text_column, rounds)
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def first_of_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """The documents with one row of each group: that of the smallest id, of several texts with that id the one
    of the smallest hash.  Rows without shingles stay; repeated rows stay once."""
    out = _groups(docs, id_column, text_column, rounds)
    stays = (F.col("n_shingles") == 0) | (F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2") == F.col("first"))
    stays = out.where(stays).select(F.col("doc_id").alias("near_id_"), F.col("k1").alias("near_1_"), F.col("k2").alias("near_2_")).distinct()
    k1, k2 = text_keys(F.col(f"`{text_column}`"))
    keyed = docs.withColumns({"near_row_": F.col(f"`{id_column}`").cast("long"), "near_a_": k1, "near_b_": k2})
    same = F.col("near_row_").eqNullSafe(F.col("near_id_")) & (F.col("near_a_") == F.col("near_1_")) & (F.col("near_b_") == F.col("near_2_"))
    once = keyed.join(stays, same, "left_semi").dropDuplicates(["near_row_", "near_a_", "near_b_"])
    return once.select(*(F.col(f"`{c}`") for c in docs.columns))
