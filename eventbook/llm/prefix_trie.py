"""Operator 11: the trie of conversations' prefixes by van Emde Boas recursion.

A node of depth d is a distinct sequence of d first turns; its name is the smallest conversation that starts
with it, which names it exactly.  Sequences of up to D - 1 turns, D a power of two, are cut at half depth:
the cut prefixes are named, which leaves an upper trie of sequences half as long and below each name a forest of
such.  All of these are cut in half again, at once, until every depth is named: log D levels.  A level reads
a turn's hash at most once and names the prefixes at its own depths only, so that all levels together name
one row for each turn.

Totals of subtrees are grafted in the opposite order.  At first each node is a trie of its own.  A level
joins every upper trie with its lower forests: the top of a lower trie adds its total to its ancestors in the
upper one, which are as many as the upper trie is deep.  All tries of a level do so in one aggregation.

No conversation and no node is held whole by one task: turns are rows, placed by a range partitioning; the
hash of a node's ends reads their ids in order from pieces that many tasks have joined.

Cases: rows without a conversation id take no part; turns without a number come first, turns of one number
follow role and text, so that repeated rows are repeated turns; null roles and texts are empty; blocks of ids
below zero are counted towards zero, as SQL's remainder does; an empty table, or one without
any id, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventbook.llm.common import numbered, word_count
from eventbook.session import cut_lineage

#: Fixed by the contract: conversations of a block share the block's first turns; fewer than this many.
BLOCK, HEADS = 20, 4
#: Bytes of a piece of joined ids.
PIECE = 1 << 20
ENDS = "depth long, name long, at long, ids string, sha string"


def heads_kept(conv: Column) -> Column:
    """How many first turns a conversation takes from its block's first conversation."""
    return F.crc32(F.encode(conv.cast("string"), "UTF-8")) % HEADS


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv, depth, s1, s2, words`` (the turns) and ``conv, length`` of all rebuilt conversations."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"),
        F.xxhash64(F.lit(1), role, text).alias("s1"), F.xxhash64(F.lit(2), role, text).alias("s2"), word_count(text).alias("words"),
    )
    symbol = ["s1", "s2", "words"]
    turns = cut_lineage(numbered(turns, [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], ["conv", *symbol]))
    own = cut_lineage(turns.groupBy("conv").agg(F.min("place_").alias("first"), F.count("*").alias("n")))
    base = F.col("conv") - F.col("conv") % BLOCK
    known = own.where(base == F.col("conv")).select(F.col("conv").alias("base"), F.col("n").alias("of_base"))
    plan = own.select("*", base.alias("base"), heads_kept(F.col("conv")).alias("h")).join(known, "base", "left")
    taken = F.least("h", F.coalesce("of_base", F.lit(0).cast("long")))
    plan = cut_lineage(plan.select("conv", "base", "first", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    nth = F.col("place_") - F.col("first") + 1
    placed = turns.join(plan, "conv")
    rest = placed.where(nth > F.col("h")).select("conv", (nth - F.col("h") + F.col("taken")).alias("depth"), *symbol)
    # At most HEADS - 1 turns of one conversation in BLOCK, for at most BLOCK conversations.
    heads = placed.where((F.col("base") == F.col("conv")) & (nth < HEADS)).select("base", nth.alias("depth"), *symbol)
    start = plan.where("taken > 0").select("conv", "base", "taken").join(heads, "base").where("depth <= taken")
    return cut_lineage(rest.unionByName(start.select("conv", "depth", *symbol))), plan.select("conv", "length")


def half_depths(longest: int) -> list[int]:
    """Of the levels from the first cut to the last, the depth of a trie's upper half."""
    return [1 << k for k in reversed(range(longest.bit_length()))]


def names(turns: DataFrame, root: int, halves: list[int]) -> DataFrame | None:
    """``conv, depth, name, words`` for every depth of every conversation that has turns."""
    levels: list[DataFrame] = []
    for half in halves:
        # The upper half of the trie that a turn belongs to at this level, if it is in one.
        cut = F.ceil(F.col("depth") / half).cast("long")
        upper = turns.withColumn("cut", cut * half).where(cut % 2 == 1)
        hashed = [F.xxhash64(F.lit(seed), "s1", "s2", "depth") for seed in (1, 2)]
        last = F.max(F.when(F.col("depth") == F.col("cut"), F.col("words")))
        parts = upper.groupBy("conv", "cut").agg(F.bit_xor(hashed[0]).alias("x"), F.bit_xor(hashed[1]).alias("y"), last.alias("words"))
        # Sequences that end before the cut belong to the upper trie alone.
        parts = parts.where(F.col("words").isNotNull())
        if levels:
            tops = reduce(DataFrame.unionByName, levels).select(F.col("conv").alias("c_"), F.col("depth").alias("d_"), F.col("name").alias("top"))
            parts = parts.join(tops, (F.col("conv") == F.col("c_")) & (F.col("cut") - half == F.col("d_")), "left").drop("c_", "d_")
            parts = parts.withColumn("top", F.coalesce("top", F.lit(root)))
        else:
            parts = parts.withColumn("top", F.lit(root))
        parts = cut_lineage(parts)
        named = parts.groupBy("cut", "top", "x", "y").agg(F.min("conv").alias("name"))
        levels.append(cut_lineage(parts.join(named, ["cut", "top", "x", "y"]).select("conv", F.col("cut").alias("depth"), "name", "words")))
    return reduce(DataFrame.unionByName, levels) if levels else None


def grafted(nodes: DataFrame, named: DataFrame, root: int, halves: list[int]) -> DataFrame:
    """``depth, name, n_leaves, saved_tokens`` of all subtrees from the nodes' own ``leaves, saved``."""
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    own = nodes.select("depth", "name", "leaves", "saved")
    added: list[DataFrame] = [own]
    for half in reversed(halves):
        at_cut = (F.col("depth") % (2 * half)) == half
        tops = reduce(DataFrame.unionByName, [x.where(at_cut) for x in added]).groupBy("depth", "name").agg(*sums)
        if half == 1:
            above = nodes.select("depth", "name", F.col("parent").alias("to_")).join(tops, ["depth", "name"])
            more = above.groupBy((F.col("depth") - 1).alias("depth"), F.col("to_").alias("name")).agg(*sums)
        else:
            each = tops.select("name", "leaves", "saved", F.explode(F.sequence(F.col("depth") - half, F.col("depth") - 1)).alias("depth"))
            of = named.select(F.col("conv").alias("c_"), F.col("depth").alias("d_"), F.col("name").alias("to_"))
            above = each.join(of, (F.col("name") == F.col("c_")) & (F.col("depth") == F.col("d_")), "left")
            more = above.groupBy("depth", F.coalesce("to_", F.lit(root)).alias("name")).agg(*sums)
        added.append(cut_lineage(more))
    return reduce(DataFrame.unionByName, added).groupBy("depth", "name").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


PIECES = [("depth", pa.int64()), ("name", pa.int64()), ("at", pa.int64()), ("ids", pa.string()), ("sha", pa.string())]


def batch_of(rows: list[tuple], columns: tuple[str, ...]) -> pa.RecordBatch:
    kinds = [(c, t) for c, t in PIECES if c in columns]
    return pa.RecordBatch.from_arrays([pa.array(values, t) for values, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], [c for c, _ in kinds])


def ids_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted ends of a range: the hashes of nodes inside it; of its first and its last node, which may go on in
    other ranges, the joined ids in pieces."""
    columns = ("depth", "name", "at", "ids", "sha")
    first, node, held = True, None, []

    def told(inside: bool) -> list[tuple]:
        if inside:
            return [(*node, 0, None, hashlib.sha256(",".join(ids for _, ids in held).encode()).hexdigest())]
        return [(*node, at, ids, None) for at, ids in held]

    for batch in batches:
        depths, names_, convs = (batch.column(c).to_numpy() for c in ("depth", "name", "conv"))
        new = np.flatnonzero(np.r_[True, (depths[1:] != depths[:-1]) | (names_[1:] != names_[:-1])]) if len(convs) else np.zeros(0, int)
        out = []
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(convs)][: len(new)], strict=True):
            here = (int(depths[a]), int(names_[a]))
            if here != node:
                if node is not None:
                    out += told(not first)
                    first = False
                node, held = here, []
            ids = convs[a:b].tolist()
            text = ",".join(map(str, ids))
            if held and len(held[-1][1]) + len(text) < PIECE:
                held[-1] = (held[-1][0], f"{held[-1][1]},{text}")
            else:
                held.append((ids[0], text))
        if out:
            yield batch_of(out, columns)
    if node is not None:
        yield batch_of(told(False), columns)


def hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``depth, name, sha`` of nodes whose pieces come in order; no more than a batch of pieces is held."""
    columns = ("depth", "name", "sha")
    node, state = None, None
    for batch in batches:
        out = []
        for depth, name, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "name", "ids")), strict=True):
            if (depth, name) == node:
                state.update(b"," + ids.encode())
                continue
            if node is not None:
                out.append((*node, state.hexdigest()))
            node, state = (depth, name), hashlib.sha256(ids.encode())
        if out:
            yield batch_of(out, columns)
    if node is not None:
        yield batch_of([(*node, state.hexdigest())], columns)


def hash_of_ends(ends: DataFrame) -> DataFrame:
    """``depth, name, ends_sha256`` from rows of ``depth, name, conv``."""
    order = ["depth", "name", "conv"]
    found = cut_lineage(ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(ids_in_order, ENDS))
    pieces = found.where("sha IS NULL").select("depth", "name", "at", "ids").repartition("depth", "name").sortWithinPartitions("depth", "name", "at")
    joined = pieces.mapInArrow(hash_pieces, "depth long, name long, sha string")
    return found.where("sha IS NOT NULL").select("depth", "name", "sha").unionByName(joined).withColumnRenamed("sha", "ends_sha256")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns``: ``conv, depth`` (from 1, without gaps), ``s1, s2`` (the turn's two hashes), ``words``;
    ``lengths``: ``conv, length``, conversations without turns included.
    """
    whole = lengths.agg(F.min("conv").alias("root"), F.max("length").alias("longest"), F.count("*").alias("n")).first()
    if whole["root"] is None:
        return lengths.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    root, halves = whole["root"], half_depths(whole["longest"])
    named = names(turns, root, halves)
    top = lengths.sparkSession.createDataFrame([(0, root, whole["n"], 0)], "depth long, name long, n_convs long, words long")
    long = lambda x: F.lit(x).cast("long")
    if named is None:
        nodes = top.withColumn("parent", F.lit(None).cast("long"))
        ends = lengths.select(long(0).alias("depth"), long(root).alias("name"), "conv")
    else:
        inner = named.groupBy("depth", "name").agg(F.count("*").alias("n_convs"), F.max("words").alias("words"))
        above = named.select(F.col("conv").alias("c_"), (F.col("depth") + 1).alias("d_"), F.col("name").alias("parent"))
        inner = inner.join(above, (F.col("name") == F.col("c_")) & (F.col("depth") == F.col("d_")), "left").drop("c_", "d_").withColumn("parent", F.coalesce("parent", long(root)))
        nodes = top.withColumn("parent", F.lit(None).cast("long")).unionByName(inner)
        at_end = named.select(F.col("conv").alias("c_"), "depth", "name")
        ends = lengths.join(at_end, (F.col("conv") == F.col("c_")) & (F.col("length") == F.col("depth")), "left")
        ends = ends.select(F.col("length").alias("depth"), F.coalesce("name", long(root)).alias("name"), "conv")
    nodes = cut_lineage(nodes)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["depth", "name"], "left").withColumn("n_children", F.coalesce("n_children", long(0)))
    nodes = cut_lineage(nodes.withColumns({"leaves": F.when(F.col("n_children") == 0, long(1)).otherwise(long(0)), "saved": (F.col("n_convs") - 1) * F.col("words")}))
    totals = grafted(nodes, named, root, halves) if named is not None else nodes.select("depth", "name", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    all_ = nodes.join(totals, ["depth", "name"]).join(hash_of_ends(ends), ["depth", "name"], "left")
    return all_.select(
        F.col("name").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of ``conv_id, turn, role, text``."""
    return trie(*rebuilt(conversations))


#: The same rows by lists of turns and all pairs of a node and its ancestors; for DuckDB.
ORACLE = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM {conversations} WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, list({'k': md5(length(r)::VARCHAR || ':' || r || x), 'n': len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))} ORDER BY i) AS s,
         xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295::BIGINT) % 4 AS h
  FROM turns GROUP BY conv_id
), whole AS (
  SELECT c.conv_id, coalesce(b.s[1:c.h], []) || c.s[c.h + 1:] AS s FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20
), prefixes AS (
  SELECT conv_id, len(s) AS size, d, array_to_string(list_transform(s[1:d], lambda t: t.k), '') AS p, CASE WHEN d > 0 THEN s[d].n ELSE 0 END AS words
  FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM whole)
), nodes AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256
  FROM prefixes GROUP BY d, p
), linked AS (
  SELECT n.*, u.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes u ON u.d = n.d - 1 AND u.p = left(n.p, 32 * (n.d - 1)::INTEGER)
), children AS (
  SELECT d - 1 AS d, parent_conv_id AS conv_id, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY ALL
), own AS (
  SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN children USING (d, conv_id)
), totals AS (
  SELECT a.d, a.p, sum((o.n_children = 0)::INTEGER) AS n_leaves, sum((o.n_convs - 1) * o.words) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS to_d FROM own) o JOIN own a ON a.d = o.to_d AND a.p = left(o.p, 32 * o.to_d::INTEGER) GROUP BY a.d, a.p
)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM own JOIN totals USING (d, p)
"""
