"""Key checks by exact bitmaps of the keys.

A word holds 64 consecutive keys in a long, a block 512 words (32,768 keys).  Dense keys, as ``assign_ids`` gives
them, take little more than a bit each.  Up to ``max_blocks`` blocks of a parent's keys (4 KB each) are sent to the
tasks that read the child, whose rows then stay where they are; the blocks are counted first.  More blocks, of a large
parent or of sparse keys, are not sent: the child meets the words in a join on the word's number.  The answers are
the same.  An empty reference passes, empty keys of a parent match nothing, and repeated parent keys do no harm.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventbook.schema import TABLES
from eventbook.session import cut_lineage

WORD_BITS, BLOCK_BITS = 6, 15
WORDS = 1 << (BLOCK_BITS - WORD_BITS)
MAX_BLOCKS = 8_192  # 32 MB
MAX_SUSPECTS = 1_000_000


def _words(df: DataFrame, key: str) -> DataFrame:
    """``(word, bits, n)``: the keys of each word and the number of rows that hold one; summed before they move."""
    value = F.col(key).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), value.bitwiseAND(F.lit(63)).cast("int"))
    return (
        df.select(F.shiftright(value, WORD_BITS).alias("word"), bit.alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"), F.count(F.lit(1)).alias("n"))
    )


def _blocks(words: DataFrame) -> DataFrame:
    """``(block, words)`` with an array of all words of a block, in order."""
    full = F.transform(F.sort_array("parts"), lambda part: part["bits"])
    entries = F.map_from_entries("parts")
    filled = F.transform(
        F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda at: F.coalesce(F.try_element_at(entries, at), F.lit(0).cast("long"))
    )
    at = F.col("word").bitwiseAND(F.lit(WORDS - 1)).cast("int").alias("at")
    return (
        words.groupBy(F.shiftright("word", BLOCK_BITS - WORD_BITS).alias("block"))
        .agg(F.collect_list(F.struct(at, "bits")).alias("parts"))
        .select("block", F.when(F.size("parts") == WORDS, full).otherwise(filled).alias("words"))
    )


class KeyBitmaps:
    """The keys of a table, to be asked by the rows of others."""

    def __init__(self, parent: DataFrame, key: str, max_blocks: int = MAX_BLOCKS):
        words = cut_lineage(_words(parent, key).filter(F.col("word").isNotNull()).select("word", "bits"))
        count = words.select(F.shiftright("word", BLOCK_BITS - WORD_BITS)).distinct().count()
        self.sent = count <= max_blocks
        self.table = cut_lineage(_blocks(words)) if self.sent else words

    def mark(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        """``rows`` with a flag ``name``: whether the table has the key in ``column`` (false where that is empty)."""
        value = F.col(column).cast("long")
        number, found = f"_number_{name}", f"_found_{name}"
        if self.sent:
            sent = F.broadcast(self.table.select(F.col("block").alias(number), F.col("words").alias(found)))
            word = F.get(found, F.shiftright(value, WORD_BITS).bitwiseAND(F.lit(WORDS - 1)).cast("int"))
            joined = rows.join(sent, F.shiftright(value, BLOCK_BITS) == F.col(number), "left")
        else:
            words = self.table.select(F.col("word").alias(number), F.col("bits").alias(found))
            word = F.col(found)
            joined = rows.join(words, F.shiftright(value, WORD_BITS) == F.col(number), "left")
        return joined.withColumn(name, self._bit(word, value)).drop(number, found)

    @staticmethod
    def _bit(word: Column, value: Column) -> Column:
        return F.coalesce(F.getbit(word, value.bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))


def missing_references(
    df: DataFrame, table: str, parents: Mapping[str, DataFrame], max_blocks: int = MAX_BLOCKS
) -> DataFrame:
    """``(key, rule, message)`` of rows whose reference names no parent row, as ``reference_violations`` finds them."""
    spec, hits = TABLES[table], []
    names = [f"ref_{i}" for i in range(len(spec.foreign_keys))]
    rows = df.select(
        F.col(spec.key).alias("key"), *[F.col(fk.column).alias(name) for fk, name in zip(spec.foreign_keys, names, strict=True)]
    )
    for fk, name in zip(spec.foreign_keys, names, strict=True):
        rows = KeyBitmaps(parents[fk.parent], fk.parent_key, max_blocks).mark(rows, name, f"has_{name}")
        message = F.concat(F.lit(f"no {fk.parent} row "), F.col(name).cast("string"))
        hit = F.struct(F.lit(fk.rule(table)).alias("rule"), message.alias("message"))
        hits.append(F.when(F.col(name).isNotNull() & ~F.col(f"has_{name}"), hit))
    return rows.select("key", F.explode(F.array_compact(F.array(*hits))).alias("hit")).select("key", "hit.rule", "hit.message")


def repeated_keys(df: DataFrame, key: str, max_suspects: int = MAX_SUSPECTS) -> DataFrame:
    """``(key, times)`` of keys that occur more than once, the empty key included.

    A word with more rows than bits holds a repeated key.  Only rows of such words are grouped by key; if there
    are more than ``max_suspects`` of these words, all rows are.
    """
    words = cut_lineage(_words(df, key))
    suspects = words.filter(F.col("n") > F.coalesce(F.bit_count("bits"), F.lit(0))).select(F.col("word").alias("_word"))
    rows = df.select(F.col(key).alias("key"))
    if suspects.count() <= max_suspects:
        number = F.shiftright(F.col("key").cast("long"), WORD_BITS)
        rows = rows.join(F.broadcast(suspects), number.eqNullSafe(F.col("_word")), "left_semi")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
