"""Operator 9: mixing sources to target weights by hash thresholds.

Every document has a hash of its id and text.  A source takes each document ``floor(target / size)`` times, and
once more those whose hash is below the source's threshold.  The threshold is found without sorting
documents: sums by source and hash bucket, the bucket in which the budget ends, and again within that
bucket alone, down to one hash value.  Larger budgets have higher thresholds, so mixes are nested.
The document at the threshold is taken if that comes nearer to the budget; of repeated rows, which share
the threshold's hash, as many as come nearest.  Documents are taken whole.

Targets: ``share`` of all words by weight; a source stops at ``most`` times its own words and what it
can't take goes to the others by weight, until none is above.

Cases: a null text has no words; null is a source of its own, after all others; a null id is an empty
one; rows that share an id and have different texts are told apart, repeated rows are interchangeable;
sources without words take none; an empty table gives an empty result; columns of other names are ignored.  All steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventbook.llm.common import numbered, word_count
from eventbook.session import cut_lineage

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Bits of the hash that each level of the search tells apart; together HASH_BITS.
HASH_BITS, LEVELS = 60, (12, 16, 32)


def row_hash(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of the MD5 of the id's digits, a colon and the text."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, size``.

    With the sources in the order in which a rising level fills them (most * size / weight), the first
    ones are full; the level of the others follows from sums before and after.  One row for each source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_code = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    place = F.row_number().over(by_code) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    whole = F.sum("source_size").over(Window.partitionBy())
    with_weight = total.select("source", "source_size", weight.alias("w"), (whole * share).alias("all"))
    filled = Window.orderBy(F.col("source_size") / F.col("w"), "w", "source_size", F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    before = F.coalesce(F.sum("source_size").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("w").over(filled.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.col("all") - most * before) / after
    full = with_weight.withColumn("full", level * F.col("w") > most * F.col("source_size"))
    full_size = F.sum(F.when(F.col("full"), F.col("source_size")).otherwise(0)).over(Window.partitionBy())
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(Window.partitionBy())
    target = F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(F.col("w") * (F.col("all") - most * full_size) / open_weight)
    return full.select("source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source, at, n, times``: the hash at which each source's budget ends, the number of rows that have it (more
    than one are repeated rows), and how many of them are taken.

    ``sizes``: ``source, size, hash``; ``budgets``: ``source, budget``.  A source whose budget is not
    reached by all its documents has no row.
    """
    open_ = budgets.where("budget > 0").withColumns({"prefix": F.lit(0).cast("long"), "passed": F.lit(0).cast("long")})
    rows, used = sizes.where("size > 0"), 0
    for bits in LEVELS:
        here = rows.withColumn("prefix", F.shiftright("hash", HASH_BITS - used))
        if used:
            # Only the rows of the boundary bucket of each source go on.
            rows = cut_lineage(here.join(open_.select(F.col("source").alias("s_"), F.col("prefix").alias("p_")), F.col("source").eqNullSafe(F.col("s_")) & (F.col("prefix") == F.col("p_")), "left_semi").drop("prefix"))
        used += bits
        bucket = F.shiftright("hash", HASH_BITS - used).alias("bucket")
        sums = rows.groupBy("source", bucket).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        joined = sums.join(open_.withColumnRenamed("source", "s_"), F.col("source").eqNullSafe(F.col("s_")))
        order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        reached = joined.withColumn("before", F.col("passed") + F.coalesce(F.sum("words").over(order), F.lit(0)))
        inside = (F.col("before") <= F.col("budget")) & (F.col("before") + F.col("words") > F.col("budget"))
        found = reached.where(inside).select("source", "budget", F.col("bucket").alias("prefix"), F.col("before").alias("passed"), "words", "n")
        found = cut_lineage(found)
        open_ = found.select("source", "budget", "prefix", "passed")
    left = F.col("budget") - F.col("passed")
    times = F.ceil(left * F.col("n") / F.col("words") - 0.5).cast("long")
    return found.select("source", F.col("prefix").alias("at"), "n", times.alias("times"))


def shares(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """A row for each source: how much of it the mix takes and where its threshold is."""
    sizes = cut_lineage(
        docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), word_count(F.col(text_column)).alias("size"), row_hash(F.col(id_column), F.col(text_column)).alias("hash"))
    )
    aims = cut_lineage(targets(sizes, weights, share, most))
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    aims = aims.withColumns({"whole": whole, "budget": F.col("target") - whole * F.col("source_size")})
    ends = thresholds(sizes, aims.select("source", "budget"))
    known = aims.join(ends.withColumnRenamed("source", "s_"), F.col("source").eqNullSafe(F.col("s_")), "left")
    names = {"source": "mix_source_", "source_size": "mix_source_size_", "target": "mix_target_", "whole": "mix_whole_", "budget": "mix_budget_", "at": "mix_at_", "n": "mix_n_", "times": "mix_times_"}
    return cut_lineage(known.select(*(F.col(c).alias(n) for c, n in names.items())))


def with_taken(docs: DataFrame, known: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The documents with ``mix_size_, mix_taken_`` and their source's columns of ``shares``."""
    sized = docs.withColumns({"mix_size_": word_count(F.col(f"`{text_column}`")), "mix_hash_": row_hash(F.col(f"`{id_column}`"), F.col(f"`{text_column}`"))})
    rows = sized.join(known, F.col(f"`{source_column}`").eqNullSafe(F.col("mix_source_")))
    at_end = (F.col("mix_budget_") > 0) & F.coalesce(F.col("mix_hash_") == F.col("mix_at_"), F.lit(False))
    size = F.col("mix_size_")
    below = (F.col("mix_budget_") > 0) & F.coalesce(F.col("mix_hash_") < F.col("mix_at_"), F.lit(False))
    once = below | (at_end & (F.col("mix_times_") >= F.col("mix_n_")))
    taken = lambda more: (F.col("mix_whole_") * size + F.when(more, size).otherwise(0)).cast("long")
    some = (F.col("mix_n_") > 1) & (F.col("mix_times_") > 0) & (F.col("mix_times_") < F.col("mix_n_"))
    if known.where(some).isEmpty():
        return rows.withColumn("mix_taken_", taken(once))
    # Of a source's repeated rows at its threshold some are taken: they are numbered.
    tied = at_end & some
    place = numbered(rows.where(tied), [F.col("mix_source_")], rows.columns)
    firsts = place.groupBy("mix_source_").agg(F.min("place_").alias("mix_first_")).select(F.col("mix_source_").alias("mix_of_"), "mix_first_")
    place = place.join(firsts, F.col("mix_source_").eqNullSafe(F.col("mix_of_")))
    chosen = place.withColumn("mix_taken_", taken(F.col("place_") - F.col("mix_first_") < F.col("mix_times_"))).select(*rows.columns, "mix_taken_")
    return rows.where(~F.coalesce(tied, F.lit(False))).withColumn("mix_taken_", taken(once)).unionByName(chosen)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every document."""
    named = docs.select("doc_id", "source", "text")
    rows = with_taken(named, shares(named, weights, share, most))
    return rows.select("doc_id", "source", *(F.col(f"mix_{c}_").alias(c) for c in ("size", "source_size", "target", "taken")))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: each document, whole, as often as it is taken, all columns kept."""
    rows = with_taken(docs, shares(docs, weights, share, most)).where(F.col("mix_taken_") > 0)
    times = F.floor(F.col("mix_taken_") / F.col("mix_size_")).cast("int")
    rows = rows.withColumn("mix_nth_", F.explode(F.sequence(F.lit(1), times)))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))


#: The same rows for the documents of a folder, by sorting; for DuckDB.
ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS hash
  FROM {documents}
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), weighted AS (
  SELECT source, source_size, sum(source_size) OVER () * 1.5::DOUBLE AS whole,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3)::INTEGER] AS w
  FROM totals
), levels AS (
  SELECT *, (whole - 2 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * w > 2 * source_size AS full_
  FROM weighted WINDOW o AS (ORDER BY source_size / w, w, source_size, source IS NULL, encode(source))
), aims AS (
  SELECT source, source_size,
         CASE WHEN full_ THEN (2 * source_size)::DOUBLE
              ELSE w * (whole - 2 * sum(CASE WHEN full_ THEN source_size ELSE 0 END) OVER ()) / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () END AS target
  FROM levels
), budgets AS (
  SELECT source, source_size, target, floor(target / greatest(source_size, 1))::BIGINT AS whole,
         target - floor(target / greatest(source_size, 1)) * source_size AS budget
  FROM aims
), hashes AS (
  SELECT source, hash, sum(size) AS words, count(*) AS n FROM sizes WHERE size > 0 GROUP BY source, hash
), passed AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM hashes
), ends AS (
  SELECT p.source, p.hash AS edge, ceil((budget - before) * n / words - 0.5) AS times
  FROM passed p JOIN budgets b ON p.source IS NOT DISTINCT FROM b.source
  WHERE budget > 0 AND before <= budget AND before + words > budget
)
SELECT s.doc_id, s.size, b.source_size, b.target,
       (whole * s.size + CASE WHEN budget <= 0 THEN 0 WHEN s.hash < edge THEN s.size WHEN s.hash = edge AND nth <= times THEN s.size ELSE 0 END)::BIGINT AS taken
FROM (SELECT *, row_number() OVER (PARTITION BY source, hash) AS nth FROM sizes) s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source LEFT JOIN ends e ON s.source IS NOT DISTINCT FROM e.source
"""
