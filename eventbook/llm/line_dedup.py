"""Operator 3: lines that spread over many sites are boilerplate and leave their documents.

A line is known by two 64-bit hashes.  HyperLogLog sketches of the sites of each line are built where
the lines are read and merge in the aggregation, so a line is one small row for each task however often
it occurs.  Lines whose estimate is within ``BAND`` of the threshold get an exact count of distinct
sites.  Lines on at least ``min_sites`` sites leave every document, unless nothing but white space would
stay: such a document is itself a copy that spreads over sites, which is a matter of whole documents, and
stays as it is.

Cases: a null source is no site; lines of white space alone are never boilerplate; a null text stays
null, an empty one empty; rows that share id and text are treated alike; an empty table gives an empty
result; columns of other names are carried, one named like a result column is replaced.  All steps are
DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventbook.session import cut_lineage

MIN_SITES = 10
#: Sketches of 2^LG_K registers; share around the threshold (over five standard errors) counted exactly.
LG_K, BAND = 12, 0.1
#: White space within a line.
WHITE = " \t\x0b\x0c\r"


def two_hashes(*values: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *values) for seed in (1, 2)]


def line_table(docs: DataFrame, text: str, site: str, key: list[Column]) -> DataFrame:
    """``l1_, l2_`` (line), ``d1_, d2_`` (row), ``at_`` (place in the text), ``site_``."""
    d1, d2 = key
    lines = docs.where(F.col(text).isNotNull()).select(d1.alias("d1_"), d2.alias("d2_"), F.col(site).alias("site_"), F.posexplode(F.split(F.col(text), "\n")).alias("at_", "line_"))
    lines = lines.where(F.length(F.translate("line_", WHITE, "")) > 0)
    l1, l2 = two_hashes(F.col("line_"))
    return lines.select(l1.alias("l1_"), l2.alias("l2_"), "d1_", "d2_", "at_", "site_")


def spread_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """``l1_, l2_`` of the lines on at least ``min_sites`` sites."""
    with_site = lines.where(F.col("site_").isNotNull())
    # One sketch for each task and line, merged where the tasks' rows of a line meet.
    sketches = with_site.groupBy("l1_", "l2_").agg(F.hll_sketch_agg(F.col("site_").cast("string"), F.lit(LG_K)).alias("sketch_"))
    estimate = F.hll_sketch_estimate("sketch_")
    room = max(1.0, BAND * min_sites)
    likely = cut_lineage(sketches.select("l1_", "l2_", estimate.alias("sites_")).where(F.col("sites_") >= min_sites - room))
    near = likely.where(F.col("sites_") <= min_sites + room)
    exact = with_site.join(near.select("l1_", "l2_"), ["l1_", "l2_"], "left_semi").groupBy("l1_", "l2_").agg(F.count_distinct("site_").alias("sites_"))
    sure = likely.where(F.col("sites_") > min_sites + room)
    return sure.select("l1_", "l2_").unionByName(exact.where(F.col("sites_") >= min_sites).select("l1_", "l2_"))


def remove_spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, id_column: str = "doc_id", text_column: str = "text", site_column: str = "source") -> DataFrame:
    """The documents with cleaned text and ``n_lines``, ``n_removed`` (long)."""
    docs = docs.drop("n_lines", "n_removed")
    key = two_hashes(F.col(id_column), F.col(text_column))
    lines = cut_lineage(line_table(docs, text_column, site_column, key))
    spread = cut_lineage(spread_lines(lines, min_sites))
    hits = lines.join(spread, ["l1_", "l2_"]).groupBy("d1_", "d2_").agg(F.collect_set("at_").alias("hits_"))
    d1, d2 = key
    carried = docs.withColumns({"k1_": d1, "k2_": d2})
    joined = carried.join(hits, (F.col("k1_") == F.col("d1_")) & (F.col("k2_") == F.col("d2_")), "left")
    split = F.split(F.col(text_column), "\n")
    count = F.size(split)
    kept = F.array_except(F.sequence(F.lit(0), count - 1), F.col("hits_"))
    joined = joined.withColumn("cleaned_", F.when(F.col("hits_").isNotNull(), F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n")))
    clean = F.length(F.translate("cleaned_", WHITE + "\n", "")) > 0
    removed = F.when(clean, F.size("hits_")).otherwise(0).cast("long")
    text = F.when(clean, F.col("cleaned_")).otherwise(F.col(text_column))
    total = F.when(F.col(text_column).isNull(), 0).otherwise(count).cast("long")
    out = [text.alias(text_column) if c == text_column else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*out, total.alias("n_lines"), removed.alias("n_removed"))


#: The same rows by exact counts; for DuckDB.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, source, text, row_, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM (SELECT *, row_number() OVER () AS row_ FROM {documents})
), spread AS (
  SELECT line FROM lines WHERE length(translate(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13), '')) > 0
  GROUP BY line HAVING count(DISTINCT source) >= 10
), cleaned AS (
  SELECT row_, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (s.hit IS NULL), '') AS text_, count(*) AS n_lines, count(s.hit) AS hits
  FROM lines LEFT JOIN (SELECT line, 1 AS hit FROM spread) s USING (line) GROUP BY row_
)
SELECT doc_id, CASE WHEN own > 0 THEN text_ ELSE text END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, CASE WHEN own > 0 THEN hits ELSE 0 END::BIGINT AS n_removed
FROM (SELECT *, row_number() OVER () AS row_ FROM {documents})
LEFT JOIN (SELECT *, length(translate(text_, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS own FROM cleaned) USING (row_)
"""
