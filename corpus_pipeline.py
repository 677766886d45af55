"""From raw documents to packed sequences: each stage is one operator over all its predecessor kept.

Cases, in every stage: null ids are ids like any other; null and empty texts end at the first stage; rows of one
id are told apart by their texts; an empty table gives an empty result; columns of other names are carried up to
the last stage, whatever they are called.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventbook.llm import language, line_dedup, mixing, near_dedup, packing
from eventbook.llm.catalog import VOCABULARY
from eventbook.llm.common import find_package
from eventbook.session import checkpoint_root


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null texts among them), or whose text is like no language learned, go."""
    find_package(spark)
    # Carried under names of their own: a column may be named like a result.
    names = {f"carried_{k}_": c for k, c in enumerate(docs.columns)}
    renamed = docs.select(*(F.col(f"`{c}`").alias(n) for n, c in names.items()), F.col("text"))
    found = language.identify(renamed, learn_from=docs, columns=tuple(names))
    return found.where(~F.col("rejected")).select(*(F.col(n).alias(c) for n, c in names.items()))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that spread over sites leave the texts; ``n_chars`` follows."""
    names = {f"carried_{k}_": c for k, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source", "n_chars")}
    renamed = docs.select("doc_id", "text", "source", *(F.col(f"`{c}`").alias(n) for n, c in names.items()))
    cleaned = line_dedup.remove_spread_lines(renamed).withColumn("n_chars", F.length("text").cast("long"))
    back = {c: n for n, c in names.items()}
    return cleaned.select(*(F.col(back.get(c, c)).alias(c) for c in docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, that of the smallest id; rows of one id and different texts
    are documents of their own, repeated rows stay once."""
    find_package(spark)
    return near_dedup.first_of_groups(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document, whole, as often as the mix takes it; documents without words are not taken."""
    return mixing.mixed_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and place."""
    find_package(spark)
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources to target weights", mix_stage),
    ("best-fit packing", pack_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs


#: The stages learn models and count tokens, which SQL cannot express.
ORACLE_SQL = None
