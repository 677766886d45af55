"""The operators' queries, one for each, and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventbook.llm import decontamination, fill_in_middle, language, line_dedup, mixing, near_dedup, neighbours, packing, prefix_trie, ranked_search, token_counts, toxicity, warc
from eventbook.llm.common import held_out, table

#: Vocabulary file of the token counts and the packing.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), F.col("doc_id") % 100 == 0)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_spread_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", "n_lines", "n_removed")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "any_hit")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.group_near(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "capture_no")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).by_document()


QUERIES = {
    "op1_ranked_search": op1_ranked_search,
    "op2_neighbours": op2_neighbours,
    "op3_line_dedup": op3_line_dedup,
    "op4_language": op4_language,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_near_dedup": op7_near_dedup,
    "op8_warc": op8_warc,
    "op9_mix_sources": op9_mix_sources,
    "op10_pack": op10_pack,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_decontamination": op13_decontamination,
}

ORACLES = {
    "op1_ranked_search": ranked_search.ORACLE.replace("{documents}", "documents"),
    "op3_line_dedup": line_dedup.ORACLE.format(documents="documents"),
    "op8_warc": warc.ORACLE.format(pages="pages"),
    "op9_mix_sources": mixing.ORACLE.format(documents="documents"),
    "op11_prefix_trie": prefix_trie.ORACLE.replace("{conversations}", "conversations"),
    "op12_fill_in_middle": fill_in_middle.ORACLE.format(documents="documents"),
    "op13_decontamination": decontamination.ORACLE.format(documents="documents", benchmark="benchmark"),
}
