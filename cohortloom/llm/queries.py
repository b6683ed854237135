"""Queries of the operators that may run Python in tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.llm import common as C
from cohortloom.llm import hard_negatives, language, sql, toxicity
from cohortloom.llm.near_dedup import near_duplicates
from cohortloom.llm.ngram_join import ngram_join
from cohortloom.llm.packing import added_tokens, pack
from cohortloom.llm.prefix_trie import prefix_nodes
from cohortloom.llm.substring_dedup import dedup_substrings
from cohortloom.llm.suffix_dedup import dedup_suffixes
from cohortloom.llm.toxicity import score_toxicity
from cohortloom.llm.warc_zip import read_archives, write_archives
from cohortloom.plans.catalog import query


@query("op3_suffix_dedup")
def op3(spark, sf):
    return dedup_suffixes(C.documents(spark, sf)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op9_substring_dedup")
def op9(spark, sf):
    return dedup_substrings(C.documents(spark, sf)).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op8_near_dedup")
def op8(spark, sf):
    return near_duplicates(C.documents(spark, sf))


@query("op2_packing")
def op2(spark, sf):
    return pack(C.documents(spark, sf), added=added_tokens()).drop("ids")


@query("op6_warc_zip")
def op6(spark, sf):
    records = read_archives(write_archives(spark.read.parquet(f"{sf}/pages.parquet")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query("op1_toxicity")
def op1(spark, sf):
    docs = C.documents(spark, sf)
    scored = score_toxicity(docs, *toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    return scored.select("doc_id", (_fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op5_language")
def op5(spark, sf):
    docs = C.documents(spark, sf)
    return language.predict(docs, language.learn(docs)).select("doc_id", (_fold(5) == 0).alias("held_out"), "lang_pred", "score")


@query("op13_hard_negatives", sql.HARD_NEGATIVES)
def op13(spark, sf):
    return hard_negatives.mine(hard_negatives.relabelled(spark.read.parquet(f"{sf}/embeddings.parquet")))


@query("op11_ngram_join", sql.NGRAM_JOIN)
def op11(spark, sf):
    return ngram_join(C.documents(spark, sf)).drop("links")


@query("op12_prefix_trie", sql.PREFIX_TRIE)
def op12(spark, sf):
    return prefix_nodes(spark.read.parquet(f"{sf}/conversations.parquet"))
