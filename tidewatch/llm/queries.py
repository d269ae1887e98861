"""The registered queries of the corpus operators, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidewatch.llm import bpe, chat, circulant, decontaminate, language, lines, ngram_join, passages, secrets, spans, tokenfiles, topk, trie
from tidewatch.llm.frames import table
from tidewatch.plans.registry import CHECKS, QUERIES


def corpus_query(name: str, sql: str | None = None):
    def register(make):
        QUERIES[name] = make
        if sql:
            CHECKS[name] = sql
        return make

    return register


@corpus_query("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_classes(table(spark, sf_dir, "documents"))


@corpus_query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"))


@corpus_query("op3_decontaminate", decontaminate.SQL)
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@corpus_query("op4_chat", chat.SQL)
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.round_trip(chat.with_probe(table(spark, sf_dir, "conversations")))


@corpus_query("op5_passages")
def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@corpus_query("op6_secrets")
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@corpus_query("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@corpus_query("op8_ngram_join")
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents")).drop("print")


@corpus_query("op9_bpe")
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


@corpus_query("op10_topk", topk.SQL)
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


@corpus_query("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.aligned(table(spark, sf_dir, "documents"))


@corpus_query("op12_prefix_trie", trie.SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


@corpus_query("op13_near_dedup")
def op13_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant.near_duplicates(table(spark, sf_dir, "documents"))


@corpus_query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
