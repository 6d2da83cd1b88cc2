"""The registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, fingerprints, language_id, merkle, mixing, packing, quality_rules, simhash, token_counts, token_files, toxicity, url_filters, vector_codes
from .common import new_path, table

TOKEN_FILE_END = 2
PACK_END = 1
CAPACITY = 4096


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.host_quality(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), TOKEN_FILE_END)
    return token_files.read_token_files(spark, folder)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), url_filters.example_rules(spark))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), PACK_END, CAPACITY)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, c = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    size = F.col(c["size"])
    return mixed.select("doc_id", size.alias("size"), F.col(c["source_size"]).alias("source_size"), F.col(c["target"]).alias("target"), (size * F.col(c["copies"])).alias("taken"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, text = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat_format.conversation_digests(chat_format.format_turns(turns.unionByName(own)))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", merkle.lower_cased(docs))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_language_id, op3_token_files, op4_url_filters, op5_fingerprints, op6_packing, op7_simhash, op8_mixing, op9_toxicity, op10_token_counts, op11_chat_format, op12_merkle, op13_vector_codes)}
