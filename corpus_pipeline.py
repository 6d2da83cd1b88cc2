"""From raw documents to packed sequences: five stages, each on all that the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm import language_id, mixing, near_copies, packing, toxicity
from tallyscope.llm.common import discard, discard_since, fresh, n_staged, staged, table
from tallyscope.llm.queries import CAPACITY, PACK_END


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; the model learns from the raw table's labelled documents.

    Null and empty texts have the score of no evidence; equal rows go or stay together; no rows: no rows.
    """
    return toxicity.keep_civil(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not found, or not with a score of a half, go.

    So do null texts and texts without a letter. Languages are learnt from the stage's own input; without
    any there, all go. Equal rows go or stay together; no rows: no rows.
    """
    return language_id.keep_identified(docs, docs, public_tokenizers.path("piece_bpe_32k.model"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash index, then exact: five-word shingles, Jaccard 0.8 or more) the document with the smallest id stays.

    A null id counts as larger than any; null and blank texts are copies of each other; of equal rows one stays; no rows: no rows.
    """
    return near_copies.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null source is a source of its own; null texts have size 0 and the rate of their source; equal rows count one by one; no rows: no rows.
    """
    mixed, names = mixing.mix(docs)
    each = F.explode(F.array_repeat(F.lit(0), F.col(names["copies"]).cast("int")))
    (again,) = fresh(docs, "again")
    return mixed.where(F.col(names["copies"]) > 0).select(*[F.col(f"`{c}`") for c in docs.columns], each.alias(again)).drop(again)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and offset.

    Null and empty texts are one piece with the end id; repeated rows are packed one by one; no rows: no rows.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), PACK_END, CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unidentified),
    ("near_duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models, tokenizers and the packing plan are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each one's rows written and read again; what a stage needed on its way goes with it, and its table once the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        mark = n_staged()
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
        discard_since(mark, docs)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
