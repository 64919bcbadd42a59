"""Corpus preparation in stages, each over all that the stage before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, for all but the last with
the columns of `docs`. `run` applies them to the table documents, with each stage's result written to the shared folder, so
that a lost executor costs a stage and not the whole run; a stage's table is deleted when the next one is stored.

What holds for every stage: an empty table gives an empty one with the same columns; columns beside doc_id, text, lang and
source are passed on whatever their names; texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import common, op1_sorted_shards, op4_mixing, op5_decontaminate, op6_jaccard_join, op8_language_id
from granary.session import remove_folder, ship, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language: without letters or a clear language, they go, and so do null and empty texts. Repeated
    rows are judged alike. Without any labelled row only texts without letters go."""
    ship(spark)
    model = op8_language_id.train(docs, common.crc_bucket("doc_id", 4) != 2)
    return op8_language_id.reject(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of linked documents: those that share 80 % of their five-word shingles.

    Texts without words are linked with nothing and stay, as do rows with a null key; of several rows with one key one stays."""
    ship(spark)
    return op6_jaccard_join.deduplicate(docs, size=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a twentieth or more of their words from benchmark windows; exactly a twentieth goes. Null and empty
    texts have no words and stay; an empty benchmark takes nothing away."""
    ship(spark)
    return op5_decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, those of small sources up to twice, by the temperature that the target entropy asks for.
    A null source is a source of its own; rows with one key are taken together."""
    return op4_mixing.mix(docs).select("doc.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sorted shards, read back: a row for each document. A null text has the end id alone, null keys come
    first and rows with one key stand next to each other."""
    ship(spark)
    return op1_sorted_shards.to_shards(docs)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID output", shards),
]

#: SQL can express neither a trained model nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = common.stored(stage(spark, docs, sf_dir), "stage")
        if before:
            remove_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
