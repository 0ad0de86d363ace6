"""The corpus pipeline: language, toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Nothing is cached between stages, and each decision takes
effect: rejected documents go, one document of a group of near duplicates stays, and repeated passages leave the texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnsketch.llm import langid, linededup, minhash, packing, toxicity
from dnsketch.llm.common import Scratch, bounded, table
from dnsketch.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus teaches; those without a letter or with a narrow margin go."""
    bounded(spark)
    return langid.keep_identified(docs, langid.learn(docs, ~langid.held_out(), Scratch(spark)))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected grade is nearer to 0 than to a toxic one."""
    bounded(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), Scratch(spark)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    bounded(spark)
    return minhash.drop_copies(docs, Scratch(spark))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier document has; n_chars follows the text."""
    bounded(spark)
    found = linededup.without_repeats(docs, Scratch(spark))
    n = F.when(F.size("removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and offset."""
    bounded(spark)
    return packing.pack(packing.pieces(docs, tokenizer_path("word_bpe_49k.json")), Scratch(spark))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("toxicity", toxic),
    ("near duplicates", near_duplicates),
    ("repeated passages", passages),
    ("packing", packed),
]

#: SQL says none of these stages; tests/llm compares each with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
