"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanespark.llm import bpe, langid, linededup, mixing, simhash
from vanespark.llm._util import written
from vanespark.session import ship_package


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; the others (no text, no letter) go. Nothing depends on ids; repeated rows fare alike."""
    ship_package(spark)
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs, and their n_chars; documents that were nothing else go. Null texts stay."""
    return linededup.drop_emptied(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity of 0.8 or more.

    The one with the smallest doc_id stays, a null id last. A null text is empty, and all texts without a word are one group. Of
    rows that repeat id and text one stays; different texts of one id, or without an id, are documents of their own.
    """
    ship_package(spark)
    return simhash.keep_first(docs, simhash.similar_documents(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, mixed to the target weights. One epoch: repeats would undo the stages before.

    Null lang and source are values of their own; a null text has no tokens. Repeated rows are taken or left one by one.
    """
    return mixing.mixed(docs, budget=(4, 5), max_epochs=1)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document and the digests of ids and decoded text; a null text has none. Repeated rows each get theirs."""
    ship_package(spark)
    return bpe.token_table(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("encode", encode),
]

#: Language ID, SimHash and BPE are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
