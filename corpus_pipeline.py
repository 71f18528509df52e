"""The corpus pipeline: toxicity, near duplicates, PII, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; between stages the rows are written as Parquet and
read again. The first four return the columns of documents, the last the pieces, their ids and their places in the sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segweave.llm import mixing, near_dup, packing, pii, toxicity
from segweave.llm.scratch import Scratch
from segweave.session import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one document stays."""
    return near_dup.keep_one_of_each(docs).select(docs.columns)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities give way to surrogates."""
    return pii.replace_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each draw of a document: sources meet their targets, so documents may be left out, cut or taken twice."""
    return mixing.mixed_rows(docs).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, with their ids and their places in sequences."""
    import public_tokenizers

    return packing.pack_sequences(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", replace_pii),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Models, hashing and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole table documents."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        after = scratch.write(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
