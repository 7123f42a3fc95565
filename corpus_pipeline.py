"""The training-corpus pipeline: five operators over ``documents``, each on all that the one before kept.

``STAGES`` lists (name, function); a function takes the session, the documents and the
folder of the tables. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracequarry.llm.common import materialize, release
from tracequarry.llm.exact_dedup import drop_exact_duplicates
from tracequarry.llm.mixing import mixed_documents
from tracequarry.llm.near_dedup import keep_representatives
from tracequarry.llm.packing import pack
from tracequarry.llm.toxicity import score_toxicity, train

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels, doesn't call toxic; null and empty texts stay."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, model, prefix="__toxic_").where("__toxic_predicted = 0")
    return scored.select(*[f"`{c}`" for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; null texts count as empty, so that one of them stays."""
    return drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, on shingles of five words, the document with the smallest id; texts without words and rows without an id stay."""
    return keep_representatives(docs, width=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target shares; a whole document once for each time that the mix takes it, one without words once."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, one row each; null and empty texts are the separator alone."""
    return pack(docs, TOKENIZER)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models, samples of a hash order and tokens are beyond SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written as Parquet to the shared folder and read again, and goes when the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)


__all__ = ["ORACLE_SQL", "STAGES", "run"]
