"""A corpus pipeline of four training-data operators; each stage works on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import stored, table
from tessera.llm.decontamination import is_contaminated
from tessera.llm.ngram_jaccard import one_of_each_group
from tessera.llm.packing import pack_documents
from tessera.llm.toxicity import train_toxicity, training_labels

#: Word pieces that the packing stage remembers; its workers forget them with the task, as other stages share the executors.
REMEMBER = 200_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below one half."""
    model = train_toxicity(docs, training_labels(table(spark, sf_dir, "labels")))
    return docs.where(model.column(F.col("text"), spark) < 0.5)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that leak no test item."""
    return docs.where(~is_contaminated(F.col("text"), table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the remaining documents lies in sequences of 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), remember=REMEMBER, keep=False)


STAGES = [("toxicity", toxicity), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("packing", packing)]

#: The models and searches are beyond SQL; tests hold each stage's decisions against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
