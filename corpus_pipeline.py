"""A corpus from raw documents to packed sequences: quality, toxicity, near copies, mix, packing.

Every stage takes all rows of the one before it.  A null text is the empty text;
a null id belongs to no label; rows that repeat others are judged like them; an
empty table gives an empty table.  Columns beside doc_id, text, lang and source
stay as they are, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import mixing, neardup, packing, perplexity, toxicity
from riskweave.llm.queries import table, tokenizer_path
from riskweave.llm.storage import cleared, kept


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is that of trusted text; texts without a word go, repeated rows stay or go together."""
    return perplexity.classify(docs, table(spark, sf_dir, "labels"), keep_rows=True).where("kept").select("row.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic; without labels, or with those of one kind only, the same verdict for all."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    return toxicity.score(docs, model, name=name).where(F.col(name) < toxicity.CUTOFF).drop(name)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; texts without words are copies of equal ones only."""
    return neardup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of training; those without words are taken never."""
    return mixing.training_order(mixing.mix(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences; a document that the mix takes twice is packed twice."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("toxicity", clean), ("near-dedup", distinct), ("mix", mixed), ("packing", packed)]

#: Models, tokens and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next; what a stage has written on its way is deleted then."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with cleared():
            docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
