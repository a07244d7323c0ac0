"""A training-corpus pipeline: each stage is one operator of ``spoolframe.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spoolframe.llm.common import Written, scratch
from spoolframe.llm.exact_dedup import drop_exact
from spoolframe.llm.mixing import mix_sources
from spoolframe.llm.ngram_join import one_of_each
from spoolframe.llm.packing import pack
from spoolframe.llm.quality import keep_good
from spoolframe.llm.queries import vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for label 0 go.

    Null text is judged as empty; repeated rows and null ids are judged each by
    their text; an empty table stays empty.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, that with the smallest id.

    Null and empty texts are equal; a null id is larger than any other; of a
    repeated id with one text a row stays; an empty table stays empty.
    """
    return drop_exact(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: five-word shingles, Jaccard of 0.8 or more.

    Texts without words, null ones among them, and rows with a null id stay; all
    rows of an id go together; an empty table stays empty.
    """
    return one_of_each(docs, width=5, num=8, den=10)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets the same share; the mixture is as large as what came in.

    A null source is one of the sources; repeated ids have the same number of
    copies each; texts are not looked at; an empty table stays empty.
    """
    return mix_sources(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, with their ids.

    Null and empty texts are their end token alone; repeated rows are packed each
    for itself; an empty table gives no piece.
    """
    return pack(docs, vocabulary("byte_bpe_50k.json"), window=1024, end_id=0)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mixing),
    ("packing", packing),
]

#: Plain SQL has neither the classifier nor the tokenizer; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each stage's result is written to the shared folder and reread.

    What a stage wrote for itself, and the result of the stage before, is dropped
    once the stage's own result stands; that of the last but one stays, as the
    returned table reads it.
    """
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(kept):
            kept.append(Written(stage(spark, docs, sf_dir), f"stage{k}"))
        for done in kept[:-1]:
            done.drop()
        docs = kept[-1].df
    return STAGES[-1][1](spark, docs, sf_dir)
