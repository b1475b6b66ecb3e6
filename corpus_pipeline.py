"""The training-text pipeline: STAGES in order, each (spark, docs, sf_dir) ->
DataFrame; ``run`` writes every stage's rows as Parquet to the shared folder
and rereads them as the next stage's documents.

toxicity          rejects documents that the classifier scores 0.7 or higher
line_dedup        removes blocks of lines that stand elsewhere (rows stay)
ngram_jaccard     keeps one document of every group of near copies (five-word
                  shingles, similarity 0.8)
mixing            draws languages and sources to target weights; a document
                  drawn in several epochs is several rows
packing           cuts token ids into sequences (one row a piece)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairgate.llm.jaccard_join import keep_one
from fairgate.llm.line_dedup import line_dedup
from fairgate.llm.mixing import mixed_documents
from fairgate.llm.packing import pack
from fairgate.llm.queries import MIX_WEIGHTS
from fairgate.llm.textutil import table, written
from fairgate.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    edited = line_dedup(docs, removed_col="lines_removed")
    size = F.when(F.col("lines_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("bigint")
    return edited.withColumn("n_chars", size).select(docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, MIX_WEIGHTS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("ngram_jaccard", ngram_jaccard), ("mixing", mixing), ("packing", packing)]

#: the classifier and the packing have no SQL form; brute-force versions test the stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
