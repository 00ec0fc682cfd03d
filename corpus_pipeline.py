"""A corpus pipeline: toxicity, language, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the
last return the columns of documents; the last returns a row for each piece of a packed document.

Defined results of all stages: columns besides id, text and language may have any name and may be null; a table
without rows gives one without rows; rows are told apart by themselves, so an id may be null or repeated; texts are read
whole, whatever their length. What a stage does with null and empty texts, ties and rows that repeat is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, language, minhash, packing, toxicity
from lodestone.llm.common import apart, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores 0.5 or more go.

    Null and empty texts have the score of the bias, so they go only where most labels are toxic; of texts that share an id, that
    of the least hash is learned from; rows that repeat are scored one by one. Without labels nothing goes.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, null and empty ones included, or whose most likely language is more likely wrong than right, go.

    Of equally likely languages the first in order counts; without any language to learn from, all go.
    """
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more over five words, that of the smallest id stays.

    A null id counts as larger than all others, equal ids go by their texts' hashes; rows that repeat id and text are one document;
    null and empty texts link with nothing.
    """
    return minhash.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut out; documents of which more than half the words are such passages go.

    Null and empty texts have no words and stay; ``n_chars`` is that of the text left; without items all stays as it is.
    """
    kept = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents laid out along a Hilbert curve in sequences of 4096 tokens.

    Null and empty texts are an end token; equal keys go by row; rows that repeat are packed one by one.
    """
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_identified),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: Fitted models, signatures and a tokenizer have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = apart(spark)  # the caller's session keeps its settings
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
