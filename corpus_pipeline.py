"""A corpus pipeline of the library's operators, each stage written as Parquet and read again by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of
``documents`` for all but the last, which returns the packed sequences. Rows are never sampled or capped.

Defined results: documents without text or without a letter go in the first stage; empty tables give empty ones; very long texts are taken whole; rows equal in
id and text are one document for the two stages of copies; columns beyond those of ``documents`` come through as they are, whatever their names. A stage's folder
is deleted once the next stage's is written; the last one stays until the caller has read the result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, langid, lines, packing
from tessera.llm._tables import delete_folder, shared_folder, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined: neither without letters nor flagged as ambiguous."""
    return langid.determined(docs, langid.train_on(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line repeats; n_chars follows the text."""
    kept = lines.drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles.

    SimHash fingerprints in BK-trees nominate what is compared, and MinHash bands what they miss.
    """
    return jaccard.one_of_each(docs, shingle=5, least=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), window=10)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return packing.pack(docs, capacity=2048)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express these stages; the tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage, over the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus_pipeline-{uuid.uuid4().hex}"
    last = None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
            if last:  # read to its end; the last stage, which is not run yet, reads only the folder just written
                delete_folder(spark, last)
            last = f"{folder}/{i}-{name}"
    return docs
