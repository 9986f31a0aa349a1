"""From raw documents to packed training sequences, a stage for each of five operators.

Each stage works on all that the one before it kept, and its decisions take effect. All but the last return
the columns of documents.

Defined results: a null or empty text, and one without a letter, goes at the first stage; a text in none of the
labelled languages goes there too, and without any labelled text all others stay; rows without an id are never near
copies, and of equal texts they go first; repeated rows are exact copies, of which one stays; equal originals are
told apart by the smaller id; very long texts are read whole, masked and cut into pieces; an empty table gives no
rows; further columns, whatever their names, are kept up to the last stage, and of columns with one name the first
is the one that is read; a table without n_chars is not given one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelsieve.llm import exact_dedup, jaccard_join, language_id, packing, secrets
from pixelsieve.llm.common import read, table_folder, unique_names


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in none of the languages that the labelled documents have."""
    prototypes, bounds = language_id.learn(docs)
    return language_id.keep_known(docs, prototypes, bounds=bounds)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the longest original stays, then the smallest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more of their five-word shingles, the smallest id stays."""
    return jaccard_join.drop_near_duplicates(docs, k=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows the masked text. No document goes."""
    named, restore = unique_names(secrets.redact(docs))
    if "n_chars" in named.columns:
        length = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
        named = named.withColumn("n_chars", length.cast(named.schema["n_chars"].dataType))
    return restore(named)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("language", language), ("exact", exact), ("near", near), ("secrets", secret_scan), ("packed", packed)]

#: Language identification and packing can't be said in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage returns is written as Parquet to the shared checkpoint folder and
    read again, so that a lost executor costs no earlier stage."""
    folder = table_folder(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
