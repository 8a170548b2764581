"""Corpus pipeline: language ID, line dedup, near-dedup, packing. Part of the llm subpackage, which it needs.

Every stage reads the columns of documents by name, whatever others there are, and gives the same columns, the last one the places of
pieces. Nulls in any column, empty and very long texts, repeated rows and empty tables are allowed in all; what becomes of them is said
at each stage. A null language or source, or number of characters, stays as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lociflow.llm import language_id, line_dedup, minhash_dedup, packing
from lociflow.llm.queries import vocabulary
from lociflow.llm.shared import delete, fresh_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier does not reject, unchanged; `lang` stays as it came.

    Null texts and texts without a letter, empty ones among them, are rejected. Learned is from labelled documents whose crc32(doc_id)
    mod 3 is not 1, a null id being one of them, as in op7. Repeated rows get one answer. If nothing is labelled, all goes.
    """
    learn = docs.filter(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(True)))
    named = language_id.identify(docs.select(*COLUMNS), language_id.fit(learn))
    return named.filter(~F.col("rejected")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines, and `n_chars` of what is left; a document that loses all its lines to others goes.

    Null and empty texts stay (their n_chars is null and 0), and so does a row with a null id, whose lines count nowhere. Of rows that repeat an id all lose the same lines.
    """
    out = line_dedup.line_dedup(docs.select(*COLUMNS))
    out = out.filter(~F.coalesce((F.col("n_dropped") > 0) & (F.trim("text") == ""), F.lit(False)))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, by row: that of the smallest id, null ids last; of equal rows one.

    Classes are of texts: two texts under one id are two documents. Null and blank texts are no one's duplicates and stay.
    """
    return minhash_dedup.one_of_each(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the pieces of what is left in sequences of 2048 tokens. Null and empty texts are one piece of an end id; rows that repeat
    an id are documents of their own."""
    return packing.best_fit_packing(docs, vocabulary("word_bpe_49k.json").decode())


STAGES = [("language_id", language), ("line_dedup", lines), ("minhash_near_dedup", near), ("best_fit_packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. Each stage's result is written to the shared folder and read again; it is deleted when the next one's
    is written, and the last one's is the caller's to delete."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = fresh_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
