"""Result bundles as JSON documents: each holds rows of some of its tables, nested; one scan gives all tables.

    {"trait_id": 5, "coloc_groups": [{...}, ...]}
    {"trait_id": 5, "study_extractions": [{...}, ...]}

A document has at most ROWS rows, so that a subject of many rows is many documents.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.ops import union_fill
from ..storage import fresh_path

ROWS = 1000
_BAD = "_bad"


@dataclass(frozen=True)
class Envelopes:
    """Tables by name, and `bad`: file and text of every document that is no JSON or does not fit the tables' schemas."""

    tables: dict[str, DataFrame]
    bad: DataFrame


def write_envelopes(tables: Mapping[str, DataFrame], path: str, key: str, rows: int = ROWS, compression: str = "none") -> None:
    """Documents of the rows of one subject each (the column `key`, which may be null); nulls are left out of them. Names and texts that
    rows repeat make up most of them, so that large ones are better compressed (`compression` as Spark names it)."""
    parts = []
    for name, df in tables.items():
        packed = df.select(F.col(key).alias("_key"), F.struct("*").alias("_row"), F.floor(F.monotonically_increasing_id() / rows).alias("_pack"))
        parts.append(packed.groupBy("_key", "_pack").agg(F.collect_list("_row").alias(name)).select(F.col("_key").alias(key), name))
    union_fill(*parts).write.option("compression", compression).json(path)


def read_envelopes(spark: SparkSession, path: str, schemas: Mapping[str, T.StructType]) -> Envelopes:
    """The tables of documents, one JSON text a line. They are parsed once: what a table is made of is read from the shared folder.

    A field that a schema does not name is left out, one that a document does not have is null. A document of which any part does not fit
    gives no rows and is kept in `bad`; an empty line is none.
    """
    fields = [T.StructField(n, T.ArrayType(s)) for n, s in schemas.items()]
    parsed = spark.read.schema(T.StructType([*fields, T.StructField(_BAD, T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD).json(path)
    at = fresh_path(spark, "envelopes")
    parsed.withColumn("_file", F.col("_metadata.file_path")).write.option("compression", "zstd").parquet(at)
    parsed = spark.read.parquet(at)
    good = parsed.filter(F.col(_BAD).isNull())
    tables = {n: good.select(F.inline(n)) for n in schemas}
    return Envelopes(tables, parsed.filter(F.col(_BAD).isNotNull()).select(F.col("_file").alias("file"), F.col(_BAD).alias("text")))
