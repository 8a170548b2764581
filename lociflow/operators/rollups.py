"""Counts of different values by trait and gene, kept up to date by new rows alone.

The state is the set of different (kind, subject, metric, value); it is exact, and two states are put together by what one has and the
other has not. Adding rows deals their entries once, together with what is known of their subjects, appends those that are new and adds
their counts to the counts. Kinds are kept apart, so that an entry is numbers: a subject, the metric's place in METRICS and a value. A
file of the state is in the order of subjects: the smallest and largest new one cut the scan of what is known.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import file_system, replace_text
from .ops import union_fill

#: Metrics with the table and the column whose different values they count.
METRICS = {"num_study_extractions": ("study_extractions", "id"), "num_coloc_groups": ("coloc_groups", "coloc_group_id"), "num_coloc_studies": ("coloc_groups", "study_id"), "num_rare": ("rare_results", "rare_result_group_id")}
#: Kinds of subjects with the column that names them; a subject is text.
KINDS = {"trait": "trait_id", "gene": "gene_id", "symbol": "gene"}
#: Types of the subjects in the store's state, and parts in which the values of one subject are dealt.
TYPES, PARTS = {"trait": "bigint", "gene": "bigint", "symbol": "string"}, 16
COUNTS = "kind string, subject string, " + ", ".join(f"{m} bigint" for m in METRICS)


def state_of(tables: dict[str, DataFrame]) -> DataFrame:
    """The different values of every metric by subject, of some of the tables of METRICS; null subjects and values are none."""
    parts = []
    for name in tables:
        values = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(c).cast("bigint").alias("value")) for m, (t, c) in METRICS.items() if t == name))
        subjects = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("subject")) for k, c in KINDS.items()))
        parts.append(tables[name].select(subjects.alias("_s"), F.inline(values)).select(F.inline("_s"), "metric", "value"))
    keys = ["kind", "subject", "metric", "value"]
    found = union_fill(*parts).filter("subject is not null and value is not null").select(*keys)
    return found.repartition(*keys).distinct()  # dealt first: most values differ, and a task's share of them before that fits no memory


def counts_of(state: DataFrame) -> DataFrame:
    """A row a subject with the count of each metric, 0 where it has no value."""
    return state.groupBy("kind", "subject").agg(*(F.count(F.when(F.col("metric") == m, 1)).alias(m) for m in METRICS))


def counts_of_kind(kind: str, tables: dict[str, DataFrame]) -> DataFrame:
    """`counts_of(state_of(tables))` for the subjects of one kind. Entries are dealt as numbers, where the column is one, and name no kind."""
    each = entries_of_kind(kind, tables).repartition("_s", "_m", "_v").distinct()  # dealt first, as in state_of
    counts = each.groupBy("_s").agg(*(F.count(F.when(F.col("_m") == i, 1)).alias(m) for i, m in enumerate(METRICS)))
    return counts.select(F.lit(kind).alias("kind"), F.col("_s").cast("string").alias("subject"), *METRICS)


def entries_of_kind(kind: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Subject, number of the metric and value, of all rows; null subjects and values are none."""
    parts = []
    for name, df in tables.items():
        values = F.array(*(F.struct(F.lit(i).cast("tinyint").alias("_m"), F.col(c).cast("bigint").alias("_v")) for i, (t, c) in enumerate(METRICS.values()) if t == name))
        parts.append(df.select(F.col(KINDS[kind]).alias("_s"), F.inline(values)))
    return union_fill(*parts).filter("_s is not null and _v is not null")


class RollupStore:
    """State and counts under a shared folder; a version is seen when the manifest names it, which is written last."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _manifest(self) -> dict:
        fs, at = file_system(self.spark, f"{self.root}/manifest.json")
        if not fs.exists(at):
            return {"version": 0, "state": []}
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.root}/manifest.json").first()[0])

    def _state(self, kind: str, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(f"_s {TYPES[kind]}, _m tinyint, _v bigint").parquet(*(f"{self.root}/{f}/{kind}" for f in folders))

    def counts(self) -> DataFrame:
        m = self._manifest()
        return self.spark.read.schema(COUNTS).parquet(f"{self.root}/counts-{m['version']}") if m["version"] else self.spark.createDataFrame([], COUNTS)

    def add(self, tables: dict[str, DataFrame]) -> None:
        """Takes new rows in. Rows that are there already change nothing; a failure leaves the version before it."""
        m = self._manifest()
        version = m["version"] + 1
        folder, fresh = f"state-{version}", []
        for kind in KINDS:
            new = entries_of_kind(kind, tables).withColumn("_s", F.col("_s").cast(TYPES[kind]))
            both = new.withColumn("_known", F.lit(False))
            if m["state"]:
                low, high = (new.agg(f("_s")).scalar() for f in (F.min, F.max))
                both = both.unionByName(self._state(kind, m["state"]).filter(F.col("_s").between(low, high)).withColumn("_known", F.lit(True)))
            dealt = both.withColumn("_p", F.pmod(F.hash("_v"), F.lit(PARTS)).cast("tinyint")).repartition("_s", "_p")  # a subject is no single task
            found = dealt.groupBy("_s", "_p", "_m", "_v").agg(F.max("_known").alias("_known")).filter(~F.col("_known"))
            self._written(found.select("_s", "_m", "_v").sortWithinPartitions("_s", "_m", "_v"), f"{folder}/{kind}")
            counts = self._state(kind, [folder]).groupBy("_s").agg(*(F.count(F.when(F.col("_m") == i, 1)).alias(c) for i, c in enumerate(METRICS)))
            fresh.append(counts.select(F.lit(kind).alias("kind"), F.col("_s").cast("string").alias("subject"), *METRICS))
        self._written(union_fill(self.counts(), *fresh).groupBy("kind", "subject").agg(*(F.sum(c).alias(c) for c in METRICS)), f"counts-{version}")
        replace_text(self.spark, f"{self.root}/manifest.json", json.dumps({"version": version, "state": [*m["state"], folder]}))

    def _written(self, df: DataFrame, folder: str) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{folder}")  # what a failed attempt at this version left
