"""The shared folder of the cluster, and tables that cut lineage there."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import fresh_path

#: Keys that more than 1 in HUBS rows have are hot: fewer than HUBS, by their share.
HUBS = 4096


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The frame as a written table of the shared folder, reread; its path, for `delete`."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def hot_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, str]:
    """Inner join of a written table with one whose keys are unique, and the path of a table that it reads, for `delete`.

    The rows of `right` that hot keys of `left` need are broadcast, fewer than HUBS; the other keys are joined by a shuffle. So the rows of
    a key that a third of all rows have stay where they are.
    """
    most = left.count() / HUBS
    hot, path = written(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > most).select(*keys), "hot")
    plain = left.join(F.broadcast(hot), list(keys), "left_anti").join(right, list(keys))
    return plain.unionByName(left.join(F.broadcast(right.join(F.broadcast(hot), list(keys), "left_semi")), list(keys))), path


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that `df` does not have, in any case."""
    have, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


#: Bytes of texts that a Python worker gets at once, where the session has Spark's own default.
BATCH, _BATCH_KEY, _BATCH_DEFAULT = "8m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """Keeps the batches of whole texts small; a setting of the caller's own stays."""
    if spark.conf.get(_BATCH_KEY, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, BATCH)


_MEMORIES: dict[str, Callable[[], None]] = {}
_USER = [""]


def memory(name: str, clear: Callable[[], None]) -> None:
    """Says how to empty what an operator's functions remember in a Python worker between tasks."""
    _MEMORIES[name] = clear


def uses_worker(name: str) -> None:
    """To be called where a function of the operator begins: a worker that another one used before forgets that one's memory first, so
    that it holds one at a time, however many operators a job has."""
    if _USER[0] != name:
        _USER[0] = name
        for other, clear in _MEMORIES.items():
            if other != name:
                clear()
        import pyarrow

        pyarrow.default_memory_pool().release_unused()
