"""Joins by position: overlapping intervals, and the last start at or before a place. Neither is planned as a nested loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ops import union_fill

#: Bits by which the bins of one size class are wider than those of the class below.
_BITS = 3


def _classed(df: DataFrame, side: str, key: str, start: str, stop: str) -> DataFrame:
    """The rows as one struct, with key, ends, and the size class: the first whose bins are at least as wide as the interval."""
    out = df.filter(F.col(key).isNotNull() & (F.col(start) <= F.col(stop)) & (F.col(start) >= 0)).select(F.struct("*").alias(side), F.col(key).alias("_key"), F.col(start).cast("bigint").alias("_from"), F.col(stop).cast("bigint").alias("_to"))
    size = F.col("_to") - F.col("_from")
    return out.withColumn("_class", F.when(size == 0, 0).otherwise(F.ceil(F.length(F.bin(size)) / _BITS)).cast("int"))


def _binned(df: DataFrame, side: str, classes: Column) -> DataFrame:
    """A row for each bin that an interval touches in each of the size classes; these are not below its own, so that it touches two at most."""
    out = df.withColumn("_level", F.explode(classes))
    width = F.pow(F.lit(2), F.col("_level") * _BITS).cast("bigint")
    first, last = F.floor(F.col("_from") / width).cast("bigint"), F.floor(F.col("_to") / width).cast("bigint")
    return out.withColumn(f"_first_{side}", first).select("_key", "_level", F.explode(F.sequence(first, last)).alias("_bin"), f"_first_{side}", side, F.col("_from").alias(f"_from_{side}"), F.col("_to").alias(f"_to_{side}"))


def overlaps(left: DataFrame, right: DataFrame, key: str = "chr", start: str = "start_bp", stop: str = "stop_bp") -> DataFrame:
    """Pairs (`left`, `right`: structs of the rows) of intervals of one key that share a place, both ends included; each pair once.

    Intervals are of size classes, each with bins eight times as wide as those of the class below. Two intervals meet in the class of the
    larger one, in the first bin that both touch: the larger one is in two bins at most, and the smaller one is copied to those classes
    only that the other side has. A row with a null key or end, a negative start or a stop before its start overlaps nothing; rows that
    repeat are intervals of their own.
    """
    a, b = _classed(left, "left", key, start, stop), _classed(right, "right", key, start, stop)
    seen = lambda df: F.broadcast(df.agg(F.collect_set("_class").alias("_classes")))  # one row of a few classes
    not_below = lambda least: F.filter("_classes", lambda c: c >= least)
    own = lambda df, side: _binned(df, side, F.array("_class"))
    pairs = (
        (own(a, "left"), _binned(b.crossJoin(seen(a)), "right", not_below(F.col("_class")))),  # the left one is the larger, or as large
        (_binned(a.crossJoin(seen(b)), "left", not_below(F.col("_class") + 1)), own(b, "right")),
    )
    met = [x.join(y, ["_key", "_level", "_bin"]) for x, y in pairs]
    hit = (F.col("_bin") == F.greatest("_first_left", "_first_right")) & (F.col("_from_left") <= F.col("_to_right")) & (F.col("_from_right") <= F.col("_to_left"))
    return met[0].filter(hit).select("left", "right").unionByName(met[1].filter(hit).select("left", "right"))


def as_of(rows: DataFrame, starts: DataFrame, key: str, at: str, start: str, values: Sequence[str], width: int = 1 << 20, parts: int = 16) -> DataFrame:
    """Every row with the `values` of the last start at or before its place on its key, null where there is none.

    Places are cut into bins of `width`; a bin's rows are dealt into `parts`, and each part gets the starts inside the bin and the last
    one before it, which is found among bins alone. So neither a long key nor a place that many rows share is one task. Of equal starts
    the one with the largest values counts. Rows with a null key or place have none. `starts` may be of any number.
    """
    bin_of = lambda c: F.floor(F.col(c) / width).cast("bigint")
    asked = rows.withColumns({"_key": F.col(key), "_bin": bin_of(at), "_at": F.col(at).cast("bigint"), "_tag": F.lit(2), "_part": F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")})
    known = starts.filter(F.col(key).isNotNull() & F.col(start).isNotNull()).select(F.col(key).alias("_key"), bin_of(start).alias("_bin"), F.struct(F.col(start).cast("bigint").alias("_s"), *values).alias("_v"))
    bins = union_fill(known, asked.select("_key", "_bin").distinct()).groupBy("_key", "_bin").agg(F.max("_v").alias("_v"))
    past = Window.partitionBy("_key").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # a row a bin
    carried = bins.select("_key", "_bin", F.last("_v", ignorenulls=True).over(past).alias("_v")).filter("_v is not null and _key is not null")
    each = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part")
    before = carried.select("_key", "_bin", "_v", (F.col("_bin") * width).alias("_at"), F.lit(0).alias("_tag"), each)
    inside = known.select("_key", "_bin", "_v", F.col("_v._s").alias("_at"), F.lit(1).alias("_tag"), each)
    w = Window.partitionBy("_key", "_bin", "_part").orderBy("_at", "_tag", "_v").rowsBetween(Window.unboundedPreceding, 0)
    out = union_fill(asked, before, inside).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_tag = 2")
    return out.select(*rows.columns, *(F.when(F.col("_at").isNotNull(), F.col(f"_v.{v}")).alias(v) for v in values))
