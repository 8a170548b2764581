"""Relational building blocks whose meaning differs from the plain SQL operator of the same name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in `order` (a total order, not the order of arrival); null keys form a group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join where null matches null; keys come from the left side, clashing names of the right side are dropped."""
    r = right.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *(c for c in right.columns if c not in keys and c not in left.columns))
    cond = [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]
    out = left.join(r, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*(f"_r_{k}" for k in keys))


def members(df: DataFrame, key: str, of: DataFrame, of_key: str | None = None, negate: bool = False) -> DataFrame:
    """Rows whose key is (not) in a column of another frame; null is a value like any other."""
    side = of.select(F.col(of_key or key).alias("_m")).distinct()
    return df.join(side, df[key].eqNullSafe(side["_m"]), "left_anti" if negate else "left_semi")


def solo_filter(df: DataFrame, key: str, least: int = 2, keep_null: bool = False) -> DataFrame:
    """Drops groups of fewer than `least` rows; rows of a null key are a group that is counted but never gathered, or all stay."""
    many = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(key)
    if not keep_null:
        return null_safe_join(df, many, [key], "left_semi")
    return df.filter(F.col(key).isNotNull()).join(many, key, "left_semi").select(df.columns).unionByName(df.filter(F.col(key).isNull()))


def closure(df: DataFrame, group: str, seed: Column) -> DataFrame:
    """All rows of every group with at least one row that satisfies `seed`."""
    ids = df.filter(seed & F.col(group).isNotNull()).select(F.col(group).alias("_g")).distinct()
    return df.join(ids, df[group] == ids["_g"], "left_semi")


def between_ids(df: DataFrame, column: str, ids: DataFrame, id_column: str) -> DataFrame:
    """Rows whose column is among the ids. The smallest and largest id are known before the files are read, so that a table in the order of
    the column is read around them only; null is never among them."""
    low, high = (ids.agg(f(id_column)).scalar() for f in (F.min, F.max))
    side = ids.select(F.col(id_column).alias("_m")).distinct()
    return df.filter(F.col(column).between(low, high)).join(side, F.col(column) == F.col("_m"), "left_semi")


def lead_per_group(df: DataFrame, keys: Sequence[str], by: Sequence[Column | str]) -> DataFrame:
    """One row per key: the smallest by `by`, nulls last."""
    return keep_first(df, keys, [F.asc_nulls_last(c) if isinstance(c, str) else c for c in by])


def mark_first(df: DataFrame, keys: Sequence[str], by: Sequence[str], name: str, parts: int = 64) -> DataFrame:
    """A column `name` that is true for one row of each key, the smallest by `by`, nulls last; of rows equal in all of these, for any one.

    Rows of a key are ranked in parts, and the first of each part against each other, so that a key of many rows is not one task. A row
    with a null key is never first.
    """
    order = [F.asc_nulls_last(c) for c in by]
    spread = df.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int"))
    spread = spread.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    spread = spread.withColumn("_part", F.when(F.col("_rn") == 1, -1).otherwise(F.col("_part")))
    first = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_rn", *order)) == 1
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return spread.withColumn(name, known & (F.col("_part") == -1) & first).drop("_part", "_rn")


def n_distinct_na(c: str) -> Column:
    """Distinct values where null counts as a value."""
    return F.countDistinct(c) + F.max(F.when(F.col(c).isNull(), 1).otherwise(0))


def distinct_counts(keys: Sequence[str], *parts: tuple[DataFrame, dict[str, str]]) -> DataFrame:
    """Per key the number of different non-null values: each part is a frame and {column: name of its count}, all columns of one type.

    Values of all parts are made distinct together, map-side first, and counted after one more shuffle; a key without a value has no row.
    """
    names = [n for _, of in parts for n in of.values()]
    items = lambda of: F.array(*(F.struct(F.lit(names.index(n)).alias("_k"), F.col(c).alias("_v")) for c, n in of.items()))
    long = union_fill(*(df.select(*keys, F.inline(items(of))) for df, of in parts))
    each = long.filter("_v is not null").distinct()
    return each.groupBy(*keys).agg(*(F.count(F.when(F.col("_k") == i, 1)).alias(n) for i, n in enumerate(names)))


def union_fill(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def unpivot_ordered(df: DataFrame, ids: Sequence[str], metrics: Sequence[tuple[str, str]], name: str, value: str) -> DataFrame:
    """Wide to long; `metrics` lists (column, label), and `<name>_ord` keeps the order of the labels."""
    cols = [F.col(c).cast("double").alias(label) for c, label in metrics]
    order = F.create_map(*[F.lit(x) for i, (_, label) in enumerate(metrics, 1) for x in (label, i)])
    return df.select(*ids, *cols).unpivot(list(ids), [f"`{label}`" for _, label in metrics], name, value).withColumn(f"{name}_ord", order[F.col(name)])
