"""Merging associations and uploads into result components."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ops import keep_first, null_safe_join, union_fill

_VALUES = ("beta", "se", "p", "eaf", "imputed")


def merge_associations(rows: DataFrame | None, associations: DataFrame | None, order: str = "ord", keys_first: bool = False) -> DataFrame | None:
    """Left join on (study_id, variant_id), first association of a key, null keys equal. Without keys or sides: unchanged.

    With `keys_first` the associations are cut to the rows' keys before the first of each is looked for: for rows that have few of them.
    """
    keys = ["study_id", "variant_id"]
    if rows is None or associations is None or not set(keys) <= set(associations.columns):
        return rows
    if keys_first:
        associations = null_safe_join(associations, rows.select(*keys).distinct(), keys, "left_semi")
    first = keep_first(associations, keys, [order]).select(*keys, *(c for c in _VALUES if c in associations.columns))
    return null_safe_join(rows, first, keys)


def merge_upload_associations(rows: DataFrame | None, associations: DataFrame | None, order: str = "ord") -> DataFrame | None:
    """Rows with study_id join on it; else rows with existing_study_id join on that; the rest stay without values.

    A part whose key column the associations lack is dropped. If they lack both, the rows without either id are what is left; only if
    there are none, all rows come back as they are.
    """
    if rows is None or associations is None:
        return rows
    values = [c for c in _VALUES if c in associations.columns]
    parts = []
    has_study, has_existing = F.col("study_id").isNotNull(), F.col("existing_study_id").isNotNull()
    neither = rows.filter(~has_study & ~has_existing)
    for key, cond in (("study_id", has_study), ("existing_study_id", ~has_study & has_existing)):
        if key in associations.columns and "variant_id" in associations.columns:
            first = keep_first(associations, [key, "variant_id"], [order]).select(key, "variant_id", *values)
            parts.append(null_safe_join(rows.filter(cond), first, [key, "variant_id"]))
    if not parts:
        some = neither.agg((F.count(F.lit(1)) > 0).alias("_any"))  # one row
        return rows.crossJoin(F.broadcast(some)).filter(~F.col("_any") | (~has_study & ~has_existing)).drop("_any")
    return union_fill(*parts, neither)


def merge_trait_result(base: DataFrame | None, upload: DataFrame | None) -> DataFrame | None:
    """Upload rows appended, columns filled with null on either side; an absent side leaves the other."""
    if base is None or upload is None:
        return upload if base is None else base
    return union_fill(base, upload)
